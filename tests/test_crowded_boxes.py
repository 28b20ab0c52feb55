"""Images of very many boxes: cut into pieces, with the results of one piece."""

import json

import numpy as np
import pytest

from figmill.operators import boxes as B
from figmill.operators import masks as M

BOXES = "figure_id string, class_id int, x1 int, y1 int, x2 int, y2 int"


def boxes(n, seed=5):
    rng = np.random.default_rng(seed)
    x, y, w, h = rng.integers(0, 150, n), rng.integers(0, 90, n), rng.integers(-2, 30, n), rng.integers(-2, 8, n)
    return [("f" if i % 3 else f"g{i % 21}", int(i % 2), *(int(v) for v in b)) for i, b in enumerate(zip(x, y, x + w, y + h))]


def dense(rows, height):
    out = {}
    for f, k, x1, y1, x2, y2 in rows:
        if x2 > x1 and y2 > y1:
            out.setdefault((f, k), np.zeros((200, height), bool))[x1:x2, y1:y2] = True
    return out


def runs_of(mask):
    edge = np.diff(np.pad(mask.view(np.int8), ((0, 0), (1, 1))), axis=1)
    x, a = np.nonzero(edge == 1)
    return [(int(i * mask.shape[1] + s), int(e - s)) for i, s, e in zip(x, a, np.nonzero(edge == -1)[1])]


@pytest.mark.parametrize(("many", "few", "runs"), [(50, 10, 100), (10_000, 10, 400_000), (10_000, 10_000, 100)])
def test_masks_and_areas_of_crowded_images(spark, monkeypatch, many, few, runs):
    monkeypatch.setattr(B, "MANY", many), monkeypatch.setattr(B, "FEW", few), monkeypatch.setattr(M, "RUNS", runs), monkeypatch.setattr(M, "TILE", 32)
    rows = boxes(500)
    df, want = spark.createDataFrame(rows, BOXES).repartition(3), dense(rows, 120)
    got = {(r.figure_id, r.class_id): [tuple(x) for x in r.runs] for r in M.masks_of_boxes(df, ["figure_id", "class_id"], 120).collect()}
    assert got == {k: runs_of(m) for k, m in want.items()}
    text = {k: json.dumps([v for s, n in runs_of(m) for v in (s + 1, n)], separators=(",", ":")) for k, m in want.items()}
    assert {(r.figure_id, r.class_id): r.t for r in M.texts_of_boxes(df, ["figure_id", "class_id"], 120).collect()} == text
    cases = sorted({f for f, _ in want})
    assert {r.figure_id: r.annotation for r in M.annotations_of_boxes(df, ["figure_id"], "class_id", 120).collect()} == {f: ";".join(text[f, k] for k in (0, 1) if (f, k) in text) for f in cases}
    area = {f: int(np.any([m for (g, _), m in want.items() if g == f], axis=0).sum()) for f in cases}
    assert {r.figure_id: r.pixels for r in M.area_of_boxes(df, ["figure_id"]).collect()} == area


def test_two_masks_of_a_case_in_one_row(spark):
    rows = boxes(300)
    df, want = spark.createDataFrame(rows, BOXES).repartition(3), dense(rows, 120)
    text = lambda f, k: json.dumps([v for s, n in runs_of(want[f, k]) for v in (s + 1, n)], separators=(",", ":")) if (f, k) in want else None
    got = {r.figure_id: (r.label, r.pred) for r in M.texts_side_by_side(df, ["figure_id"], "class_id", {"label": 0, "pred": 1}, 120).collect()}
    assert got == {f: (text(f, 0), text(f, 1)) for f in {f for f, _ in want}}
