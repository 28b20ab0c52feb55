"""Limits, best panels and pairs where one image has very many boxes, against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from figmill.operators import boxes as B
from figmill.operators import candidates, dataset, detections


def boxes(n=420, seed=7):
    rng = np.random.default_rng(seed)
    x, y, w, h = rng.integers(0, 400, n), rng.integers(0, 300, n), rng.integers(-3, 60, n), rng.integers(-3, 60, n)
    return [("f" if i % 3 else f"g{i % 40}", i, i % 2, *(int(v) for v in b)) for i, b in enumerate(zip(x, y, x + w, y + h))]


@pytest.fixture
def dets(spark):
    return spark.createDataFrame(boxes(), "figure_id string, row_no int, class_id int, x1 int, y1 int, x2 int, y2 int").repartition(3)


def test_context_limits_without_pairs(dets):
    want = {}
    for f, r, _, x1, y1, x2, y2 in boxes():
        near = [o[3:] for o in boxes() if o[0] == f]
        beside, above = ([o for o in near if min(hi, o[k + 2]) > max(lo, o[k])] for k, lo, hi in ((1, y1, y2), (0, x1, x2)))
        want[r] = (max([o[2] + 4.0 for o in beside if o[2] <= x1], default=0.0), max([o[3] + 4.0 for o in above if o[3] <= y1], default=0.0),
                   min([o[0] - 4.0 for o in beside if o[0] >= x2], default=float("inf")), min([o[1] - 4.0 for o in above if o[1] >= y2], default=float("inf")))
    df = detections.context_limits(dets, "figure_id", gap=4)
    assert "Join" not in df._jdf.queryExecution().toString()
    assert {r.row_no: tuple(r)[2:] for r in df.collect()} == want


@pytest.mark.parametrize("pairs", [1 << 30, 1_000])
def test_best_panel_of_many(dets, monkeypatch, pairs):
    monkeypatch.setattr(dataset, "PAIRS", pairs)
    want = {}
    for f, r, k, *a in boxes():
        if k or a[2] <= a[0] or a[3] <= a[1]:
            continue
        at = [(max(0, min(a[2], o[5]) - max(a[0], o[3])) * max(0, min(a[3], o[6]) - max(a[1], o[4])), -o[1]) for o in boxes() if o[0] == f and o[2] and o[5] > o[3] and o[6] > o[4]]
        common, panel = max(at, default=(0, 0))
        if common and common / ((a[2] - a[0]) * (a[3] - a[1])) >= 0.2:
            want[r] = (f, -panel, common / ((a[2] - a[0]) * (a[3] - a[1])))
    parts, panels = dets.where("class_id = 0").withColumn("part", F.col("row_no")), dets.where("class_id = 1").withColumn("panel", F.col("row_no"))
    got = dataset.best_panel(parts, panels, "figure_id", "part", "panel")
    assert got.columns == ["figure_id", "part", "panel", "share"] and {r.part: (r.figure_id, r.panel, r.share) for r in got.collect()} == want


def test_best_of_many_in_blocks():
    rng = np.random.default_rng(3)
    x, y, w, h = (rng.integers(a, b, 900).astype(float) for a, b in ((0, 500), (0, 400), (1, 90), (1, 90)))
    box = [x, y, x + w, y + h]
    i, j, top = dataset._best_of_many(box, np.arange(600, 900), np.arange(600), block=32, chunk=50)
    common = dataset._common([v[600:, None] for v in box], [v[:600] for v in box])
    assert dict(zip(i.tolist(), zip(j.tolist(), top.tolist()))) == {600 + p: (int(c.argmax()), c.max()) for p, c in enumerate(common) if c.max() > 0}


def test_pairs_of_a_large_group_in_blocks(spark):
    rows = [("f", 2, f"p{i % 37}") for i in range(50)] + [("g", 2, "a"), ("h", 2, "b"), ("h", 2, "c"), ("h", 2, None)]
    df = spark.createDataFrame(rows, "figure_id string, class_id int, panel_uid string")
    got = [tuple(r) for r in candidates.pairs_in_groups(df, ["figure_id", "class_id"], "panel_uid", block=5).collect()]
    want = {(f, k, a, b) for f, k, a in rows for g, _, b in rows if f == g and a and b and a < b}
    assert len(got) == len(want) and set(got) == want


def test_groups_over_batches(spark):
    import pyarrow as pa

    keys = [None, None, "a", "a", "a", "b", "c", "c", "d"]
    for size in range(1, 10):
        got = list(B.whole_groups((pa.record_batch({"k": pa.array(keys[i:i + size], pa.string())}) for i in range(0, 9, size)), ["k"]))
        assert [k for t, _ in got for k in t.column("k").to_pylist()] == keys
        assert [t.column("k")[s].as_py() for t, starts in got for s in starts.tolist()] == [None, "a", "b", "c", "d"]
