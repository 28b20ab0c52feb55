import json

import numpy as np
import pytest

from figmill.operators import masks as M
from figmill.plans import reference_queries as R

BOXES = "figure_id string, class_id int, x1 int, y1 int, x2 int, y2 int"


def test_masks_of_boxes_against_dense(spark):
    rng = np.random.default_rng(4)
    rows = [("f", int(k), *(int(v) for v in (x, y, x + w, y + h))) for k, x, y, w, h in zip(rng.integers(0, 4, 60), rng.integers(0, 40, 60), rng.integers(0, 30, 60), rng.integers(-1, 15, 60), rng.integers(-1, 9, 60))]
    got = {r.class_id: r.runs for r in M.masks_of_boxes(spark.createDataFrame(rows, BOXES), ["figure_id", "class_id"], 50).collect()}
    for k in range(4):
        want, mine = np.zeros((2, 60 * 50), bool)
        for _, c, x1, y1, x2, y2 in rows:
            if c == k:
                for x in range(x1, x2):
                    want[x * 50 + y1:x * 50 + max(y1, y2)] = True
        for s, n in got[k]:
            assert not mine[s:s + n].any()
            mine[s:s + n] = True
        assert (mine == want).all() and len(got[k]) == (np.diff(np.concatenate(([0], want.view(np.int8)))) == 1).sum()
    with pytest.raises(Exception, match="reaches the height"):
        M.masks_of_boxes(spark.createDataFrame([("f", 1, 0, 0, 5, 50)], BOXES), ["figure_id"], 50).collect()


def test_annotations_are_pixels(spark, tmp_path):
    # thinner than a cell, and below the figure's height
    spark.createDataFrame([("f", 1, 3, 5, 5, 9), ("f", 2, 17, 1590, 18, 1700)], BOXES).write.parquet(f"{tmp_path}/detections.parquet")
    h = R.MASK_HEIGHT
    got = R.ref_annotations(spark, str(tmp_path)).first().annotation
    assert [json.loads(t) for t in got.split(";")] == [[3 * h + 6, 4, 4 * h + 6, 4], [17 * h + 1591, 110]]


def test_pipeline_annotations_are_pixels(spark, tmp_path):
    dets = [(i, "f", f"p{i}::cls=a", 0, 0.9, 100 * i + 3, 7, 100 * i + 5, 9) for i in range(3)]
    spark.createDataFrame(dets, "row_no int, figure_id string, panel_uid string, class_id int, conf double, x1 int, y1 int, x2 int, y2 int").write.parquet(f"{tmp_path}/detections.parquet")
    spark.createDataFrame([("f", "p0::cls=a", "p2::cls=a", True)], "figure_id string, panel_a string, panel_b string, is_match boolean").write.parquet(f"{tmp_path}/pair_matches.parquet")
    got = R.ref_pipeline(spark, str(tmp_path)).first()
    h = R.MASK_HEIGHT
    assert got.kind == "compound_multi" and json.loads(got.annotation) == [v for x in (3, 4, 203, 204) for v in (x * h + 8, 2)]
