import numpy as np

from figmill.operators import masks, pipeline


def test_figure_annotations(spark):
    d = [("f", p, i, 0, 0.9, 10 * i, 0, 10 * i + 4, 4) for i, p in enumerate("pqrst")] + [("g", "x", 0, 0, 0.9, 40, 40, 60, 60), ("h", "y", 0, 0, 0.9, 0, 0, 9, 9)]
    dets = spark.createDataFrame(d, "figure_id string, panel string, row_no int, class_id int, conf double, x1 int, y1 int, x2 int, y2 int")
    m = spark.createDataFrame([("f", "p", "q"), ("f", "s", "t"), ("f", "t", "r"), ("g", "x", "x2"), ("f", "q", "q")], "figure_id string, a string, b string")
    runs = masks.runs_of_boxes(dets, ["figure_id", "panel"], 100)
    got = {r.figure_id: (r.kind, r.annotation) for r in pipeline.figure_annotations(dets, m, runs, w=100, h=100).collect()}
    assert got["g"] == ("compound_single", "authentic") and got["h"] == ("simple", "authentic") and got["f"][0] == "compound_multi"
    one, two = got["f"][1].split(";")
    assert one.startswith("[2001,4") and two.startswith("[1,4") and one.count(",") == 2 * 12 - 1 and two.count(",") == 2 * 8 - 1


def test_fusion_and_statistics(spark):
    run = lambda a: [(int(s), 1) for s in np.flatnonzero(a.T.ravel())]
    a, b, c = np.zeros((3, 20, 20), bool)
    a[2:8, 2:8], b[4:9, 4:9], c[14:19, 14:19] = True, True, True
    df = spark.createDataFrame([("f", "inter", 1, run(a)), ("f", "intra", 1, run(b)), ("f", "intra", 2, run(c)), ("e", "intra", 1, run(c))], "figure_id string, origin string, mask_no int, runs array<struct<start:long,len:long>>")
    got = {(r.figure_id, r.mask_no): sum(x["len"] for x in r.runs) for r in pipeline.fuse_figures(df, 20, 20).collect()}
    assert got == {("f", 1): (a | b).sum(), ("f", 2): 25, ("e", 1): 25}
    st = spark.createDataFrame([("p", 1, run(a | c))], "path string, mask_no int, runs array<struct<start:long,len:long>>")
    s = pipeline.instance_statistics(st, 20, 20).first()
    assert (s.pixels, s.regions, s.boundary) == (61, 2, 20 + 16)


def test_annotations_of_boxes_equal_those_of_runs(spark):
    rng = np.random.default_rng(6)
    d = [(f, f"p{i}", i, 0, 0.9, int(x), int(y), int(x) + 9, int(y) + 7) for f in "fgh" for i, (x, y) in enumerate(rng.integers(0, 60, (12, 2)))]
    dets = spark.createDataFrame(d, "figure_id string, panel string, row_no int, class_id int, conf double, x1 int, y1 int, x2 int, y2 int")
    m = spark.createDataFrame([(f, f"p{a}", f"p{b}") for f in "fg" for a, b in rng.integers(0, 12, (7, 2)).tolist()], "figure_id string, a string, b string")
    want = pipeline.figure_annotations(dets, m, masks.runs_of_boxes(dets, ["figure_id", "panel"], 100), w=80, h=80)
    got = pipeline.box_annotations(dets, m, dets.select("figure_id", "panel", "x1", "y1", "x2", "y2"), 100, w=80, h=80)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
