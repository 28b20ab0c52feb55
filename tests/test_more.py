import json

import numpy as np
from pyspark.sql import functions as F

from figmill.functions import text as T
from figmill.operators import detections as D
from figmill.operators import kernels
from figmill.sources import files


def test_names(spark):
    df = spark.createDataFrame([("a/b/fig1.png", 1234, ["q", "p", "p", "r"])], "p string, n int, m array<string>")
    r = df.select(T.output_name(F.col("p"), ".txt", "preserve").alias("a"), T.output_name(F.col("p"), ".txt", "flat").alias("b"), T.output_name(F.col("p"), ".txt", "batch", F.col("n"), 1000).alias("c"), T.digits_for(F.col("n")).alias("d"),
                  T.cadence(F.lit("/data/Weekly/2026"), {"weekly": "Weekly"}).alias("e"), T.cadence(F.lit("/x"), {"weekly": "Weekly"}).alias("f"), T.pairs_in(F.col("m")).alias("g"), T.canonical_hash(F.col("p")).alias("h")).first()
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == ("a/b/fig1.txt", "a__b__fig1.txt", "batch_00001/fig1.txt", 4, "Weekly", "Custom range")
    assert [tuple(x) for x in r.g] == [("p", "q"), ("p", "r"), ("q", "r")] and len(r.h) == 40


def test_manifest_packages_licences(spark, tmp_path):
    rows = [{"kind": "aug_positive", "orig_file": "o", "variant_file": "v"}, {"kind": "aug_positive", "orig_file": "o", "variant_file": "v"}, {"kind": "other", "orig_file": "o", "variant_file": "w"}, {"kind": "aug_positive", "orig_file": "gone", "variant_file": "x"}]
    (tmp_path / "m.jsonl").write_text("\n".join(map(json.dumps, rows)))
    ex = spark.createDataFrame([("o",), ("v",), ("x",)], "path string")
    assert files.read_manifest(spark, str(tmp_path / "m.jsonl")).count() == 2 and [r.variant_file for r in files.read_manifest(spark, str(tmp_path / "m.jsonl"), ex).collect()] == ["v"]
    m = spark.createDataFrame([("p", "a.nxml"), ("p", "b.nxml"), ("q", "z.xml"), ("q", "y.xml"), ("r", "f.jpg")], "path string, member string")
    assert {r.path: (r.xml, r.error is None) for r in files.package_xml(m).collect()} == {"p": ("b.nxml", True), "q": ("y.xml", True), "r": (None, False)}
    x = spark.createDataFrame([(1, '<a xmlns:l="u"><permissions><license license-type="open" l:href="http://cc"><p>Free  use</p></license></permissions></a>'), (2, "<a><permissions>All rights</permissions></a>"), (3, "<a>"), (4, None), (5, "<a/>")], "k long, x string")
    got = {r.k: tuple(r)[1:] for r in files.article_licences(x, "k", "x").collect()}
    assert got == {1: ("open", "http://cc", "Free use"), 2: (None, None, "All rights"), 3: (None,) * 3, 4: (None,) * 3, 5: (None,) * 3}
    a, i = spark.createDataFrame([("/d/x/a.json",)], "path string"), spark.createDataFrame([("/d/x/1.png",), ("/d/x/1_mask.png",), ("/d/y/2.png",)], "path string")
    assert [r.image for r in files.images_beside(a, i, ["_mask"]).collect()] == ["/d/x/1.png"]
    s = spark.createDataFrame([("png", 10), ("png", 30), ("jpg", 5)], "ext string, length long")
    assert {r.ext: (r.files, r.bytes) for r in files.file_statistics(s).collect()} == {"png": (2, 40), "jpg": (1, 5)}
    v = spark.createDataFrame([(1, [0, 0, 1, 5])], "k int, a array<int>")
    assert {r.value: (r.n, r.share) for r in files.value_counts(v, "k", "a").collect()} == {0: (2, 0.5), 1: (1, 0.25), 5: (1, 0.25)}


def test_detect_and_tiles(spark):
    raw = spark.createDataFrame([("a", 1, 10.0, 10.0, 8.0, 8.0, 0.9, [0.1, 0.9]), ("a", 2, 11.0, 10.0, 8.0, 8.0, 0.9, [0.1, 0.8]), ("a", 3, 50.0, 5.0, 8.0, 8.0, 0.9, [0.9, 0.1]), ("a", 4, 70.0, 70.0, 8.0, 8.0, 0.1, [0.9, 0.1])], "img string, row_no long, cx double, cy double, w double, h double, obj double, probs array<double>")
    got = [(r.row_no, r.class_id, r.panel_id) for r in D.detect(raw, "img", w=100, h=100).orderBy("panel_id").collect()]
    assert got == [(3, 0, 0), (1, 1, 1)]
    t = spark.createDataFrame([("a", 1, 0, 0.9, 10, 10, 30, 30, 0, 0), ("a", 2, 0, 0.8, 0, 10, 20, 30, 10, 0), ("a", 3, 1, 0.7, 60, 60, 70, 70, 100, 100)], "img string, row_no long, class_id int, conf double, x1 int, y1 int, x2 int, y2 int, tile_x int, tile_y int")
    assert sorted((r.row_no, round(r.x1)) for r in D.merge_tiles(t, "img").collect()) == [(1, 10), (3, 160)]


def test_model_output_and_matching():
    assert kernels.batch_vectors(np.zeros((2, 5, 7))).shape == (2, 7) and kernels.batch_vectors(np.zeros((2, 5, 3, 3))).shape == (2, 5) and kernels.batch_vectors(np.zeros(4)).shape == (1, 4)
    rng = np.random.default_rng(0)
    d, p = rng.random((30, 16)), rng.integers(0, 50, (30, 2)).astype(float)
    f = {"points": p, "descriptors": d, "shape": (50, 50), "flip_points": None, "flip_descriptors": None}
    every = lambda a, b: np.arange(len(a))
    r = kernels.match_features(f, f, every)
    assert r["is_match"] and not r["is_flipped"] and r["matched_keypoints"] == 30 and r["shared_area_a"] == r["shared_area_b"] > 0.5
    g = {**f, "descriptors": rng.random((30, 16)) * 0 + 1, "flip_points": p, "flip_descriptors": d}
    assert kernels.match_features(g, f, every)["is_flipped"]
    assert not kernels.match_features({**f, "descriptors": np.ones((30, 16))}, f, lambda a, b: np.zeros(0, int))["is_match"]
