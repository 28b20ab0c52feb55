import io
import json
import tarfile

import numpy as np
from pyspark.sql import functions as F

from figmill.operators import dataset, kernels, masks
from figmill.sources import files, sinks
from figmill.streaming import windows


def test_listing_and_pairs(spark, tmp_path):
    for p in ["match/x/A.png", "match/x/B.png", "match/x/meta.json", "no_match/y/z/A.PNG", "no_match/y/z/A.png", "no_match/y/z/B.png", "no_match/w/A.png", "other.txt"]:
        q = tmp_path / p
        q.parent.mkdir(parents=True, exist_ok=True)
        q.write_bytes(b"1")
    l = files.list_files(spark, str(tmp_path), [".PNG"])
    assert l.count() == 6 and set(r.stem for r in l.collect()) == {"A", "B"}
    every = files.list_files(spark, str(tmp_path), ["png", "json"])
    got = {r.pair_id: (r.label, r.meta_path is not None) for r in files.pair_examples(every, str(tmp_path)).collect()}
    assert got == {"match__x": (1, True), "no_match__y__z": (0, False)}
    assert files.pair_examples(every, str(tmp_path), strict=False).count() == 3
    assert files.seeded_order(every.select("path"), "path", 1, 2).collect() == files.seeded_order(every.select("path"), "path", 1, 2).collect()


def test_annotations_and_records(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"imageHeight": 50, "imageWidth": 60, "shapes": [{"label": "B", "points": [[30.2, 5], [70, 20.5]], "shape_type": "rectangle"}, {"label": "A", "points": [[-3, 2], [10, 9]], "shape_type": "rectangle"}, {"label": "E", "points": [[5, 5], [5, 5]], "shape_type": "rectangle"}]}))
    got = [(r.panel_id, r.label, r.x1, r.y1, r.x2, r.y2) for r in files.read_polygons(spark, str(tmp_path / "a.json")).orderBy("panel_id").collect()]
    assert got == [("p001", "A", 0, 2, 10, 9), ("p002", "B", 30, 5, 60, 21)]
    fig = spark.createDataFrame([("f", json.dumps({"figure_annotations": {"width": 10, "1": {"class": "Blot", "bbox": {"x0": 9, "y0": 1, "x1": 2, "y1": 5}}, "x2": {}}})), ("g", "{broken"), ("h", None)], "id string, j string")
    assert [(r.box_id, r.label, r.x1, r.x2) for r in files.read_figure_boxes(fig, "id", "j").collect()] == [(1, "Blot", 2.0, 9.0)]
    for payload in ('{"0": "a", "1": "b"}', '{"a": 0, "b": 1}', '["a", "b"]', '{"names": ["a", "b"]}'):
        assert files.class_names(payload) == {0: "a", 1: "b"}
    xml = spark.createDataFrame([(1, '<article xmlns:xlink="u"><fig id="F1"><caption><p>One <i>two</i></p></caption><graphic xlink:href="a.jpg"/><graphic xlink:href="b.jpg"/></fig></article>'), (2, "<broken"), (3, None)], "k long, x string")
    assert [(r.k, r.figure_id, r.href, r.caption) for r in files.jats_figures(xml, "k", "x").collect()] == [(1, "F1", "a.jpg", "One two"), (1, "F1", "b.jpg", "One two")]
    oa = spark.createDataFrame([('<OA><records><record license="CC BY"><link format="tgz" href="ftp://h/x.tgz"/></record></records></OA>',), ('<OA><error code="idDoesNotExist">x</error></OA>',), ("no xml",)], "x string")
    r = [tuple(x.r) for x in oa.select(files.open_access_record(F.col("x")).alias("r")).collect()]
    assert r[0][1:] == ("CC BY", "ftp://h/x.tgz") and r[1][0] == "idDoesNotExist" and r[2][0] is None


def test_archives_and_masks(spark):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w:gz") as t:
        for n in ("PMC1/fig1.jpg", "PMC1/fig1_t.jpg", "PMC1/x.nxml", "PMC1/fig2.png"):
            i = tarfile.TarInfo(n)
            i.size = 3
            t.addfile(i, io.BytesIO(b"abc"))
    df = spark.createDataFrame([("p", buf.getvalue()), ("q", b"nonsense"), ("r", None)], "path string, content binary")
    m = files.archive_members(df)
    assert m.where("error is not null").count() == 2 and m.where("member is not null").count() == 4
    w = spark.createDataFrame([("fig1",), ("PMC1/fig2.png",), ("gone",)], "href string")
    assert sorted(r.member for r in files.wanted_members(m.where("member is not null"), w).collect()) == ["PMC1/fig1.jpg", "PMC1/fig2.png"]
    a = np.zeros((2, 4, 5), np.uint8)
    a[0, 1:3, 2] = 1
    b = io.BytesIO()
    np.save(b, a)
    z = io.BytesIO()
    np.savez(z, other=a[0], mask=np.moveaxis(a, 0, 2).astype(float))
    r = files.mask_runs(spark.createDataFrame([("n", b.getvalue()), ("z", z.getvalue())], "path string, content binary")).collect()
    assert [(x.path, x.mask_no, [tuple(y) for y in x.runs]) for x in sorted(r)] == [("n", 1, [(9, 2)]), ("z", 1, [(9, 2)])]
    assert files.channel_axis((4, 5, 2), (4, 5)) == 2 and files.channel_axis((3, 50, 60)) == 0 and files.channel_axis((99, 95, 90)) == 2


def test_sinks(spark, tmp_path):
    sub = spark.createDataFrame([("1", "authentic"), ("2", "[1, 2]")], "case_id string, annotation string")
    sinks.write_submission(sub, str(tmp_path / "s"))
    assert sorted(tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "s")).collect()) == [("1", "authentic"), ("2", "[1, 2]")]
    pr = spark.createDataFrame([("p", 1, 0.5, "ok"), ("q", 0, None, "error")], "pair_id string, label int, score double, status string")
    sinks.append_predictions(pr, str(tmp_path / "p"))
    sinks.append_predictions(pr.withColumn("pair_id", F.concat("pair_id", F.lit("2"))), str(tmp_path / "p"))
    assert files.read_predictions(spark, str(tmp_path / "p")).count() == 4 and files.read_predictions(spark, str(tmp_path / "p"), retry_errors=True).count() == 2
    d = spark.createDataFrame([("i", 1, 0, 0.5, "A", 0, 0, 50, 100), ("i", 2, 1, 0.9, "B", 50, 0, 100, 100)], "img string, row_no long, class_id int, conf double, class_name string, x1 int, y1 int, x2 int, y2 int")
    t = {r.img: r.text for r in sinks.label_files(d, "img", 100, 100, images=spark.createDataFrame([("i",), ("none",)], "img string")).collect()}
    assert t["none"] == "" and t["i"].split("\n") == ["1 0.750000 0.500000 0.500000 1.000000", "0 0.250000 0.500000 0.500000 1.000000"]
    back = sinks.read_detections_json(sinks.detections_json(d, "img", raw=True), "img").orderBy("row_no").collect()
    assert [(r.x1, r.x2, r.conf, r.class_id, r.class_name) for r in back] == [(0, 50, 0.5, 0, "A"), (50, 100, 0.9, 1, "B")]
    old = spark.createDataFrame([("i", '{"detections": [{"box_xyxy": [1, 2, 3, 4], "cls": 3, "conf": 0.1}]}')], "img string, json string")
    assert [(r.y1, r.class_id) for r in sinks.read_detections_json(old, "img").collect()] == [(2.0, 3)]
    rep = sinks.model_report(spark.createDataFrame([("a", 0.1), ("b", 0.9)], "model string, mrr double"), "model", ["mrr"], "mrr").collect()
    assert [r.line for r in rep] == ["| model | mrr |", "|---|---|", "| b | 0.9000 |", "| a | 0.1000 |"]


def test_dataset_steps(spark):
    cur = spark.createDataFrame([("a", 1, "t1", "NEW"), ("b", 2, "t2", "DONE")], "k string, seq long, title string, status string")
    inc = spark.createDataFrame([("b", None, "X", 1), ("c", "t3", "Y", 2), ("c", "t4", "Z", 3)], "k string, title string, status string, n int")
    got = sorted(tuple(r) for r in dataset.upsert(cur, inc, "k", ["status"], [F.col("n").desc()]).collect())
    assert got == [("a", 1, "t1", "NEW"), ("b", 2, "t2", "DONE"), ("c", 3, "t4", "Z")]
    docs = dataset.paper_documents(spark.createDataFrame([("a", "t")], "k string, title string"), spark.createDataFrame([("a", "F2", "h", "c", None), ("a", "F1", "h", "c", None), ("z", "F1", "h", "c", None)], "k string, figure_id string, href string, caption string, file_path string"), "k").collect()
    assert [f.figure_id for f in docs[0].figures] == ["F1", "F2"] and len(docs) == 1
    one = dataset.first_by_extension(spark.createDataFrame([("s", "png", "s.png"), ("s", "JPG", "s.JPG"), ("t", "xyz", "t.xyz")], "stem string, ext string, path string"), ["stem"], "ext")
    assert sorted(r.path for r in one.collect()) == ["s.JPG", "t.xyz"]


def test_kernels(spark):
    kernels.register_model("stub", lambda: lambda pdf: pdf.assign(v=pdf.k * 2.0)[pdf.k > 1])
    out = kernels.apply_model(spark.range(4).withColumnRenamed("id", "k"), "stub", "k long, v double", load=kernels._LOADERS["stub"])
    assert sorted(tuple(r) for r in out.collect()) == [(2, 4.0), (3, 6.0)]
    img, gain, (dx, dy) = kernels.letterbox(np.ones((10, 20, 3), np.uint8), 40, 40)
    assert img.shape == (40, 40, 3) and gain == 2 and (dx, dy) == (0, 10) and (img[:10] == 114).all() and (img[10:30] == 1).all()
    assert kernels.to_tensor(img).shape == (1, 3, 40, 40) and kernels.enlarge_factor(80, 400) == 4
    g = kernels.equalise(np.array([[0, 0, 10], [10, 20, 20]], np.uint8))
    assert g.min() == 0 and g.max() == 255
    sq = np.array([[2, 2], [6, 2], [6, 6], [2, 6], [4, 4]], float)
    assert kernels.hull_mask(sq, 10, 10).sum() == 25 and kernels.shared_area(sq, 10, 10) == 0.25 and kernels.shared_area(sq[:2], 10, 10) == 0
    rng = np.random.default_rng(0)
    a = rng.random((12, 8))
    m = kernels.chain_matches(a, a[::-1] + 1e-6)
    assert [tuple(x) for x in m] == [(i, 11 - i) for i in range(12)]
    assert np.allclose((kernels.root_features(a) ** 2).sum(1), 1, atol=1e-5) and len(kernels.chain_matches(a[:0], a)) == 0


def test_stream_equals_batch(spark, tmp_path):
    ev = spark.createDataFrame([(i, f"2026-01-01 {i % 5:02d}:{i % 60:02d}:00", "ab"[i % 2], float(i)) for i in range(60)], "event_id long, t string, kind string, value double").withColumn("ts", F.to_timestamp("t")).drop("t")
    ev.write.parquet(str(tmp_path / "ev"))
    batch = spark.read.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "ev"))
    q = windows.windowed_counts(stream, "ts", "kind", "value").writeStream.outputMode("complete").format("memory").queryName("w").start()
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(spark.sql("select * from w")) == key(windows.windowed_counts(batch, "ts", "kind", "value"))
    assert windows.sessions(batch, "ts", "kind").agg(F.sum("n")).first()[0] == 60
    assert windows.first_of_each(batch, ["kind"], "ts").count() == 2
    assert masks.AUTHENTIC == "authentic"
