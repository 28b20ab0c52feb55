import numpy as np
import pytest
from pyspark.sql import functions as F

from figmill.functions import geometry as G
from figmill.functions import text as T
from figmill.operators import candidates as C
from figmill.operators import components as K
from figmill.operators import detections as D

S = "img string, row_no long, class_id int, conf double, x1 double, y1 double, x2 double, y2 double"


def sample(spark, n=120, seed=3):
    rng = np.random.default_rng(seed)
    xy, wh = rng.integers(0, 60, (n, 2)), rng.integers(0, 40, (n, 2))
    return [(f"i{k % 3}", k, int(rng.integers(0, 2)), float(rng.integers(1, 9)) / 10, float(a), float(b), float(a + c), float(b + d)) for k, ((a, b), (c, d)) in enumerate(zip(xy.tolist(), wh.tolist()))]


def iou(a, b):
    i = max(0, min(a[2], b[2]) - max(a[0], b[0])) * max(0, min(a[3], b[3]) - max(a[1], b[1]))
    s = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return i / (s(a) + s(b) - i + 1e-9)


def brute(rows, thr, by_class, merge):
    out = []
    for img in {r[0] for r in rows}:
        kept = []
        for r in sorted((r for r in rows if r[0] == img), key=lambda r: (-r[3], r[1])):
            home = next((k for k in kept if (not by_class or k[0][2] == r[2]) and iou(k[0][4:], r[4:]) > thr), None)
            if home is None:
                kept.append([r, [r]])
            else:
                home[1].append(r)
        for r, group in kept:
            w = np.array([g[3] for g in group])
            b = (np.array([g[4:] for g in group]) * w[:, None]).sum(0) / (w.sum() + 1e-9) if merge else np.array(r[4:])
            out.append((r[1], *np.round(b, 4)))
    return sorted(out)


@pytest.mark.parametrize("by_class,merge", [(True, False), (False, False), (True, True)])
def test_suppression_against_brute_force(spark, by_class, merge):
    rows = sample(spark)
    df = spark.createDataFrame([*rows, ("i0", 900, 0, None, 0.0, 0.0, 5.0, 5.0), ("i0", 901, 0, float("nan"), 0.0, 0.0, 5.0, 5.0)], S)
    got = sorted((r.row_no, *np.round([r.x1, r.y1, r.x2, r.y2], 4)) for r in D.suppress(df, "img", 0.3, by_class=by_class, merge=merge).collect())
    assert got == brute(rows, 0.3, by_class, merge)
    assert D.suppress(df.where("false"), "img", 0.3).count() == 0


def test_raw_predictions_and_kinds(spark):
    raw = spark.createDataFrame([("a", 1, 10.0, 10.0, 4.0, 4.0, 0.9, [0.1, 0.8]), ("a", 2, 1.0, 1.0, 1.0, 1.0, 0.1, [0.5, 0.2]), ("b", 3, 5.0, 5.0, 2.0, 2.0, 3.0, [-2.0, 4.0])], "img string, row_no long, cx double, cy double, w double, h double, obj double, probs array<double>")
    got = {r.row_no: r for r in D.from_raw(raw, "img", conf=0.25).collect()}
    assert sorted(got) == [1, 3] and got[1].class_id == 1 and got[1].conf == pytest.approx(0.72) and (got[1].x1, got[1].y2) == (8, 12)
    assert got[3].conf == pytest.approx(1 / (1 + np.exp(-3)) / (1 + np.exp(-4)))
    d = spark.createDataFrame([("m", 1, 0, 0.5, 1.0, 1.0, 9.0, 9.0), ("m", 2, 0, 0.5, 1.0, 1.0, 9.0, 9.0), ("e", 3, 0, 0.5, 3.0, 50.0, 99.0, 99.0), ("s", 4, 0, 0.5, 30.0, 30.0, 60.0, 60.0)], S)
    kinds = {r.img: r.kind for r in D.figure_kind(d, "img", w=100, h=100, sizes=spark.createDataFrame([("m",), ("e",), ("s",), ("n",)], "img string")).collect()}
    assert kinds == {"m": "compound_multi", "e": "simple", "s": "compound_single", "n": "unknown"}
    assert D.class_tokens(["Flow cytometry", "0", 0], {0: "Blots", 4: "Flow-Cytometry"}) == [4, 0]
    with pytest.raises(ValueError):
        D.class_tokens(["nothing"], {0: "Blots"})


def test_tiles_and_text(spark):
    def tiles(h, w, t, o):
        out, s, y = [], max(1, int(t * (1 - o))), 0
        while True:
            y2, x = min(h, y + t), 0
            while True:
                x2 = min(w, x + t)
                out.append((max(0, x2 - t), max(0, y2 - t), x2, y2))
                if x2 >= w:
                    break
                x += s
            if y2 >= h:
                return out
            y += s

    sizes = [(100, 100), (64, 64), (65, 200), (10, 129), (333, 97)]
    df = spark.createDataFrame(sizes, "w int, h int")
    for r in df.select("w", "h", G.tiles(F.col("w"), F.col("h"), 64, 64, 0.25).alias("t")).collect():
        assert [tuple(x) for x in r.t] == tiles(r.h, r.w, 64, 0.25)
    t = spark.createDataFrame([("fig2.png",), ("Fig10.png",), ("fig1.png",)], "s string")
    assert [r.s for r in t.orderBy(T.natural_key(F.col("s"))).collect()] == ["fig1.png", "fig2.png", "Fig10.png"]
    one = t.limit(1).select(T.folder_name(F.lit(" Body-Imaging (x) ")).alias("a"), T.folder_name(F.lit("??")).alias("b"), T.human_bytes(F.lit(1536)).alias("c"), T.hyphen_slug(F.lit("A b_c!")).alias("d"), T.truncated(F.lit(0.999), 2).alias("e"),
                            T.transform_name(F.lit(" Rotate(90)")).alias("f"), T.period_of(F.lit("x/2026-01-02_2026-02-03/y")).alias("g"), T.strip_class(F.lit("a::cls=1::cls=2")).alias("h")).first()
    assert (one.a, one.b, one.c, one.d, one.e, one.f, one.h) == ("body_imaging_x", "unknown", "1.50 KB", "a-b-c", "0.99", "rotate", "a::cls=1")
    assert str(one.g.first) == "2026-01-02" and str(one.g.last) == "2026-02-03"


def test_negative_pairs(spark):
    panels = [(f, f"{f}{i:02d}", "ab"[i % 2]) for f, n in (("f", 7), ("g", 4), ("h", 2)) for i in range(n)]
    pos = [("f", "f00", "f01"), ("g", "g01", "g00"), ("g", "g02", "g03")]
    p, q = spark.createDataFrame(panels, "fig string, panel string, label string"), spark.createDataFrame(pos, "fig string, a string, b string")
    got = [tuple(r) for r in C.negative_pairs(p, q, "fig", "panel", "label", per_positive=3).collect()]
    assert len(got) == len(set(got)) and sum(g[0] == "f" for g in got) == 3 and sum(g[0] == "g" for g in got) == 4 and not any(g[0] == "h" for g in got)
    assert not {(f, min(a, b), max(a, b)) for f, a, b in pos} & set(got)
    many = C.negative_pairs(p, q, "fig", "panel", "label", per_positive=100).where("fig = 'f'").count()
    assert many == 7 * 6 // 2 - 1


def test_components(spark):
    rng = np.random.default_rng(5)
    e = [(f"n{a:03d}", f"n{b:03d}") for a, b in rng.integers(0, 150, (90, 2))] + [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(60)] + [(None, "x"), ("self", "self")]
    parent = {}
    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x
    for a, b in e:
        if a and b and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    want = {k: find(k) for k in parent}
    df = spark.createDataFrame(e, "a string, b string")
    c = K.label_components(df)
    assert {r.node: r.root for r in c.collect()} == want
    g = K.listed_groups(c).orderBy("group_no").collect()
    assert [(-r["size"], r["first"]) for r in g] == sorted((-r["size"], r["first"]) for r in g) and g[0]["size"] == 61
    assert K.label_components(df.where("false")).count() == 0
