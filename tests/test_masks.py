import itertools

import numpy as np
import pytest

from figmill.operators import masks as M


def dense(runs, size):
    out = np.zeros(size, bool)
    for s, n in runs:
        out[s:s + n] = True
    return out


GOLDEN = [
    ([("authentic", "authentic")] * 3, ["authentic"] * 3, 1.0),
    ([("authentic", "authentic")] * 3, ["[101, 102]"] * 3, 0.0),
    ([("[101, 102]", "[720, 960]")] * 3, ["[101, 102]"] * 3, 1.0),
    ([("[101, 103]", "[720, 960]"), ("[101, 102]", "[720, 960]"), ("[101, 102]", "[720, 960]")], ["[101, 102]"] * 3, 0.9983739837398374),
    ([("[101, 102];[300, 100]", "[720, 960]"), ("[101, 102]", "[720, 960]"), ("[101, 102]", "[720, 960]")], ["[101, 102]"] * 3, 0.8333333333333334),
]


@pytest.mark.parametrize("solution,submission,want", GOLDEN)
def test_published_scores(spark, solution, submission, want):
    sol = spark.createDataFrame([(i, a, s) for i, (a, s) in enumerate(solution)], "row_id long, annotation string, shape string")
    sub = spark.createDataFrame(list(enumerate(submission)), "row_id long, annotation string")
    assert M.score(sol, sub).first()["score"] == pytest.approx(want, abs=1e-12)


def test_assignment_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(40):
        n, m = (int(x) for x in rng.integers(1, 6, 2))
        c = rng.random((n, m))
        r, k = M.assign(c)
        small, big = min(n, m), max(n, m)
        side = c if n <= m else c.T
        best = min(sum(side[i, p[i]] for i in range(small)) for p in itertools.permutations(range(big), small))
        assert c[r, k].sum() == pytest.approx(best)


def test_run_algebra(spark):
    rng = np.random.default_rng(2)
    a = [(k, int(s), int(n)) for k in (1, 2, 3) for s, n in zip(rng.integers(0, 200, 15), rng.integers(0, 20, 15))]
    b = [(k, int(s), int(n)) for k in (1, 2, 3) for s, n in zip(rng.integers(0, 200, 15), rng.integers(1, 20, 15))]
    da, db = (spark.createDataFrame(x, "k int, start long, len long") for x in (a, b))
    got = {r["k"]: r for r in M.overlap(da, db, ["k"]).collect()}
    for k in (1, 2, 3):
        x, y = (dense([(s, n) for i, s, n in z if i == k], 300) for z in (a, b))
        assert (got[k]["a"], got[k]["b"], got[k]["common"]) == (x.sum(), y.sum(), (x & y).sum())
        assert got[k]["iou"] == pytest.approx((x & y).sum() / (x | y).sum())
    assert M.union(spark.createDataFrame([], "k int, start long, len long"), ["k"]).count() == 0
    split = M.union(spark.createDataFrame([(1, 5, 30), (1, 20, 40)], "k int, start long, len long"), ["k"], bits=4)
    assert split.groupBy().sum("len").first()[0] == 55


def test_text_round_trip(spark):
    df = spark.createDataFrame([("[1, 3, 10, 2]",), ("[5, 2, 1, 1]",), ("[1, 2, 3]",), ("[]",), (None,), ("[1, 3, 2, 2]",)], "t string")
    got = [r["r"] for r in df.select(M.parse_runs(df.t).alias("r")).collect()]
    assert [[tuple(x) for x in g] if g is not None else None for g in got] == [[(0, 3), (9, 2)], None, None, [], None, None]
    out = df.limit(1).select(M.text_of(M.parse_runs(df.t)).alias("t")).first()["t"]
    assert out == "[1,3,10,2]"
    masks = spark.createDataFrame([("c", 2, [(0, 3)]), ("c", 1, [(9, 2)]), ("d", 1, [])], "case string, mask_no int, runs array<struct<start:long,len:long>>")
    assert {r["case"]: r["annotation"] for r in M.annotation(masks, ["case"]).collect()} == {"c": "[10,2];[1,3]", "d": "authentic"}


def test_paste_and_box(spark):
    crop = np.zeros((4, 5), bool)
    crop[1:3, 1:4] = True
    pos = np.flatnonzero(crop.T.ravel())
    df = spark.createDataFrame([(1, int(p), 1) for p in pos], "k int, start long, len long")
    from pyspark.sql import functions as F
    moved = M.paste(df, ["k"], 4, F.lit(3), F.lit(-2), 10, 6)
    fig = np.zeros((6, 10), bool)
    fig[0:1, 4:7] = True
    assert sorted(r["start"] for r in moved.collect()) == np.flatnonzero(fig.T.ravel()).tolist()
    b = M.bounding_box(df, ["k"], 4).first()
    assert (b.x1, b.y1, b.x2, b.y2) == (1, 1, 4, 3)


def test_dense_kernels():
    m = np.zeros((6, 7), bool)
    m[2, 3] = True
    assert M.dilate(m, 1).sum() == 9 and M.erode(M.dilate(m, 1)).sum() == 1
    ring = M.boundary(M.dilate(m, 2))
    assert ring.sum() == 16
    two = np.zeros((5, 5), bool)
    two[0, 0] = two[1, 1] = True
    assert len(M.regions(two)) == 1 and len(M.regions(two, diagonal=False)) == 2
    u = np.array([[1, 0, 1], [1, 1, 1]], bool)
    assert [r["area"] for r in M.regions(u, diagonal=False)] == [5]
    a = np.zeros((20, 20), bool)
    a[2:8, 2:8] = True
    b = np.zeros((20, 20), bool)
    b[4:9, 4:9] = True
    far = np.zeros((20, 20), bool)
    far[14:19, 14:19] = True
    out = M.fuse({1: a}, [b, far, np.zeros((20, 20), bool)])
    assert sorted(out) == [1, 2] and out[1].sum() == (a | b).sum()
