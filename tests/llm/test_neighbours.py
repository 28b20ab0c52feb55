import numpy as np
import pytest

from figmill.llm import neighbours as N


def brute(rows, k, dim):
    ok = {}
    for i, g, v in rows:
        if v is not None and len(v) == dim and all(x is not None and np.isfinite(x) for x in v) and any(v):
            ok.setdefault(g, {})[i] = np.float32(v).astype(float)
    out = set()
    for items in ok.values():
        ids = sorted(items)
        x = np.array([items[i] for i in ids])
        x /= np.abs(x).max(1, keepdims=True)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        s = np.round(x @ x.T, 12)
        for a, i in enumerate(ids):
            order = [b for b in np.lexsort((ids, -s[a])) if b != a][:k]
            out |= {(i, ids[b]) for b in order}
    return out


def vectors(n, dim, seed):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((8, dim))
    return [(centres[i % 8] + 0.2 * rng.standard_normal(dim) if i % 3 else rng.standard_normal(dim)).astype(np.float32) for i in range(n)]


def test_exact_small(spark):
    dim = 8
    v = vectors(160, dim, 1)
    rows = [(i, ["a", "b", None][min(2, i % 4 // 1 if i % 4 < 2 else 0)], x.tolist()) for i, x in enumerate(v)]
    rows += [(500 + i, "a", v[0].tolist()) for i in range(12)] + [(600, "a", (v[0] * 2).tolist()), (601, "a", [0.0] * dim), (602, "a", None), (603, "a", [1.0] * 3), (604, "a", [float("nan")] * dim), (605, "a", [float("inf")] * dim), (606, "lone", v[1].tolist()), (607, "two", v[1].tolist()), (608, "two", v[2].tolist()), (609, "a", (v[3] * 1e-20).tolist())]
    rows += [rows[3]]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "item_id long, index_id string, embedding array<float>, grp string, point int")
    got = N.similar_vectors(df, 5, dim=dim, slice_size=256)
    pairs = {(r.item_id, r["match"]) for r in got.collect()}
    assert pairs == brute(rows, 5, dim)
    top = got.where("item_id = 500").orderBy("rank").collect()
    assert [r["match"] for r in top] == [0, 501, 502, 503, 504] and all(r.score == pytest.approx(1) for r in top)
    assert N.similar_vectors(df.where("false"), 5, dim=dim).count() == 0
    assert N.similar_vectors(df.where("item_id > 600 and item_id < 606"), 5, dim=dim).count() == 0


def test_forest_recall(spark):
    v = vectors(3000, 64, 2)
    rows = [(i, "a", x.tolist()) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "item_id long, index_id string, embedding array<float>")
    want = brute(rows, 5, 64)
    recall = []
    for ascents in (0, 2):
        got = {(r.item_id, r["match"]) for r in N.similar_vectors(df, 5, slice_size=256, ascents=ascents).select("item_id", "match").collect()}
        assert len(got) == len(want)
        recall.append(len(got & want) / len(want))
    # a third of these vectors has no near neighbour, which is what the ascents are for
    assert recall[0] > 0.8 and recall[1] > 0.95


def test_slices():
    rng = np.random.default_rng(0)
    codes = np.sort(np.r_[rng.integers(0, 1 << 62, 900), np.full(70, 12345), rng.integers(0, 1 << 40, 300)])
    got = sorted(N.slices(codes, 50, 62))
    assert [a for a, _, _ in got] == [0, *[b for _, b, _ in got[:-1]]] and got[-1][1] == len(codes)
    for a, b, d in got:
        assert b - a <= 50 and len(set(codes[a:b] >> (62 - d))) == 1
        same = codes >> (62 - d + 1) == codes[a] >> (62 - d + 1)
        assert d == 0 or same.sum() > 50  # no shorter prefix would do
    assert len({d for _, _, d in got}) > 3


def test_hot_group_and_many_equal(spark):
    v = vectors(40, 64, 4)
    rows = [(i, "a", v[i % 40].tolist()) for i in range(4000)] + [(5000 + i, f"g{i}", v[i].tolist()) for i in range(40)]
    df = spark.createDataFrame(rows, "item_id long, index_id string, embedding array<float>")
    got = N.similar_vectors(df, 5).where("item_id in (0, 3999, 5000)").collect()
    assert {(r.item_id, r["match"]) for r in got} == {(0, 40 * i) for i in range(1, 6)} | {(3999, 39 + 40 * i) for i in range(5)}
