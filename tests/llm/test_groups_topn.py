import numpy as np
import pytest

from figmill.llm.groups import connected_groups
from figmill.llm.topn import top_n


def components(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            ra, rb = find(a), find(b)
            parent[max(ra, rb)] = min(ra, rb)
    return {k: find(k) for k in parent}


def test_groups(spark):
    rng = np.random.default_rng(4)
    e = [(f"r{a:03d}", f"r{b:03d}") for a, b in rng.integers(0, 120, (60, 2))] + [(f"c{i:02d}", f"c{i + 1:02d}") for i in range(40)] + [("hub", f"s{i}") for i in range(50)]
    e += [(b, a) for a, b in e[:10]] + e[:5] + [(None, "x"), ("y", None), ("self", "self")]
    df = spark.createDataFrame([(a, b, "clash", 1) for a, b in e], "a string, b string, c string, t int")
    assert {r.member: r.group for r in connected_groups(df).collect()} == components(e)
    assert connected_groups(df.where("false")).count() == 0
    nums = spark.createDataFrame([(1, 2), (2, 3), (9, 8)], "p long, q long")
    assert {r.member: r.group for r in connected_groups(nums, "p", "q").collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8}


@pytest.mark.parametrize("salts", [1, 16])
def test_top_n(spark, salts):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(600):
        g = "hot" if rng.random() < 0.4 else f"g{rng.integers(0, 30)}"
        s = [None, float("nan"), float(rng.integers(0, 6))][min(2, int(rng.integers(0, 12)))]
        rows.append((i, None if rng.random() < 0.02 else g, int(rng.integers(0, 2)), s, f"u{rng.integers(0, 60)}", 5))
    rows += [(i, g, c, s, u, 5) for i, g, c, s, u, _ in rows[:40]]
    df = spark.createDataFrame(rows, "id long, g string, c int, s double, u string, rank int")

    def brute(once):
        best = {}
        if once:
            for r in rows:
                k = (r[1], r[2], r[4])
                if k not in best or r[0] < best[k][0]:
                    best[k] = r
            items = list(best.values())
        else:
            items = rows
        out = []
        for k in {(r[1], r[2]) for r in items}:
            grp = sorted((-r[3], r[0]) for r in items if (r[1], r[2]) == k and r[3] is not None and r[3] == r[3])[:3]
            out += [(str(k[0]), k[1], i, -s, n + 1) for n, (s, i) in enumerate(grp)]
        return sorted(out)

    for once in (None, ["u"]):
        got = sorted((str(r.g), r.c, r.id, r.s, r["rank"]) for r in top_n(df, ["g", "c"], "s", "id", 3, once=once, salts=salts).collect())
        assert got == brute(once)
    assert top_n(df.where("false"), ["g"], "s", "id", 3).count() == 0
    with pytest.raises(ValueError):
        top_n(df, ["g"], "s", "id", 0)


def test_hub_and_long_chain(spark):
    e = [("hub", f"s{i:05d}") for i in range(5000)] + [(f"c{i:04d}", f"c{i + 1:04d}") for i in range(600)] + [("s00007", "c0300")]
    df = spark.createDataFrame(e, "a string, b string")
    got = {r.member: r.group for r in connected_groups(df).collect()}
    assert got == components(e) and set(got.values()) == {"c0000"}
