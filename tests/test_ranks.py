from pyspark.sql import functions as F

from figmill.operators import metrics, retrieval


def test_rank_reads_over_unusable_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, None), (4, [nan, 1.0]), (5, [1.0]), (6, []), (7, [0.0, 1.0]), (8, [1.0, None])]
    df = spark.createDataFrame(rows, "i long, embedding array<double>")
    got = [(r["query"], r["i"], r["rank"]) for r in retrieval.rank(df, df, 1, ident="i", query="i", exclude_self=True).orderBy("query").collect()]
    assert got == [(1, 2, 1), (2, 1, 1), (7, 2, 1)]
    assert retrieval.rank(df, df.where("i = 3"), 1, ident="i", query="i").count() == 0


def test_quantiles_without_a_window_over_a_group(spark):
    df = spark.createDataFrame([("a", float(x)) for x in (5, 1, 4, 2)] + [("b", 7.0), (None, 1.0), (None, 2.0), ("c", None)], "g string, x double")
    got = {r["g"]: (r["m"], r["p"]) for r in metrics.exact_quantiles(df, "x", {"m": 0.5, "p": 0.95}, ["g"]).collect()}
    assert got["a"][0] == 3.0 and abs(got["a"][1] - 4.85) < 1e-9 and got["b"] == (7.0, 7.0) and got[None][0] == 1.5 and "c" not in got
    assert metrics.exact_quantiles(df, "x", {"m": 0.5}).first()["m"] == 2.0
    s = metrics.number_summary(df, "x", ["g"]).where(F.col("g") == "c").first()
    assert s["n"] == 0 and s["median"] is None
