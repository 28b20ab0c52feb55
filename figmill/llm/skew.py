"""Joins on keys of which a few may hold a great part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key with more than this share of all rows is split, so no more keys than its inverse are; and the parts it is split into.
HOT_SHARE, HOT_PARTS = 1 / 500, 64
#: Rows below which no key is worth splitting.
HOT_ROWS = 1000


def hot_keys(rows: DataFrame, key: str, weight: str | None = None) -> list:
    """Keys that hold more than HOT_SHARE of the rows, or of their weight; at most 1 / HOT_SHARE of them."""
    size = F.count(F.lit(1)) if weight is None else F.sum(weight)
    top = rows.where(F.col(key).isNotNull()).groupBy(key).agg(size.alias("n")).orderBy(F.col("n").desc()).limit(int(1 / HOT_SHARE) + 1).collect()
    if not top or top[0]["n"] < HOT_ROWS:
        return []
    total = rows.agg(size).first()[0]
    return [r[key] for r in top if r["n"] > max(HOT_ROWS, total * HOT_SHARE)]


def split_join(rows: DataFrame, other: DataFrame, key: str, how: str = "inner", hot: list | None = None) -> DataFrame:
    """Join on ``key`` where a few keys may hold a great part of ``rows``: these are split, and their partners repeated."""
    hot = hot_keys(rows, key) if hot is None else hot
    if not hot:
        return rows.join(other, key, how)
    is_hot = F.coalesce(F.col(key).isin(hot), F.lit(False))
    left = rows.withColumn("_part", F.when(is_hot, F.pmod(F.xxhash64(*[c for c in rows.columns if c != key]), F.lit(HOT_PARTS))).otherwise(0).cast("int"))
    right = other.withColumn("_part", F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0)))))
    return left.join(right, [key, "_part"], how).drop("_part")
