"""Running totals over one global order, without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from figmill.plans.lineage import cut


def ordered_parts(df: DataFrame, order: list[Column]) -> DataFrame:
    """Rows range-partitioned by ``order``; ``_part`` numbers the ranges in that order."""
    return cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ordered")


def running(parts: DataFrame, order: list[Column], sums: dict[str, Column] | None = None, tops: dict[str, Column] | None = None) -> DataFrame:
    """Adds running sums from the start and running maxima from the end, over all ranges.

    Each range is scanned by itself; what comes before or after it is one row per
    range, joined back.
    """
    sums, tops = sums or {}, tops or {}
    cols = [F.sum(c).alias(f"_s_{k}") for k, c in sums.items()] + [F.max(c).alias(f"_m_{k}") for k, c in tops.items()]
    per = parts.groupBy("_part").agg(*cols)
    # one row per range, a number fixed by the shuffle partitions
    before, after = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1), W.orderBy("_part").rowsBetween(1, W.unboundedFollowing)
    offsets = per.select("_part", *[F.coalesce(F.sum(f"_s_{k}").over(before), F.lit(0)).alias(f"_s_{k}") for k in sums], *[F.max(f"_m_{k}").over(after).alias(f"_m_{k}") for k in tops])
    w = W.partitionBy("_part").orderBy(*order)
    up, down = w.rowsBetween(W.unboundedPreceding, 0), w.rowsBetween(0, W.unboundedFollowing)
    out = parts.join(F.broadcast(offsets), "_part")
    for k, c in sums.items():
        out = out.withColumn(k, F.sum(c).over(up) + F.col(f"_s_{k}"))
    for k, c in tops.items():
        out = out.withColumn(k, F.greatest(F.max(c).over(down), F.col(f"_m_{k}")))
    return out.drop(*[f"_s_{k}" for k in sums], *[f"_m_{k}" for k in tops])


def numbered(df: DataFrame, order: list[Column], name: str, start: int = 1) -> DataFrame:
    """Rows numbered in a global order, range by range."""
    parts = ordered_parts(df, order)
    return running(parts, order, sums={name: F.lit(1)}).withColumn(name, (F.col(name) + (start - 1)).cast("bigint")).drop("_part")


def numbered_in_groups(df: DataFrame, by: list[str], order: list[Column], name: str, start: int = 1) -> DataFrame:
    """Rows numbered inside their group, whatever the groups' sizes.

    One global order by group, then ``order``: a group that holds a third of all
    rows is spread over ranges, and its numbers are counted from its first row's.
    """
    every = numbered(df, [*[F.col(b) for b in by], *order], "_global")
    first = every.groupBy(*[F.col(b).alias(f"_g_{b}") for b in by]).agg(F.min("_global").alias("_first"))
    same = F.lit(True)
    for b in by:
        same = same & F.col(b).eqNullSafe(F.col(f"_g_{b}"))
    return every.join(first, same).withColumn(name, (F.col("_global") - F.col("_first") + start).cast("bigint")).drop("_global", "_first", *[f"_g_{b}" for b in by])
