"""Integer keys as contiguous runs, and as-of matching of keys against runs.

Both the change tracker and the reference checker rest on these two steps.
Keys are handled in buckets of ``2**BUCKET_BITS`` consecutive values, so that no
window spans the whole key space; a run never crosses a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Consecutive key values handled by one window partition (2**16).
BUCKET_BITS = 16


def bucket(key: Column, bits: int = BUCKET_BITS) -> Column:
    return F.shiftright(key, bits)


def compress(keys: DataFrame, key: str, by: tuple[str, ...] = (), witness: str | None = None, bits: int = BUCKET_BITS) -> DataFrame:
    """Contiguous runs of integer keys: ``by..., bucket, lo, hi[, witnesses]``.

    Repeated keys count once and NULL keys are left out.  ``witness`` names a
    column whose distinct values are kept per run, for keys that are hashes.
    The distinct step aggregates before the shuffle, so one key that holds a
    third of the rows does not make a hot window.
    """
    cols = [*by, key] + ([witness] if witness else [])
    k = keys.where(F.col(key).isNotNull()).select(*cols).distinct().withColumn("bucket", bucket(F.col(key), bits))
    w = W.partitionBy(*by, "bucket").orderBy(key)
    # dense_rank, as two witnesses may share one key
    k = k.withColumn("island", F.col(key) - F.dense_rank().over(w))
    aggs = [F.min(key).alias("lo"), F.max(key).alias("hi")]
    if witness:
        aggs.append(F.collect_set(witness).alias("witnesses"))
    return k.groupBy(*by, "bucket", "island").agg(*aggs).drop("island")


def as_of(points: DataFrame, key: str, runs: DataFrame, by: tuple[str, ...] = (), extra: tuple[str, ...] = (), bits: int = BUCKET_BITS) -> DataFrame:
    """Each point with the run that starts last at or before it.

    Adds ``covered`` (the run reaches the key) and the ``extra`` columns of that
    run.  Points and run starts are sorted together inside (by, bucket), so there
    is no join of points with runs and no comparison of pairs.  ``points`` should
    hold each key once; see ``compress`` for hot keys.
    """
    names = [c for c in points.columns if c not in (*by, key)]
    kinds = {f.name: f.dataType for f in points.schema}
    rkinds = {f.name: f.dataType for f in runs.schema}
    pts = points.select(*by, F.col(key).alias("_k"), bucket(F.col(key), bits).alias("_b"), F.lit(1).alias("_o"), F.lit(None).cast("bigint").alias("_hi"),
                        *[F.lit(None).cast(rkinds[c]).alias(f"_x_{c}") for c in extra], *[F.col(c).alias(f"_p_{c}") for c in names])
    rns = runs.select(*by, F.col("lo").alias("_k"), F.col("bucket").alias("_b"), F.lit(0).alias("_o"), F.col("hi").alias("_hi"),
                      *[F.col(c).alias(f"_x_{c}") for c in extra], *[F.lit(None).cast(kinds[c]).alias(f"_p_{c}") for c in names])
    w = W.partitionBy(*by, "_b").orderBy("_k", "_o").rowsBetween(W.unboundedPreceding, 0)
    both = pts.unionByName(rns)
    out = both.withColumn("_run", F.last(F.when(F.col("_o") == 0, F.struct("_hi", *[f"_x_{c}" for c in extra])), ignorenulls=True).over(w)).where("_o = 1")
    return out.select(*by, F.col("_k").alias(key), *[F.col(f"_p_{c}").alias(c) for c in names],
                      F.coalesce(F.col("_run._hi") >= F.col("_k"), F.lit(False)).alias("covered"), *[F.col(f"_run._x_{c}").alias(c) for c in extra])
