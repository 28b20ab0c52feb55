"""Exact rankings of stated queries against an index of vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Queries that go to the executors in one block.
QUERY_BLOCK = 4096


def _values(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a column, all of ``dim`` elements, from its flat buffer."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _sound(rows: DataFrame, vector: str, dim: int | None = None) -> DataFrame:
    """Rows with a vector of finite elements, of ``dim`` of them if that is given."""
    v = F.col(vector)
    out = rows.where(v.isNotNull() & (F.size(v) > 0)).where(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))))
    return out if dim is None else out.where(F.size(v) == dim)


def rank(index: DataFrame, queries: DataFrame, k: int, *, ident: str, query: str, vector: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """``query, ident, score, rank``: the k rows of the index nearest to each query by cosine.

    Queries are a stated set and go out in blocks of QUERY_BLOCK vectors; every
    partition of the index keeps its best k per query, so what is shuffled is
    k rows per query and partition.  Ties go to the smaller ident.  Vectors that
    are null, empty, not finite or of another length than the greatest number of
    queries have take no part.
    """
    spark = index.sparkSession
    sound = _sound(queries, vector)
    common = sound.groupBy(F.size(vector).alias("dim")).count().orderBy(F.col("count").desc(), "dim").first()
    if common is None:
        return spark.createDataFrame([], f"query bigint, `{ident}` bigint, score double, rank int")
    dim = common["dim"]
    q = _sound(queries, vector, dim).select(F.col(query).cast("bigint").alias("q"), F.col(vector).alias("v"))
    blocks = max(1, -(-q.count() // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        rows = q.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).collect()
        if not rows:
            continue
        ids = np.array([r["q"] for r in rows])
        vs = np.array([r["v"] for r in rows], np.float64)
        vs /= np.maximum(np.linalg.norm(vs, axis=1, keepdims=True), 1e-12)
        shared = spark.sparkContext.broadcast((ids, vs))

        def best(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            qi, qv = shared.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                ix, x = batch.column(0).to_numpy(), _values(batch.column(1), dim)
                x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
                s = np.round(qv @ x.T, 12)
                if exclude_self:
                    s[qi[:, None] == ix[None, :]] = -np.inf
                n = min(k, len(ix))
                order = np.lexsort((np.broadcast_to(ix, s.shape), -s), axis=1)[:, :n]
                got = np.take_along_axis(s, order, 1)
                keep = np.isfinite(got)
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(qi[:, None], got.shape)[keep]), pa.array(ix[order][keep]), pa.array(got[keep])], names=["q", "i", "score"])

        part = _sound(index, vector, dim).select(F.col(ident).cast("bigint").alias("i"), F.col(vector).alias("v")).mapInArrow(best, "q bigint, i bigint, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"query bigint, `{ident}` bigint, score double, rank int")
    w = W.partitionBy("q").orderBy(F.col("score").desc(), "i")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("q").alias("query"), F.col("i").alias(ident), "score", "rank")


def truth_ranks(scores: DataFrame, query: str, score: str, is_truth: str) -> DataFrame:
    """Competition rank of each query's true item: one more than the items that score higher."""
    truth = scores.where(F.col(is_truth)).groupBy(query).agg(F.max(score).alias("gt"))
    return scores.join(truth, query).groupBy(query).agg((F.count_if(F.col(score) > F.col("gt")) + 1).alias("rank"), F.first("gt").alias("gt_score"), F.max_by(score, score).alias("top1_score"))


def as_json(ranking: DataFrame, query: str, path: str) -> DataFrame:
    """One JSON list of {path, score, rank} per query, in order of rank."""
    item = F.struct("rank", F.struct(F.col(path).alias("path"), "score", "rank").alias("r"))
    return ranking.groupBy(query).agg(F.to_json(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["r"])).alias("matches"))
