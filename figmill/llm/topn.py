"""Top N items within every group, by a secondary sort.

Rows are hash-partitioned by group, sorted inside the partition by score and
identifier, and read as a stream of Arrow batches that lets the first N rows of
each group through; no group is ever held in memory.  A group may hold a third
of all rows, so a first pass works on (group, salt), where the salt comes from
the identifier, and only N rows per (group, salt) reach the second pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts a group is split into before the second pass, at least; with more shuffle partitions there are as many parts.
SALTS = 64


def _first_n(n: int, keys: list[str], rank: str | None):
    """Arrow stream filter: the first n rows of each run of equal keys."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None
        seen = 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            change = np.zeros(rows, bool)
            for k in keys:
                col = batch.column(batch.schema.get_field_index(k))
                codes = col.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                change[1:] |= codes[1:] != codes[:-1]
            first = tuple(batch.column(batch.schema.get_field_index(k))[0].as_py() for k in keys)
            starts = np.flatnonzero(change)
            place = np.arange(rows)
            place -= np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [rows]))))
            head = starts[0] if len(starts) else rows
            if first == last:
                place[:head] += seen
            seen = int(place[-1]) + 1
            last = tuple(batch.column(batch.schema.get_field_index(k))[rows - 1].as_py() for k in keys)
            keep = np.flatnonzero(place < n)
            if not len(keep):
                continue
            out = batch.take(pa.array(keep))
            if rank:
                out = out.append_column(rank, pa.array((place[keep] + 1).astype("int32")))
            yield out

    return stream


def top_n(items: DataFrame, group: list[str], score: str, ident: str, n: int, *, once: list[str] | None = None, rank: str = "rank", salts: int | None = None) -> DataFrame:
    """The n rows of highest ``score`` per group, the smaller ``ident`` first on a tie.

    ``once`` names columns that identify an item inside its group: of its rows,
    that of the smallest ident stands for it (chosen before the shuffle, by a
    partial aggregate).  NULL and NaN scores never count; a repeated row counts
    once with ``once`` and as often as it stands there without.  NULL group keys
    form a group; an empty table gives no rows.  Columns besides group, score and
    ident are dropped, so clashing names cannot arise.  Adds ``rank`` from 1.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    if salts is None:
        salts = max(SALTS, int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    names = [f"_g{i}" for i in range(len(group))]
    rows = items.select(*[F.col(g).alias(a) for g, a in zip(group, names)], F.col(ident).alias("_id"), F.col(score).cast("double").alias("_score"),
                        *[F.col(c).alias(f"_o{i}") for i, c in enumerate(once or [])])
    if once:
        best = rows.groupBy(*names, *[f"_o{i}" for i in range(len(once))]).agg(F.min(F.struct("_id", "_score")).alias("s"))
        rows = best.select(*names, "s.*")
    rows = rows.where(F.col("_score").isNotNull() & ~F.isnan("_score"))
    order = [F.col("_score").desc(), F.col("_id").asc()]
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int"))
    part = salted.repartition(*names, "_salt").sortWithinPartitions(*names, "_salt", *order)
    part = part.mapInArrow(_first_n(n, [*names, "_salt"], None), part.schema).drop("_salt")
    whole = part.repartition(*names).sortWithinPartitions(*names, *order)
    schema = T.StructType([*whole.schema.fields, T.StructField("_rank", T.IntegerType())])
    out = whole.mapInArrow(_first_n(n, names, "_rank"), schema)
    return out.select(*[F.col(a).alias(g) for g, a in zip(group, names)], F.col("_id").alias(ident), F.col("_score").alias(score), F.col("_rank").alias(rank))
