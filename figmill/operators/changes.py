"""Processing only new or changed records.

Processed sequence numbers are kept as disjoint intervals.  A run subtracts
them from what is available, processes the gaps (late commits inside the range
included) and commits its output, the merged intervals and what it knows of each
record in one rename.  The longest intervals reach the scan as bounds, so files
that hold processed numbers only are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from figmill.functions.keys import article_digits, instant, status_key, utc_instant
from figmill.operators.runs import BUCKET_BITS, as_of, compress
from figmill.plans.lineage import drop_path, exists, list_dirs, rename

#: Processed ranges that are handed to a scan as bounds.
RANGES = 64


def last_success(run_log: DataFrame) -> DataFrame:
    """One row ``limit``: the greatest cutoff_at of runs whose outcome is ok; NULL if none."""
    return run_log.where(F.lower(F.trim("outcome")) == "ok").agg(F.max("cutoff_at").alias("limit"))


def intervals_until(rows: DataFrame, seq: str, received: str, limit: DataFrame) -> DataFrame:
    """Intervals of the sequence numbers received up to and including the limit."""
    # one row by construction (a global aggregate), hence a bounded broadcast
    covered = rows.select(seq, received).join(F.broadcast(limit), F.col(received) <= F.col("limit"))
    return compress(covered, seq)


def longest_ranges(intervals: DataFrame, most: int = RANGES) -> list[tuple[int, int]]:
    """The ``most`` longest processed ranges: buckets that are processed in full are joined first, bucket numbers being keys in their turn."""
    size = 1 << BUCKET_BITS
    full = (F.col("hi") - F.col("lo")) == size - 1
    joined = compress(intervals.where(full).select(F.col("bucket").alias("number")), "number").select((F.col("lo") * size).alias("lo"), (F.col("hi") * size + size - 1).alias("hi"))
    every = intervals.where(~full).select("lo", "hi").unionByName(joined)
    return [(r["lo"], r["hi"]) for r in every.orderBy((F.col("hi") - F.col("lo")).desc()).limit(most).collect()]


def outside(rows: DataFrame, seq: str, ranges: list[tuple[int, int]]) -> DataFrame:
    """Rows outside the ranges, by plain comparisons that a scan can use to skip files."""
    for lo, hi in ranges:
        rows = rows.where((F.col(seq) < lo) | (F.col(seq) > hi))
    return rows


def unprocessed(rows: DataFrame, seq: str, intervals: DataFrame) -> DataFrame:
    """Rows whose sequence number lies in no interval; rows without a number are left out."""
    far = outside(rows.where(F.col(seq).isNotNull()), seq, longest_ranges(intervals))
    gaps = as_of(far.select(F.col(seq).cast("bigint").alias(seq)).distinct(), seq, intervals).where(~F.col("covered")).select(seq)
    return far.join(gaps, seq, "left_semi")


def merge_intervals(intervals: DataFrame, done: DataFrame, seq: str) -> DataFrame:
    """Disjoint intervals that cover the old ones and the newly processed numbers.

    Works on runs, not on single numbers: touching runs of a bucket are joined
    by a running maximum of their ends.
    """
    from pyspark.sql import Window as W

    both = intervals.select("bucket", "lo", "hi").unionByName(compress(done, seq).select("bucket", "lo", "hi"))
    w = W.partitionBy("bucket").orderBy("lo", "hi")
    reach = F.max("hi").over(w.rowsBetween(W.unboundedPreceding, -1))
    starts = both.withColumn("new", F.when(reach.isNull() | (F.col("lo") > reach + 1), 1).otherwise(0))
    return starts.withColumn("island", F.sum("new").over(w.rowsBetween(W.unboundedPreceding, 0))).groupBy("bucket", "island").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi")).drop("island")


def article_states(articles: DataFrame) -> DataFrame:
    """``digits, state``: the state of each article among the given rows, aggregated before the shuffle.

    The state is the row of the latest instant (updated_at, else received_at), the
    smaller row_no on a tie.  Rows without digits in pmcid belong to no article;
    null attempts mean 0.
    """
    rows = articles.select(
        article_digits(F.col("pmcid")).alias("digits"), F.coalesce(instant(F.col("updated_at")), utc_instant(articles, "received_at")).alias("at"),
        (-F.col("row_no").cast("bigint")).alias("neg"), status_key(F.col("status")).alias("status"), F.coalesce(F.col("attempts"), F.lit(0)).cast("int").alias("attempts"))
    return rows.where("digits is not null").groupBy("digits").agg(F.max(F.struct("at", "neg", "status", "attempts")).alias("state"))


def article_changes(fresh: DataFrame, known: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """What new rows change: the changed articles, and the states of all articles they touch.

    ``known`` holds the states before (several per article are allowed, the latest
    counts).  Only states of articles that ``fresh`` touches take part.  An article
    is new without a state before; changed when status or attempts differ.
    """
    now = article_states(fresh)
    if known is None:
        both = now.select("digits", F.lit(None).cast(now.schema["state"].dataType).alias("was"), F.col("state").alias("now"))
    else:
        was = known.join(now.select("digits"), "digits", "left_semi").groupBy("digits").agg(F.max("state").alias("was"))
        both = now.join(was, "digits", "left").select("digits", "was", F.greatest("was", "state").alias("now"))
    differs = ~F.col("now.status").eqNullSafe(F.col("was.status")) | ~F.col("now.attempts").eqNullSafe(F.col("was.attempts"))
    changes = both.where(F.col("was").isNull() | differs).select(
        F.concat(F.lit("PMC"), "digits").alias("pmcid"), F.col("was").isNull().alias("is_new"),
        F.col("was.status").alias("status_before"), F.col("was.attempts").alias("attempts_before"),
        F.col("now.status").alias("status"), F.col("now.attempts").alias("attempts"))
    return changes, both.select("digits", F.col("now").alias("state"))


def changed_articles(articles: DataFrame, intervals: DataFrame) -> DataFrame:
    """Articles added or changed by rows outside the processed intervals, without kept states.

    Returns ``pmcid`` (plain), ``is_new``, and status/attempts before and after.
    The states before are read from the processed rows of the articles touched;
    an empty table gives no rows.
    """
    fresh = unprocessed(articles, "row_no", intervals)
    touched = fresh.select(article_digits(F.col("pmcid")).alias("digits")).distinct()
    before = articles.join(touched, article_digits(F.col("pmcid")) == F.col("digits"), "left_semi")
    before = before.join(fresh.select("row_no").distinct(), "row_no", "left_anti")
    return article_changes(fresh, article_states(before))[0]


class IntervalLedger:
    """Commits of a recurring job: each holds its output, the merged intervals and, if the job keeps any, states.

    A commit is a folder ``c<number>`` that appears by one rename, which fails if
    it is already there.  A run that dies before it leaves only a staging folder,
    which nobody reads, so the next run takes the same gaps again; after it, they
    are never taken again.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _commits(self) -> list[str]:
        return [d for d in list_dirs(self.spark, self.path) if d.startswith("c")]

    def intervals(self) -> DataFrame:
        commits = self._commits()
        schema = "bucket bigint, lo bigint, hi bigint"
        if not commits:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{commits[-1]}/intervals")

    def _all(self, part: str) -> DataFrame | None:
        paths = [p for c in self._commits() if exists(self.spark, p := f"{self.path}/{c}/{part}")]
        return self.spark.read.parquet(*paths) if paths else None

    def output(self, commit: str | None = None) -> DataFrame | None:
        """What all commits, or one of them, put out."""
        return self._all("output") if commit is None else self.spark.read.parquet(f"{self.path}/{commit}/output")

    def states(self) -> DataFrame | None:
        """States kept by all commits: one row per record and commit that touched it."""
        return self._all("states")

    def run(self, rows: DataFrame, seq: str, process: Callable[..., DataFrame | tuple[DataFrame, DataFrame]], states: bool = False) -> str | None:
        """Process the rows outside the intervals and commit; the commit's name, None if another run won.

        ``process`` gets the new rows and returns the output; with ``states`` it also
        gets the states kept so far (None at first) and returns output and states.
        """
        before, number = self.intervals(), len(self._commits())
        known = self.states() if states else None
        fresh = unprocessed(rows, seq, before)
        staging = f"{self.path}/_staging-{uuid.uuid4().hex}"
        # the input is frozen, so that output and intervals see the same rows
        fresh.write.parquet(f"{staging}/input")
        frozen = self.spark.read.schema(fresh.schema).parquet(f"{staging}/input")
        if states:
            output, kept = process(frozen, known)
            kept.write.parquet(f"{staging}/states")
        else:
            output = process(frozen)
        output.write.parquet(f"{staging}/output")
        merge_intervals(before, frozen, seq).write.parquet(f"{staging}/intervals")
        drop_path(self.spark, f"{staging}/input")
        name = f"c{number:010d}"
        if rename(self.spark, staging, f"{self.path}/{name}"):
            return name
        drop_path(self.spark, staging)
        return None
