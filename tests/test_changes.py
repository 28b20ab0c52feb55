from datetime import datetime as D

import pytest
from pyspark.sql import functions as F

from figmill.operators import changes as C
from figmill.operators.runs import as_of, compress

SCHEMA = "row_no long, pmcid string, status string, attempts int, updated_at string, received_at timestamp_ntz, bucket int, covered string"


def rows(spark, data):
    return spark.createDataFrame([(*r, 1, "clash") for r in data], SCHEMA)


def test_runs_and_as_of(spark):
    keys = spark.createDataFrame([(1,), (2,), (3,), (3,), (7,), (None,), (65535,), (65536,), (-5,), (-4,)], "k long")
    got = sorted((r["lo"], r["hi"]) for r in compress(keys, "k").collect())
    assert got == [(-5, -4), (1, 3), (7, 7), (65535, 65535), (65536, 65536)]
    pts = spark.createDataFrame([(0, "a"), (2, "b"), (4, "c"), (7, "d"), (65536, "e"), (-4, "f")], "k long, p string")
    got = {r["p"]: r["covered"] for r in as_of(pts, "k", compress(keys, "k")).collect()}
    assert got == {"a": False, "b": True, "c": False, "d": True, "e": True, "f": True}


def test_changed_articles(spark):
    t = lambda d: D(2026, 1, d)
    data = [
        (1, "PMC1", "NEW", 0, "2026-01-01T00:00:00Z", t(1)), (2, "pmc 1", "new ", None, "2026-01-02T00:00:00Z", t(9)),      # same state, late
        (3, "PMC2", "NEW", 0, "2026-01-01T00:00:00Z", t(1)), (4, "2", "DONE", 0, "20260102T000000Z", t(9)),               # changed
        (5, "PMC3", "NEW", 0, None, t(9)),                                                                                 # new
        (6, "PMC4", "NEW", 0, "2026-01-05T00:00:00Z", t(1)), (7, "PMC4", "DONE", 3, "2026-01-04T23:30:00-01:00", t(9)),   # later instant by zone
        (8, "PMC5", "DONE", 1, "2026-01-05 00:00:00", t(1)), (9, "PMC5", "NEW", 0, "2026-01-04", t(9)),                   # older version arrives late
        (10, "PMC6", None, None, None, t(1)), (11, "PMC6", None, None, None, t(9)),                                        # nulls, no change
        (12, None, "NEW", 0, None, t(9)), (13, "none", "NEW", 0, None, t(9)),
        (14, "PMC7", "NEW", 0, "2026-01-05T00:00:00Z", t(1)), (15, "PMC7", "DONE", 0, "2026-01-05T00:00:00Z", t(9)),      # tie: smaller row
    ]
    a = rows(spark, data)
    log = spark.createDataFrame([(1, "OK", t(3)), (2, " ok", t(2)), (3, "failed", t(8)), (4, None, t(9))], "run_id long, outcome string, cutoff_at timestamp_ntz")
    iv = C.intervals_until(a, "row_no", "received_at", C.last_success(log))
    got = {r["pmcid"]: r for r in C.changed_articles(a, iv).collect()}
    assert sorted(got) == ["PMC2", "PMC3", "PMC4"]
    assert got["PMC3"]["is_new"] and got["PMC4"]["status"] == "DONE" and got["PMC4"]["attempts_before"] == 0
    none = C.intervals_until(a, "row_no", "received_at", C.last_success(log.where("false")))
    assert C.changed_articles(a, none).count() == 7
    assert C.changed_articles(a.where("false"), iv).count() == 0


def test_intervals_merge(spark):
    old = spark.createDataFrame([(0, 1, 4), (0, 10, 12)], "bucket long, lo long, hi long")
    done = spark.createDataFrame([(5,), (6,), (9,), (20,), (70000,)], "row_no long")
    got = sorted((r["lo"], r["hi"]) for r in C.merge_intervals(old, done, "row_no").collect())
    assert got == [(1, 6), (9, 12), (20, 20), (70000, 70000)]


def test_ledger_survives_failures(spark, tmp_path):
    path = f"file://{tmp_path}/ledger"
    ledger = C.IntervalLedger(spark, path)
    make = lambda ids: spark.createDataFrame([(i, f"v{i}") for i in ids], "row_no long, v string")
    assert ledger.run(make([1, 2, 5]), "row_no", lambda df: df) == "c0000000000"
    with pytest.raises(ZeroDivisionError):
        ledger.run(make([1, 2, 3, 5, 6]), "row_no", lambda df: 1 / 0)
    assert ledger.output().count() == 3
    # 3 and 4 commit late, inside the range that was already seen
    ledger.run(make([1, 2, 3, 4, 5, 6]), "row_no", lambda df: df.withColumn("v", F.upper("v")))
    ledger.run(make([1, 2, 3, 4, 5, 6]), "row_no", lambda df: df)
    out = sorted(r["row_no"] for r in ledger.output().collect())
    assert out == [1, 2, 3, 4, 5, 6]
    assert sorted((r["lo"], r["hi"]) for r in ledger.intervals().collect()) == [(1, 6)]


def test_two_runs_at_once_commit_once(spark, tmp_path):
    ledger = C.IntervalLedger(spark, f"file://{tmp_path}/ledger")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "row_no long, v string")
    inner = []

    def slow(rows):
        if not inner:
            inner.append(None)
            inner.append(ledger.run(df, "row_no", slow))
        return rows

    assert ledger.run(df, "row_no", slow) is None and inner[1] == "c0000000000"
    assert ledger.output().count() == 2 and len(ledger._commits()) == 1


def test_states_are_kept(spark, tmp_path):
    t = D(2026, 1, 1)
    data = [(1, "PMC1", "NEW", 0, "2026-01-01T00:00:00Z", t), (2, "PMC2", "NEW", 0, "2026-01-01T00:00:00Z", t), (3, "1", "DONE", 0, "2026-01-02T00:00:00Z", t), (4, "PMC2", "OLD", 0, "2025-01-02T00:00:00Z", t), (5, "PMC3", "NEW", None, None, t)]
    ledger = C.IntervalLedger(spark, f"file://{tmp_path}/ledger")
    out = []
    for n in (2, 3, 5, 5):
        name = ledger.run(rows(spark, data[:n]), "row_no", C.article_changes, states=True)
        out.append(sorted((r["pmcid"], r["is_new"], r["status"]) for r in ledger.output(name).collect()))
    assert out == [[("PMC1", True, "NEW"), ("PMC2", True, "NEW")], [("PMC1", False, "DONE")], [("PMC3", True, "NEW")], []]


def test_longest_ranges(spark):
    n = 1 << 16
    iv = spark.createDataFrame([(0, 0, n - 1), (1, n, 2 * n - 1), (2, 2 * n, 2 * n + 5), (2, 2 * n + 9, 2 * n + 9), (4, 4 * n, 5 * n - 1)], "bucket long, lo long, hi long")
    assert C.longest_ranges(iv, 3) == [(0, 2 * n - 1), (4 * n, 5 * n - 1), (2 * n, 2 * n + 5)]
    rows = spark.createDataFrame([(-1,), (0,), (2 * n + 5,), (2 * n + 6,), (2 * n + 9,), (3 * n,), (4 * n,), (5 * n,), (None,)], "row_no long")
    assert sorted(r[0] for r in C.unprocessed(rows, "row_no", iv).collect()) == [-1, 2 * n + 6, 3 * n, 5 * n]
    assert "PushedFilters: []" not in C.outside(spark.read.parquet("/root/testdata/sf0.001/articles.parquet"), "row_no", [(5, 9)])._jdf.queryExecution().toString()
