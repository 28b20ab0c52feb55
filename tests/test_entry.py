import os
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = Path(os.environ.get("FIGMILL_TEST_DATA", "/root/testdata/sf0.001"))
NAMES = [n for n in entry.queries() if "figmill.llm" not in entry.queries()[n].__module__]

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


def value(v) -> str:
    """A value as text: numbers alike whatever their type, NaN and null apart."""
    if isinstance(v, (bool, int, float, Decimal)):
        v = float(v)
        return "NaN" if v != v else str(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sql, name):
    df = entry.queries()[name](spark, str(DATA))
    names = sorted(df.columns)
    got = sorted(tuple(value(r[c]) for c in names) for r in df.collect())
    if name in entry.oracle_sql():
        want = sql.execute(entry.oracle_sql()[name])
        columns = [d[0] for d in want.description]
        assert sorted(columns) == names
        order = [columns.index(c) for c in names]
        assert got == sorted(tuple(value(r[i]) for i in order) for r in want.fetchall())
    else:
        assert name in ("ref_negative_pairs", "ref_pipeline") and got


def test_entry(spark):
    assert entry.entry(spark).count() > 0
