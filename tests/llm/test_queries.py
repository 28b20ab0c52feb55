"""The registered queries of the training-data problems against their SQL."""

import os
from pathlib import Path

import duckdb
import pytest

from figmill.llm import queries as Q

DATA = Path(os.environ.get("FIGMILL_TEST_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test data")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in DATA.glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query(spark, sql, name):
    got = Q.QUERIES[name](spark, str(DATA))
    rows = sorted(tuple(r[c] for c in sorted(got.columns)) for r in got.collect()) if name in Q.ORACLE else got.collect()
    if name in Q.ORACLE:
        want = sql.execute(Q.ORACLE[name])
        names = [d[0] for d in want.description]
        assert sorted(names) == sorted(got.columns)
        order = [names.index(c) for c in sorted(names)]
        assert rows == sorted(tuple(r[i] for i in order) for r in want.fetchall())
    else:
        assert name in ("p1_found", "p1_text", "p8_ids", "p9_leaks") and (rows or name == "p9_leaks")
