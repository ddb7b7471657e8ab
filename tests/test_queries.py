"""Every query with SQL gives what DuckDB gives on the smallest tables."""
import math
from pathlib import Path

import pytest

from quillarn.plans import corpus, qa, roster, study  # noqa: F401

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(roster.SQL))
def test_same_as_sql(spark, duck, name):
    df = roster.QUERIES[name](spark, DATA)
    mine = sorted(str([plain(r[c]) for c in sorted(df.columns)]) for r in df.collect())
    got = duck.execute(roster.SQL[name])
    cols = [d[0] for d in got.description]
    theirs = sorted(str([plain(r[cols.index(c)]) for c in sorted(cols)]) for r in got.fetchall())
    assert sorted(cols) == sorted(df.columns)
    assert mine == theirs


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(roster.SQL) <= set(e.oracle_sql()) and set(roster.QUERIES) <= set(e.queries())
