"""The subpackage's queries with SQL give what DuckDB gives on the smallest tables."""
import math
from pathlib import Path

import pytest

from quillarn.llm import encode, queries

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists() or not Path(encode.VOCABULARY).exists(), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 5) + 0.0)
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return str(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_same_as_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    mine = sorted(str([plain(r[c]) for c in cols]) for r in df.collect())
    got = con.execute(queries.SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    assert mine == sorted(str([plain(r[names.index(c)]) for c in cols]) for r in got.fetchall())
