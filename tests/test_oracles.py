"""Every query that has SQL gives the rows of its SQL over the smallest tables."""

import math
from pathlib import Path

import duckdb
import pytest
from lathe.plans import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}") + 0.0
    if hasattr(v, "as_tuple"):
        return float(v)
    return v


@pytest.mark.skipif(not Path(SF).exists(), reason="the test tables aren't here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    if name not in SQL:
        assert got
        return
    result = con.execute(SQL[name])
    columns = [d[0] for d in result.description]
    assert sorted(columns) == sorted(df.columns)
    keys = sorted(columns)
    want = sorted((tuple(norm(r[columns.index(k)]) for k in keys) for r in result.fetchall()), key=repr)
    assert sorted((tuple(norm(r[k]) for k in keys) for r in got), key=repr) == want
