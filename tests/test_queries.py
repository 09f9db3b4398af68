"""Every registered query of the core against its SQL on the smallest shared tables, and its schema where it has none."""

import glob
import math
import os
from datetime import datetime

import pytest

from tidemark.plans import changes, engine_queries, reference

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no shared tables")
QUERIES = {**changes.QUERIES, **reference.QUERIES, **engine_queries.QUERIES}
SQL = {**changes.SQL, **reference.SQL, **engine_queries.SQL}


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None)
    return round(float(v), 6) if hasattr(v, "as_tuple") else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    if name in SQL:
        q = duck.execute(SQL[name])
        names = [x[0] for x in q.description]
        assert sorted(names) == cols
        assert got == sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in q.fetchall()), key=repr)
