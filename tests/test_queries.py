"""Every registered query of the engine against its SQL on the smallest tables."""

import os

import duckdb
import pytest

from rasterloom.plans.registry import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    rows = sorted(repr(tuple(r)) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    if name not in ORACLE_SQL:
        assert rows
        return
    wanted = duck.sql(ORACLE_SQL[name])
    assert sorted(wanted.columns) == columns
    assert rows == sorted(map(repr, wanted.project(", ".join(f'"{c}"' for c in columns)).fetchall()))
