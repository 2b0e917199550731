"""Every registered query of the archive engine against its SQL, at the smallest scale."""

import os

import duckdb
import pytest

from stowage.plans import catalog_queries
from stowage.plans.catalog_queries import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return c


def plain(df):
    cols = sorted(df.columns)
    rows = df[cols].astype(object).where(df[cols].notna(), None).itertuples(index=False, name=None)
    return cols, sorted(repr(tuple(int(v) if isinstance(v, float) and v == int(v) else v for v in r)) for r in rows)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in ORACLE_SQL:
        assert plain(got) == plain(duck.execute(ORACLE_SQL[name]).df())
    else:
        assert len(got)


def test_extract_by_prefix_writes_all_documents(spark, monkeypatch):
    made, write = [], catalog_queries.written
    monkeypatch.setattr(catalog_queries, "written", lambda *a: made.append(write(*a)) or made[0])
    got = QUERIES["extract_by_prefix"](spark, DATA).count()
    assert got < made[0].count() == spark.read.parquet(f"{DATA}/documents.parquet").count()
