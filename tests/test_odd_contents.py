"""Queries over documents with empty and null texts, against their SQL."""

import duckdb
import pytest

from stowage.plans.catalog_queries import ORACLE_SQL, QUERIES

TEXTS = ["", "a", None, "some words " * 900, "", "x" * 4096, "é" * 3000, "y" * 8192]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{d}/documents.parquet")
    return d


@pytest.mark.parametrize("name", ["block_reassemble", "code_length_kraft"])
def test_empty_and_null_texts(spark, odd, name):
    duck = duckdb.connect()
    duck.execute(f"create view documents as select * from '{odd}/documents.parquet/*.parquet'")
    want = duck.execute(ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(map(tuple, QUERIES[name](spark, odd).select(*columns).collect())) == sorted(want.fetchall())
