import hashlib
import random
import re

from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F

from stowage.llm import exact_dedup as d


def brute(rows):
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in rows]
    out = []
    for (i, _), n in zip(rows, norm, strict=True):
        same = [j for (j, _), m in zip(rows, norm, strict=True) if m == n]
        out.append((i, min((x for x in same if x is not None), default=None), len(same), hashlib.sha256(n.encode()).hexdigest()))
    return sorted(out, key=str)


ROWS = [(5, "a  b"), (3, "a\tb"), (9, None), (2, ""), (7, "a b"), (8, " a b"), (3, "a b"), (None, "a\r\n b"), (11, "x" * 300_000), (10, "x" * 300_000), (12, "x" * 299_999 + "y"), (None, "lone")]


def check(spark, rows, **kw):
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit(1)).withColumn("hash_a", F.lit("clash"))
    got = d.exact_duplicates(df, **kw).collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got), key=str) == brute(rows)
    groups = {}
    for r in got:
        groups.setdefault(r.text_sha256, []).append(r)
    for g in groups.values():
        assert sum(r.kept for r in g) == 1
        assert all(r.doc_id == r.keep_id for r in g if r.kept)


def test_against_brute_force(spark):
    check(spark, ROWS)
    check(spark, ROWS, broadcast_bytes=0)
    check(spark, [])


def test_collisions_are_told_apart(spark):
    rng = random.Random(1)
    rows = [(i, "".join(rng.choice("ab") for _ in range(4))) for i in range(200)]
    check(spark, rows, moduli=(3, 2))


@given(st.binary(max_size=300), st.binary(max_size=300))
def test_hashes_compose(a, b):
    maker = d.Fingerprinter(chunk=16)
    assert maker.combine(maker.of(a), maker.of(b), len(b)) == maker.of(a + b)
    assert maker.of(a) == d.Fingerprinter().of(a)


def test_parts(spark):
    rows = [("x", 1, b"hello "), ("x", 2, b"world"), ("y", 0, b""), ("x", 3, None), (None, 1, b"hello world")]
    got = {r[0]: tuple(r)[1:] for r in d.fingerprint_parts(spark.createDataFrame(rows, "k string, no int, data binary"), "k", "no", "data").collect()}
    want = (*d.Fingerprinter().of(b"hello world"), 11)
    assert got == {"x": want, None: want, "y": (0, 0, 0)}


def test_keep_first(spark):
    df = spark.createDataFrame([(*r, "de", n) for n, r in enumerate(ROWS)], "doc_id long, text string, lang string, n_chars int")
    out = d.keep_first(df)
    assert out.columns == df.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted(["3", "2", "7", "8", "10", "12", "None"])


def test_stages_keep_columns_of_any_name(spark):
    rows = [(1, "a b", "x", 1), (2, "a  b", "y", 2), (3, None, None, 3), (4, "", "z", 4), (4, "", "z", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _own string, _ID int").withColumn("_digest", F.lit(1)).withColumn("_maybe_", F.lit(2))
    kept = d.keep_first(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r)[:4] for r in kept.collect()) == [(1, "a b", "x", 1), (3, None, None, 3)]


def test_beyond_the_broadcast_limit(spark, monkeypatch):
    rows = [(i, f"text {i % 40}" if i < 300 else f"own {i}") for i in range(500)] + [(None, "text 1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = sorted(map(tuple, d.exact_duplicates(docs).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    kept = sorted(r.doc_id for r in d.keep_first(docs).collect())
    monkeypatch.setattr(d, "BROADCAST_BYTES", 0)
    got = sorted(map(tuple, d.exact_duplicates(docs, broadcast_bytes=0).select("doc_id", "keep_id", "group_size", "kept").collect()), key=str)
    assert got == want and kept == [*range(40), *range(300, 500)]
    assert sorted(r.doc_id for r in d.keep_first(docs).collect()) == kept


def test_huge_texts_are_hashed_in_parts(spark, monkeypatch):
    monkeypatch.setattr(d, "PART_BYTES", 7)
    rows = [(1, "é \t" * 40), (2, "a" * 50), (3, "short"), (4, None), (5, " " * 60), (6, "é  " * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    whole, parts = (sorted(map(tuple, d.fingerprint(docs, huge_bytes=n).drop("row_id").collect())) for n in (1 << 20, 20))
    assert whole == parts and len(whole) == 6
    assert whole[0][1:] == whole[5][1:]
