"""Exact duplicates by composable polynomial fingerprints.

A text's bytes are cut into chunks. Each chunk has a polynomial hash modulo
two primes; the hash of two adjoining pieces is ``left * base**len(right) +
right``, so chunks can be hashed in parallel, in any grouping, and put
together afterwards. Texts with equal fingerprints are then compared chunk by
chunk as sorted streams: a fingerprint is confirmed when, at every chunk
position, the smallest and the largest chunk of its rows are the same. Rows of
a fingerprint that fails this (a true collision) are told apart by SHA-256.

Scale: the texts themselves meet only in the comparison, which is a
map-side-combined aggregate, so a group with a third of all rows sends one row
per chunk and map task; texts of groups of one aren't compared. Everything else
moves rows of fixed width, those of one group dealt to several tasks.

Defined results: a null text counts as empty, empty texts are equal to each
other; a null doc_id sorts last; of rows that repeat doc_id and text exactly
one is kept; no rows in, no rows out; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.skew import fresh, sieve, sifted, spread_join
from stowage.llm.words import rows_by_bytes
from stowage.llm.workers import lean
from stowage.tables import Scratch, table

MODULI = (2147483629, 2147483587)
BASES = (911382323, 972663749)
CHUNK = 4096
COMPARE_CHUNK = 1 << 16
#: Longer texts are hashed in parts of this size.
HUGE_BYTES, PART_BYTES = 32 << 20, 4 << 20
SPACES = "[\\x20\\x09-\\x0D]+"
#: Parts of a document that are put together at once.
PART_RUN = 4096
#: Keys up to this many bytes are broadcast to pick the rows worth comparing or moving; beyond it a bitmap of fixed size is.
BROADCAST_BYTES = 32 << 20
#: What a dropped row's key takes in a broadcast, at most.
GONE_BYTES = 160
_GAPS = bytes.maketrans(b"\t\n\v\f\r", b"     ")


def normalise(text: str | None) -> bytes:
    """UTF-8 with each run of space, tab, line feed, vertical tab, form feed and carriage return as one space."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(_GAPS)
    while b"  " in raw:
        raw = raw.replace(b"  ", b" ")
    return raw


class Fingerprinter:
    """Hashes of byte strings, and their composition, for given moduli."""

    def __init__(self, moduli: tuple[int, int] = MODULI, chunk: int = CHUNK) -> None:
        self.moduli, self.chunk = moduli, chunk
        down = [[pow(b, i, p) for i in range(chunk - 1, -1, -1)] for b, p in zip(BASES, moduli, strict=True)]
        # 257 * 2**31 * 4096 < 2**53, so floating-point dot products are exact
        self.weights = np.array(down, np.float64).T

    def of_chunks(self, data: bytes) -> list[tuple[int, int]]:
        """The hash of each chunk, the first of them being the shorter one."""
        if not data:
            return []
        rows = -(-len(data) // self.chunk)
        grid = np.zeros(rows * self.chunk)
        grid[rows * self.chunk - len(data) :] = np.frombuffer(data, np.uint8)
        grid[rows * self.chunk - len(data) :] += 1
        sums = grid.reshape(rows, self.chunk) @ self.weights
        return [(int(x) % self.moduli[0], int(y) % self.moduli[1]) for x, y in sums]

    def shift(self, length: int) -> tuple[int, int]:
        """What a hash is multiplied by when ``length`` bytes follow."""
        return pow(BASES[0], length, self.moduli[0]), pow(BASES[1], length, self.moduli[1])

    def combine(self, left: tuple[int, int], right: tuple[int, int], right_length: int) -> tuple[int, int]:
        s = self.shift(right_length)
        return tuple((x * m + y) % p for x, y, m, p in zip(left, right, s, self.moduli, strict=True))

    def of(self, data: bytes) -> tuple[int, int]:
        x = y = 0
        s, t = self.shift(self.chunk)
        p, q = self.moduli
        for a, b in self.of_chunks(data):
            x, y = (x * s + a) % p, (y * t + b) % q
        return x, y


FACTS = "row_id long, doc_id long, hash_a long, hash_b long, n_bytes long, text_sha256 string"
KEY = ["hash_a", "hash_b", "n_bytes"]


def fingerprint(df: DataFrame, moduli: tuple[int, int] = MODULI, huge_bytes: int = HUGE_BYTES) -> DataFrame:
    """One row of fixed width per row of ``df`` (doc_id, text). Texts over ``huge_bytes`` are hashed in parts by several tasks."""

    def run(batches: Iterable[pa.RecordBatch]):
        maker = Fingerprinter(moduli)
        for batch in rows_by_bytes(batches, 2):
            texts = [normalise(t) for t in batch.column(2).to_pylist()]
            marks = [maker.of(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    batch.column(1),
                    pa.array([m[0] for m in marks], pa.int64()),
                    pa.array([m[1] for m in marks], pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                ],
                names=["row_id", "doc_id", "hash_a", "hash_b", "n_bytes", "text_sha256"],
            )

    rows = df.select(F.monotonically_increasing_id().alias("row_id"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    is_huge = F.coalesce(F.octet_length("text") > huge_bytes, F.lit(False))
    small = rows.where(~is_huge).mapInArrow(lean(run), FACTS)
    huge = rows.where(is_huge).select("row_id", "doc_id", F.regexp_replace("text", SPACES, " ").cast("binary").alias("data"))
    numbers = F.sequence(F.lit(0), F.floor((F.octet_length("data") - 1) / PART_BYTES).cast("int"))
    parts = huge.select("row_id", "data", F.explode(numbers).alias("no")).select("row_id", "no", F.substring("data", F.col("no") * PART_BYTES + 1, F.lit(PART_BYTES)).alias("part"))
    made = fingerprint_parts(parts.repartition("row_id", "no"), "row_id", "no", "part", moduli)
    told = huge.select("row_id", "doc_id", F.sha2("data", 256).alias("text_sha256")).join(made, "row_id")
    return small.unionByName(told.select(*small.columns))


def fingerprint_parts(parts: DataFrame, key: str, number: str, data: str, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """Fingerprints of documents that lie in several rows: (key, part number, bytes).

    Each part is hashed where it lies; only hashes and lengths are shuffled.
    Gives (key, hash_a, hash_b, n_bytes), as ``fingerprint`` of the joined
    bytes would. Null parts count as empty.
    """

    def run(batches: Iterable[pa.RecordBatch]):
        maker = Fingerprinter(moduli)
        for batch in batches:
            raw = [x or b"" for x in batch.column(2).to_pylist()]
            marks = [(*maker.of(x), *maker.shift(len(x))) for x in raw]
            made = [pa.array([m[i] for m in marks], pa.int64()) for i in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made, pa.array([len(x) for x in raw], pa.int64())], names=["key", "no", "a", "b", "s", "t", "n"])

    kind = dict(parts.dtypes)[key]
    rows = parts.select(F.col(key).alias("key"), F.col(number).cast("long").alias("no"), F.col(data).cast("binary").alias("data"))
    rows = rows.mapInArrow(lean(run), f"key {kind}, no long, a long, b long, s long, t long, n long")
    p, q = (F.lit(m).cast("long") for m in moduli)

    def fold(ordered: Column) -> Column:
        one = F.struct(*(F.lit(x).cast("long").alias(n) for n, x in zip("abst", (0, 0, 1, 1), strict=True)))
        return F.aggregate(ordered, one, lambda x, y: F.struct(((x.a * y.s + y.a) % p).alias("a"), ((x.b * y.t + y.b) % q).alias("b"), (x.s * y.s % p).alias("s"), (x.t * y.t % q).alias("t")))

    # runs of parts first, so that no task holds all parts of a document
    made = rows.withColumn("run", F.floor(F.col("no") / PART_RUN))
    for by in (["key", "run"], ["key"]):
        place = F.col("no") if "run" in by else F.col("run").alias("no")
        ordered = F.array_sort(F.collect_list(F.struct(place, "a", "b", "s", "t")))
        made = made.groupBy(*by).agg(fold(ordered).alias("h"), F.sum("n").alias("n")).select(*by, "h.*", "n")
    return made.select(F.col("key").alias(key), F.col("a").alias("hash_a"), F.col("b").alias("hash_b"), F.col("n").alias("n_bytes"))


def chunk_rows(df: DataFrame, moduli: tuple[int, int] = MODULI, size: int = COMPARE_CHUNK) -> DataFrame:
    """(fingerprint, chunk number, chunk) of each row's normalised text."""

    def run(batches: Iterable[pa.RecordBatch]):
        maker = Fingerprinter(moduli)
        schema = pa.schema([(k, pa.int64()) for k in [*KEY, "chunk_no"]] + [("chunk", pa.binary())])
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            held = 0
            for value in batch.column(0):
                data = normalise(value.as_py())
                a, b = maker.of(data)
                for i in range(0, len(data), size):
                    for col, x in zip(cols, (a, b, len(data), i // size, data[i : i + size]), strict=True):
                        col.append(x)
                held += len(data)
                if held > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)
                    cols, held = [[], [], [], [], []], 0
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)

    return df.select(F.col("text").cast("string").alias("text")).mapInArrow(lean(run), "hash_a long, hash_b long, n_bytes long, chunk_no long, chunk binary")


def collisions(df: DataFrame, groups: DataFrame, small: bool, moduli: tuple[int, int] = MODULI) -> DataFrame:
    """Fingerprints of ``groups`` whose rows aren't all the same text."""
    parts = chunk_rows(df, moduli)
    if small:
        parts = parts.join(F.broadcast(groups.select(*KEY)), KEY, "left_semi")
    else:
        parts = sifted(parts, sieve(groups, F.xxhash64(*KEY)), F.xxhash64(*KEY)).where("_maybe").drop("_maybe")
    ends = parts.groupBy(*KEY, "chunk_no").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most"))
    return ends.where(F.col("least") != F.col("most")).select(*KEY).distinct()


def exact_duplicates(df: DataFrame, moduli: tuple[int, int] = MODULI, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(row_id, doc_id, keep_id, group_size, kept, text_sha256, fingerprint) for each row of ``df`` (doc_id, text)."""
    scratch = Scratch(df.sparkSession)
    facts = scratch.store(fingerprint(df, moduli), "facts")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_id")).alias("first")
    groups = scratch.store(facts.groupBy(*KEY).agg(F.count(F.lit(1)).alias("group_size"), first), "groups")
    several = groups.where("group_size > 1")
    small = several.count() * 48 <= broadcast_bytes
    odd = scratch.store(collisions(df, several, small, moduli), "odd")
    if odd.isEmpty():
        joined = spread_join(facts, groups, KEY)
    else:
        told = spread_join(facts, odd.withColumn("odd", F.lit(True)), KEY, "left").withColumn("told", F.when(F.col("odd"), F.col("text_sha256")).otherwise(""))
        told = scratch.store(told, "told")
        joined = spread_join(told, told.groupBy(*KEY, "told").agg(F.count(F.lit(1)).alias("group_size"), first), [*KEY, "told"])
    return joined.select("row_id", "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", (F.col("row_id") == F.col("first.row_id")).alias("kept"), "text_sha256", *KEY)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """``docs`` without all but the first row of each group of equal texts, all columns as they were, whatever their names."""
    scratch = Scratch(docs.sparkSession)
    found = exact_duplicates(docs).groupBy("doc_id", "text_sha256").agg(F.bool_or("kept").alias("stays"), F.count(F.lit(1)).alias("rows"))
    found = scratch.store(found, "decisions")
    id_, theirs, own = fresh(docs, "_id", "_digest", "_own")
    gone = found.where("not stays").select(F.col("doc_id").alias(id_), F.col("text_sha256").alias(theirs))
    digest = F.sha2(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), SPACES, " ").cast("binary"), 256)
    rows = docs.withColumn(own, digest)
    equal = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(theirs))
    if gone.count() * GONE_BYTES <= BROADCAST_BYTES:  # then texts needn't move
        out = rows.join(F.broadcast(gone), equal, "left_anti")
    else:
        hashed = F.xxhash64(F.col("doc_id").cast("long"), F.col(own))
        tested = sifted(rows, sieve(gone, F.xxhash64(id_, theirs)), hashed)
        out = tested.where("not _maybe").drop("_maybe").unionByName(tested.where("_maybe").drop("_maybe").join(gone, equal, "left_anti"))
    # rows that repeat doc_id and text stay together; only where there are any, one of each is picked
    if not found.where("stays and rows > 1").isEmpty():
        out = out.dropDuplicates(["doc_id", own])
    return out.drop(own)


ORACLE_SQL = """
with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') as norm from documents),
     g as (select norm, min(doc_id) as keep_id, count(*) as group_size from t group by norm)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, sha256(t.norm) as text_sha256 from t join g on t.norm = g.norm
"""
