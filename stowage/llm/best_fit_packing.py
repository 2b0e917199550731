"""Packing token sequences by bounded-space online best fit.

A packer reads pieces one by one and puts each into the open bin with the
least free space that still holds it. Open bins are keyed by free space: bit f
of one integer says whether some open bin has f tokens free, so the best fit is
the lowest set bit at or above the piece's length. At most ``open_bins`` bins
are open; when one more is needed the fullest is closed. Pieces come in an order
that a hash makes, in waves of ``WAVE``; those of a wave are taken by falling
length, so that long ones don't come when only small gaps are left.

Scale: tokenising writes one row of numbers per piece. Those rows alone are
dealt evenly among packers (``pieces_per_packer`` each), whose memory is bounded by
their open bins and a wave; the number of packers grows with the input, and each
leaves at most its open bins unfilled.

Defined results: null texts are empty and give the closing id alone; a document
longer than a sequence is cut into full pieces after a shorter first one; null
or repeated doc_ids are packed like any other row; no rows in, no rows out.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.tokens import Encoder, Plan
from stowage.llm.words import rows_by_bytes
from stowage.llm.workers import lean
from stowage.tables import Scratch, table

CAPACITY = 2048
OPEN_BINS = 1024
PIECES_PER_PACKER = 100_000
#: Pieces that a packer looks at together and takes by falling length.
WAVE = 4 * OPEN_BINS


class BestFit:
    """The packer: ``place(length)`` gives (bin number, offset in the bin)."""

    def __init__(self, capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> None:
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0  # bit f: some open bin has f tokens free
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.open = self.made = 0

    def place(self, length: int) -> tuple[int, int]:
        if not 0 < length <= self.capacity:
            raise ValueError(f"a piece of {length} tokens in bins of {self.capacity}")
        fits = self.free >> length
        if fits:
            space = length + (fits & -fits).bit_length() - 1
            number = self.bins[space].pop()
            if not self.bins[space]:
                self.free ^= 1 << space
            self.open -= 1
        else:
            if self.open == self.open_bins:
                self._close_fullest()
            space, number = self.capacity, self.made
            self.made += 1
        left = space - length
        if left:
            self.bins[left].append(number)
            self.free |= 1 << left
            self.open += 1
        return number, self.capacity - space

    def _close_fullest(self) -> None:
        space = (self.free & -self.free).bit_length() - 1
        self.bins[space].pop()
        if not self.bins[space]:
            self.free ^= 1 << space
        self.open -= 1


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens; only the first may be shorter than the capacity."""
    if n <= capacity:
        return [(0, n)]
    head = n % capacity
    out = [(0, head)] if head else []
    return out + [(s, capacity) for s in range(head, n, capacity)]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end_id: int = 0) -> DataFrame:
    """One row per piece of each document's ids followed by ``end_id``."""
    plan = Plan(tokenizer)

    def run(batches: Iterable[pa.RecordBatch]):
        encode = Encoder(plan)
        tail = np.array([end_id], "<u4").tobytes()
        schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in rows_by_bytes(batches, 1):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = encode(text or "") + tail
                for i, (start, length) in enumerate(cut(len(data) // 4, capacity)):
                    rows.append((doc_id, i, start, length, zlib.crc32(data[4 * start : 4 * (start + length)])))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), PIECES)


def pack(found: DataFrame, n_pieces: int, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, per_packer: int = PIECES_PER_PACKER) -> DataFrame:
    """``found`` with ``sequence_id`` and ``offset``; it must be a stored table, so that a repeated task sees the same rows."""

    names = [*found.columns, "sequence_id", "offset"]

    def run(batches: Iterable[pa.RecordBatch]):
        packer = BestFit(capacity, open_bins)
        base = TaskContext.get().partitionId() << 40
        for wave in waves(batches, WAVE):
            wave = wave.take(pa.compute.sort_indices(wave, [("length", "descending")]))
            places = [packer.place(n) for n in wave.column("length").to_pylist()]
            wave = wave.append_column("sequence_id", pa.array([base + p[0] for p in places], pa.int64()))
            wave = wave.append_column("offset", pa.array([p[1] for p in places], pa.int64()))
            yield from wave.select(names).combine_chunks().to_batches()

    packers = max(1, -(-n_pieces // per_packer))
    dealt = found.repartition(packers).sortWithinPartitions(F.xxhash64("doc_id", "piece", "ids_crc32"), "doc_id", "piece", "ids_crc32")
    return dealt.mapInArrow(lean(run), f"{PIECES}, sequence_id long, offset long")


def waves(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of ``batches`` in tables of ``rows`` each; the last may be shorter."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        while batch.num_rows:
            held.append(batch.slice(0, rows - size))
            size += held[-1].num_rows
            batch = batch.slice(held[-1].num_rows)
            if size == rows:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) with their places; ``tokenizer`` is the path of a tokenizer file."""
    scratch = Scratch(docs.sparkSession)
    path = tokenizer or public_tokenizers.path("byte_bpe_50k.json")
    found = scratch.store(pieces(docs, path, capacity), "pieces")
    return pack(found, found.count(), capacity)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
