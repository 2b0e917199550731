"""Documents that hold benchmark items, by SimHash of item-sized windows and exact verification.

Texts become lower-case words without punctuation; a text's shingles are its
runs of five words, weighted by how often each occurs (an item with fewer
words is one shingle). For each item length a window of that many words slides
over a document word by word. A window needs at least ``THRESHOLD`` of an
item's shingles, so windows with fewer shingles of items of that length are
passed over: running sums of hits show this without looking at each window.

The 128-bit SimHash of each window left is looked up in a multi-index: the
bits are cut into ``BLOCKS`` blocks with thresholds such that a fingerprint within
the radius differs in at least one block by no more than that block's. At similarity 0.8 the expected distance is 19
bits with a standard deviation of 4, and the radius lies 4 deviations above.
Candidates within the radius are verified by exact weighted Jaccard similarity.

Scale: one map over documents for each block of the benchmark; a block holds
items of about ``BLOCK_BYTES``, so what is sent to tasks is bounded whatever
the benchmark's size. With several blocks each one's result is written out before
the next is read, so the driver holds one at a time. No shuffle of documents.

Defined results: null or empty texts and items without words match nothing;
repeated documents or items each give their own rows; of a pair's windows the
most similar is reported, the first of equals; no rows in, no rows out; other
columns are ignored (``clean`` keeps them).
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.words import ONLY_WORDS, U, Words, chunks, mix, rows_by_bytes
from stowage.llm.workers import lean
from stowage.tables import Scratch, table

WIDTH = 5
THRESHOLD = 0.8
BITS = 128
RADIUS = 36
BLOCKS = 8
BLOCK_BYTES = 4 << 20


def fold(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def simhash(grams: np.ndarray) -> np.ndarray:
    """The fingerprint of a bag of shingles as two 64-bit numbers."""
    both = np.stack([mix(grams), mix(grams + U(0x9E3779B97F4A7C15))], 1)
    bits = np.unpackbits(both.view(np.uint8).reshape(len(grams), BITS // 8), axis=1)
    return np.packbits(2 * bits.sum(0, dtype=np.int64) > len(grams)).view(U)


def similarity(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags."""
    shared = sum(min(n, b[g]) for g, n in a.items() if g in b)
    return shared / (a.total() + b.total() - shared)


def thresholds(radius: int, blocks: int) -> list[int]:
    """Bits by which each block may differ, so that of any two prints within the radius some block does: one less in all would let one slip."""
    least, more = divmod(radius + 1 - blocks, blocks)
    return [least + (i < more) for i in range(blocks)]


@cache
def masks(bits: int, most: int) -> np.ndarray:
    """Every number of ``bits`` bits of which at most ``most`` are set, fewest first."""
    count = np.bitwise_count(np.arange(1 << bits, dtype=np.int64))
    return np.argsort(count, kind="stable")[: int((count <= most).sum())]


class MultiIndex:
    """Fingerprints by blocks of bits: ``near(f)`` gives all within the radius, and their distances.

    Two prints within the radius differ in one of the blocks by no more than its
    threshold (see ``thresholds``). Each block has a table of its values; a
    look-up goes to all values that near. Of unrelated prints about a fifth are met so
    and then compared, at 128 bits, 8 blocks and a radius of 36.
    """

    def __init__(self, prints: np.ndarray, radius: int = RADIUS, blocks: int = BLOCKS) -> None:
        self.prints, self.radius = prints, radius
        self.bits = BITS // blocks
        self.most = thresholds(radius, blocks)
        values = self._values(prints)
        self.order = [np.argsort(v, kind="stable") for v in values]
        edges = np.arange((1 << self.bits) + 1)
        self.starts = [np.searchsorted(v[o], edges).astype(np.int32) for v, o in zip(values, self.order, strict=True)]

    def _values(self, prints: np.ndarray) -> list[np.ndarray]:
        per_word = 64 // self.bits
        return [(prints[:, i // per_word] >> U(self.bits * (i % per_word)) & U((1 << self.bits) - 1)).astype(np.int64) for i in range(len(self.most))]

    def met(self, print_: np.ndarray) -> np.ndarray:
        """The numbers of the prints that some block brings up."""
        hit = np.zeros(len(self.prints), bool)
        for value, most, order, starts in zip(self._values(print_[None, :]), self.most, self.order, self.starts, strict=True):
            if most < 0:
                continue
            near = masks(self.bits, most) ^ value[0]
            first, size = starts[near], starts[near + 1] - starts[near]
            used = np.flatnonzero(size)
            first, size = first[used], size[used]
            at = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
            hit[order[at]] = True
        return np.flatnonzero(hit)

    def near(self, print_: np.ndarray) -> list[tuple[int, int]]:
        found = self.met(print_)
        distance = np.bitwise_count(self.prints[found] ^ print_).sum(1)
        return [(int(i), int(d)) for i, d in zip(found, distance, strict=True) if d <= self.radius]


class Items:
    """Benchmark items, prepared for scanning. ``rows``: (item_id, text)."""

    def __init__(self, rows: list[tuple[int | None, str | None]], threshold: float = THRESHOLD) -> None:
        self.threshold = threshold
        self.block, self.blocks = 0, 1
        self.ids, self.bags, prints, kinds = [], [], [], []
        for item_id, text in rows:
            words = Words([fold(text)], kinds=ONLY_WORDS)
            n = len(words.hashes)
            if not n:
                continue
            width = min(WIDTH, n)
            grams = words.ngrams(width)[: n - width + 1]
            self.ids.append(item_id)
            self.bags.append(Counter(grams.tolist()))
            prints.append(simhash(grams))
            kinds.append((width, n))
        self.kinds = kinds
        self.index = MultiIndex(np.array(prints, U).reshape(-1, 2))
        #: per shingle width the item shingles, sorted, the least item length, and the item lengths of each shingle
        self.widths = {}
        for width in sorted({w for w, _ in kinds}):
            lengths: dict[int, set[int]] = {}
            for i in (i for i, k in enumerate(kinds) if k[0] == width):
                for g in self.bags[i]:
                    lengths.setdefault(g, set()).add(kinds[i][1])
            self.widths[width] = np.array(sorted(lengths), U), min(set.union(*lengths.values())), lengths

    def scan(self, texts: list[str | None]):
        """(text number, item number, similarity, first word, words, distance) of each match."""
        raw = [fold(t) for t in texts]
        for a, b in chunks(raw):
            words = Words(raw[a:b], kinds=ONLY_WORDS)
            for width, (known, shortest, lengths) in self.widths.items():
                grams = words.ngrams(width)
                hit = known[np.minimum(np.searchsorted(known, grams), len(known) - 1)] == grams
                sums = np.concatenate([[0], np.cumsum(hit)])
                least = self.threshold * (shortest - width + 1)
                for i in range(b - a):
                    lo, hi = words.first[i], words.first[i + 1]
                    if hi - lo >= width and sums[hi - width + 1] - sums[lo] >= least:
                        yield from ((a + i, *m) for m in self._windows(grams[lo : hi - width + 1], np.flatnonzero(hit[lo : hi - width + 1]), width, lengths))

    def _windows(self, grams: np.ndarray, hits: np.ndarray, width: int, lengths: dict[int, set[int]]):
        best: dict[int, tuple] = {}
        n = len(grams)
        starts = np.arange(n)
        by_length: dict[int, list[int]] = {}
        for at, gram in zip(hits.tolist(), grams[hits].tolist(), strict=True):
            for length in lengths[gram]:
                by_length.setdefault(length, []).append(at)
        for length, own in sorted(by_length.items()):
            shingles = length - width + 1
            if len(own) < self.threshold * shingles - 1e-9:
                continue
            ends = np.minimum(starts + shingles, n)
            sums = np.zeros(n + 1, np.int64)
            sums[np.array(own) + 1] = 1
            sums = np.cumsum(sums)
            for s in np.flatnonzero(sums[ends] - sums[:-1] >= self.threshold * shingles - 1e-9):
                window = grams[s : ends[s]]
                bag = None
                for item, distance in self.index.near(simhash(window)):
                    if self.kinds[item] != (width, length):
                        continue
                    bag = bag or Counter(window.tolist())
                    found = similarity(bag, self.bags[item])
                    if found >= self.threshold and (item not in best or found > best[item][1]):
                        best[item] = (item, found, int(s), int(ends[s] - s + width - 1), distance)
        return best.values()


def item_blocks(benchmark: DataFrame, block_bytes: int = BLOCK_BYTES):
    """The benchmark in blocks of about ``block_bytes`` of text, each as ``Items`` with its number and the number of blocks."""
    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-int(total) // block_bytes))
    for block in range(blocks):
        part = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        items = Items([tuple(r) for r in part.orderBy("item_id", "text").collect()])
        items.block, items.blocks = block, blocks
        yield items


MATCHES = "doc_id long, item_id long, similarity double, first_word long, n_words long, distance int"


def matches(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document and item that it holds."""

    def scanner(items: Items):
        def run(batches: Iterable[pa.RecordBatch]):
            for batch in rows_by_bytes(batches, 1):
                ids = batch.column(0).to_pylist()
                rows = [(ids[i], items.ids[j], *rest) for i, j, *rest in items.scan(batch.column(1).to_pylist())]
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in MATCHES.split(", ")])

        return run

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    scratch, found = Scratch(docs.sparkSession), None
    for items in item_blocks(benchmark, block_bytes):
        part = rows.mapInArrow(lean(scanner(items)), MATCHES)
        if items.blocks > 1:
            part = scratch.store(part, f"matches{items.block}")
        found = part if found is None else found.unionByName(part)
    return found


def clean(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without documents that hold an item, all columns as they were."""

    def keeper(items: Items, column: int):
        def run(batches: Iterable[pa.RecordBatch]):
            for batch in rows_by_bytes(batches, column):
                held = {i for i, *_ in items.scan(batch.column(column).to_pylist())}
                yield batch.filter(pa.array([i not in held for i in range(batch.num_rows)], pa.bool_()))

        return run

    scratch = Scratch(docs.sparkSession)
    for items in item_blocks(benchmark, block_bytes):
        docs = docs.mapInArrow(lean(keeper(items, docs.columns.index("text"))), docs.schema)
        if items.block + 1 < items.blocks:
            docs = scratch.store(docs, f"clean{items.block}")
            scratch.drop(f"clean{items.block - 1}")
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
