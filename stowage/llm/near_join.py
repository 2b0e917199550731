"""Exact Jaccard self-join of documents on word n-grams, split by set size.

Small sets (up to a size chosen by cost) are joined by enumerating subsets:
two sets of n and m shingles link exactly when they share c(n, m) of them, so
every subset of that size is a key, and sets that meet at a key link without
further checks. Large sets are joined by scanning inverted lists: in one
global order of shingles, frequent ones last, linked sets share a shingle
within their first n - ceil(t n) + 1, so only those are indexed. Small sets
near the boundary are indexed too, for partners beyond it.

Equal sets are one class from the start. In a list, sets are first compared
with the list's most central set alone; what links becomes one component. Then
only pairs of sets from different components are compared, which loses no
component and spares all pairs inside a group of copies. A pair meets in a
list only if enough of both sets follows there in the order; linked sets do so
at the first shingle they share, so one of them, the smaller, must come early
in some list, and sets that are merely akin mostly don't. Such pairs must pass
parity sketches, a short one while they are joined and one of about a bit per
shingle before texts are fetched: the sketches of two sets differ in at most
as many bits as the sets in elements, so they never drop a link. Remaining pairs are compared exactly.

Sets go by 64-bit numbers; where two different ones meet in a number (a second
number tells), they go by the second. Subset keys have 96 bits. Shingles are 64-bit
hashes, and "exact" comparison compares these.

Scale: lists are never gathered; hubs come from aggregates combined before
shuffling, pairs from joins. Joins on sets, hubs and components deal the rows of
a frequent key to several tasks. Only texts of sets that may link are moved:
they are found by a broadcast of their numbers, or beyond ``BROADCAST_BYTES`` of
these by a broadcast bitmap of fixed size before a shuffle. Which shingles are
frequent is a bounded list (``HEAVY``) that only sets the order: results don't
depend on it, and the more frequent come later. It is made from counts over all
documents, and made anew from the counts of the lists themselves if lists
longer than ``SHORT_LIST`` hold more pairs than there are sets, then again while
a list is longer than ``LONG_LIST``.

Defined results: null texts and texts without words have no shingles and link
with nothing (component_id is their own doc_id); a component's number is its
smallest doc_id, nulls last; repeated rows are copies of each other; no rows
in, no rows out; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.components import connected
from stowage.llm.skew import fresh, sieve, sifted, spread_join
from stowage.llm.words import U, mix, rows_by_bytes, shingle_sets
from stowage.llm.workers import lean
from stowage.tables import Scratch, table

HEAVY = 1_000_000
LONG_LIST = 2000
#: Longer lists than this are counted by their pairs.
SHORT_LIST = 4
REFINEMENTS = 3
#: Subset keys that a small set may have for each list entry it would have otherwise.
SUBSET_COST = 16
BROADCAST_BYTES = 32 << 20
MIN_BITS = 64
#: Bits of the sketch that joins look at.
MARK_BITS = 512


class Rule:
    """Sets link when 100 * intersection >= percent * union. ``bits`` of sets' first numbers are used (fewer in tests)."""

    def __init__(self, width: int = 4, percent: int = 85, bits: int = 64) -> None:
        self.width, self.percent = width, percent
        self.mask = U((1 << bits) - 1)
        #: First numbers that several sets have, filled in while joining.
        self.shared: frozenset[int] = frozenset()
        n = 1
        while self.subsets(n + 1) <= SUBSET_COST * self.prefix(n + 1):
            n += 1
        self.small = n

    def overlap(self, n: int, m: int) -> int:
        """The least intersection of linked sets of these sizes."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def least(self, n: int) -> int:
        return -(-self.percent * n // 100)

    def prefix(self, n: int) -> int:
        return n - self.least(n) + 1

    def partners(self, n: int) -> range:
        return range(max(1, self.least(n)), 100 * n // self.percent + 1)

    def subsets(self, n: int) -> int:
        return sum(math.comb(n, c) for m in self.partners(n) if (c := self.overlap(n, m)) <= min(n, m))

    @property
    def listed(self) -> int:
        """From this size on sets are in the lists."""
        return self.least(self.small + 1)


def set_numbers(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit numbers for each row of sorted elements."""
    n = U(sets.shape[1])
    steps = mix(np.arange(1, sets.shape[1] + 1, dtype=U))
    return mix(mix(sets ^ steps).sum(1, dtype=U) + n), mix(mix(sets + mix(steps)).sum(1, dtype=U) ^ n)


def set_number(shingles: np.ndarray, rule: Rule) -> int:
    """The number that a set goes by, as a signed integer."""
    first, second = set_numbers(shingles[None, :])
    number = int((first & rule.mask).view(np.int64)[0])
    return int(second.view(np.int64)[0]) if number in rule.shared else number


def bits_for(n: int) -> int:
    return max(MIN_BITS, 1 << (n - 1).bit_length())


def sketch(shingles: np.ndarray, bits: int = 0) -> bytes:
    """The parity of the number of elements in each bucket; about as many buckets as there are elements, or ``bits``."""
    bits = bits or bits_for(len(shingles))
    counts = np.bincount((mix(shingles) & U(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A lower bound of the symmetric difference of two sets, from their sketches."""
    x, y = int.from_bytes(a, "little"), int.from_bytes(b, "little")
    n, m = 8 * len(a), 8 * len(b)
    while n > m:
        n //= 2
        x = (x >> n) ^ (x & ((1 << n) - 1))
    while m > n:
        m //= 2
        y = (y >> m) ^ (y & ((1 << m) - 1))
    return (x ^ y).bit_count()


def _texts(batch: pa.RecordBatch, column: int) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(column).to_pylist()]


def facts(docs: DataFrame, rule: Rule) -> DataFrame:
    """(doc_id, text_number, text_check, set_id, set_check, n, sketch, marks) of each row; no set_id for an empty set."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in rows_by_bytes(batches, 3):
            found = []
            for s in shingle_sets(_texts(batch, 3), rule.width):
                if not len(s):
                    found.append((None, None, 0, None, None))
                    continue
                first, second = set_numbers(s[None, :])
                found.append((int((first & rule.mask).view(np.int64)[0]), int(second.view(np.int64)[0]), len(s), sketch(s), list(memoryview(sketch(s, MARK_BITS)).cast("q"))))
            made = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["doc_id", "text_number", "text_check", "set_id", "set_check", "n", "sketch", "marks"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *numbers(text), text.alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, text_number long, text_check int, set_id long, set_check long, n int, sketch binary, marks array<long>")


def shared_numbers(known: DataFrame) -> frozenset[int]:
    """Numbers of several different sets: about n**2 / 2**65 of n sets."""
    ends = known.where("n > 0").groupBy("set_id").agg(F.min("set_check").alias("least"), F.max("set_check").alias("most"))
    return frozenset(r[0] for r in ends.where("least <> most").select("set_id").toLocalIterator())


def frequent(docs: DataFrame, rule: Rule, at_once: int = 1_000_000) -> DataFrame:
    """Shingles that some task saw in two documents or more of a stretch, with those counts summed.

    With T tasks this finds the shingles in more than about sqrt(8 T) documents.
    """

    def run(batches: Iterable[pa.RecordBatch]):
        held: list[np.ndarray] = []
        size = 0

        def out():
            values, counts = np.unique(np.concatenate(held), return_counts=True)
            keep = counts >= 2
            return pa.RecordBatch.from_arrays([pa.array(values[keep].view(np.int64)), pa.array(counts[keep].astype(np.int64))], names=["shingle", "count"])

        for batch in rows_by_bytes(batches, 0):
            for s in shingle_sets(_texts(batch, 0), rule.width):
                held.append(s)
                size += len(s)
                if size >= at_once:
                    yield out()
                    held, size = [], 0
        if held:
            yield out()

    counts = docs.select(F.col("text").cast("string")).mapInArrow(lean(run), "shingle long, count long")
    return counts.groupBy("shingle").agg(F.sum("count").alias("count")).where("count >= 8")


def heaviest(counts: DataFrame, known: tuple[np.ndarray, np.ndarray] | None = None, limit: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, at most ``limit`` with those of ``known``, sorted, and the logarithms of their counts; they only set the order of lists."""
    top = counts.orderBy(F.col("count").desc(), "shingle").limit(limit).select("shingle", "count").toPandas()
    heavy, ranks = top["shingle"].to_numpy(np.int64).view(U), np.log2(top["count"].to_numpy(np.int64)).astype(np.uint8)
    if known is not None:
        heavy, ranks = np.concatenate([heavy, known[0]]), np.concatenate([ranks, known[1]])
    falling = np.lexsort((heavy, 255 - ranks))
    heavy, first = np.unique(heavy[falling], return_index=True)
    ranks = ranks[falling][first]
    if len(heavy) > limit:
        keep = np.sort(np.argsort(255 - ranks, kind="stable")[:limit])
        heavy, ranks = heavy[keep], ranks[keep]
    return heavy, ranks


def entries(docs: DataFrame, rule: Rule, heavy: np.ndarray, ranks: np.ndarray) -> DataFrame:
    """List entries (shingle, set_id, n, place in the order) of the sets that are large or near the boundary; once per task for equal sets."""

    def run(batches: Iterable[pa.RecordBatch]):
        seen: set[int] = set()
        for batch in rows_by_bytes(batches, 0):
            numbers, sizes, heads = [], [], []
            for s in shingle_sets(_texts(batch, 0), rule.width):
                if len(s) < rule.listed or (number := set_number(s, rule)) in seen:
                    continue
                seen.add(number)
                place = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                late = heavy[place] == s if len(heavy) else np.zeros(len(s), bool)
                k = rule.prefix(len(s))
                head = np.concatenate([s[~late], s[late][np.argsort(ranks[place[late]], kind="stable")]])[:k] if late.any() else s[:k]
                numbers.append(number)
                sizes.append(len(s))
                heads.append(head)
            if heads:
                each = [len(h) for h in heads]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(heads).view(np.int64)),
                        pa.array(np.repeat(np.array(numbers, np.int64), each)),
                        pa.array(np.repeat(np.array(sizes, np.int32), each)),
                        pa.array(np.concatenate([np.arange(k, dtype=np.int32) for k in each])),
                    ],
                    names=["shingle", "set_id", "n", "place"],
                )

    return docs.select(F.col("text").cast("string")).mapInArrow(lean(run), "shingle long, set_id long, n int, place int")


def subset_keys(docs: DataFrame, rule: Rule) -> DataFrame:
    """(key, check, sizes, larger, set_id) of small sets: sets at one key of which not both are of one kind link."""

    def run(batches: Iterable[pa.RecordBatch]):
        seen: set[int] = set()
        names = ["key", "check", "sizes", "larger", "set_id"]
        for batch in rows_by_bytes(batches, 0):
            columns: list[list[np.ndarray]] = [[], [], [], [], []]
            for s in shingle_sets(_texts(batch, 0), rule.width):
                n = len(s)
                if not 0 < n <= rule.small or (number := set_number(s, rule)) in seen:
                    continue
                seen.add(number)
                for m in rule.partners(n):
                    c = rule.overlap(n, m)
                    if m > rule.small or c > min(n, m):
                        continue
                    first, second = set_numbers(s[_choices(n, c)])
                    k = len(first)
                    made = first.view(np.int64), (second & U(0x7FFFFFFF)).astype(np.int32), np.full(k, min(n, m) * 64 + max(n, m), np.int32), np.full(k, n > m), np.full(k, number, np.int64)
                    for column, x in zip(columns, made, strict=True):
                        column.append(x)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], names=names)

    return docs.select(F.col("text").cast("string")).mapInArrow(lean(run), "key long, check int, sizes int, larger boolean, set_id long")


@cache
def _choices(n: int, c: int) -> np.ndarray:
    """Every way to choose c of n places, a row each."""
    return np.array(list(itertools.combinations(range(n), c)))


def small_links(docs: DataFrame, rule: Rule) -> DataFrame:
    """Links (a, b) that connect all small sets which meet at a subset."""
    keys, by = subset_keys(docs, rule), ["key", "check", "sizes"]
    hubs = keys.groupBy(*by).agg(F.min(F.when(~F.col("larger"), F.col("set_id"))).alias("one"), F.min(F.when(F.col("larger"), F.col("set_id"))).alias("two"), F.count(F.lit(1)).alias("k")).where("k > 1")
    met = keys.join(hubs, by)
    same = F.col("sizes") % 64 == F.floor(F.col("sizes") / 64)
    hub = F.when(same, F.col("one")).when(F.col("larger"), F.col("one")).otherwise(F.col("two"))
    return met.select(F.least(hub, "set_id").alias("a"), F.greatest(hub, "set_id").alias("b")).where("a <> b").distinct()


def close_enough(pairs: DataFrame, sketches: DataFrame, rule: Rule) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sketches allow a link."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            n, m, x, y = (batch.column(i).to_pylist() for i in range(2, 6))
            keep = [least_difference(p, q) <= i + j - 2 * rule.overlap(i, j) for i, j, p, q in zip(n, m, x, y, strict=True)]
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    one = sketches.select(F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("sketch_a"))
    two = sketches.select(F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("sketch_b"))
    joined = spread_join(pairs, one, ["a"]).join(two, "b")
    return joined.select("a", "b", "n_a", "n_b", "sketch_a", "sketch_b").mapInArrow(lean(run), "a long, b long")


def numbers(text: Column) -> list[Column]:
    """Two numbers by which a text is found again without shingling it."""
    return [F.xxhash64(text).alias("text_number"), F.hash(text).alias("text_check")]


def texts_of(docs: DataFrame, ids: DataFrame, sets: DataFrame) -> DataFrame:
    """(set_id, text) with one text for each set of ``ids``, stored."""
    keys = sets.join(ids, "set_id").select("set_id", "first.text_number", "first.text_check")
    text = F.col("text").cast("string")
    rows = docs.select(text.alias("text"), *numbers(text))
    if keys.count() * 64 <= BROADCAST_BYTES:
        keys = F.broadcast(keys)
    else:
        rows = sifted(rows, sieve(keys, F.col("text_number")), F.col("text_number")).where("_maybe").drop("_maybe")
    return rows.join(keys, ["text_number", "text_check"]).groupBy("set_id").agg(F.first("text").alias("text"))


def linked(pairs: DataFrame, docs: DataFrame, sets: DataFrame, rule: Rule, scratch: Scratch, name: str) -> DataFrame:
    """Those of ``pairs`` (a, b), stored, that link by exact comparison. Many pairs should share their a."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in rows_by_bytes(batches, 2):
            ones, twos = _texts(batch, 2), _texts(batch, 3)
            distinct = {t: None for t in itertools.chain(ones, twos)}
            sets = dict(zip(distinct, shingle_sets(list(distinct), rule.width), strict=True))
            keep = []
            for x, y in zip(ones, twos, strict=True):
                p, q = sets[x], sets[y]
                keep.append(len(np.intersect1d(p, q, assume_unique=True)) >= rule.overlap(len(p), len(q)))
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    ids = scratch.store(pairs.select(F.col("a").alias("set_id")).unionByName(pairs.select(F.col("b").alias("set_id"))).distinct(), f"{name}-ids")
    texts = scratch.store(texts_of(docs, ids, sets), f"{name}-texts")
    one, two = texts.select(F.col("set_id").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("set_id").alias("b"), F.col("text").alias("text_b"))
    joined = spread_join(pairs.join(two, "b").select("b", "text_b", "a"), one, ["a"], like=pairs)
    out = scratch.store(joined.select("a", "b", "text_a", "text_b").mapInArrow(lean(run), "a long, b long"), f"{name}-links")
    scratch.drop(f"{name}-texts", f"{name}-ids")
    return out


def classed(hits: DataFrame, percent: int) -> DataFrame:
    """``hits`` in size classes: a set as ``own`` in its class, and as a possible larger partner in the one below."""
    step = math.log(100 / percent)
    own = F.floor(F.log(F.col("n")) / step + 1e-9).cast("int")
    return hits.select("*", F.explode(F.array(F.struct(own.alias("size"), F.lit(True).alias("own")), F.struct((own - 1).alias("size"), F.lit(False).alias("own")))).alias("c")).select("shingle", "set_id", "n", "place", "c.size", "c.own")


def clusters(docs: DataFrame, rule: Rule | None = None) -> DataFrame:
    """(doc_id, text_number, n, component) of each row of ``docs`` (doc_id, text); rows with equal components belong together, null ones alone."""
    rule = rule or Rule()
    scratch = Scratch(docs.sparkSession)
    known = scratch.store(facts(docs, rule), "facts")
    rule.shared = shared_numbers(known)
    if rule.shared:
        known = scratch.store(known.withColumn("set_id", F.when(F.col("set_id").isin(list(rule.shared)), F.col("set_check")).otherwise(F.col("set_id"))), "told")
    text = F.min(F.struct("text_number", "text_check")).alias("first")
    sets = scratch.store(known.where("n > 0").groupBy("set_id").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("marks").alias("marks"), text), "sets")

    heavy = heaviest(frequent(docs, rule))
    for turn in range(REFINEMENTS + 1):
        lists = scratch.store(entries(docs, rule, *heavy), f"lists{turn}")
        counts = scratch.store(lists.groupBy("shingle").agg(F.count(F.lit(1)).alias("count")).where("count > 1"), f"counts{turn}")
        long = counts.where(F.col("count") > SHORT_LIST)
        pairs, longest = long.agg(F.sum(F.col("count") * (F.col("count") - 1) / 2), F.max("count")).first()
        if turn == REFINEMENTS or (pairs or 0) <= sets.count() or (turn and longest <= LONG_LIST):
            break
        more = heaviest(long, heavy)
        if np.array_equal(more[0], heavy[0]) and np.array_equal(more[1], heavy[1]):
            break
        heavy = more
        scratch.drop(f"lists{turn}", f"counts{turn}")
    hits = scratch.store(lists.join(counts.select("shingle"), "shingle").distinct(), "hits")
    scratch.drop(f"lists{turn}", f"counts{turn}")
    spread = classed(hits, rule.percent)

    def least_shared(both: Column) -> Column:
        """``rule.overlap`` of sets of ``both`` elements together."""
        return F.floor((rule.percent * both + 99 + rule.percent) / (100 + rule.percent))

    def fits(n: str, m: str) -> Column:
        return (F.least(n, m) * 100 >= F.greatest(n, m) * rule.percent)

    # first each list's sets against its most central one alone: the one that is in most lists, as an original is among its copies
    central = hits.groupBy("set_id").agg((-F.count(F.lit(1))).alias("rank"))
    best = F.min(F.when(F.col("own"), F.struct("rank", "n", "set_id"))).alias("hub")
    hubs = spread.join(central, "set_id").groupBy("shingle", "size").agg(best, F.count(F.lit(1)).alias("k")).where("k > 1 and hub is not null")
    hubs = hubs.select("shingle", "size", F.col("hub.set_id").alias("a"), F.col("hub.n").alias("n_a"))
    stars = spread.join(hubs, ["shingle", "size"]).where(fits("n_a", "n") & (F.col("set_id") != F.col("a"))).select("a", F.col("set_id").alias("b")).distinct()
    tried = scratch.store(stars, "stars")
    first = linked(scratch.store(close_enough(tried, sets, rule), "close1"), docs, sets, rule, scratch, "first")
    links = scratch.store(first.unionByName(small_links(docs, rule)), "links1")
    roots = connected(links, scratch, "roots1")

    # then sets of different components that share a list
    placed = scratch.store(spread.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id")), "placed")
    # where a pair meets at the first shingle that it shares, no more than what follows is shared; elsewhere it needn't meet again
    placed = placed.withColumn("early", F.col("own") & (F.col("n") - F.col("place") >= least_shared(2 * F.col("n"))))
    parts = placed.groupBy("shingle", "size", "root").agg(F.count(F.lit(1)).alias("k"), F.max("early").alias("early"))
    mains = parts.groupBy("shingle", "size").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count(F.lit(1)).alias("parts"), F.max("early").alias("any")).where("parts > 1 and any").select("shingle", "size", "main")
    marked = placed.join(mains, ["shingle", "size"]).join(sets.select("set_id", "marks"), "set_id").withColumn("odd", F.col("root") != F.col("main"))
    # the smaller of a pair comes early; not both are of the list's largest component
    facing = F.explode(F.when(F.col("odd"), F.array(F.lit(True), F.lit(False))).otherwise(F.array(F.lit(True))))
    smaller = marked.where("early").select("shingle", "size", F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("place_a"), F.col("root").alias("root_a"), F.col("marks").alias("marks_a"), facing.alias("odd"))
    differ = sum((F.bit_count(F.get("marks", i).bitwiseXOR(F.get("marks_a", i))) for i in range(MARK_BITS // 64)), F.lit(0))
    both = F.col("n") + F.col("n_a")
    may_link = differ <= both - 2 * least_shared(both)
    enough = F.least(F.col("n") - F.col("place"), F.col("n_a") - F.col("place_a")) >= least_shared(both)
    in_order = F.struct("n_a", "a") < F.struct("n", "set_id")
    met = smaller.join(marked, ["shingle", "size", "odd"]).where((F.col("root_a") != F.col("root")) & in_order & fits("n_a", "n") & enough & may_link)
    pairs = met.select(F.least("a", "set_id").alias("a"), F.greatest("a", "set_id").alias("b")).distinct()
    done = tried.select(F.least("a", "b").alias("x"), F.greatest("a", "b").alias("y"))
    pairs = pairs.join(done, (F.least("a", "b") == F.col("x")) & (F.greatest("a", "b") == F.col("y")), "left_anti")
    rest = scratch.store(close_enough(scratch.store(pairs, "pairs"), sets, rule), "close2")
    if not rest.isEmpty():
        links = scratch.store(links.unionByName(linked(rest, docs, sets, rule, scratch, "rest")), "links2")
        roots = connected(links, scratch, "roots2")
    scratch.drop("hits", "placed", "stars", "pairs")
    return spread_join(known.select("doc_id", "text_number", "n", "set_id"), roots.withColumnRenamed("node", "set_id"), ["set_id"], "left").select("doc_id", "text_number", "n", F.coalesce("root", "set_id").alias("component"))


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = clusters(table(spark, sf_dir, "documents"))
    found = Scratch(spark).store(found, "found")
    least = found.where("component is not null").groupBy("component").agg(F.min("doc_id").alias("least"))
    joined = spread_join(found, least, ["component"], "left")
    own = F.when(F.col("component").isNull(), F.col("doc_id")).otherwise(F.col("least"))
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule) -> DataFrame:
    """``docs`` with one document of each component: the one with the smallest doc_id. Equal rows must be gone before."""
    scratch = Scratch(docs.sparkSession)
    found = scratch.store(clusters(docs, rule), "found")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "text_number")
    first = found.where("component is not null").groupBy("component").agg(F.min(order).alias("first"))
    id_, number, mine = fresh(docs, "_id", "_text", "_mine")
    gone = spread_join(found.where("component is not null"), first, ["component"]).where(~order.eqNullSafe(F.col("first"))).select(F.col("doc_id").alias(id_), F.col("text_number").alias(number))
    gone = scratch.store(gone, "gone")
    own = F.xxhash64(F.col("text").cast("string"))
    equal = F.col("doc_id").cast("long").eqNullSafe(F.col(id_)) & F.col(mine).eqNullSafe(F.col(number))
    rows = docs.withColumn(mine, own)
    if gone.count() * 64 <= BROADCAST_BYTES:  # then texts needn't move
        return rows.join(F.broadcast(gone), equal, "left_anti").drop(mine)
    tested = sifted(rows, sieve(gone, F.col(number)), F.col(mine))
    kept = tested.where("not _maybe").drop("_maybe")
    return kept.unionByName(tested.where("_maybe").drop("_maybe").join(gone, equal, "left_anti")).drop(mine)


ORACLE_SQL = """
with recursive
w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as ws from documents),
s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 4 then [array_to_string(ws, ' ')]
      else list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) end as sh from w),
e as (select doc_id, len(sh) as n, unnest(sh) as g from s),
p as (select a.doc_id as x, b.doc_id as y from e a join e b on a.g = b.g and a.doc_id < b.doc_id
      group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
l as (select x, y from p union select y, x from p),
r(doc_id, c) as (select doc_id, doc_id from s union select l.y, r.c from r join l on l.x = r.doc_id)
select s.doc_id, len(sh)::bigint as n_shingles, min(c) as component_id from s join r on r.doc_id = s.doc_id group by s.doc_id, len(sh)
"""
