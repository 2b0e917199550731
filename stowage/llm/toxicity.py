"""Toxicity from subword-bag embeddings and a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its byte n-grams (with its
edges marked) and of the word itself, all hashed into one table, so an unseen
misspelling or ending shares most of its vectors with words that were seen. A
window of ``WINDOW`` words averages their vectors, and a linear softmax over
the two classes scores it. A text scores as its most toxic window, so a few
words in a long text aren't diluted; by default a window is a single word.

The table and the softmax are fitted together by Adagrad: first on whole-text
averages, then on windows: the most toxic window of toxic texts against the
most toxic and random windows of the others, picked anew in each round. Errors on
toxic windows weigh more, by a power of the ratio of the classes. Part of the words
are misspelled at random while learning.

Since window scores are linear in the vectors, scoring needs one number per
n-gram bucket (1 MB), and no Python code per word.

Scale: fitting sees a bounded sample on the driver (see ``labelled``);
scoring is one map over documents without a shuffle. Texts are scored in pieces
of ``SLICE_BYTES``, so memory beside a text doesn't grow with it.

Defined results: null and empty texts score as a window without words; rows
are scored one by one, so repeats and clashing columns don't matter; without
any labelled row of either class every score is 0; no rows in, no rows out.
"""

from __future__ import annotations

import random
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import labelled
from stowage.llm.words import DOWN, ONLY_WORDS, SLICE_BYTES, U, UP, VALUES, Words, chunks, mix, rows_by_bytes
from stowage.llm.workers import give_back, lean
from stowage.tables import table

BUCKETS = 1 << 18
SIZES = (3, 4, 5, 6)
WINDOW = 1
DIMENSIONS = 8
THRESHOLD = 0.7
#: Errors on toxic windows weigh the ratio of the classes to this power: 0 not at all, 1 to full balance.
BALANCE = 0.6


def fold(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def folded(text: str | None, limit: int = SLICE_BYTES) -> Iterator[bytes]:
    """``fold(text)`` in pieces of about ``limit`` characters that end at spaces, which no lower-casing looks across."""
    text = text or ""
    start = 0
    while len(text) - start > limit:
        stop = text.rfind(" ", start, start + limit) + 1
        if stop <= start:
            stop = text.find(" ", start + limit) + 1 or len(text)
        yield fold(text[start:stop])
        start = stop
    yield fold(text[start:])


def grams(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(word, bucket) of the byte n-grams of the words in ``raw``, one size and slice at a time.

    ``raw`` begins and ends with a gap. Gaps of any kind look alike, and mark the edges of words.
    """
    reach = max(SIZES) - 1
    before = 0  # words begun before the slice
    for base in range(0, len(raw), SLICE_BYTES - reach):
        part = np.frombuffer(raw, np.uint8, min(SLICE_BYTES, len(raw) - base), base)
        n, own = len(part), min(SLICE_BYTES - reach, len(part))
        inside = ONLY_WORDS[part] > 0
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        begins[0] &= base == 0 or not ONLY_WORDS[raw[base - 1]]
        word = np.cumsum(begins, dtype=np.int32)
        gaps = np.concatenate([[0], np.cumsum(~inside, dtype=np.int32)])
        total = np.zeros(n + 1, U)
        np.cumsum(np.where(inside, VALUES[part], U(1)) * UP[:n], out=total[1:])
        for size in SIZES:
            at = np.arange(max(0, min(own, n - size + 1)))
            at = at[gaps[at + size - 1] == gaps[at + 1]]
            made = mix((total[at + size] - total[at]) * DOWN[at] + U(size)) & U(BUCKETS - 1)
            yield word[at + 1] + (before - 1), made.astype(np.int32)
        before += int(word[own - 1])


class Bags:
    """The words of some texts with their n-gram buckets: ``grams[k]`` belongs to word ``owner[k]``."""

    def __init__(self, texts: list[bytes]) -> None:
        self.words = Words(texts, kinds=ONLY_WORDS)
        own = np.arange(len(self.words.hashes)), (self.words.hashes & U(BUCKETS - 1)).astype(np.int32)
        owners, made = zip(own, *grams(self.words.raw), strict=True)
        self.owner, self.grams = np.concatenate(owners).astype(np.int32), np.concatenate(made)


def word_scores(words: Words, table: np.ndarray) -> np.ndarray:
    """The mean over each word's buckets of their numbers in ``table``."""
    sums = table[(words.hashes & U(BUCKETS - 1)).astype(np.int32)].astype(np.float64)
    counts = np.ones(len(sums), np.int32)
    for owner, buckets in grams(words.raw):
        if len(owner):
            first = int(owner[0])
            part = np.bincount(owner - first, table[buckets])
            sums[first : first + len(part)] += part
            counts[first : first + len(part)] += np.bincount(owner - first).astype(np.int32)
    return sums / counts


def window_scores(words: np.ndarray) -> np.ndarray:
    """The mean of each run of WINDOW words, or of all where there are fewer."""
    if len(words) <= WINDOW:
        return words.mean(keepdims=True) if len(words) else np.zeros(1)
    total = np.concatenate([[0.0], np.cumsum(words)])
    return (total[WINDOW:] - total[:-WINDOW]) / WINDOW


class Model:
    """``table``: a number per bucket; with ``bias``, the log-odds of a window."""

    def __init__(self, table: np.ndarray, bias: float) -> None:
        self.table, self.bias = table, bias

    def scores(self, texts: Iterable[str | None]) -> np.ndarray:
        """One score per text. Long texts are gone over in pieces, each with the last words of the one before."""
        out: list[float] = []
        short: list[bytes] = []

        def flush() -> None:
            for a, b in chunks(short, SLICE_BYTES):
                words = Words(short[a:b], kinds=ONLY_WORDS)
                found, first = word_scores(words, self.table), words.first
                out.extend(window_scores(found[first[i] : first[i + 1]]).max() for i in range(b - a))
            short.clear()

        for text in texts:
            if len(text or "") <= SLICE_BYTES:
                short.append(fold(text))
                if len(short) >= 512:
                    flush()
                continue
            flush()
            best, tail = -np.inf, np.zeros(0)
            for piece in folded(text):
                tail = np.concatenate([tail, word_scores(Words([piece], kinds=ONLY_WORDS), self.table)])
                if len(tail) >= WINDOW:
                    best = max(best, window_scores(tail).max())
                    tail = tail[len(tail) - WINDOW + 1 :]
            out.append(best if best > -np.inf else window_scores(tail).max())
        flush()
        return 1 / (1 + np.exp(-np.clip(np.array(out) + self.bias, -30, 30)))


def misspell(text: bytes, rng: random.Random, share: float) -> bytes:
    """``text`` with a share of its longer words changed in one letter."""
    words = text.decode("utf-8", "replace").split(" ")
    for i in range(len(words)):
        w = words[i]
        if len(w) > 3 and rng.random() < share:
            j, kind = rng.randrange(1, len(w) - 1), rng.randrange(4)
            words[i] = (w[:j] + w[j + 1 :], w[:j] + w[j] + w[j:], w[:j] + w[j + 1] + w[j] + w[j + 2 :], w[:j] + rng.choice("abcdefghijklmnopqrstuvwxyz0134") + w[j + 1 :])[kind]
    return " ".join(words).encode()


def _summed(keys: np.ndarray, rows: np.ndarray, number: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and for each the sum of its rows; ``rows[number[i]]`` belongs to the i-th key."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    starts = np.concatenate([[0], np.flatnonzero(ordered[1:] != ordered[:-1]) + 1])
    return ordered[starts], np.add.reduceat(rows[order if number is None else number[order]], starts, axis=0)


class _Trainer:
    """Distinct words with their buckets, the texts as numbers of words, and the parameters."""

    def __init__(self, texts: list[bytes], seed: int) -> None:
        self.rng = np.random.default_rng(seed)
        seen, counts, text_words, lengths = np.zeros(0, U), [], [], []
        order: list[np.ndarray] = []
        grams = bytearray()  # grows in place
        for a, b in chunks(texts, SLICE_BYTES):
            bags = Bags(texts[a:b])
            hashes = bags.words.hashes
            text_words.append(hashes)
            lengths.append(np.diff(bags.words.first))
            known, pick = np.unique(hashes, return_index=True)
            pick = pick[~np.isin(known, seen)]
            by_owner = np.argsort(bags.owner, kind="stable")
            owner = bags.owner[by_owner]
            lo, hi = np.searchsorted(owner, pick), np.searchsorted(owner, pick, "right")
            counts.append((hi - lo).astype(np.int32))
            at = np.repeat(lo - (np.cumsum(hi - lo) - (hi - lo)), hi - lo) + np.arange((hi - lo).sum())
            grams += memoryview(bags.grams[by_owner[at]]).cast("B")
            order.append(hashes[pick])
            seen = np.union1d(seen, known)
        numbers = np.concatenate(order)
        by_hash = np.argsort(numbers).astype(np.int32)
        numbers = numbers[by_hash]
        for i, h in enumerate(text_words):
            text_words[i] = by_hash[np.searchsorted(numbers, h)]
        self.word = np.concatenate(text_words)
        del text_words, order, numbers, seen
        self.count = np.concatenate(counts)
        self.start = np.concatenate([[0], np.cumsum(self.count, dtype=np.int64)])
        self.grams = np.frombuffer(grams, np.int32)
        self.first = np.concatenate([[0], np.cumsum(np.concatenate(lengths))])
        self.table = self.rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
        self.top = self.rng.normal(0, 0.1, (DIMENSIONS, 2)).astype(np.float32)
        self.bias = np.zeros(2, np.float32)
        self.table_seen = np.full((BUCKETS, DIMENSIONS), 1e-6, np.float32)
        self.top_seen, self.bias_seen = np.full((DIMENSIONS, 2), 1e-6, np.float32), np.full(2, 1e-6, np.float32)

    def step(self, spans: list[tuple[int, int]], labels: np.ndarray, rate: float, weight: float) -> None:
        """One Adagrad step on spans of words; errors on toxic ones count ``weight`` times."""
        sizes = np.array([b - a for a, b in spans])
        words = np.concatenate([self.word[a:b] for a, b in spans])
        known, which = np.unique(words, return_inverse=True)
        count = self.count[known]
        ends = np.cumsum(count)
        at = np.arange(ends[-1]) + np.repeat(self.start[known] - (ends - count), count)
        grams = self.grams[at]
        word_vectors = np.add.reduceat(self.table[grams], ends - count) / count[:, None]
        begin = np.cumsum(sizes) - sizes
        spans_vectors = np.add.reduceat(word_vectors[which], begin) / sizes[:, None]
        logits = spans_vectors @ self.top + self.bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(labels)), labels] -= 1
        p *= np.where(labels == 1, weight, 1.0)[:, None] / len(labels)
        d_top, d_bias = spans_vectors.T @ p, p.sum(0)
        _, d_word = _summed(which, np.repeat(p @ self.top.T / sizes[:, None], sizes, axis=0))
        hit, d_table = _summed(grams, (d_word / count[:, None]).astype(np.float32), np.repeat(np.arange(len(known)), count))
        self.table_seen[hit] += d_table**2
        self.table[hit] -= rate * d_table / np.sqrt(self.table_seen[hit])
        for value, seen, d in ((self.top, self.top_seen, d_top), (self.bias, self.bias_seen, d_bias)):
            seen += d**2
            value -= rate * d / np.sqrt(seen)

    def linear(self) -> tuple[np.ndarray, float]:
        return (self.table @ (self.top[:, 1] - self.top[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])

    def words(self) -> np.ndarray:
        """The score of each word of each text."""
        table, _ = self.linear()
        out = np.zeros(len(self.count), np.float32)
        for lo in range(0, len(out), 1 << 15):
            hi = min(len(out), lo + (1 << 15))
            begin = self.start[lo]
            out[lo:hi] = np.add.reduceat(table[self.grams[begin : self.start[hi]]], self.start[lo:hi] - begin) / self.count[lo:hi]
        return out[self.word]


def train(rows: list[tuple[bytes, int]], rounds: int = 16, rate: float = 0.1, seed: int = 7, batch: int = 128) -> Model:
    """Fits a model to (text, 0 or 1); one without effect if a class is missing."""
    rng = random.Random(seed)
    labels = [k for _, k in rows] * 2
    if len(set(labels)) < 2:
        return Model(np.zeros(BUCKETS, np.float32), -30.0)
    texts = [fold(t.decode("utf-8", "replace")) for t, _ in rows]
    texts += [misspell(t, rng, 0.3) for t in texts]
    t = _Trainer(texts, seed)
    del texts
    spans = [(t.first[i], t.first[i + 1], k) for i, k in enumerate(labels) if t.first[i + 1] > t.first[i]]

    toxic = sum(k for *_, k in spans)
    # each round has one window of a toxic text and three of another; part of the difference in numbers is made up for
    weight = (3 * (len(spans) - toxic) / max(1, toxic)) ** BALANCE

    def pass_over(chosen: list[tuple[int, int, int]], size: int) -> None:
        rng.shuffle(chosen)
        for i in range(0, len(chosen), size):
            part = chosen[i : i + size]
            t.step([(a, b) for a, b, _ in part], np.array([k for *_, k in part]), rate, weight)

    # small samples are gone over more often
    for _ in range(max(1, min(10, 3000 // len(spans)))):
        pass_over(list(spans), batch // 4)
    for _ in range(max(rounds, min(40, 40_000 // len(spans)))):
        words, chosen = t.words(), []
        for a, b, k in spans:
            s = window_scores(words[a:b])
            picks = [int(s.argmax())] if k else [int(s.argmax()), rng.randrange(len(s)), rng.randrange(len(s))]
            chosen += [(a + j, min(b, a + j + WINDOW), k) for j in picks]
        pass_over(chosen, batch)
    return Model(*t.linear())


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, toxicity) of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in rows_by_bytes(batches, 1):
            made = model.scores(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64())], names=["doc_id", "toxicity"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, toxicity double")


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the texts that score ``threshold`` or more, all columns as they were."""
    column = docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in rows_by_bytes(batches, column):
            yield batch.filter(pa.array(model.scores(batch.column(column).to_pylist()) < threshold))

    return docs.mapInArrow(lean(run), docs.schema)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    try:
        return train(labelled.sample(docs, labels, "toxic"))
    finally:
        give_back()


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= THRESHOLD).cast("int").alias("predicted"))
