"""Text quality by logistic regression on hashed word n-grams, learned with follow-the-regularised-leader updates.

Tokens are runs of word characters and runs of punctuation. Features are
hashed token unigrams and bigrams; a bigram of two equal tokens hashes to one
bucket whatever the token, so that repetition itself is learned. A feature's
value is the root of its share of the text's features. Weights are learned
one row at a time by the per-coordinate proximal form with L1 and L2 terms,
which leaves most of them zero; a score is a sparse dot product.

Scale: fitting sees a bounded sample on the driver (see ``labelled``);
scoring is one map over documents without a shuffle, with 2 MB of weights.

Defined results: null and empty texts have no features and score by the bias
alone; rows are scored one by one, so repeats and clashing columns don't
matter; without a labelled row every score is 0.5; no rows in, no rows out.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm import labelled
from stowage.llm.words import BY_MARKS, U, Words, chunks, mix, rows_by_bytes
from stowage.llm.workers import lean
from stowage.tables import table

BUCKETS = 1 << 19
REPEAT = 1  # bucket of a bigram of equal tokens
BIAS = 0
THRESHOLD = 0.5


def features(texts: list[bytes]):
    """(sorted distinct buckets, values) of each text; the bias comes first."""
    for a, b in chunks(texts):
        found = Words(texts[a:b], kinds=BY_MARKS)
        one = found.hashes
        two = found.ngrams(2)
        two[:-1] = np.where(one[1:] == one[:-1], U(REPEAT), two[:-1] | U(2))
        for i in range(b - a):
            lo, hi = found.first[i], found.first[i + 1]
            if hi == lo:
                yield np.array([BIAS]), np.ones(1)
                continue
            own = np.concatenate([mix(one[lo:hi]) | U(2), two[lo : hi - 1]]) & U(BUCKETS - 1)
            buckets, counts = np.unique(own.astype(np.int64), return_counts=True)
            yield np.concatenate([[BIAS], buckets]), np.concatenate([[1.0], np.sqrt(counts / len(own))])


class FollowTheLeader:
    """Per-coordinate proximal follow-the-regularised-leader logistic regression."""

    def __init__(self, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1, buckets: int = BUCKETS) -> None:
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros(buckets), np.zeros(buckets)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def update(self, at: np.ndarray, values: np.ndarray, label: int, weight: float = 1.0) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ values, -30, 30)))
        g = weight * (p - label) * values
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def train(rows: list[tuple[bytes, int]], passes: int = 3, seed: int = 3) -> np.ndarray:
    """The weights learned from (text, 0 or 1)."""
    leader = FollowTheLeader()
    texts, labels = [t for t, _ in rows], np.array([k for _, k in rows])
    made = [(at.astype(np.int32), v.astype(np.float32)) for at, v in features(texts)]
    rng = np.random.default_rng(seed)
    # small samples are gone over more often
    for _ in range(max(passes, min(20, 6000 // max(1, len(made))))):
        for i in rng.permutation(len(made)):
            leader.update(*made[i], labels[i])
    return leader.weights().astype(np.float32)


def scores(texts: list[str | None], weights: np.ndarray) -> np.ndarray:
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    dots = np.fromiter((weights[at] @ v for at, v in features(raw)), np.float64, len(raw))
    return 1 / (1 + np.exp(-np.clip(dots, -30, 30)))


def score(docs: DataFrame, weights: np.ndarray) -> DataFrame:
    """(doc_id, quality) of each row of ``docs`` (doc_id, text)."""

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in rows_by_bytes(batches, 1):
            made = scores(batch.column(1).to_pylist(), weights)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.float64())], names=["doc_id", "quality"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), "doc_id long, quality double")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    weights = train(labelled.sample(docs, table(spark, sf_dir, "labels"), "quality"))
    scored = score(docs, weights)
    return scored.select("doc_id", labelled.held_out(F.col("doc_id")).alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= THRESHOLD).cast("int").alias("predicted"))
