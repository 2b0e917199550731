"""The corpus pipeline: stages over ``documents``, each written and read again as the next one's input.

A document that the toxicity classifier rejects goes; of equal texts and then
of near-equal ones (five-word shingles, Jaccard similarity 0.8 or more, linked
directly or through others) the one with the smallest doc_id stays; documents
that hold a benchmark item go; the rest are packed into token sequences. All
stages but the last keep the columns of their input, whatever their names.

Defined results: a null text counts as empty; empty texts are equal to each other,
so one of them stays, near to nothing and packed as the closing id alone; a null
doc_id comes after all others where the smallest stays; of rows that repeat
doc_id and text one stays, of ties in doc_id with different texts each is judged
by its text; without labels of both kinds no document is toxic, without
benchmark items none holds one; no documents in, no pieces out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stowage.llm import best_fit_packing, decontamination, exact_dedup, near_join, toxicity
from stowage.tables import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep_first(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_join.keep_one(docs, near_join.Rule(width=5, percent=80))


def drop_benchmark_holders(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_benchmark_holders),
    ("best-fit packing", pack),
]

#: Training a classifier and tokenising have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, scratch = table(spark, sf_dir, "documents"), Scratch(spark)
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.store(stage(spark, docs, sf_dir), f"stage{i}")
        if i:
            scratch.drop(f"stage{i - 1}")
    return docs
