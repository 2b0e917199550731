"""Bounded samples of labelled documents to fit classifiers on.

The bound is ``rows_per_class``: of the rows to learn from (crc32 of the
doc_id's digits modulo 3 is not 1) those with the smallest hashes of doc_id are
taken for each class. Texts over ``MAX_BYTES`` aren't learned from; every text
is scored, whole. Rows without a label or a doc_id aren't learned from; of
several labels of a doc_id the largest counts, and of several texts each, up to
``2 * rows_per_class`` texts in all. So at most 160 MB of text reach the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.llm.workers import give_back

ROWS_PER_CLASS = 2500
MAX_BYTES = 1 << 15


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from learning; a null doc_id isn't labelled, and not held out."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, label: str, rows_per_class: int = ROWS_PER_CLASS) -> list[tuple[bytes, int]]:
    """(text, label) of the sample, in an order that doesn't depend on the partitioning."""
    ids = labels.where(~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_label"))
    ids = ids.where("_id is not null").withColumn("_order", F.xxhash64("_id"))
    chosen = [ids.where(F.col("_label") == k).orderBy("_order", "_id").limit(rows_per_class) for k in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), text.alias("_text")).where(F.octet_length("_text") <= MAX_BYTES)
    # at most 2 * rows_per_class ids of fixed width
    found = rows.join(F.broadcast(chosen), "_id").select("_order", "_id", "_text", "_label")
    found = found.orderBy("_order", "_id", "_text").limit(2 * rows_per_class).toPandas()
    rows = [(t.encode(), int(k)) for t, k in zip(found["_text"], found["_label"], strict=True)]
    del found
    give_back()
    return rows
