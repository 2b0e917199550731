"""Contents as blocks: splitting, parallel coding and reassembly in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage import codec
from stowage.functions import udfs
from stowage.functions.columns import col

#: Contents up to this size are encoded by the task that has them.
WHOLE = 1 << 20


def split(df: DataFrame, content: Column | str, size: int, outer: bool = False) -> DataFrame:
    """``df`` with one row per block: ``block_no``, ``raw`` and ``is_final``.

    Empty contents have none; with ``outer`` they and null ones have a row
    without a ``block_no`` whose ``raw`` is the content, so that no key is lost.
    """
    data = col(content)
    count = F.ceil(F.octet_length(data) / size).cast("int")
    numbers = F.when(count > 0, F.sequence(F.lit(0), count - 1))
    out = df.withColumn("_data", data).withColumn("block_no", (F.explode_outer if outer else F.explode)(numbers))
    start = (F.col("block_no") * size + 1).cast("int")
    raw = F.substring(F.col("_data"), start, F.lit(size))
    out = out.withColumn("raw", F.coalesce(raw, F.col("_data")) if outer else raw)
    return out.withColumn("is_final", F.octet_length("raw") < size).drop("_data")


def encode(blocks: DataFrame, method: int, level: int) -> DataFrame:
    """``blocks`` with ``encoded`` and ``error``."""
    made = udfs.encode_block("raw", F.lit(method), F.lit(level))
    return blocks.withColumn("_made", made).withColumn("encoded", F.col("_made.data")).withColumn("error", F.col("_made.error")).drop("_made")


def reassemble(blocks: DataFrame, key: str, data: str, *others: str) -> DataFrame:
    """(key, *others, payload): the blocks of each key joined in the order of ``block_no``; null if all are."""
    ordered = F.array_sort(F.collect_list(F.struct("block_no", F.col(data).alias("data"))))
    # as hexadecimal digits, since joining binary values one by one copies what is joined already
    joined = F.unhex(F.array_join(F.transform(ordered, lambda x: F.hex(x["data"])), ""))
    return blocks.groupBy(key).agg(*(F.first(c).alias(c) for c in others), F.when(F.count(data) > 0, joined).alias("payload"))


def encode_rows(df: DataFrame, key: str, content: Column | str, method: int, level: int) -> DataFrame:
    """``df`` with ``payload`` and ``error``: contents encoded block by block in parallel. Null contents stay null.

    Contents of up to ``WHOLE`` bytes are encoded where they are; only longer
    ones are shuffled by blocks and put together by ``key``, which must be unique.
    Stored contents need no coding.
    """
    size = codec.block_size(method, level)
    none = F.lit(None).cast("string")
    if method == codec.NONE:
        return df.withColumn("payload", col(content).cast("binary")).withColumn("error", none)
    rows = df.withColumn("_content", col(content).cast("binary"))
    whole = F.coalesce(F.octet_length("_content") <= WHOLE, F.lit(True))
    short = rows.where(whole).withColumn("_made", udfs.encode_content("_content", F.lit(method), F.lit(level)))
    short = short.withColumn("payload", F.col("_made.data")).withColumn("error", F.col("_made.error")).drop("_made", "_content")
    blocks = encode(split(rows.where(~whole), "_content", size).drop("_content"), method, level)
    # blocks are cut to size and levels are checked, so that none can fail
    others = [c for c in df.columns if c != key]
    long = reassemble(blocks, key, "encoded", *others).withColumn("error", none)
    return short.unionByName(long.select(*df.columns, "payload", "error"))


def encode_contents(df: DataFrame, key: str, content: Column | str, method: int, level: int) -> DataFrame:
    """(key, payload, error): contents encoded block by block in parallel."""
    rows = df.select(key, col(content).cast("binary").alias("_whole"))
    return encode_rows(rows, key, "_whole", method, level).drop("_whole")


def decode_contents(df: DataFrame, payload: str = "payload", method: Column | str = "method", level: Column | str = "level") -> DataFrame:
    """``df`` with ``content`` and ``error`` in place of the payload."""
    data, stored = col(payload), (col(method) == codec.NONE) & (col(level) == 0)
    # what is stored as it is needn't go through Python
    made = udfs.decode_content(F.when(~stored, data), col(method), col(level))
    out = df.withColumn("_made", made).withColumn("content", F.when(stored, data).otherwise(F.col("_made.data")))
    return out.withColumn("error", F.when(~stored, F.col("_made.error"))).drop("_made", payload)
