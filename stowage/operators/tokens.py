"""The LZ77 tokens of contents as a table, and what is counted over them."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage import codec
from stowage.codec import lz77
from stowage.functions.columns import col, distance_symbol, length_symbol, litlen_symbol


def tokens(df: DataFrame, key: str, content: Column | str, level: int) -> DataFrame:
    """(key, block_no, token_no, literal, length, distance): a literal has its byte, a match its length and distance; the others are null.

    Blocks are those of Deflate at ``level``. Null and empty contents have no tokens.
    """
    codec.check_level(codec.DEFLATE, level)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            for owner, data in zip(batch.column(0), batch.column(1), strict=True):
                for number, block in enumerate(codec.split(data.as_py() or b"", codec.DEFLATE, level)):
                    value, distance = lz77.tokens(block, level)
                    n, match = len(value), distance > 0
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([owner.as_py()] * n, owner.type), pa.array(np.full(n, number, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(value.astype(np.int32), mask=match), pa.array(value.astype(np.int32), mask=~match), pa.array(distance.astype(np.int32), mask=~match)],
                        names=["key", "block_no", "token_no", "literal", "length", "distance"],
                    )

    rows = df.select(F.col(key).alias("key"), col(content).cast("binary").alias("content"))
    return rows.mapInArrow(run, f"key {kind}, block_no int, token_no int, literal int, length int, distance int").withColumnRenamed("key", key)


def totals(df: DataFrame, key: str, content: Column | str, level: int) -> DataFrame:
    """(key, blocks, tokens, bytes) of each content that has tokens: end symbols, tokens, and the bytes that they stand for.

    Counted where the tokens are made, a few blocks at a time, so that no row per token is passed on.
    """
    codec.check_level(codec.DEFLATE, level)
    kind = dict(df.dtypes)[key]

    def run(batches: Iterable[pa.RecordBatch]):
        for batch in batches:
            blocks, owner = [], []
            for i, data in enumerate(batch.column(1)):
                found = codec.split(data.as_py() or b"", codec.DEFLATE, level)
                blocks += found
                owner += [i] * len(found)
            ends, count, size = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for first, end in codec.grouped(blocks):
                value, distance, counts = lz77.tokens_of(blocks[first:end], level)
                rows = np.array(owner[first:end])
                np.add.at(ends, rows, 1)
                np.add.at(count, rows, counts)
                np.add.at(size, np.repeat(rows, counts), np.where(distance > 0, value, 1))
            has = np.flatnonzero(ends)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(has)), *(pa.array(x[has]) for x in (ends, count, size))], names=["key", "blocks", "tokens", "bytes"])

    rows = df.select(F.col(key).alias("key"), col(content).cast("binary").alias("content"))
    return rows.mapInArrow(run, f"key {kind}, blocks long, tokens long, bytes long").withColumnRenamed("key", key)


def is_match(length: Column | str = "length") -> Column:
    return col(length).isNotNull()


def symbols(found: DataFrame) -> DataFrame:
    """``found`` tokens with the ``symbol`` of the literal/length alphabet and the ``dist_symbol`` of matches."""
    symbol = litlen_symbol("literal", F.when(is_match(), length_symbol("length")))
    return found.withColumn("symbol", symbol).withColumn("dist_symbol", F.when(is_match(), distance_symbol("distance")))


def symbol_histogram(found: DataFrame, *by: str) -> DataFrame:
    """(by, alphabet, symbol, count) over tokens: 'litlen' with one end symbol for each block, and 'dist'."""
    known = symbols(found)
    litlen, dist = F.struct(F.lit("litlen").alias("alphabet"), F.col("symbol").cast("int").alias("symbol")), F.struct(F.lit("dist").alias("alphabet"), F.col("dist_symbol").cast("int").alias("symbol"))
    # each block has one token of number 0
    end = F.when(F.col("token_no") == 0, F.struct(F.lit("litlen").alias("alphabet"), F.lit(256).alias("symbol")))
    every = known.select(*by, F.explode(F.array_compact(F.array(litlen, F.when(is_match(), dist), end))).alias("_s"))
    return every.groupBy(*by, F.col("_s.alphabet").alias("alphabet"), F.col("_s.symbol").alias("symbol")).agg(F.count(F.lit(1)).alias("count"))
