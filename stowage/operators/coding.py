"""Coding statistics as relational operators."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage.functions.columns import col

LIMIT = 15


def byte_histogram(df: DataFrame, content: Column | str) -> DataFrame:
    """(byte, count) over all contents: counted per batch, then summed."""

    def run(batches):
        total = np.zeros(256, np.int64)
        for batch in batches:
            for data in batch["data"]:
                if data is not None:
                    total += np.bincount(np.frombuffer(data, np.uint8), minlength=256)
        used = np.flatnonzero(total)
        yield pd.DataFrame({"byte": used.astype(np.int64), "count": total[used]})

    parts = df.select(col(content).cast("binary").alias("data")).mapInPandas(run, "byte long, count long")
    return parts.groupBy("byte").agg(F.sum("count").alias("count"))


def byte_histogram_native(df: DataFrame, content: Column | str) -> DataFrame:
    """The same by SQL functions alone, one row per byte on the way."""
    pairs = F.regexp_extract_all(F.hex(col(content).cast("binary")), F.lit("(..)"), F.lit(1))
    return df.select(F.explode(pairs).alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("count")).select(F.conv("pair", 16, 10).cast("long").alias("byte"), "count")


def canonical_codes(lengths: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """``lengths`` (sym, len) with each used symbol's canonical ``code``: the code space of those before it."""
    used = lengths.where("len > 0")
    before = Window.partitionBy(*by).orderBy("len", "sym").rowsBetween(Window.unboundedPreceding, -1)
    space = F.expr(f"shiftleft(1L, {LIMIT} - cast(len as int))")
    taken = F.coalesce(F.sum(space).over(before), F.lit(0))
    return used.withColumn("_taken", taken).withColumn("code", F.expr(f"shiftright(_taken, {LIMIT} - cast(len as int))").cast("long")).drop("_taken")


def kraft(lengths: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Per group the Kraft sum in units of 2**-15, the used symbols, and whether the lengths make a valid code."""
    used = lengths.where("len > 0")
    out = used.groupBy(*by).agg(F.sum(F.expr(f"shiftleft(1L, {LIMIT} - cast(len as int))")).cast("long").alias("kraft_sum"), F.count(F.lit(1)).alias("symbols"))
    return out.withColumn("is_valid", (F.col("symbols") <= 1) | (F.col("kraft_sum") == 1 << LIMIT))


def kraft_of(lengths: Column | str) -> Column:
    """``kraft`` of an array of code lengths, inside its row."""
    used = F.filter(col(lengths), lambda x: x > 0)
    units = F.array(*(F.lit(1 << (LIMIT - n)).cast("long") for n in range(1, LIMIT + 1)))
    total = F.aggregate(used, F.lit(0).cast("long"), lambda x, n: x + F.element_at(units, n.cast("int")))
    symbols = F.size(used).cast("long")
    return F.struct(total.alias("kraft_sum"), symbols.alias("symbols"), ((symbols <= 1) | (total == 1 << LIMIT)).alias("is_valid"))


def runs(lengths: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(run, len, reps): runs of equal lengths in the order of ``idx``."""
    order = Window.partitionBy(*by).orderBy("idx")
    begins = F.when(F.lag("len").over(order) == F.col("len"), 0).otherwise(1)
    numbered = lengths.withColumn("_begins", begins).withColumn("run", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "run").agg(F.first("len").alias("len"), F.count(F.lit(1)).alias("reps"))


def run_symbol_counts(found: DataFrame) -> DataFrame:
    """``found`` (len, reps) with how often the run symbols 16, 17 and 18 and the length itself are counted."""
    reps, zero = F.col("reps"), F.col("len") == 0
    rest, more = reps % 138, reps - 1
    whole = lambda x: F.floor(x).cast("long")
    return (
        found.withColumn("sym16", F.when(zero, 0).otherwise(whole(more / 6) + F.when(more % 6 >= 3, 1).otherwise(0)).cast("long"))
        .withColumn("sym17", F.when(zero & (rest >= 3), 1).otherwise(0).cast("long"))
        .withColumn("sym18", F.when(zero, whole(reps / 138) + F.when(rest >= 11, 1).otherwise(0)).otherwise(0).cast("long"))
        .withColumn("own", F.when(zero, F.when(rest < 3, rest).otherwise(0)).otherwise(1 + F.when(more % 6 < 3, more % 6).otherwise(0)).cast("long"))
    )
