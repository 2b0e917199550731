"""Joins that neither send one key's rows to one task nor move rows without a partner."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is frequent with more than this share of all rows, so there are at most so many frequent keys.
MOST_KEYS = 10_000
LEAST_ROWS = 100
#: Bits of a sieve: 8,192 bitmaps of 4 KB, 32 MB however many keys there are.
SIEVE_BUCKETS = 1 << 13
_BITMAP = 1 << 15


def spread_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", like: DataFrame | None = None) -> DataFrame:
    """``big`` joined with ``small``, which has each key once; ``how`` is ``inner`` or ``left``.

    Rows of a frequent key are dealt to several tasks, by a hash of their other
    columns, and its row of ``small`` is sent to each of these. Frequent keys
    come from counts combined before they are shuffled; there are at most
    ``MOST_KEYS``, so their list can be broadcast. Null keys match nothing. Keys are
    counted in ``like``, a stored table with the same keys as often, if ``big`` is
    dear to compute.
    """
    like = big if like is None else like
    total = like.agg(F.count(F.lit(1)).alias("n")).scalar()
    share = F.greatest(F.lit(LEAST_ROWS), F.ceil(total / MOST_KEYS))
    counts = like.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > share)
    frequent = F.broadcast(counts.select(*keys, F.ceil(F.col("_n") / share).cast("int").alias("_parts")))
    others = [c for c in big.columns if c not in keys]
    own = F.xxhash64(*others) if others else F.monotonically_increasing_id()
    parts = F.coalesce("_parts", F.lit(1))
    # rows without a key are dealt out, too
    nameless = F.lit(False)
    for k in keys:
        nameless = nameless | F.col(k).isNull()
    dealt = big.join(frequent, keys, "left").withColumn("_part", F.when(nameless, F.pmod(own, F.lit(MOST_KEYS))).otherwise(F.pmod(own, parts)).cast("int")).drop("_parts")
    copies = small.join(frequent, keys, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [*keys, "_part"], how).drop("_part")


def sieve(keys: DataFrame, hashed: Column) -> DataFrame:
    """(bucket, bits): bitmaps of the hashes of ``keys``, at most ``SIEVE_BUCKETS`` of 4 KB."""
    place = F.pmod(hashed, F.lit(SIEVE_BUCKETS * _BITMAP))
    rows = keys.select(F.floor(place / _BITMAP).cast("int").alias("_bucket"), F.pmod(place, F.lit(_BITMAP)).cast("long").alias("_bit"))
    return rows.groupBy("_bucket").agg(F.bitmap_construct_agg("_bit").alias("_bits"))


def sifted(rows: DataFrame, made: DataFrame, hashed: Column) -> DataFrame:
    """``rows`` with ``_maybe``: false only if no key of the sieve ``made`` has the hash. The sieve is broadcast."""
    bucket, bits, place = fresh(rows, "_bucket", "_bits", "_place")
    found = rows.withColumn(place, F.pmod(hashed, F.lit(SIEVE_BUCKETS * _BITMAP)))
    found = found.withColumn(bucket, F.floor(F.col(place) / _BITMAP).cast("int"))
    found = found.join(F.broadcast(made.select(F.col("_bucket").alias(bucket), F.col("_bits").alias(bits))), bucket, "left")
    bit = F.pmod(F.col(place), F.lit(_BITMAP)).cast("int")
    byte = F.conv(F.hex(F.substring(bits, F.shiftright(bit, 3) + 1, F.lit(1))), 16, 10).cast("int")
    # a mask by doubling, since shifts by a column have no function of their own
    mask = F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), bit.bitwiseAND(7) + 1)
    return found.withColumn("_maybe", F.coalesce(byte.bitwiseAND(mask) > 0, F.lit(False))).drop(bucket, bits, place)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them as long as ``df`` has such columns (of any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out
