"""Catalog operators: relational composition over entry rows, without touching contents.

A catalog has at least ``path``, ``content_size`` and ``ord``, a number that
orders its entries; other columns pass through. ``archive`` columns, where
given, keep several archives apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from stowage import schema
from stowage.functions import columns as c

#: A window of running sums sees entries whose orders differ in these many low bits at most; then buckets of buckets follow.
BITS = 21


def catalog(df: DataFrame, ord_: Column | str, path: Column, content: Column, entry_type: int = schema.FILE, permissions: int = 0o644, method: int = 0, level: int = 0) -> DataFrame:
    """Any DataFrame as entries: content as it is, one entry per row."""
    return df.select(
        c.col(ord_).cast("long").alias("ord"),
        path.alias("path"),
        F.lit(entry_type).cast("tinyint").alias("entry_type"),
        F.lit(permissions).cast("smallint").alias("permissions"),
        F.lit(method).cast("tinyint").alias("method"),
        F.lit(level).cast("tinyint").alias("level"),
        F.octet_length(content).cast("long").alias("content_size"),
        F.lit(schema.pack_version()).cast("long").alias("version"),
        content.cast("binary").alias("content"),
    )


def positions(entries: DataFrame, archive: tuple[str, ...] = ()) -> DataFrame:
    """``entries`` with ``pos``: the sum of the full sizes before each.

    Sums run inside buckets of orders that share all but their low bits, on top
    of sums over buckets, which are summed in the same way. So no task sees more
    than two million entries or buckets, however orders lie.
    """
    sized = entries.withColumn("_full", c.full_size("path", "content_size")).withColumn("_key", F.col("ord"))
    return _summed(sized, archive, 64 - BITS).withColumn("pos", F.col("_before").cast("long")).drop("_before", "_full", "_key")


def _summed(rows: DataFrame, archive: tuple[str, ...], left: int) -> DataFrame:
    """``rows`` with ``_before``: the sum of ``_full`` over those with a smaller ``_key``, which has ``left`` bits beyond the low ones."""
    if left <= 0:
        window = Window.partitionBy(*archive).orderBy("_key")
        return rows.withColumn("_before", F.coalesce(F.sum("_full").over(window.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    by = [*archive, "_up"]
    placed = rows.withColumn("_up", F.shiftright("_key", BITS))
    window = Window.partitionBy(*by).orderBy("_key").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("_own", F.coalesce(F.sum("_full").over(window), F.lit(0)))
    totals = rows.withColumn("_up", F.shiftright("_key", BITS)).groupBy(*by).agg(F.sum("_full").alias("_full")).withColumnRenamed("_up", "_key")
    before = _summed(totals, archive, left - BITS).select(*archive, F.col("_key").alias("_up"), F.col("_before").alias("_base"))
    return placed.join(before, by).withColumn("_before", F.col("_base") + F.col("_own")).drop("_base", "_own", "_up")


def listing(entries: DataFrame) -> DataFrame:
    """(ord, mode, path, full_size) as a directory listing."""
    return entries.select("ord", c.mode_string("entry_type", "permissions").alias("mode"), "path", c.full_size("path", "content_size").alias("full_size"))


def find(entries: DataFrame, path: str | Column) -> DataFrame:
    """The first entry of a path."""
    return entries.where(F.col("path") == path).orderBy("ord").limit(1)


def within(entries: DataFrame, directory: str) -> DataFrame:
    return entries.where(c.within_dir("path", directory))


def append(entries: DataFrame, new: DataFrame) -> DataFrame:
    """All of ``entries``, then all of ``new`` in their order; equal paths are kept.

    The new entries' orders follow the largest one there, which a scalar subquery finds.
    """
    last, first = entries.agg(F.max("ord").alias("last")).scalar(), new.agg(F.min("ord").alias("first")).scalar()
    shift = F.coalesce(last, F.lit(-1)) + 1 - F.coalesce(first, F.lit(0))
    return entries.unionByName(new.withColumn("ord", F.col("ord") + shift), allowMissingColumns=True)


def concatenate(*archives: DataFrame) -> DataFrame:
    """Archives one after the other are an archive."""
    out = archives[0]
    for further in archives[1:]:
        out = append(out, further)
    return out


def matches(entries: DataFrame, pending: DataFrame) -> DataFrame:
    """Of ``entries`` the first ones of each path, as many as ``pending`` has rows of it: those that an update replaces.

    Rows of ``pending`` with an ``error`` were never read and replace nothing.
    """
    return _ranked(entries, pending).where(F.col("_rank") <= F.coalesce("_count", F.lit(0))).drop("_rank", "_count")


def remove_matches(entries: DataFrame, pending: DataFrame) -> DataFrame:
    """``entries`` without ``matches``."""
    return _ranked(entries, pending).where(F.col("_rank") > F.coalesce("_count", F.lit(0))).drop("_rank", "_count")


def _ranked(entries: DataFrame, pending: DataFrame) -> DataFrame:
    if "error" in pending.columns:
        pending = pending.where(F.col("error").isNull())
    count = pending.groupBy("path").agg(F.count(F.lit(1)).alias("_count"))
    ranked = entries.withColumn("_rank", F.row_number().over(Window.partitionBy("path").orderBy("ord")))
    return ranked.join(count, "path", "left")


def update(entries: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` replaces entries of equal paths one for one, and stands behind the rest."""
    good = new.where(F.col("error").isNull()).drop("error") if "error" in new.columns else new
    return append(remove_matches(entries, new), good)


def remove(entries: DataFrame, keys: DataFrame, on: str = "pos") -> DataFrame:
    """``entries`` without those at the positions of ``keys``; a position given twice counts once."""
    return entries.join(keys.select(on).distinct(), on, "left_anti")


def remove_path(entries: DataFrame, path: str | Column) -> DataFrame:
    """``entries`` without the first entry of a path."""
    return entries.join(find(entries, path).select("ord"), "ord", "left_anti")


def remove_within(entries: DataFrame, directory: str) -> DataFrame:
    return entries.where(~c.within_dir("path", directory))


def remove_status(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """(path, error) for each path asked for; an error where no entry has it."""
    there = entries.select("path").distinct().withColumn("_there", F.lit(True))
    return asked.join(there, "path", "left").select("path", F.when(F.col("_there").isNull(), "non-existent path").alias("error"))


def first_requests(requests: DataFrame) -> DataFrame:
    """The first request of each path, by ``req``."""
    rank = F.row_number().over(Window.partitionBy("path").orderBy("req"))
    return requests.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def corruption(entries: DataFrame, files: DataFrame) -> DataFrame:
    """(archive, is_corrupted, is_truncated) for each of ``files`` (archive, length).

    Corrupted: bytes follow the last entry that parses, or none does. Truncated:
    the last entry's content passes the end.
    """
    ends = entries.groupBy("archive").agg(F.max(F.col("pos") + c.full_size("path", "content_size")).alias("_end"))
    end = F.coalesce("_end", F.lit(0))
    return files.join(ends, "archive", "left").select("archive", (end < F.col("length")).alias("is_corrupted"), (end > F.col("length")).alias("is_truncated"))


def all_succeeded(status: DataFrame) -> DataFrame:
    return status.agg(F.coalesce(F.bool_and(F.col("error").isNull()), F.lit(True)).alias("succeeded"))


def last_entry(entries: DataFrame) -> DataFrame:
    """The last entry's path and position of each archive."""
    return entries.groupBy("archive").agg(F.max_by("path", "pos").alias("path"), F.max("pos").alias("pos"))


def symlink_target(payload: Column | str, content_size: Column | str) -> Column:
    """The target of a link: its content without the closing zero byte; null if it is empty."""
    size = c.col(content_size)
    return F.when(size > 0, F.substring(c.col(payload), 1, (size - 1).cast("int")).cast("string"))
