"""Appending a stream of inputs to an archive, one part archive per micro-batch partition.

Inputs (path, entry_type, permissions, content) are encoded as they come. A
batch's parts carry the stream's id, which its checkpoint keeps, and the
batch's number; a batch that is repeated after a failure replaces what it
wrote before, however many parts that were, and another stream's parts are
never touched. Inputs that can't be written (no path, an unknown type) are left
out and listed, with an error each, in the status table of the batch.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage import codec, schema
from stowage.functions import udfs
from stowage.operators import blocks
from stowage.sources import archive as source
from stowage.sources.parts import Place
from stowage.tables import Scratch


def encoded(inputs: DataFrame, method: int, level: int) -> DataFrame:
    """Inputs as entries with their payload, or with an error; works on streams, too."""
    file = F.col("entry_type") == schema.FILE
    made = udfs.encode_content(F.coalesce("content", F.lit(b"")), F.when(file, method).otherwise(0), F.when(file, level).otherwise(0))
    return entries(inputs.withColumn("_made", made).withColumn("payload", F.col("_made.data")).withColumn("error", F.col("_made.error")), method, level)


def entries(coded: DataFrame, method: int, level: int) -> DataFrame:
    wrong = F.when(F.col("path").isNull(), "no path").when(F.octet_length("path") > schema.MAX_PATH, "path too long").when(~F.coalesce(F.col("entry_type").between(0, 3), F.lit(False)), "unknown entry type")
    return coded.select(
        F.lit(schema.pack_version()).cast("long").alias("version"),
        F.octet_length("payload").cast("long").alias("content_size"),
        F.lit(method).cast("tinyint").alias("method"),
        F.lit(level).cast("tinyint").alias("level"),
        F.col("entry_type").cast("tinyint").alias("entry_type"),
        F.coalesce("permissions", F.lit(0)).cast("smallint").alias("permissions"),
        "path",
        "payload",
        F.coalesce(wrong, "error", F.when(F.col("payload").isNull(), "no payload")).alias("error"),
    )


def stream_id(spark, checkpoint: str) -> str:
    """The id that a stream's checkpoint holds from its start on."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()[0])["id"]


def add_batch(batch: DataFrame, number: int, path: str, stream: str, method: int = codec.DEFLATE, level: int = 8, status: str | None = None) -> None:
    """Appends one batch, in place of what the same stream and number wrote before."""
    scratch = Scratch(batch.sparkSession)
    rows = batch.withColumn("_row", F.monotonically_increasing_id())
    rows = scratch.store(rows.select("_row", "path", "entry_type", "permissions", F.col("content").cast("binary").alias("content")), "inputs")
    file = F.coalesce(F.col("entry_type") == schema.FILE, F.lit(False))
    coded = blocks.encode_rows(rows.where(file), "_row", F.coalesce("content", F.lit(b"")), method, level)
    other = rows.where(~file).withColumn("payload", F.when(F.col("entry_type") == schema.SYMLINK, F.coalesce("content", F.lit(b""))).otherwise(F.lit(b""))).withColumn("error", F.lit(None).cast("string"))
    made = scratch.store(entries(coded.unionByName(other), method, level), "coded")
    if status:
        made.select("path", "error").write.mode("overwrite").parquet(f"{status}/batch={number}")
    good = made.where("error is null").drop("error")
    good.write.format("archive").option("key", f"{stream}:{number}").mode("append").save(path)
    scratch.drop("inputs", "coded")


def append_stream(inputs: DataFrame, path: str, checkpoint: str, method: int = codec.DEFLATE, level: int = 8, status: str | None = None):
    """A started query that appends each micro-batch of ``inputs`` to the archive folder ``path``.

    (path, error) of each input go to the parquet table ``status``, by default
    ``<checkpoint>-status``. An unknown method or level fails at once.
    """
    codec.check_level(method, level)
    source.register(inputs.sparkSession)
    place = Place(path)
    if place.is_file:
        raise ValueError(f"streams append to folders of part archives, not to the file {path}")
    place.make()
    status = status or f"{checkpoint.rstrip('/')}-status"
    columns = inputs.select("path", "entry_type", "permissions", "content")

    def add(batch: DataFrame, number: int) -> None:
        add_batch(batch, number, path, stream_id(batch.sparkSession, checkpoint), method, level, status)

    return columns.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).start()
