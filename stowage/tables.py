"""Reading input tables and keeping intermediate ones in shared storage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


#: Bytes of an Arrow batch on its way to Python, where a session doesn't set its own.
BATCH_BYTES = 8 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Bounds Arrow batches by bytes, since a batch of very long texts exists several times on its way."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``, a path that only Spark need be able to open."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` for work that is dear per row: dealt to all cores if it has fewer partitions than these, as from one small file."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor and the driver share: ``spark.checkpoint.dir``.

    Only where a session has none, as in tests on one machine, a temporary
    folder is made and remembered in the session.
    """
    if not (found := spark.conf.get("spark.checkpoint.dir", None)):
        found = f"file://{tempfile.mkdtemp(prefix='stowage-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries inside go when each ends, and not only when the JVM happens to collect them."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class Scratch:
    """Parquet tables below the shared folder, which cut lineage and outlive a lost executor.

    ``drop()`` deletes those that no later result reads; the rest go when the
    driver's JVM ends.
    """

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        small_batches(spark)
        self.top = f"{shared_dir(spark)}/stowage-{uuid.uuid4().hex}"
        self._path(self.top, lambda fs, p: fs.deleteOnExit(p))

    def _path(self, path: str, act):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return act(p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p)

    def path(self, name: str) -> str:
        return f"{self.top}/{name}"

    def store(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._path(self.path(name), lambda fs, p: fs.delete(p, True))

    def bytes(self, name: str) -> int:
        """What a stored table takes in storage: the size that a broadcast is checked against."""
        return self._path(self.path(name), lambda fs, p: fs.getContentSummary(p).getLength())
