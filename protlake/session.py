"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import AbstractContextManager, contextmanager

from pyspark.sql import DataFrame, SparkSession

# AQE splits skewed join partitions and merges small shuffle partitions at run time.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # capturing a Python stack for every Column costs more than small plans take to run
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def build_session(app: str = "protlake", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local-mode session without the setting falls back to a temporary folder.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    local = tempfile.mkdtemp(prefix="protlake-")
    spark.conf.set("spark.checkpoint.dir", local)
    return local


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write once to the shared folder and read back.

    For tables several later branches need: the work is not repeated, lineage ends at files that outlive any
    executor, and each branch reads only its own columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def arrow_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most ``rows`` rows for what is written inside the block; the session's setting comes back at its end."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    if not 0 < int(before) <= rows:
        spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what is planned and run inside the block; the earlier ones come back at its end."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def small_files(spark: SparkSession) -> AbstractContextManager[None]:
    """For reads of many small files: they share tasks by the hundred, a few tasks list their folders, and the driver keeps no list beyond its read."""
    return settings(spark, {"spark.sql.files.openCostInBytes": str(64 << 10), "spark.sql.hive.filesourcePartitionFileCacheSize": "0",
                            "spark.sql.sources.parallelPartitionDiscovery.parallelism": str(4 * spark.sparkContext.defaultParallelism)})


def shuffles_dropped(spark: SparkSession) -> AbstractContextManager[None]:
    """Shuffle files of a query go at its end, not when the driver happens to collect its garbage.

    Nothing inside the block may cache a table: its lost parts would be made again.
    """
    return settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"})


class Scratch:
    """Tables in the shared folder for the length of a ``with`` block; all of them are deleted at its end.

    What the block returns must not read them: write it out with ``staged`` first.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.folder = scratch_path(spark, name)
        self._written = 0

    def table(self, df: DataFrame, by: list[str] = ()) -> DataFrame:
        """Written once and read back; with ``by`` in folders, of which a filter opens only its own."""
        self._written += 1
        path = f"{self.folder}/{self._written}"
        if by:
            df.write.partitionBy(*by).parquet(path)
            return self.spark.read.schema(df.schema).parquet(path)
        df.write.parquet(path)
        return self.spark.read.parquet(path)

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        delete_tree(self.spark, self.folder)


def delete_tree(spark: SparkSession, folder: str) -> None:
    """Delete a folder through Spark's file systems; a missing one is fine."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
