"""Clustered tables with a key-range index, and tables that are checked in the pass that writes them."""

from __future__ import annotations

import bisect
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from protlake.session import delete_tree, scratch_path

RANGES = "_key_ranges"  # below the table; a leading underscore keeps it out of scans


def write_clustered(rows: DataFrame, path: str, key: str, files: int | None = None) -> None:
    """Parquet files of disjoint, sorted key ranges and a small table of each file's range. Rows without a key are kept in the first file."""
    dealt = rows.repartitionByRange(files, key) if files else rows.repartitionByRange(key)
    dealt.sortWithinPartitions(key).write.mode("overwrite").parquet(path)
    spark = rows.sparkSession
    # a file's range comes from its rows, so it holds whatever has been written
    spark.read.parquet(path).select(key, F.expr("_metadata.file_path").alias("file")).groupBy("file").agg(
        F.min(key).alias("low"), F.max(key).alias("high")).write.parquet(f"{path}/{RANGES}")


def files_with(spark: SparkSession, path: str, ids: DataFrame, key: str) -> list[str]:
    """The files whose range holds one of the keys. Ranges are few and disjoint: each key finds its file by bisection."""
    ranges = sorted((r.low, r.high, r.file) for r in spark.read.parquet(f"{path}/{RANGES}").where("low is not null").collect())
    lows, highs = [r[0] for r in ranges], [r[1] for r in ranges]

    @F.arrow_udf(T.IntegerType())
    def place(keys: pa.Array) -> pa.Array:
        at = [None if k is None else bisect.bisect_right(lows, k) - 1 for k in keys.to_pylist()]
        return pa.array([i if i is not None and i >= 0 and k <= highs[i] else None for i, k in zip(at, keys.to_pylist())], pa.int32())

    hit = ids.select(place(F.col(key)).alias("i")).where("i is not null").distinct().collect()  # at most the number of files
    return [ranges[r.i][2] for r in hit]


def read_clustered(spark: SparkSession, path: str, ids: DataFrame, key: str) -> DataFrame:
    """Rows of a key set from a clustered table; files whose range holds none of the keys are not opened."""
    files = files_with(spark, path, ids, key)
    rows = spark.read.parquet(*files) if files else spark.read.parquet(path).where("false")
    return rows.join(ids.select(key), key, "left_semi")


def write_observed(rows: DataFrame, path: str, figures: dict[str, Column], refuse: Callable[[dict], str | None]) -> dict:
    """Writes a table and its figures (aggregates) in one pass and publishes it only if ``refuse`` finds no fault with them.

    The rows go to a folder of their own first; a refused one is deleted, and nothing is left at ``path``. The accepted one is renamed.
    """
    spark = rows.sparkSession
    aside, seen = scratch_path(spark, "unpublished"), Observation()
    rows.observe(seen, *[c.alias(n) for n, c in figures.items()]).write.parquet(aside)
    found = seen.get
    fault = refuse(found)
    if fault:
        delete_tree(spark, aside)
        raise ValueError(f"{path}: {fault}: {found}")
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    if files.exists(target) or not files.rename(spark._jvm.org.apache.hadoop.fs.Path(aside), target):
        raise ValueError(f"{path} exists or lies in another file system than {aside}")
    return found


def non_empty(found: dict) -> str | None:
    """Refuses a table without rows; ``found`` has its ``rows``."""
    return None if found["rows"] else "no rows"
