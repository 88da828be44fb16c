"""Tables of versions: rows are written into folders of their own and become visible by one small commit file.

A version is the list of the folders that make it up. A reader takes the newest commit, so a run that fails before it has published leaves the former version
as it was; folders that no kept commit names are leftovers and go when versions expire. All file work goes through Spark's file systems.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

BUCKETS = 64  # of a key index; more for larger tables, the same for all runs over one table


class Versions:
    """The versions of the table at ``path``. A commit has named parts (lists of folders below ``path``) and a ``mark`` of who wrote it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, folder: str) -> list[str]:
        at = self._at(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def numbers(self) -> list[int]:
        """Published versions, oldest first."""
        return [int(n) for n in self._names("commits") if n.isdigit()]

    def commit(self, number: int | None = None) -> dict:
        """A version's parts and mark; of the newest without a number, empty before the first."""
        numbers = self.numbers()
        if not numbers:
            return {"parts": {}, "mark": None}
        # one line of text, read by Spark like any input
        return json.loads(self.spark.read.text(f"{self.path}/commits/{number if number is not None else numbers[-1]:020d}", wholetext=True).first()[0])

    def write(self, rows: DataFrame, part: str = "rows", by: str | None = None) -> str:
        """Writes rows into a new folder and gives its name; nothing is published yet."""
        folder = f"{part}-{uuid.uuid4().hex}"
        writer = rows.write.partitionBy(by) if by else rows.write
        writer.parquet(f"{self.path}/{folder}")
        return folder

    def publish(self, parts: dict[str, list[str]], mark: str | None = None) -> int:
        """Makes a new version of these folders, all at once: the commit file is written aside and renamed."""
        numbers = self.numbers()
        number = numbers[-1] + 1 if numbers else 0
        self._fs.mkdirs(self._at("commits"))
        aside = self._at(f"aside-{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps({"parts": parts, "mark": mark}), "utf-8"))
        out.close()
        if not self._fs.rename(aside, self._at(f"commits/{number:020d}")):
            raise RuntimeError(f"version {number} of {self.path} has been published by another run")
        return number

    def read(self, part: str = "rows", number: int | None = None) -> DataFrame:
        """Rows of a version, of the newest without a number."""
        folders = self.commit(number)["parts"].get(part, [])
        if not folders:
            raise ValueError(f"{self.path} has no published {part}")
        # buckets of a key index are folders below each of them
        return self.spark.read.option("recursiveFileLookup", "true").parquet(*[f"{self.path}/{f}" for f in folders])

    def expire(self, keep: int = 2) -> None:
        """Drops all but the newest ``keep`` versions, then the folders that no version names."""
        for number in self.numbers()[:-keep]:
            self._fs.delete(self._at(f"commits/{number:020d}"), False)
        named = {f for n in self.numbers() for folders in self.commit(n)["parts"].values() for f in folders}
        for name in self._names(""):
            if name != "commits" and name not in named:
                self._fs.delete(self._at(name), True)


def publish_state(table: Versions, keep: int = 2) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch`` in complete mode: each batch's results so far as a new version."""
    def save(batch: DataFrame, _: int) -> None:
        table.publish({"rows": [table.write(batch)]})
        table.expire(keep)
    return save


def publish_so_far(table: Versions, run: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: a version has all rows so far, a batch writes only its own. A batch of the same ``run`` that comes again changes nothing."""
    def save(batch: DataFrame, number: int) -> None:
        before = table.commit()
        at = before["mark"].rpartition(":") if before["mark"] else ("", "", "-1")
        if at[0] == run and int(at[2]) >= number:
            return
        folder = table.write(transform(batch) if transform else batch)
        table.publish({"rows": [*before["parts"].get("rows", []), folder]}, f"{run}:{number}")
    return save


def append_unseen(table: Versions, keys: list[str], transform: Callable[[DataFrame], DataFrame] | None = None, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: adds the rows whose key no published row has, one for each key.

    The keys of the published rows lie in hash buckets, and a batch reads only its own buckets of them. Rows and keys are published together,
    so a run that starts over without its checkpoint, or repeats a batch, adds nothing twice.
    """
    bucket = F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")

    def save(batch: DataFrame, _: int) -> None:
        before = table.commit()["parts"]
        rows = (transform(batch) if transform else batch).dropDuplicates(keys).withColumn("__bucket", bucket)
        if before.get("keys"):
            touched = [r[0] for r in rows.select("__bucket").distinct().collect()]  # at most ``buckets``
            index = table.spark.read.schema(rows.select(*keys, "__bucket").schema)
            known = reduce(DataFrame.unionByName, [index.parquet(f"{table.path}/{f}").where(F.col("__bucket").isin(touched)) for f in before["keys"]])
            rows = rows.join(known, [*keys, "__bucket"], "left_anti")
        written = table.write(rows.drop("__bucket"))
        added = table.spark.read.parquet(f"{table.path}/{written}")
        if before and added.isEmpty():
            return
        index = table.write(added.select(*keys).withColumn("__bucket", bucket).repartition("__bucket"), "keys", by="__bucket")
        table.publish({"rows": [*before.get("rows", []), written], "keys": [*before.get("keys", []), index]})
    return save
