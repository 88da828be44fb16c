"""Incremental runs: file streams with a checkpoint, running counters, periodic snapshots, arriving epochs."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from protlake.operators import metrics
from protlake.streaming.versions import Versions, append_unseen, publish_so_far, publish_state


def new_rows(spark: SparkSession, path: str, schema, fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).load(path)


def append_new(stream: DataFrame, out: str, checkpoint: str, transform: Callable[[DataFrame], DataFrame] | None = None) -> StreamingQuery:
    """Process only inputs not seen before and append exactly once; a second run over the same files adds nothing."""
    rows = transform(stream) if transform else stream
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint) \
        .outputMode("append").trigger(availableNow=True).start()


def append_keyed(stream: DataFrame, out: str, checkpoint: str, keys: list[str], transform: Callable[[DataFrame], DataFrame] | None = None, **index) -> StreamingQuery:
    """Adds rows whose key the table of versions at ``out`` does not have yet; read it with ``Versions.read``.

    Unlike ``append_new`` this holds without the checkpoint too: what was written before it existed, or was lost with it, is recognised by key.
    """
    table = Versions(stream.sparkSession, out)
    return stream.writeStream.foreachBatch(append_unseen(table, keys, transform, **index)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_counts(stream: DataFrame, keys: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Counts per status so far; every batch publishes a new version of the table at ``out``."""
    counts = stream.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.writeStream.foreachBatch(publish_state(Versions(stream.sparkSession, out))).option("checkpointLocation", checkpoint) \
        .outputMode("complete").trigger(availableNow=True).start()


def running_buckets(stream: DataFrame, thresholds: list[float], by: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Mergeable metric counters over arriving (score, y) rows. State is one row per group and threshold bucket; versions as in ``running_counts``."""
    table = Versions(stream.sparkSession, out)
    return metrics.bucket_counts(stream, thresholds, by).writeStream.foreachBatch(publish_state(table)) \
        .option("checkpointLocation", checkpoint).outputMode("complete").trigger(availableNow=True).start()


def metrics_on_read(buckets: DataFrame, thresholds: list[float], by: list[str] = (), *, cells: Column | None = None, dense: bool = False) -> DataFrame:
    """Best threshold so far. ``cells``: entries times terms of a group; those that no row has scored yet are negatives of score 0."""
    if not dense:
        if cells is None:
            raise ValueError("cells are needed to count what has no score; or declare the rows dense")
        seen = buckets.groupBy(*by).agg(F.sum(F.col("pos") + F.col("neg")).alias("__seen"))
        extra = seen.select(*by, metrics.bucket_of(F.lit(0.0), thresholds).alias("bucket"), F.lit(0).cast("bigint").alias("pos"),
                            (cells - F.col("__seen")).cast("bigint").alias("neg"))
        buckets = buckets.select(*by, "bucket", "pos", "neg").unionByName(extra)
    return metrics.best_threshold(metrics.with_ratios(metrics.threshold_counts(buckets, thresholds, by)), by)


def snapshot_each_batch(stream: DataFrame, out: str, checkpoint: str, run: str = "run") -> StreamingQuery:
    """Results so far after every micro-batch as a version of the table at ``out``; a batch writes only its own rows, and one that is retried changes nothing.

    ``run`` names the checkpoint: with a new checkpoint over the same table give another name.
    """
    table = Versions(stream.sparkSession, out)
    return stream.writeStream.foreachBatch(publish_so_far(table, run)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Stopping(StatefulProcessor):
    """Best value and epochs since it, one small state per run; epochs behind the stop change nothing."""

    def __init__(self, keys: list[str], patience: int, mode: str, min_delta: float, strict: bool):
        self.keys, self.patience, self.sign, self.min_delta, self.strict = keys, patience, 1.0 if mode == "max" else -1.0, min_delta, strict

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "best double, best_epoch bigint, since bigint, total bigint, stopped_at bigint, stop_epoch bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        best, best_epoch, since, total, stopped_at, stop_epoch = self.state.get() if self.state.exists() else (None, None, 0, 0, None, None)
        for epoch, value in sorted((int(e), v) for pdf in rows for e, v in zip(pdf["epoch"], pdf["value"])):
            total += 1
            if stopped_at is not None:
                continue
            v = None if value is None or pd.isna(value) or abs(value) == float("inf") else float(value) * self.sign
            if v is not None and (best is None or (v > best + self.min_delta if self.strict else v >= best + self.min_delta)):
                best, best_epoch, since = v, epoch, 0
            else:
                since += 1
            if since >= self.patience:
                stopped_at, stop_epoch = total, epoch
        self.state.update((best, best_epoch, since, total, stopped_at, stop_epoch))
        yield pd.DataFrame({**{k: [v] for k, v in zip(self.keys, key)}, "epochs_total": [total], "epochs_run": [total if stopped_at is None else stopped_at],
                            "stop_epoch": pd.array([stop_epoch], "Int64"), "best_epoch": pd.array([best_epoch], "Int64"),
                            "best_value": pd.array([None if best is None else best * self.sign], "Float64"), "stopped_early": [stopped_at is not None]})

    def close(self) -> None:
        pass


def stopping(stream: DataFrame, keys: list[str], patience: int, mode: str = "max", min_delta: float = 0.0, strict: bool = True) -> DataFrame:
    """``epochs.early_stop`` over arriving epochs: after each batch the present row of every run that got epochs.

    Epochs of a run arrive in order, batch after batch; inside a batch their order does not matter. The session needs the RocksDB state store.
    """
    kinds = ", ".join(f"`{k}` {stream.schema[k].dataType.simpleString()}" for k in keys)
    return stream.select(*keys, "epoch", "value").groupBy(*keys).transformWithStateInPandas(
        _Stopping(keys, patience, mode, min_delta, strict),
        f"{kinds}, epochs_total bigint, epochs_run bigint, stop_epoch bigint, best_epoch bigint, best_value double, stopped_early boolean", "update", "none")


def running_stops(stream: DataFrame, keys: list[str], patience: int, out: str, checkpoint: str, **rule) -> StreamingQuery:
    """The newest row of every run in the table of versions at ``out``: a batch's rows take the place of the runs' earlier ones."""
    table = Versions(stream.sparkSession, out)

    def save(batch: DataFrame, _: int) -> None:
        if table.numbers():
            old = table.read().join(batch.select(*keys), keys, "left_anti")
            batch = old.unionByName(batch)
        table.publish({"rows": [table.write(batch)]})
        table.expire(2)

    return stopping(stream, keys, patience, **rule).writeStream.foreachBatch(save).outputMode("update") \
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
