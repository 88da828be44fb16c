"""Sinks. Order is made only here, by a range-partitioned sort, never inside operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from protlake import schemas
from protlake.operators.fragments import conform
from protlake.operators.splits import split_summary


def write_table(df: DataFrame, path: str, ddl: str | None = None, mode: str = "overwrite", partition_by: list[str] = ()) -> None:
    """Parquet under a declared schema when one is given."""
    rows = conform(df, ddl) if ddl else df
    writer = rows.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_manifest(fragments: DataFrame, entries: DataFrame, path: str) -> None:
    """Fragments in entry order, then model id with NULL first."""
    ordered = fragments.join(entries.select("entry_id", "ord"), "entry_id") \
        .orderBy("ord", F.coalesce("model_entity_id", F.lit("")))
    write_table(ordered, path, schemas.FRAGMENT_MANIFEST)


def write_failures(failures: DataFrame, path: str) -> None:
    conform(failures, schemas.FAILURE_LOG).write.mode("overwrite").csv(path, header=True)


def write_ground_truth(rows: DataFrame, path: str) -> None:
    rows.select(F.col("entry_id").alias("EntryID"), "term", "aspect").distinct().orderBy("EntryID", "term", "aspect") \
        .write.mode("overwrite").csv(path, sep="\t", header=True)


def write_report(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").csv(path, header=True)


def write_bundle(scores: DataFrame, path: str) -> None:
    """Score table partitioned by whichever of aspect and split it has."""
    parts = [c for c in ("aspect", "split") if c in scores.columns]
    write_table(scores, path, partition_by=parts)


def write_vocabulary(vocab: DataFrame, path: str) -> None:
    vocab.write.mode("overwrite").partitionBy("aspect").json(path)


def write_splits(split: DataFrame, vocab: DataFrame, ratios: tuple[float, float, float], seed: int, path: str) -> None:
    """Id lists in ``aspect=/split=`` folders and one summary table."""
    split.select("aspect", "split", "entry_id").write.mode("overwrite").partitionBy("aspect", "split").text(f"{path}/ids")
    split_summary(split, vocab, ratios, seed).write.mode("overwrite").json(f"{path}/summary")


def mirror_splits(spark, source: str, target: str, vocab: DataFrame) -> None:
    """Same splits for a second consumer with its own vocabulary."""
    spark.read.option("basePath", f"{source}/ids").text(f"{source}/ids") \
        .select("aspect", "split", "value").write.mode("overwrite").partitionBy("aspect", "split").text(f"{target}/ids")
    write_vocabulary(vocab, f"{target}/vocabulary")
