"""Run artifacts: training logs, run configs and summaries, entries metadata, vocabularies, score bundles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from protlake import schemas
from protlake.functions import scalar as fn


def read_training_logs(spark: SparkSession, path: str) -> DataFrame:
    """(run, aspect, epoch, values MAP<STRING,STRING>) from ``<run>/<aspect>/train.log``."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.log").text(path) \
        .select("value", F.expr("_metadata.file_path").alias("path"))
    at = F.split("path", "/")
    return parse_log_lines(raw.select(F.element_at(at, -3).alias("run"), F.upper(F.element_at(at, -2)).alias("aspect"), "value"))


def parse_log_lines(lines: DataFrame, text: str = "value") -> DataFrame:
    """Keeps lines that start with ``epoch=N``; the last value of a repeated key wins."""
    s = F.trim(text)
    pairs = F.regexp_extract_all(s, F.lit(r"(\S+?=\S+)"), F.lit(1))
    keys = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    last = F.filter(F.transform(pairs, lambda p, i: F.struct(p.alias("p"), i.alias("i"), F.substring_index(p, "=", 1).alias("k"))),
                    lambda q: ~F.exists(F.slice(keys, q.i + 2, F.size(keys)), lambda k: k == q.k))
    as_map = F.map_from_entries(F.transform(last, lambda q: F.struct(q.k, F.regexp_replace(q.p, "^[^=]*=", ""))))
    return lines.where(s.rlike(r"^epoch=\d+(\s|$)")).select(
        *[c for c in lines.columns if c != text], F.regexp_extract(s, r"^epoch=(\d+)", 1).cast("bigint").alias("epoch"),
        as_map.alias("values"))


def log_metrics(logs: DataFrame, names: list[str]) -> DataFrame:
    """One DOUBLE column per metric; absent or non-numeric ones are NULL."""
    return logs.select(*[c for c in logs.columns if c != "values"],
                       *[F.try_element_at("values", F.lit(n)).try_cast("double").alias(n) for n in names])


def log_values(logs: DataFrame) -> DataFrame:
    """Long rows with the typed reading of every value."""
    return logs.select(*[c for c in logs.columns if c != "values"], F.explode("values").alias("key", "text")) \
        .withColumn("v", fn.typed_value(F.col("text"))).select("*", "v.*").drop("v", "text")


def read_run_configs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(run, config…) from ``<run>/run_config.json``; runs without a file simply have no row."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "run_config.json") \
        .json(path, schema=schema, multiLine=True)
    return rows.select(F.element_at(F.split(F.expr("_metadata.file_path"), "/"), -2).alias("run"), "*")


def read_run_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(run, aspect, summary…) from ``<run>/<aspect>/summary.json``."""
    rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "summary.json") \
        .json(path, schema=schemas.RUN_SUMMARY, multiLine=True)
    at = F.split(F.expr("_metadata.file_path"), "/")
    return rows.select(F.element_at(at, -3).alias("run"), F.upper(F.element_at(at, -2)).alias("aspect"), "*")


def read_entries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, schema=schemas.ENTRIES_METADATA, multiLine=True)


def vocabulary_terms(text: Column) -> Column:
    """Term list of a vocabulary JSON: ``{"terms": […]}``, ``{term: count}`` or ``[…]``; counts sort their keys."""
    v = F.try_parse_json(text)
    return F.coalesce(
        F.try_variant_get(v, "$.terms", "array<string>"), F.try_variant_get(v, "$", "array<string>"),
        F.array_sort(F.map_keys(F.try_variant_get(v, "$", "map<string,variant>"))))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(path, term, term_index) of one or many vocabulary files."""
    raw = spark.read.text(path, wholetext=True)
    return raw.select(F.expr("_metadata.file_path").alias("path"), F.posexplode(vocabulary_terms(F.col("value"))).alias("term_index", "term"))


def read_bundle(spark: SparkSession, path: str, space: str = "probabilities") -> DataFrame:
    """(entry_id, term, value column) of a score table. Logit space without logits is refused."""
    rows = spark.read.parquet(path)
    need = "score" if space == "probabilities" else "logit"
    if need not in rows.columns:
        raise ValueError(f"{path} has no {need} column")
    return rows
