"""Data checks. Each returns a small report; ``require`` turns a report into an error."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def require(report: DataFrame, column: str, expected, message: str) -> None:
    row = report.first()
    if row is None or row[column] != expected:
        raise ValueError(f"{message}: {row.asDict() if row else 'no rows'}")


def missing_sequences(wanted: DataFrame, sequences: DataFrame) -> DataFrame:
    """Count of selected ids without a sequence and the first five."""
    gone = wanted.select("entry_id").distinct().join(sequences.select("entry_id"), "entry_id", "left_anti")
    first = gone.orderBy("entry_id").limit(5).agg(F.array_sort(F.collect_list("entry_id")).alias("first_ids"))
    return gone.agg(F.count("*").alias("missing")).withColumn("first_ids", first.scalar())


def alignment_counts(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Ids only left, only right and in both."""
    a = left.select(key).distinct().withColumn("__a", F.lit(1))
    b = right.select(key).distinct().withColumn("__b", F.lit(1))
    return a.join(b, key, "full").agg(
        F.count_if(F.col("__b").isNull()).alias("left_only"), F.count_if(F.col("__a").isNull()).alias("right_only"),
        F.count_if(F.col("__a").isNotNull() & F.col("__b").isNotNull()).alias("both"))


def bundle_compatibility(first: DataFrame, second: DataFrame) -> DataFrame:
    """One row: differing entries, differing terms, row counts, and whether the tables can be fused."""
    entries, terms = alignment_counts(first, second, "entry_id"), alignment_counts(first, second, "term")
    out = first.agg(F.count("*").alias("first_rows")).withColumn("second_rows", second.agg(F.count("*")).scalar())
    for name, table in (("entries", entries), ("terms", terms)):
        out = out.withColumn(f"{name}_differ", table.select(F.col("left_only") + F.col("right_only")).scalar())
    return out.withColumn("compatible", (F.col("entries_differ") == 0) & (F.col("terms_differ") == 0)
                          & (F.col("first_rows") == F.col("second_rows")))


def vector_widths(rows: DataFrame, vector: str, expected: int | None = None) -> DataFrame:
    """Distinct widths, smallest and largest; ``uniform`` also needs the expected width when given."""
    w = F.size(vector)
    out = rows.where(F.col(vector).isNotNull()).agg(F.count("*").alias("vectors"), F.count_distinct(w).alias("widths"),
                                                    F.min(w).alias("min_width"), F.max(w).alias("max_width"))
    ok = F.col("widths") == 1
    return out.withColumn("uniform", ok if expected is None else ok & (F.col("min_width") == expected))


def completeness(rows: DataFrame, key: str, expected: int) -> DataFrame:
    """missing / partial / complete against the expected number of distinct keys."""
    out = rows.agg(F.count_distinct(key).alias("found"))
    return out.withColumn("expected", F.lit(expected).cast("bigint")).withColumn(
        "status", F.when(F.col("found") == 0, "missing").when(F.col("found") < expected, "partial").otherwise("complete"))


def non_empty(rows: DataFrame, what: str) -> DataFrame:
    """The rows, or an error when there are none; reads at most one row."""
    if rows.limit(1).count() == 0:
        raise ValueError(f"no {what}")
    return rows


def matrix_shapes(rows: DataFrame, matrix: str, count: str) -> DataFrame:
    """Rows whose matrix is not square with the given size."""
    from protlake.functions.scalar import is_square
    return rows.where(~F.coalesce(is_square(F.col(matrix), F.col(count)), F.lit(False)))


def artifact_gaps(listed: DataFrame, present: DataFrame, path: str) -> DataFrame:
    """Count of listed artifacts that do not exist. ``present`` = (path) from a file listing."""
    return listed.where(F.coalesce(path, F.lit("")) != "").join(
        present.select(F.col("path").alias(path)).distinct(), path, "left_anti").agg(F.count("*").alias("missing"))
