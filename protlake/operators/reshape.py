"""Report reshapes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from protlake.functions import scalar as fn


def stack_tables(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def pivot_first(rows: DataFrame, index: list[str], column: str, values: list, value: str) -> DataFrame:
    return rows.groupBy(*index).pivot(column, values).agg(F.first(value, ignorenulls=True))


def ordered_pivot(rows: DataFrame, order: DataFrame, index: str, column: str, values: list, value: str) -> DataFrame:
    """Pivot with every row of the order table, also those without data. ``order`` = (index, ord)."""
    return order.join(pivot_first(rows, [index], column, values, value), index, "left")


def delta_to_baseline(rows: DataFrame, keys: list[str], value: str, is_baseline: Column, name: str = "delta") -> DataFrame:
    """Value minus the baseline row's value of the same key."""
    base = rows.where(is_baseline).groupBy(*keys).agg(F.max(value).alias("__base"))
    return rows.join(base, keys, "left").withColumn(name, F.col(value) - F.col("__base")).drop("__base")


def relabel(column: Column, mapping: dict[str, str]) -> Column:
    return F.coalesce(F.try_element_at(fn.literal_map(mapping), column), column)


def metric_rows(one_row: DataFrame) -> DataFrame:
    """Columns of a one-row table as (metric, value) rows."""
    return one_row.select(F.explode(F.array(*[
        F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in one_row.columns])).alias("r")) \
        .select("r.metric", "r.value")


def project(rows: DataFrame, columns: dict[str, str], **constants) -> DataFrame:
    """Select and rename columns, add constants."""
    return rows.select(*[F.col(a).alias(b) for a, b in columns.items()], *[F.lit(v).alias(k) for k, v in constants.items()])
