"""Named queries over the given tables and their SQL counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(run: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql.strip()
        return run
    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(column: str | Column, name: str | None = None) -> Column:
    """Six decimals: engines add floating-point numbers in different orders."""
    if isinstance(column, str):
        return F.round(F.col(column).cast("double"), 6).alias(name or column)
    out = F.round(column.cast("double"), 6)
    return out.alias(name) if name else out


def rounded(df: DataFrame) -> DataFrame:
    """All DOUBLE and FLOAT columns to six decimals."""
    kinds = dict(df.dtypes)
    return df.select(*[r6(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])
