"""Shared parts of the two vector searches."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id`` and ``v`` (array<double>) of the vectors that take part.

    Left out are null ids, null and empty vectors and vectors with a null, NaN or infinite component. Rows that repeat a vec_id count once,
    with the smallest vector.
    """
    v = F.col("embedding").cast("array<double>")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(
        "vec_id is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf'))")
    return rows.groupBy("vec_id").agg(F.min("v").alias("v"))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equal length as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy().reshape(len(column), -1)


def best_of(scores: np.ndarray, k: int, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k largest finite scores of each row, ties to the smaller column number.

    With ``floor`` only scores at or above it, by row.
    """
    n = scores.shape[1]
    if n > k:
        least = np.partition(scores, n - k, axis=1)[:, n - k]
    else:
        least = np.full(len(scores), -np.inf)
    if floor is not None:
        least = np.maximum(least, floor)
    row, col = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
    # of the ties at the edge only the first columns: ranks run over (row, score descending, column)
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(len(scores)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], col[keep]


def table_of(batches: Iterable[pa.RecordBatch] | pa.Table) -> pa.Table:
    return batches if isinstance(batches, pa.Table) else pa.Table.from_batches(list(batches))
