"""Exact top-k search by distributed histogram selection.

Everything is scored, in blocks of vectors against blocks of queries. A pass adds up one histogram per query over all blocks and finds the bin with the
k-th largest score; the next pass divides that bin, until a bin is one score wide. Then every block gives its scores at or above
the k-th value, of the ties at that value those with the smallest ids, and the first k by score and id remain.

A block's histogram holds its own k best scores: lower ones can't be among the k best of all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from protlake.llm.vectors import matrix, usable
from protlake.session import staged

BLOCK, QUERY_BLOCK, BINS = 4096, 2048, 256


def quantised(v: Column, scale: int = 64) -> Column:
    """Components as floor(scale * x)."""
    return F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))


LEAST = np.iinfo(np.int64).min  # stands for no candidate


def _scores(q: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Integer inner products, computed in double precision where no sum can leave its exact range."""
    top = float(np.abs(q).max(initial=0)) * float(np.abs(v).max(initial=0)) * q.shape[1]
    if top < 2.0**53:
        return (q.astype(np.float64) @ v.astype(np.float64).T).astype(np.int64)
    return q @ v.T


def _best(scores: np.ndarray, k: int, floor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k largest scores of each row at or above ``floor``, ties to the smaller column number."""
    n = scores.shape[1]
    least = np.maximum(floor, LEAST + 1)
    if n > k:
        least = np.maximum(least, np.partition(scores, n - k, axis=1)[:, n - k])
    row, col = np.nonzero(scores >= least[:, None])
    order = np.lexsort((col, -scores[row, col], row))
    row, col = row[order], col[order]
    first = np.searchsorted(row, np.arange(len(scores)))
    keep = np.arange(len(row)) - first[row] < k
    return row[keep], col[keep]


def _blocks(rows: DataFrame, queries: DataFrame, blocks: int, query_blocks: int):
    """Both tables dealt out so that every block of vectors meets every block of queries of the same length once."""
    left = rows.select("dim", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int").alias("block"), "vec_id", "x",
                       F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("query_block"))
    right = queries.select("*", F.pmod(F.xxhash64("query_id", F.lit(1)), F.lit(query_blocks)).cast("int").alias("query_block"),
                           F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
    key = ("dim", "block", "query_block")
    return left.groupBy(*key).cogroup(right.groupBy(*key))


def _scored(left: pa.Table, right: pa.Table):
    left, right = left.combine_chunks(), right.combine_chunks()
    ids = left["vec_id"].to_numpy()
    order = np.argsort(ids, kind="stable")
    ids, v = ids[order], matrix(left["x"])[order]
    for low in range(0, right.num_rows, 512):
        some = right.slice(low, 512).combine_chunks()
        asked = some["query_id"].to_numpy()
        scores = _scores(matrix(some["x"]), v)
        own = np.searchsorted(ids, asked)
        there = np.flatnonzero((own < len(ids)) & (ids[np.minimum(own, len(ids) - 1)] == asked))
        scores[there, own[there]] = LEAST
        yield some, asked, ids, scores


def _histogram(k: int, width: int, bins: int):
    """Counts of a block's best scores in [low, high), by query and bin of ``width`` scores."""
    def histogram(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            for some, asked, _, scores in _scored(left, right):
                low, high = some["low"].to_numpy(), some["high"].to_numpy()
                scores[scores >= high[:, None]] = LEAST  # counted in an earlier pass
                row, col = _best(scores, k, low)
                place = (scores[row, col] - low[row]) // width
                pair, times = np.unique(row * bins + place, return_counts=True)
                out.append(pa.table({"query_id": asked[pair // bins], "bin": (pair % bins).astype(np.int32), "n": times.astype(np.int64)}))
        return pa.concat_tables(out) if out else pa.table({"query_id": pa.array([], pa.int64()), "bin": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})

    return histogram


def top_scores(vectors: DataFrame, queries: DataFrame, k: int = 20, scale: int = 64, bins: int = BINS) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score`` (long): the k largest inner products of floor(scale * x) for each query, exactly.

    ``vectors`` and ``queries`` have ``vec_id`` and ``embedding``; a query's own id is no candidate. Ties go to the smaller vec_id; with fewer
    than k candidates all are returned. Null vectors and vectors with a null or non-finite component take no part, zero vectors do; only vectors
    of the query's length are candidates. Other columns are not read. A vector's product with itself must lie below
    2**62, so that no score leaves a long; else the job fails.
    """
    rows = staged(usable(vectors).select("vec_id", F.size("v").alias("dim"), quantised(F.col("v"), scale).alias("x")), "topk-vectors")
    asked = staged(usable(queries).select(F.col("vec_id").alias("query_id"), F.size("v").alias("dim"), quantised(F.col("v"), scale).alias("x")), "topk-queries")
    square = F.max(F.expr("aggregate(x, 0D, (s, c) -> s + c * 1D * c)"))
    (count, longest), (wanted, far) = (t.agg(F.count(F.lit(1)), square).first() for t in (rows, asked))
    reach = int(max(longest or 0, far or 0) * (1 + 1e-9)) + 1  # no score is larger (Cauchy and Schwarz)
    if reach >= 2**62:
        raise ValueError("scores may lie beyond 2**62")
    blocks, query_blocks = max(1, -(-count // BLOCK)), max(1, -(-wanted // QUERY_BLOCK))

    # where the k-th score of each query lies: in [low, high), and how many are wanted from its top down
    span = 2 * reach + 1
    state = asked.select("query_id", "dim", "x", F.lit(-reach).cast("long").alias("low"), F.lit(reach + 1).cast("long").alias("high"), F.lit(k).cast("long").alias("need"))
    while span > 1:
        width = -(-span // bins)

        counted = _blocks(rows, state, blocks, query_blocks).applyInArrow(_histogram(k, width, bins), "query_id long, bin int, n long")
        summed = counted.groupBy("query_id", "bin").agg(F.sum("n").alias("n"))
        down = Window.partitionBy("query_id").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
        reached = summed.withColumn("sum", F.sum("n").over(down)).join(state.select("query_id", "need"), "query_id")
        # the first bin by which enough are there; with too few candidates the lowest score of all
        chosen = reached.filter(F.col("sum") >= F.col("need")).groupBy("query_id").agg(F.max(F.struct("bin", (F.col("sum") - F.col("n")).alias("above"))).alias("hit"))
        low = F.coalesce(F.col("low") + F.col("hit.bin").cast("long") * F.lit(width).cast("long"), "low").cast("long")
        # the last bin may reach beyond the range that was divided: what lies there is counted already
        state = staged(state.join(chosen, "query_id", "left").select(
            "query_id", "dim", "x", low.alias("low"), F.least(low + F.lit(width).cast("long"), "high").alias("high"),
            (F.col("need") - F.coalesce("hit.above", F.lit(0))).alias("need")), "topk-state")
        span = width

    def select(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            for some, asked_ids, ids, scores in _scored(left, right):
                row, col = _best(scores, k, some["low"].to_numpy())
                out.append(pa.table({"query_id": asked_ids[row], "vec_id": ids[col], "score": scores[row, col]}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})

    found = _blocks(rows, state, blocks, query_blocks).applyInArrow(select, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
