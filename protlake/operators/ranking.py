"""Ranks, winners and exact quantiles that stay distributed when one key is hot."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from protlake.functions import scalar as fn
from protlake.session import Scratch, staged


# Spark prunes each map task to k rows per key (WindowGroupLimit) only up to this k.
GROUP_LIMIT = 1000
SALTS = 64


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key; ``order`` must end in a tie-break for a stable result.

    Up to GROUP_LIMIT rows Spark prunes before the shuffle by itself. For a larger k the rows of a key are first
    ranked in salted parts, so a hot key never arrives whole in one task either.
    """
    name = rank or "__rank"
    src = df
    if k > GROUP_LIMIT:
        salted = df.withColumn("__salt", F.pmod(F.spark_partition_id(), F.lit(SALTS)))  # any dealing will do, whatever the column types
        part = F.row_number().over(W.partitionBy(*keys, "__salt").orderBy(*order))
        src = salted.withColumn("__part", part).where(F.col("__part") <= k).drop("__salt", "__part")
    out = src.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)
    return out if rank else out.drop(name)


def best_per_group(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return top_k(df, keys, order, 1)


def first_n(df: DataFrame, order: list[Column], n: int | None) -> DataFrame:
    """First rows in input order, after whatever filters ``df`` already has."""
    return df if n is None else df.orderBy(*order).limit(n)


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on keys where NULL equals NULL; right key columns are dropped."""
    renamed = right.select(*[F.col(c).alias(f"__r_{c}") if c in keys else F.col(c) for c in right.columns])
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"__r_{c}")) for c in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{c}" for c in keys])


def bucket_offsets(df: DataFrame, keys: list[str], bucket: str, weight: Column) -> DataFrame:
    """Rows before each bucket and in total per key; ``bucket`` has a small fixed value range."""
    sizes = df.groupBy(*keys, bucket).agg(F.sum(weight).alias("__size"))
    w = W.partitionBy(*keys)
    running = w.orderBy(bucket).rowsBetween(W.unboundedPreceding, W.currentRow)
    return sizes.select(
        *keys, bucket, "__size",
        (F.sum("__size").over(running) - F.col("__size")).alias("__before"),
        F.sum("__size").over(w).alias("__total"),
    )


def hash_rank(df: DataFrame, keys: list[str], id_col: str, seed: int, prefix: int = 3,
              per_group: Callable[[Column], Column] | None = None) -> DataFrame:
    """Exact rank (1-based) of each id in md5 order per key, plus the key's row count.

    md5 spreads ids evenly over 16**prefix buckets, so no task ever holds a whole key. ``per_group`` adds
    ``group_info``, computed from the row count on the small bucket table.
    """
    hashed = df.withColumn("__h", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))) \
        .withColumn("__b", F.substring("__h", 1, prefix))
    offsets = bucket_offsets(hashed, keys, "__b", F.lit(1))
    info = [per_group(F.col("__total")).alias("group_info")] if per_group else []
    offsets = offsets.select(*keys, "__b", "__before", F.col("__total").alias("group_size"), *info)
    local = F.row_number().over(W.partitionBy(*keys, "__b").orderBy("__h", id_col))
    ranked = hashed.withColumn("__local", local)
    return null_safe_join(ranked, offsets, [*keys, "__b"]).select(
        *df.columns,
        (F.col("__before") + F.col("__local")).alias("hash_rank"), "group_size", *(["group_info"] if per_group else []))


DIGIT = 16  # bits that a counting pass settles
_WIDTH = 64


@F.arrow_udf(T.LongType())
def _order_bits(values: pa.Array) -> pa.Array:
    """Doubles as signed integers of the same order; both zeros are one value, NaN is the largest."""
    v = values.to_numpy(zero_copy_only=False) + 0.0
    v[np.isnan(v)] = np.nan
    bits = v.view(np.int64)
    return pa.array(np.where(bits < 0, bits ^ np.int64(2**63 - 1), bits))


@F.arrow_udf(T.DoubleType())
def _from_order_bits(bits: pa.Array) -> pa.Array:
    b = bits.to_numpy(zero_copy_only=False)
    return pa.array(np.where(b < 0, b ^ np.int64(2**63 - 1), b).view(np.float64))


def wanted_ranks(counts: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """(keys…, rank): the ranks from 0 that linear interpolation at ``probs`` needs, from (keys…, __total)."""
    at = [F.lit(float(p)) * (F.col("__total") - 1) for p in probs]
    return counts.select(*keys, F.explode(F.array_distinct(F.array(*[f(p).cast("bigint") for p in at for f in (F.floor, F.ceil)]))).alias("rank"))


def values_at(coded: DataFrame, keys: list[str], probs: list[float], scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """(keys…, rank, __v) and (keys…, __total): the values that ``probs`` need, by radix selection over (keys…, __k) in order bits.

    A pass counts the next ``DIGIT`` bits of the rows that share a prefix with a wanted value and so settles them. Only counts
    are shuffled, combined before and at most 2**DIGIT for each key and open prefix, however many rows a key has.
    """
    w = W.partitionBy(*keys, "__p").orderBy("__d").rowsBetween(W.unboundedPreceding, W.currentRow)

    def counted(settled: int, wanted: DataFrame | None) -> DataFrame:
        prefix = F.shiftright("__k", _WIDTH - settled) if settled else F.lit(0).cast("bigint")
        digit = F.shiftright("__k", _WIDTH - settled - DIGIT)
        rows = coded.select(*keys, prefix.alias("__p"), (digit.bitwiseAND(F.lit(2**DIGIT - 1)) if settled else digit).alias("__d"))
        if wanted is not None:
            rows = null_safe_join(rows, wanted.select(*keys, "__p").distinct(), [*keys, "__p"], "left_semi")
        return rows.groupBy(*keys, "__p", "__d").agg(F.count("*").alias("__n"))

    def narrowed(wanted: DataFrame, counts: DataFrame, settled: int) -> DataFrame:
        ends = counts.withColumn("__end", F.sum("__n").over(w))
        hit = null_safe_join(wanted, ends, [*keys, "__p"]).where((F.col("__left") < F.col("__end")) & (F.col("__left") >= F.col("__end") - F.col("__n")))
        base = F.shiftleft("__p", DIGIT) if settled else F.lit(0).cast("bigint")
        return hit.select(*keys, "rank", (F.col("__left") - F.col("__end") + F.col("__n")).alias("__left"), (base + F.col("__d")).alias("__p"))

    first = scratch.table(counted(0, None))
    totals = first.groupBy(*keys).agg(F.sum("__n").alias("__total"))
    wanted = wanted_ranks(totals, keys, probs).select(*keys, "rank", F.col("rank").alias("__left"), F.lit(0).cast("bigint").alias("__p"))
    wanted = narrowed(wanted, first, 0)
    for settled in range(DIGIT, _WIDTH, DIGIT):
        wanted = narrowed(wanted, counted(settled, wanted), settled)
        if settled + DIGIT < _WIDTH:
            wanted = scratch.table(wanted)
    return wanted.select(*keys, "rank", _from_order_bits("__p").alias("__v")), totals


def exact_quantiles(df: DataFrame, keys: list[str], value: str, probs: list[float]) -> DataFrame:
    """Exact linear-interpolated quantiles: one row per key and probability ``(keys…, q, quantile)``.

    Built-in ``percentile`` keeps every distinct value of a key in one buffer. Here the wanted ranks are found by radix
    selection (``values_at``), so no task holds, sorts or windows the values of a key. NULL values do not count; NaN is the largest value.
    """
    if not keys:
        return exact_quantiles(df.withColumn("__one", F.lit(1)), ["__one"], value, probs).drop("__one")
    with Scratch(df.sparkSession, "quantiles") as scratch:
        coded = scratch.table(df.where(F.col(value).isNotNull()).select(*keys, _order_bits(F.col(value).cast("double")).alias("__k")))
        found, totals = values_at(coded, keys, probs, scratch)
        at = F.transform(fn.double_array(probs), lambda p: F.struct(p.alias("q"), (p * (F.col("__total") - 1)).alias("pos")))
        # each value goes to the probabilities that lie next to its rank
        beside = F.filter("__at", lambda a: F.abs(a.pos - F.col("rank")) < 1)
        shares = null_safe_join(found, totals.withColumn("__at", at), keys).select(*keys, "__v", "rank", F.explode(beside).alias("__a")) \
            .withColumn("__end", F.struct(F.col("rank") - F.col("__a.pos"), "__v"))
        ends = shares.groupBy(*keys, F.col("__a.q").alias("q")).agg(F.min("__end").alias("low"), F.max("__end").alias("high"))
        low, high = (F.col(f"{e}.__v") for e in ("low", "high"))
        part = -F.col("low.col1")
        return staged(ends.select(*keys, "q", F.when((part == 0) | (low == high), low).otherwise(low * (1 - part) + high * part).alias("quantile")), "quantiles")


def numbered(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Rows numbered from 0 in order of ``order`` within each key, by a distributed prefix scan.

    Rows are dealt out in ranges of (keys, order), so a large key lies in several tasks. Each row's place in its range is known from
    the sorted write; the places before a range follow from the ranges' row counts, one per key and range.
    """
    place = F.monotonically_increasing_id()  # range number in the upper bits, place in the lower 33
    with Scratch(df.sparkSession, "numbered") as scratch:
        ranged = scratch.table(df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order).withColumn("__at", place))
        parts = ranged.groupBy(*keys, F.shiftright("__at", 33).alias("__part")).agg(F.min("__at").alias("__first"), F.count("*").alias("__n"))
        before = W.partitionBy(*keys).orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
        offsets = parts.select(*keys, "__part", (F.coalesce(F.sum("__n").over(before), F.lit(0)) - F.col("__first")).alias("__shift"))
        located = ranged.withColumn("__part", F.shiftright("__at", 33))
        return staged(null_safe_join(located, offsets, [*keys, "__part"]).select(*df.columns, (F.col("__at") + F.col("__shift")).alias(name)), "numbered")


SKETCH_K, SKETCH_BOUND = 400, 0.01  # a sketch's size, and the error of a rank as a share of all rows that it keeps with high probability


def value_sketches(df: DataFrame, keys: list[str], value: str, k: int = SKETCH_K) -> DataFrame:
    """(keys…, sketch): a mergeable KLL sketch of the values of each key, of bounded size; sketches of batches can be stored and merged on read."""
    return df.groupBy(*keys).agg(F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def sketched_quantiles(sketches: DataFrame, keys: list[str], probs: list[float]) -> DataFrame:
    """(keys…, q, quantile) from any number of stored sketches per key. Ranks are off by ``SKETCH_BOUND`` at most, with high probability."""
    merged = sketches.groupBy(*keys).agg(F.kll_merge_agg_double("sketch").alias("sketch"))
    each = F.array(*[F.struct(fn.d(p).alias("q"), F.kll_sketch_get_quantile_double("sketch", fn.d(p)).alias("quantile")) for p in probs])
    return merged.select(*keys, F.inline(each))


SUMMARY_PROBS = {"p50": 0.50, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def numeric_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """count, min, p50, p90, p95, p99, max, mean per key; all NULL but the count when empty."""
    moments = df.groupBy(*keys).agg(
        F.count(value).alias("count"), F.min(F.col(value).cast("double")).alias("min"),
        F.max(F.col(value).cast("double")).alias("max"), F.avg(F.col(value).cast("double")).alias("mean"))
    quantiles = exact_quantiles(df, keys, value, list(SUMMARY_PROBS.values()))
    wide = quantiles.groupBy(*keys).agg(
        *[F.max(F.when(F.col("q") == p, F.col("quantile"))).alias(n) for n, p in SUMMARY_PROBS.items()])
    if keys:
        joined = null_safe_join(moments, wide, keys, "left")
    else:
        joined = moments.withColumn("__w", wide.select(F.struct(*SUMMARY_PROBS).alias("w")).scalar()).select("*", "__w.*")
    return joined.select(*keys, "count", "min", *SUMMARY_PROBS, "max", "mean")
