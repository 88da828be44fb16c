"""Applying stored scorers, calibration and late fusion."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from protlake import constants as C
from protlake.functions import scalar as fn
from protlake.operators import metrics
from protlake.session import staged

# A weight matrix up to this size is shipped once to every executor; a larger one is joined block by block.
BROADCAST_LIMIT = 64 << 20
BLOCK_TERMS, BLOCK_ROWS = 512, 4096  # a pair of blocks gives two million scores
# Most score cells one Python task holds at a time.
OUTPUT_CELLS = 1 << 20


def linear_scores(features: DataFrame, weights: DataFrame, vector: str = "embedding", bias: bool = True,
                  broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """logit = W.x + b for every (entry, term): (entry_id, term, logit DOUBLE).

    ``weights`` = (term, w ARRAY[, b]). Its exact size is read first; it decides between one shipped matrix
    (a batched product per Arrow batch) and a block-wise equi-join.
    """
    w = weights if bias else weights.withColumn("b", fn.d(0))
    size, width = _checked(w)
    if not size and weights.isEmpty():
        return features.select(F.col("entry_id").cast("string").alias("entry_id"), F.lit(None).cast(weights.schema["term"].dataType).alias("term"),
                               F.lit(None).cast("double").alias("logit")).where("false")
    features = _of_width(features, vector, width)
    if size > broadcast_limit:
        return _blocked_product(features, w, vector)
    # names come from the same ordering as the matrix rows; only numbers cross the Python boundary
    names = w.agg(F.array_sort(F.collect_list("term")).alias("t")).scalar()
    product = _shipped_product(features, w, vector).withColumn("__t", names)
    return product.select("entry_id", F.inline(F.arrays_zip(F.col("__t").alias("term"), F.col("logits").alias("logit"))))


def _checked(weights: DataFrame) -> tuple[int, int]:
    """Bytes of the matrix with its term texts, and its width. A NULL or doubled term, a NULL or ragged vector or a NULL bias is an error on every route."""
    width = F.size("w")
    s = weights.agg(F.count("*").alias("n"), F.count_distinct("term").alias("terms"), F.min(width).alias("low"), F.max(width).alias("high"), F.count("w").alias("vectors"),
                    F.count("b").alias("biases"), F.coalesce(F.sum(width.cast("bigint") * 8 + F.octet_length(F.col("term").cast("string"))), F.lit(0)).alias("bytes")).first()
    if s["n"] != s["terms"]:
        raise ValueError("weights: terms must be distinct and not NULL")
    if s["n"] != s["vectors"] or s["n"] != s["biases"] or s["low"] != s["high"]:
        raise ValueError("weights: vectors must have one width, and vectors and biases must not be NULL")
    return s["bytes"], s["low"] or 0


def _of_width(features: DataFrame, vector: str, width: int) -> DataFrame:
    """Features whose vectors fit the weights; another width is an error on every route."""
    fits = F.col(vector).isNull() | (F.size(vector) == width)
    return features.where(F.when(fits, True).otherwise(F.raise_error(F.lit(f"features: a vector does not have the width {width} of the weights")).cast("boolean")))


def _shipped_product(features: DataFrame, weights: DataFrame, vector: str, relu: bool = False) -> DataFrame:
    """(entry_id, logits ARRAY<DOUBLE>) in term order, one matrix product per Arrow batch."""
    rows = weights.select("term", F.col("w").cast("array<double>"), F.col("b").cast("double")).orderBy("term").toArrow()
    model = features.sparkSession.sparkContext.broadcast(
        (np.array(rows["w"].to_pylist(), dtype="float64").reshape(rows.num_rows, -1), np.array(rows["b"].to_pylist(), dtype="float64")))

    def score(batches):
        w, b = model.value
        step = max(1, OUTPUT_CELLS // max(1, len(b)))
        for pdf in batches:
            for start in range(0, len(pdf), step):
                part = pdf.iloc[start:start + step]
                out = np.stack(part[vector].to_numpy()).astype("float64") @ w.T + b
                yield pd.DataFrame({"entry_id": part["entry_id"].to_numpy(), "logits": list(np.maximum(out, 0.0) if relu else out)})

    src = features.where(F.col(vector).isNotNull()).select(F.col("entry_id").cast("string"), vector)
    return src.mapInPandas(score, "entry_id string, logits array<double>")


def _blocked_product(features: DataFrame, weights: DataFrame, vector: str) -> DataFrame:
    """Blocks of features meet blocks of terms, both from row counts, and a pair of blocks is one matrix product; no task sees a whole side.

    Every block of terms travels once for each block of features and the other way round, as any product of two tables needs.
    """
    def dealt(rows: DataFrame, name: str, key: str, most: int) -> tuple[DataFrame, int]:
        blocks = max(1, -(-rows.count() // most))
        return rows.withColumn(name, F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")), blocks

    x, xs = dealt(features.where(F.col(vector).isNotNull()).select(F.col("entry_id").cast("string").alias("entry_id"), F.col(vector).cast("array<double>").alias("x")), "xb", "entry_id", BLOCK_ROWS)
    w, ws = dealt(weights.select("term", F.col("w").cast("array<double>").alias("w"), F.col("b").cast("double").alias("b")), "wb", "term", BLOCK_TERMS)
    kind = weights.schema["term"].dataType.simpleString()
    left = x.withColumn("wb", F.explode(F.sequence(F.lit(0), F.lit(ws - 1))))
    right = w.withColumn("xb", F.explode(F.sequence(F.lit(0), F.lit(xs - 1))))

    def product(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.table({"entry_id": pa.array([], pa.string()), "term": b["term"].slice(0, 0), "logit": pa.array([], pa.float64())})
        u, v = (t[c].combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1) for t, c in ((a, "x"), (b, "w")))
        out = u @ v.T + b["b"].to_numpy()
        i, j = np.repeat(np.arange(a.num_rows), b.num_rows), np.tile(np.arange(b.num_rows), a.num_rows)
        return pa.table({"entry_id": a["entry_id"].take(pa.array(i)), "term": b["term"].take(pa.array(j)), "logit": out.reshape(-1)})

    return left.groupBy("xb", "wb").cogroup(right.groupBy("xb", "wb")).applyInArrow(product, f"entry_id string, term {kind}, logit double")


def two_layer_scores(features: DataFrame, hidden: DataFrame, output: DataFrame, vector: str = "embedding",
                     broadcast_limit: int = BROADCAST_LIMIT) -> DataFrame:
    """ReLU hidden layer then linear output. ``hidden`` = (unit INT, w, b), ``output`` = (term, w, b).

    A hidden layer that fits stays one vector per entry; only a larger one is regrouped from rows.
    """
    units = hidden.select(F.format_string("%09d", "unit").alias("term"), "w", "b")
    size, width = _checked(units)
    features = _of_width(features, vector, width)
    if size <= broadcast_limit:
        activated = _shipped_product(features, units, vector, relu=True).withColumnRenamed("logits", "__h")
    else:
        activated = _blocked_product(features, units, vector).groupBy("entry_id").agg(F.transform(
            F.array_sort(F.collect_list(F.struct("term", "logit"))), lambda s: F.greatest(s.logit, fn.d(0))).alias("__h"))
    return linear_scores(activated, output, "__h", broadcast_limit=broadcast_limit)


def label_vector_scores(features: DataFrame, term_vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Dot product of entry and term vectors. ``term_vectors`` = (term, w)."""
    return linear_scores(features, term_vectors, vector, bias=False)


def calibrate(logits: DataFrame, priors: DataFrame | None = None, strength: float = 1.0, temperature: float = 1.0) -> DataFrame:
    """(logit + strength * log-odds of the prior) / temperature. ``priors`` = (term, prior)."""
    if temperature <= 0:
        raise ValueError("temperature must be positive")
    out = logits
    if priors is not None:
        odds = F.ln(F.col("prior") / (fn.d(1) - F.col("prior"))) * fn.d(strength)
        out = logits.join(priors.select("term", "prior"), "term", "left") \
            .withColumn("logit", F.col("logit") + F.coalesce(odds, fn.d(0))).drop("prior")
    return out.withColumn("logit", F.col("logit") / fn.d(temperature)) if temperature != 1.0 else out


def aligned(first: DataFrame, second: DataFrame, value: str) -> DataFrame:
    """Join two score tables on (entry, term); a pair present on one side only is an error."""
    a = first.select("entry_id", "term", F.col(value).alias("first_value"), F.lit(1).alias("__a"))
    b = second.select("entry_id", "term", F.col(value).alias("second_value"), F.lit(1).alias("__b"))
    both = a.join(b, ["entry_id", "term"], "full")
    complete = F.col("__a").isNotNull() & F.col("__b").isNotNull()
    message = F.concat(F.lit("score tables differ at "), F.col("entry_id"), F.lit(" / "), F.col("term"))
    return both.where(F.when(complete, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))).drop("__a", "__b")


def fuse(first: DataFrame, second: DataFrame, first_weight: float, second_weight: float,
         space: str = "probabilities") -> DataFrame:
    """Weighted mean of scores, or of logits followed by a sigmoid; weights are normalised."""
    total = float(first_weight) + float(second_weight)
    if total <= 0:
        raise ValueError("fusion weights must sum to a positive value")
    if space not in ("probabilities", "logits"):
        raise ValueError(f"unknown score space {space!r}")
    column = "score" if space == "probabilities" else "logit"
    for side in (first, second):
        if column not in side.columns:
            raise ValueError(f"{space} space needs a {column} column on both sides")
    mixed = _mix(F.col("first_value"), F.col("second_value"), fn.d(first_weight / total), fn.d(second_weight / total))
    both = aligned(first, second, column)
    if space == "probabilities":
        return both.select("entry_id", "term", mixed.cast("float").alias("score"))
    return both.select("entry_id", "term", mixed.cast("float").alias("logit"), fn.sigmoid(mixed).cast("float").alias("score"))


def _mix(a: Column, b: Column, wa: Column, wb: Column) -> Column:
    return wa * a.cast("double") + wb * b.cast("double")


def fusion_grid(pairs: DataFrame, first: str, second: str, weights: int = 11, step: float = 0.01, *, entries: DataFrame | None = None,
                terms: DataFrame | None = None, dense: bool = False) -> DataFrame:
    """Fmax for each weight 0 … 1 of the first score: rows are multiplied by the weights, not by the thresholds."""
    grid, steps = fn.double_array([i / (weights - 1) for i in range(weights)]), metrics.step_thresholds(step)
    # a cell that nobody scored has score 0 at every weight
    extra = metrics.unscored(pairs, entries, terms, dense, steps)
    extra = extra if extra is None else extra.withColumn("weight", F.explode(grid))
    mixed = pairs.withColumn("weight", F.explode(grid)).withColumn(
        "score", _mix(F.col(first), F.col(second), F.col("weight"), fn.d(1) - F.col("weight")).cast("float"))
    return metrics.best_threshold(metrics.sweep(mixed, steps, ["weight"], implicit=extra), ["weight"])


def best_fusion_weight(grid: DataFrame) -> DataFrame:
    """Highest Fmax; the lowest weight wins a tie. ``grid`` has one row per weight."""
    return grid.agg(F.max_by(F.struct("weight", "fmax"), F.struct(F.col("fmax"), -F.col("weight"))).alias("b")).select("b.*")


def clamped(pairs: DataFrame) -> DataFrame:
    """Scores clamped away from 0 and 1, as fused scores are judged: nothing is positive at threshold 1."""
    return pairs.withColumn("score", fn.clamp(F.col("score").cast("double"), C.SCORE_CLAMP, 1.0 - C.SCORE_CLAMP).cast("float"))


def evaluate(pairs: DataFrame, terms: DataFrame, threshold: float, step: float = 0.01, by: list[str] = (), *, entries: DataFrame | None = None,
             dense: bool = False) -> DataFrame:
    """All metrics of a score table, one row per group. ``terms`` = (by…, term) is the whole vocabulary, ``entries`` all entries; the result does not read ``pairs`` again.

    Cells without a row are negatives of score 0, so ``threshold`` must lie above the clamp.
    """
    if threshold <= C.SCORE_CLAMP:
        raise ValueError("threshold must lie above the score clamp")
    by, grid = list(by), metrics.step_thresholds(step)
    metrics.need_cells(entries, terms, dense)
    # the score table is read once; what is kept has one row per term and bucket
    counters = staged(metrics.term_bucket_counts(clamped(pairs), grid, threshold, by), "counters")
    extra = metrics.unscored(counters, entries, terms, dense, grid, by, rows="rows")
    per_term = counters.groupBy(*by, "term").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])
    flat = metrics.micro_macro(metrics.complete_terms(per_term, terms, by), by)
    buckets = counters.select(*by, "bucket", "pos", "neg")
    buckets = buckets if extra is None else buckets.unionByName(extra)
    best = metrics.best_threshold(metrics.with_ratios(metrics.threshold_counts(buckets, grid, by)), by)
    if by:
        out = flat.join(best, by)
    else:
        out = flat.withColumn("__b", best.select(F.struct("*").alias("b")).scalar()).select("*", "__b.*").drop("__b")
    return out.withColumn("metric_threshold", fn.d(threshold)).withColumn("fmax_threshold_step", fn.d(step))
