"""Training histories ``(run…, epoch, value)``: best epoch, running best with a minimum delta, early stop."""

from __future__ import annotations

import bisect
import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from protlake.functions import scalar as fn
from protlake.operators.ranking import null_safe_join, numbered
from protlake.session import staged

CHUNK = 4096  # epochs of a chunk
FAN = 64  # chunks whose step functions are composed together


def best_epoch(history: DataFrame, keys: list[str], metric: str = "val_fmax", epoch: str = "epoch") -> DataFrame:
    """Record of the best metric per run (a missing metric loses, the first epoch wins ties) and epochs completed."""
    score = F.coalesce(F.col(metric), F.lit(float("-inf")))
    payload = [c for c in history.columns if c not in keys]
    return history.groupBy(*keys).agg(
        F.max_by(F.struct(*payload), F.struct(score, -F.col(epoch))).alias("__b"),
        F.max(epoch).alias("epochs_completed")).select(*keys, "__b.*", "epochs_completed")


def _chunks(history: DataFrame, keys: list[str], mode: str) -> DataFrame:
    """Rows (keys…, __i, __skip, __e, __v): chunks of a run in order, with their epochs and values and how many epochs lie before.

    Values are negated in min mode, so larger is always better; non-finite ones are NULL and never improve. A chunk holds ``CHUNK``
    epochs of the run's order, so a long run lies in many rows and tasks.
    """
    if mode not in ("min", "max"):
        raise ValueError(f"unknown mode {mode!r}")
    v = F.col("value").cast("double") * (1.0 if mode == "max" else -1.0)
    finite = ~F.isnan(v) & (F.abs(v) < F.lit(math.inf))
    rows = numbered(history.select(*keys, "epoch", F.when(finite, v).alias("v")), keys, ["epoch", "v"], "__n")
    held = rows.groupBy(*keys, F.floor(F.col("__n") / CHUNK).alias("__i")).agg(F.array_sort(F.collect_list(F.struct("__n", "epoch", "v"))).alias("__r"))
    return held.select(*keys, "__i", (F.col("__i") * CHUNK).alias("__skip"), F.col("__r.epoch").alias("__e"), F.col("__r.v").alias("__v"))


def improving(values: np.ndarray, best: float | None, min_delta: float, strict: bool) -> list[int]:
    """Positions that beat the best so far by the rule; NaN never does. Only prefix maxima are looked at one by one."""
    filled = np.where(np.isnan(values), -np.inf, values)
    earlier = np.concatenate(([-np.inf if best is None else best], np.maximum.accumulate(filled)[:-1] if len(filled) else []))
    if best is not None:
        earlier = np.maximum(earlier, best)
    kept = []
    for i in np.flatnonzero((filled > -np.inf) & ((filled > earlier) | (filled >= earlier) & (not strict))):
        v = float(filled[i])
        if best is None or (v > best + min_delta if strict else v >= best + min_delta):
            best = v
            kept.append(int(i))
    return kept


Steps = tuple[list[float], list[float], list[int]]


def step_function(values: np.ndarray, skip: int, min_delta: float, strict: bool) -> Steps:
    """What a chunk does to any best so far: a best that the k-th limit beats, and no earlier one, becomes the k-th (value, epochs by then).

    The limits are the chunk's prefix maxima. From each of them the rule goes on the same way whatever came before, so going through
    them from the last to the first finds all ends; limits with one end are kept once.
    """
    filled = np.where(np.isnan(values), -np.inf, values)
    ends: dict[int, tuple[float, int]] = {}

    def end(i: int) -> tuple[float, int]:
        way = []
        while i not in ends:
            way.append(i)
            later = filled[i + 1:]
            beats = np.flatnonzero(later > filled[i] + min_delta if strict else later >= filled[i] + min_delta)
            if not len(beats):
                ends[i] = (float(filled[i]), skip + i + 1)
                break
            i += 1 + int(beats[0])
        for j in way:
            ends[j] = ends[i]
        return ends[way[0]] if way else ends[i]

    tops = np.flatnonzero((filled > -np.inf) & (filled > np.concatenate(([-np.inf], np.maximum.accumulate(filled)[:-1] if len(filled) else []))))
    return _joined([float(filled[i]) for i in tops], [end(int(i)) for i in tops])


def _joined(limits: list[float], ends: list[tuple[float, int]]) -> Steps:
    keep = [k for k in range(len(limits)) if k + 1 == len(limits) or ends[k] != ends[k + 1]]
    return [limits[k] for k in keep], [ends[k][0] for k in keep], [ends[k][1] for k in keep]


def applied(steps: Steps, best: float | None, at: int, min_delta: float, strict: bool) -> tuple[float | None, int]:
    """(best, epochs by then) behind a chunk."""
    limits, values, places = steps
    k = 0 if best is None else (bisect.bisect_right if strict else bisect.bisect_left)(limits, best + min_delta)
    return (values[k], places[k]) if k < len(limits) else (best, at)


def composed(first: Steps, second: Steps, min_delta: float, strict: bool) -> Steps:
    """One step function for two in a row. A best that the first leaves alone can only be beaten by the second's limits above all of the first's."""
    ends = [applied(second, v, n, min_delta, strict) for v, n in zip(first[1], first[2])]
    limits = list(first[0])
    for limit, v, n in zip(*second):
        if not limits or limit > limits[-1]:
            limits.append(limit)
            ends.append((v, n))
    return _joined(limits, ends)


def _entered(chunks: DataFrame, keys: list[str], min_delta: float, strict: bool) -> DataFrame:
    """Adds (__best, __at), what each chunk starts from: step functions composed up a tree of fan-out ``FAN`` and states handed down it."""
    top = chunks.agg(F.max("__i")).first()[0] or 0
    if top == 0:
        return chunks.select("*", F.lit(None).cast("double").alias("__best"), F.lit(0).cast("bigint").alias("__at"))
    steps = F.pandas_udf(lambda v, skip: pd.DataFrame([step_function(np.asarray(a, np.float64), int(s), min_delta, strict) for a, s in zip(v, skip)], columns=["l", "v", "n"]),
                         "l array<double>, v array<double>, n array<bigint>")
    level = chunks.select(*keys, "__i", steps("__v", "__skip").alias("__f")).select(*keys, "__i", "__f.*")
    kinds = ", ".join(f"`{k}` {chunks.schema[k].dataType.simpleString()}" for k in keys)
    levels = [staged(level, "epoch-steps")]
    while top >= FAN:
        def up(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("__i")
            whole = reduce(lambda a, b: composed(a, b, min_delta, strict), [(list(r.l), list(r.v), list(r.n)) for r in pdf.itertuples()])
            return pdf.iloc[:1][keys].assign(__i=pdf["__i"].iloc[0] // FAN, l=[whole[0]], v=[whole[1]], n=[whole[2]])

        parents = levels[-1].withColumn("__p", F.floor(F.col("__i") / FAN)).groupBy(*keys, "__p").applyInPandas(
            lambda pdf: up(pdf.drop(columns="__p")), f"{kinds}, __i bigint, l array<double>, v array<double>, n array<bigint>")
        levels.append(staged(parents, "epoch-steps"))
        top //= FAN

    def down(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        best = None if pd.isna(pdf["__best"].iloc[0]) else float(pdf["__best"].iloc[0])
        at, out = int(pdf["__at"].iloc[0]), []
        for r in pdf.itertuples():
            out.append((best, at))
            best, at = applied((list(r.l), list(r.v), list(r.n)), best, at, min_delta, strict)
        return pdf[[*keys, "__i"]].assign(__best=pd.Series([b for b, _ in out], pdf.index, dtype="float64"), __at=pd.Series([a for _, a in out], pdf.index, dtype="int64"))

    states = levels[-1].select(*keys).distinct().select(*keys, F.lit(0).cast("bigint").alias("__p"), F.lit(None).cast("double").alias("__best"), F.lit(0).cast("bigint").alias("__at"))
    for level in reversed(levels):
        placed = null_safe_join(level.withColumn("__p", F.floor(F.col("__i") / FAN)), states, [*keys, "__p"])
        states = placed.groupBy(*keys, "__p").applyInPandas(lambda pdf: down(pdf), f"{kinds}, __i bigint, __best double, __at bigint").withColumnRenamed("__i", "__p")
    return null_safe_join(chunks, states.withColumnRenamed("__p", "__i"), [*keys, "__i"])


def _improved(history: DataFrame, keys: list[str], mode: str, min_delta: float, strict: bool) -> DataFrame:
    """Chunks with ``__on``, the positions from 0 that improve. The history is read once."""
    if min_delta < 0:
        raise ValueError("min_delta must not be negative")
    entered = _entered(staged(_chunks(history, keys, mode), "epoch-chunks"), keys, min_delta, strict)
    positions = F.pandas_udf(lambda v, best: pd.Series([improving(np.asarray(a, np.float64), None if pd.isna(b) else float(b), min_delta, strict) for a, b in zip(v, best)]), "array<int>")
    return entered.withColumn("__on", positions("__v", "__best"))


def improvements(history: DataFrame, keys: list[str], mode: str = "max", min_delta: float = 0.0, strict: bool = True) -> DataFrame:
    """Epochs that beat the running best by more than ``min_delta`` (or by at least it when not ``strict``).

    The rule runs over chunks of a run in parallel: what a chunk does to any best before it is a step function; these are composed in a tree (``_entered``).
    """
    found = F.transform("__on", lambda k: F.struct(F.get("__e", k).alias("epoch"), F.get("__v", k).alias("v"), (F.col("__skip") + k + 1).alias("n")))
    return _improved(history, keys, mode, min_delta, strict).select(*keys, F.inline(found))


def early_stop(history: DataFrame, keys: list[str], patience: int, mode: str = "max", min_delta: float = 0.0,
               strict: bool = True) -> DataFrame:
    """Per run: epochs run until ``patience`` epochs in a row bring no improvement, the stop epoch (NULL when the
    run ends first) and the best epoch and value seen by then."""
    size, p = F.size("__e"), F.lit(patience)
    marks = F.concat(F.array(F.col("__at")), F.transform("__on", lambda k: F.col("__skip") + k + 1))  # epochs by the last improvement, and by each here
    behind = lambda i: F.coalesce(F.get(marks, i + 1), F.col("__skip") + size + 1)
    stops = F.filter(F.transform(marks, lambda n, i: F.when(behind(i) - n > p, n + p)), lambda n: n.isNotNull())
    chunk = fn.once(_improved(history, keys, mode, min_delta, strict), stop=F.get(stops, F.lit(0)))
    seen = F.filter("__on", lambda k: F.col("stop").isNull() | (F.col("__skip") + k + 1 <= F.col("stop")))
    last = F.get(seen, F.size(seen) - 1)
    each = fn.once(chunk, last=F.when(F.size(seen) > 0, last)).select(
        *keys, "__i", size.alias("m"), "stop", F.when(F.col("last").isNotNull(), F.struct("__i", F.get("__e", F.col("last")).alias("e"), F.get("__v", F.col("last")).alias("v"))).alias("best"),
        F.get("__e", (F.col("stop") - F.col("__skip") - 1).cast("int")).alias("at"))
    # the first chunk with a stop ends the run; the best one is the last improvement up to it
    runs = each.groupBy(*keys).agg(
        F.sum("m").alias("epochs_total"), F.min(F.when(F.col("stop").isNotNull(), F.struct("__i", "stop", "at"))).alias("end"),
        F.array_sort(F.collect_list("best")).alias("bests"))
    before = F.filter("bests", lambda b: F.col("end").isNull() | (b["__i"] <= F.col("end.__i")))
    best, sign = F.get(before, F.size(before) - 1), F.lit(1.0 if mode == "max" else -1.0)
    return runs.select(
        *keys, "epochs_total", F.coalesce("end.stop", "epochs_total").alias("epochs_run"), F.col("end.at").alias("stop_epoch"), best.e.alias("best_epoch"),
        (best.v * sign).alias("best_value"), F.col("end").isNotNull().alias("stopped_early"))


def ranked_trials(trials: DataFrame, score: str, by: list[str] = (), ties: list[str] = ()) -> DataFrame:
    """Trials with their place from 1, best score first; a missing score comes last. Ties go by ``ties``."""
    order = [F.col(score).desc_nulls_last(), *map(F.col, ties)]
    if by:
        return trials.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order)).cast("bigint"))
    key = F.when(F.col(score).isNull(), F.lit(float("inf"))).otherwise(-F.col(score).cast("double"))
    return numbered(trials.withColumn("__key", key), [], ["__key", *ties], "__place").withColumn("place", F.col("__place") + 1).drop("__key", "__place")


def run_rollup(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Wide row per run from its summary: record at the best epoch (first match) and the last record."""
    at_best = F.try_element_at(F.filter("history", lambda h: h.epoch == F.col("best_epoch")), F.lit(1))
    last = F.try_element_at("history", F.lit(-1))
    out = runs.withColumn("__b", at_best).withColumn("__l", last)
    metrics = [F.try_element_at(F.col(f"{rec}.{split}"), F.lit(m)).alias(f"{name}_{split}_{m}")
               for rec, name in (("__b", "best"), ("__l", "final")) for split in ("val", "test") for m in ("loss", "fmax")]
    return out.select(*keys, "best_epoch", "best_val_loss", "checkpoint_metric", "best_checkpoint_metric", "stopped_early",
                      "loss_function", "lr_scheduler", F.col("__l.epoch").alias("final_epoch"), *metrics)
