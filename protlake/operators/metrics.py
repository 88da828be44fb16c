"""Multi-label metrics over long score tables.

``pairs`` has one row per scored (entry, term): ``entry_id, term, score FLOAT, y BOOLEAN`` plus any grouping
columns. A metric counts every cell of the entry x term matrix; a cell without a row has score 0 and is
negative. ``implicit_cells`` adds those by arithmetic, never as rows.
"""

from __future__ import annotations

import math
from itertools import accumulate, repeat

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from protlake.functions import scalar as fn
from protlake.operators.ranking import null_safe_join
from protlake.session import staged

MICRO = ("precision", "recall", "f1")


def step_thresholds(step: float = 0.01) -> list[float]:
    """Running sums of ``step`` in double below 1, from 0 and closed by 1."""
    if not step > 0:
        raise ValueError("threshold step must be positive")
    sums = accumulate(repeat(step, math.ceil(1 / step) + 1))
    return [0.0, *(t for t in sums if t < 1.0), 1.0]


def even_grid(low: float, high: float, n: int) -> list[float]:
    return [low + (high - low) * i / (n - 1) for i in range(n)]


def _grid(thresholds: list[float]) -> Column:
    """Literal FLOAT array: scores are FLOAT and compare as FLOAT."""
    return fn.double_array(thresholds, "float")


def bucket_of(score: Column, thresholds: list[float]) -> Column:
    """How many of the ascending thresholds are <= score.

    On an even grid the answer is estimated by division and settled by at most three comparisons; other grids
    compare with each threshold.
    """
    n, s = len(thresholds), score.cast("float")
    step = (thresholds[-1] - thresholds[0]) / (n - 1) if n > 1 else 0.0
    even = n > 3 and all(abs(t - (thresholds[0] + i * step)) < step / 4 for i, t in enumerate(thresholds))
    grid = _grid(thresholds)
    if not even:
        return F.size(F.filter(grid, lambda t: s >= t))
    guess = F.floor((s.cast("double") - fn.d(thresholds[0])) / fn.d(step)).cast("int")
    low = F.least(F.greatest(guess - 1, F.lit(0)), F.lit(n - 3))
    return low + sum((s >= F.get(grid, low + i)).cast("int") for i in range(3))


def join_targets(scores: DataFrame, labels: DataFrame, keep_unscored: bool = True, entries: DataFrame | None = None) -> DataFrame:
    """Scores with y; labels nobody scored enter as positives of score 0.

    With ``entries`` (those that have a label record) a scored entry that isn't among them is an error.
    """
    if entries is not None:
        known = entries.select("entry_id").distinct().withColumn("__known", F.lit(True))
        message = F.concat(F.lit("no label record for scored entry "), F.col("entry_id"))
        checked = F.when(F.col("__known"), True).otherwise(F.raise_error(message).cast("boolean"))
        scores = scores.join(known, "entry_id", "left").where(checked).drop("__known")
    y = labels.select("entry_id", "term").distinct().withColumn("__y", F.lit(True))
    joined = scores.join(y, ["entry_id", "term"], "full" if keep_unscored else "left")
    return joined.withColumn("y", F.coalesce("__y", F.lit(False))).drop("__y") \
        .withColumn("score", F.coalesce("score", F.lit(0.0).cast("float")))


def implicit_cells(pairs: DataFrame, entries: DataFrame, terms: DataFrame, thresholds: list[float],
                   by: list[str] = (), weight: str | None = None, each_term: bool = False, rows: str | None = None) -> DataFrame:
    """Bucket row of the cells without a pair: (by…, bucket, pos=0, neg). ``terms`` lists (by…, term[, weight]).

    Entries without the ``by`` columns count in every group. With ``rows`` that column of ``pairs`` says how many pairs a row stands for.
    """
    by = list(by)
    entry_by = [c for c in by if c in entries.columns]
    seen = pairs.groupBy(*by, "term").agg((F.sum(rows) if rows else F.count("*")).alias("__seen"))
    base = terms.join(seen, [*by, "term"], "left")
    if entry_by:
        base = base.join(entries.groupBy(*entry_by).agg(F.count("*").alias("__n")), entry_by)
    else:
        base = base.withColumn("__n", entries.agg(F.count("*")).scalar())
    w = F.col(weight) if weight else F.lit(1)
    missing = w * (F.col("__n") - F.coalesce("__seen", F.lit(0)))
    by = [*by, "term"] if each_term else by
    agg = base.groupBy(*by).agg(F.sum(missing).alias("neg"))
    return agg.select(*by, bucket_of(F.lit(0.0), thresholds).alias("bucket"),
                      F.lit(0).cast("double" if weight else "bigint").alias("pos"), "neg")


def implicit_per_term(pairs: DataFrame, entries: DataFrame, terms: DataFrame, thresholds: list[float], by: list[str] = ()) -> DataFrame:
    """As ``implicit_cells``, but a row (by…, term, bucket, pos=0, neg) for every term, so that weights and per-term metrics see them too."""
    by = list(by)
    return implicit_cells(pairs, entries, terms.select(*by, "term"), thresholds, by, each_term=True)


def unscored(pairs: DataFrame, entries: DataFrame | None, terms: DataFrame | None, dense: bool, thresholds: list[float],
             by: list[str] = (), weight: str | None = None, each_term: bool = False, rows: str | None = None) -> DataFrame | None:
    """Bucket row of the cells without a pair; none for a table declared dense, which has a row for every cell."""
    if dense:
        return None
    need_cells(entries, terms, dense)
    return implicit_per_term(pairs, entries, terms, thresholds, by) if each_term else implicit_cells(pairs, entries, terms, thresholds, by, weight, rows=rows)


def need_cells(entries: DataFrame | None, terms: DataFrame | None, dense: bool) -> None:
    if not dense and (entries is None or terms is None):
        raise ValueError("entries and terms are needed to count the cells without a score; or declare the table dense")


def term_buckets(pairs: DataFrame, thresholds: list[float], by: list[str], entries: DataFrame | None, terms: DataFrame | None, dense: bool) -> DataFrame:
    """Bucket counts by term, with the cells that have no score unless the table is declared dense."""
    counts, more = bucket_counts(pairs, thresholds, [*by, "term"]), unscored(pairs, entries, terms, dense, thresholds, by, each_term=True)
    return counts if more is None else counts.unionByName(more)


def bucket_counts(pairs: DataFrame, thresholds: list[float], by: list[str] = (), weight: str | None = None) -> DataFrame:
    """(by…, bucket, pos, neg): the only pass over the score table; combines map-side into few rows."""
    w = F.col(weight) if weight else F.lit(1)
    zero = F.lit(0.0) if weight else F.lit(0)
    return pairs.groupBy(*by, bucket_of(F.col("score"), thresholds).alias("bucket")).agg(
        F.sum(F.when(F.col("y"), w).otherwise(zero)).alias("pos"),
        F.sum(F.when(F.col("y"), zero).otherwise(w)).alias("neg"))


def threshold_counts(buckets: DataFrame, thresholds: list[float], by: list[str] = ()) -> DataFrame:
    """(by…, k, threshold, tp, fp, fn) for every threshold, from running sums over at most len(thresholds) rows."""
    by, n = list(by), len(thresholds)
    merged = buckets.groupBy(*by, "bucket").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    cells = F.map_from_entries(F.collect_list(F.struct("bucket", F.struct("pos", "neg"))))
    packed = merged.groupBy(*by).agg(cells.alias("__m"), F.sum("pos").alias("__p"))
    grid = fn.double_array(thresholds)
    rows = packed.select(*by, "__m", "__p", F.posexplode(grid).alias("k", "threshold")) \
        .withColumn("__c", F.try_element_at("__m", F.col("k") + 1))
    down = W.partitionBy(*by).orderBy(F.col("k").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    zero = F.lit(0)
    return rows.select(
        *by, "k", "threshold",
        F.sum(F.coalesce("__c.pos", zero)).over(down).alias("tp"),
        F.sum(F.coalesce("__c.neg", zero)).over(down).alias("fp"), "__p") \
        .select(*by, "k", "threshold", "tp", "fp", (F.col("__p") - F.col("tp")).alias("fn"))


def with_ratios(counts: DataFrame, eps: bool = False) -> DataFrame:
    """precision, recall, f1: zero when undefined, or with 1e-12 in each denominator."""
    if eps:
        p = fn.eps_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
        r = fn.eps_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
        return counts.withColumn("precision", p).withColumn("recall", r).withColumn(
            "f1", fn.eps_ratio(fn.d(2) * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    p = fn.safe_ratio(F.col("tp"), F.col("tp") + F.col("fp"))
    r = fn.safe_ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r) \
        .withColumn("f1", fn.f1(F.col("precision"), F.col("recall")))


def best_threshold(sweep: DataFrame, by: list[str] = (), value: str = "f1", prefix: str = "fmax") -> DataFrame:
    """Row of the highest value, lowest threshold among ties; groups hold one row per threshold."""
    best = sweep.groupBy(*by).agg(F.max_by(
        F.struct(value, "threshold", "precision", "recall"), F.struct(F.col(value), -F.col("k"))).alias("__b"))
    return best.select(*by, F.col(f"__b.{value}").alias(prefix), F.col("__b.threshold").alias(f"{prefix}_threshold"),
                       F.col("__b.precision").alias(f"{prefix}_precision"), F.col("__b.recall").alias(f"{prefix}_recall"))


def sweep(pairs: DataFrame, thresholds: list[float], by: list[str] = (), weight: str | None = None,
          eps: bool = False, implicit: DataFrame | None = None) -> DataFrame:
    buckets = bucket_counts(pairs, thresholds, by, weight)
    if implicit is not None:
        buckets = buckets.unionByName(implicit)
    return with_ratios(threshold_counts(buckets, thresholds, by), eps)


def fmax(pairs: DataFrame, step: float = 0.01, by: list[str] = (), *, entries: DataFrame | None = None, terms: DataFrame | None = None,
         dense: bool = False) -> DataFrame:
    """Pooled F1 over every entry x term cell, maximised over the step grid."""
    grid = step_thresholds(step)
    return best_threshold(sweep(pairs, grid, by, implicit=unscored(pairs, entries, terms, dense, grid, by)), by)


def weighted_fmax(pairs: DataFrame, weights: DataFrame, thresholds: list[float], by: list[str] = (), *, entries: DataFrame | None = None,
                  terms: DataFrame | None = None, dense: bool = False) -> DataFrame:
    """Information-weighted Fmax over every entry x term cell; terms without a weight count zero. ``weights`` = (term, ia).

    Counts per (term, bucket) are made first, so the weight table joins the reduced rows, not the scores.
    """
    weighted = weigh(term_buckets(pairs, thresholds, list(by), entries, terms, dense), weights, by)
    return best_threshold(with_ratios(threshold_counts(weighted, thresholds, by), eps=True), by, prefix="ia_fmax")


def weigh(per_term: DataFrame, weights: DataFrame, by: list[str] = ()) -> DataFrame:
    """Per-term bucket counts times each term's weight."""
    return per_term.join(weights.select("term", "ia"), "term", "left").withColumn("ia", F.coalesce("ia", fn.d(0))) \
        .select(*by, "bucket", (F.col("pos") * F.col("ia")).alias("pos"), (F.col("neg") * F.col("ia")).alias("neg"))


def term_bucket_counts(pairs: DataFrame, thresholds: list[float], at: float, by: list[str] = ()) -> DataFrame:
    """(by…, term, bucket, pos, neg, tp, fp, fn, rows): one pass that serves the sweeps, the metrics at one threshold and the count of cells."""
    hit, y = F.col("score").cast("float") >= F.lit(at).cast("float"), F.col("y")
    return pairs.groupBy(*by, "term", bucket_of(F.col("score"), thresholds).alias("bucket")).agg(
        F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"), F.count_if(hit & y).alias("tp"),
        F.count_if(hit & ~y).alias("fp"), F.count_if(~hit & y).alias("fn"), F.count("*").alias("rows"))


def term_counts_at(pairs: DataFrame, threshold: float, by: list[str] = ()) -> DataFrame:
    """(by…, term, tp, fp, fn) at one threshold."""
    hit = F.col("score").cast("float") >= F.lit(threshold).cast("float")
    return pairs.groupBy(*by, "term").agg(
        F.count_if(hit & F.col("y")).alias("tp"), F.count_if(hit & ~F.col("y")).alias("fp"),
        F.count_if(~hit & F.col("y")).alias("fn"))


def complete_terms(per_term: DataFrame, terms: DataFrame, by: list[str] = ()) -> DataFrame:
    """Terms of the vocabulary without any row get zero counts."""
    return terms.select(*by, "term").join(per_term, [*by, "term"], "left").fillna(0, ["tp", "fp", "fn"])


def micro_macro(per_term: DataFrame, by: list[str] = ()) -> DataFrame:
    """Micro and macro precision/recall/F1 plus label counts from per-term counters."""
    tp, fp, fn_ = F.col("tp"), F.col("fp"), F.col("fn")
    rows = per_term.withColumn("__p", fn.safe_ratio(tp, tp + fp)).withColumn("__r", fn.safe_ratio(tp, tp + fn_)) \
        .withColumn("__f", fn.safe_ratio(tp * 2, tp * 2 + fp + fn_))
    has = (tp + fn_) > 0
    agg = rows.groupBy(*by).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"),
        F.avg("__p").alias("macro_precision"), F.avg("__r").alias("macro_recall"), F.avg("__f").alias("macro_f1"),
        F.coalesce(F.avg(F.when(has, F.col("__f"))), fn.d(0)).alias("macro_f1_positive_labels"),
        F.count("*").alias("label_count"), F.count_if(has).alias("label_count_with_positive"))
    out = with_ratios(agg)
    return out.select(*by, *[F.col(m).alias(f"micro_{m}") for m in MICRO], "macro_precision", "macro_recall", "macro_f1",
                      "macro_f1_positive_labels", "label_count", "label_count_with_positive")


def samples_f1(pairs: DataFrame, threshold: float, entries: DataFrame, by: list[str] = ()) -> DataFrame:
    """Mean over all entries of each entry's F1; an entry without labels and predictions counts 0."""
    hit = F.col("score").cast("float") >= F.lit(threshold).cast("float")
    per = pairs.groupBy(*by, "entry_id").agg(
        F.count_if(hit & F.col("y")).alias("tp"), F.count_if(hit).alias("predicted"), F.count_if("y").alias("actual"))
    f = fn.safe_ratio(F.col("tp") * 2, F.col("predicted") + F.col("actual"))
    sums = per.groupBy(*by).agg(F.sum(f).alias("__s"))
    if by:
        sizes = entries.groupBy(*by).agg(F.count("*").alias("__n"))
        return sizes.join(sums, list(by), "left").select(
            *by, fn.safe_ratio(F.coalesce("__s", fn.d(0)), F.col("__n")).alias("samples_f1"))
    return sums.withColumn("__n", entries.agg(F.count("*")).scalar()).select(
        fn.safe_ratio(F.coalesce("__s", fn.d(0)), F.col("__n")).alias("samples_f1"))


def macro_sweep(pairs: DataFrame, thresholds: list[float], terms: DataFrame, by: list[str] = (), *, entries: DataFrame | None = None,
                dense: bool = False) -> DataFrame:
    """(by…, k, threshold, macro_f1): per-term running sums over every cell, averaged over all terms of the vocabulary."""
    keys = [*by, "term"]
    per_term = threshold_counts(term_buckets(pairs, thresholds, list(by), entries, terms, dense), thresholds, keys)
    f = fn.safe_ratio(F.col("tp") * 2, F.col("tp") * 2 + F.col("fp") + F.col("fn"))
    sums = per_term.groupBy(*by, "k", "threshold").agg(F.sum(f).alias("__s"))
    if by:
        sized = sums.join(terms.groupBy(*by).agg(F.count("*").alias("__n")), list(by))
    else:
        sized = sums.withColumn("__n", terms.agg(F.count("*")).scalar())
    return sized.select(*by, "k", "threshold", (F.col("__s") / F.col("__n")).alias("macro_f1"))


def threshold_sweep(pairs: DataFrame, thresholds: list[float], terms: DataFrame, by: list[str] = (), *, entries: DataFrame | None = None,
                    dense: bool = False) -> DataFrame:
    """Micro and macro F1 per threshold over every cell."""
    micro = sweep(pairs, thresholds, by, implicit=unscored(pairs, entries, terms, dense, thresholds, by)).select(*by, "k", "threshold", F.col("f1").alias("micro_f1"))
    macro = macro_sweep(pairs, thresholds, terms, by, entries=entries, dense=dense).drop("threshold")
    return micro.join(macro, [*by, "k"]).select(*by, "threshold", "micro_f1", "macro_f1")


def best_of_sweep(rows: DataFrame, value: str, by: list[str] = ()) -> DataFrame:
    return rows.groupBy(*by).agg(F.max_by("threshold", F.struct(F.col(value), -F.col("threshold"))).alias("threshold"),
                                 F.max(value).alias(value))


def label_errors(pairs: DataFrame, threshold: float, by: list[str] = ("aspect",)) -> DataFrame:
    """Per-label error table with rates."""
    t = term_counts_at(pairs, threshold, list(by))
    true, pred = F.col("tp") + F.col("fn"), F.col("tp") + F.col("fp")
    return t.select(*by, "term", true.alias("true_count"), pred.alias("pred_count"), "tp", "fp", "fn",
                    fn.eps_ratio(F.col("fn"), true).alias("fn_rate"), fn.eps_ratio(F.col("fp"), pred).alias("fp_rate"))


def error_summary(errors: DataFrame, entries: DataFrame, threshold: float, by: list[str] = ("aspect",)) -> DataFrame:
    """Totals per aspect and mean labels per entry. ``entries`` = (aspect, entry_id)."""
    totals = errors.groupBy(*by).agg(
        F.sum("tp").alias("total_tp"), F.sum("fp").alias("total_fp"), F.sum("fn").alias("total_fn"),
        F.sum("true_count").alias("total_true_labels"), F.sum("pred_count").alias("total_predicted_labels"))
    n = entries.groupBy(*by).agg(F.count("*").alias("__n"))
    return totals.join(n, list(by)).withColumn("threshold", fn.d(threshold)).select(
        *by, "threshold", "total_tp", "total_fp", "total_fn", "total_true_labels", "total_predicted_labels",
        (F.col("total_true_labels") / F.col("__n")).alias("avg_true_labels_per_protein"),
        (F.col("total_predicted_labels") / F.col("__n")).alias("avg_predicted_labels_per_protein"))


def labels_per_entry(pairs: DataFrame, threshold: float, by: list[str] = ()) -> DataFrame:
    hit = F.col("score").cast("float") >= F.lit(threshold).cast("float")
    return pairs.groupBy(*by, "entry_id").agg(F.count_if("y").alias("true_labels"), F.count_if(hit).alias("predicted_labels"))


def losses(pairs: DataFrame, logit: Column, by: list[str] = (), pos_weight: str | None = None, gamma: float = 2.0,
           alpha: float = 0.25) -> DataFrame:
    """Mean BCE, positive-weighted BCE and focal BCE from logits, in the overflow-safe form."""
    y = F.when(F.col("y"), fn.d(1)).otherwise(fn.d(0))
    x = logit.cast("double")
    softplus = F.log1p(F.exp(-F.abs(x)))
    bce = F.greatest(x, fn.d(0)) - x * y + softplus
    w = F.col(pos_weight) if pos_weight else fn.d(1)
    weighted = (fn.d(1) - y) * x + (fn.d(1) + (w - fn.d(1)) * y) * (softplus + F.greatest(-x, fn.d(0)))
    p = fn.sigmoid(x)
    pt = F.when(F.col("y"), p).otherwise(fn.d(1) - p)
    a = F.when(F.col("y"), fn.d(alpha)).otherwise(fn.d(1 - alpha))
    focal = a * F.pow(F.greatest(fn.d(1) - pt, fn.d(0)), fn.d(gamma)) * bce
    return pairs.groupBy(*by).agg(F.avg(bce).alias("bce"), F.avg(weighted).alias("weighted_bce"), F.avg(focal).alias("focal_bce"))


def weighted_mean_loss(batches: DataFrame, loss: str, size: str, by: list[str] = ()) -> DataFrame:
    return batches.groupBy(*by).agg((F.sum(F.col(loss) * F.col(size)) / F.sum(size)).alias("mean_loss"))


def model_comparison(pairs: DataFrame, weights: DataFrame, thresholds: list[float], by: list[str], *, entries: DataFrame | None = None,
                     terms: DataFrame | None = None, dense: bool = False) -> DataFrame:
    """One row per group (aspect, model …): weighted Fmax and pooled Fmax on the same grid over every cell, from one pass. ``terms`` lists (by…, term)."""
    per_term = staged(term_buckets(pairs, thresholds, list(by), entries, terms, dense), "term-buckets")
    weighted = with_ratios(threshold_counts(weigh(per_term, weights, by), thresholds, by), eps=True)
    plain = with_ratios(threshold_counts(per_term, thresholds, by))
    return best_threshold(weighted, by, prefix="ia_fmax").join(best_threshold(plain, by), list(by))


def precision_recall(pairs: DataFrame, by: list[str] = (), *, entries: DataFrame | None = None, terms: DataFrame | None = None, dense: bool = False) -> DataFrame:
    """Pooled precision-recall curve over all distinct scores: (by…, score, tp, fp, fn, precision, recall, area, step).

    Cells of one score are one step; cells without a score are negatives of score 0 unless the table is declared dense. Distinct scores are dealt out in ranges of
    (by, falling score), so running sums are made inside a range and raised by the sums of the ranges before. A point knows its
    forerunner from its own counts: ``area`` is the trapezoid between the two, ``step`` the rectangle of average precision. The first forerunner
    has recall 0 and precision 1. Groups without a positive have recall 0 throughout.
    """
    by = list(by)
    y = F.col("y")
    steps = pairs.groupBy(*by, F.col("score").cast("float").alias("score")).agg(F.count_if(y).alias("pos"), F.count_if(~y).alias("neg"))
    more = unscored(pairs, entries, terms, dense, [0.0], by)
    if more is not None:
        zero = more.select(*by, F.lit(0.0).cast("float").alias("score"), F.lit(0).cast("bigint").alias("pos"), F.col("neg").cast("bigint").alias("neg"))
        steps = steps.unionByName(zero).groupBy(*by, "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).where("pos + neg > 0")
    ordered = [F.col(c) for c in by] + [F.col("score").desc()]
    ranged = staged(steps.repartitionByRange(*ordered).sortWithinPartitions(*ordered).withColumn("__at", F.monotonically_increasing_id()), "curve-steps") \
        .withColumn("__part", F.shiftright("__at", 33))
    sums = ranged.groupBy(*by, "__part").agg(F.sum("pos").alias("__pos"), F.sum("neg").alias("__neg"))
    whole = W.partitionBy(*by)
    before = whole.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(*by, "__part", *[F.coalesce(F.sum(f"__{c}").over(before), F.lit(0)).alias(f"__{c}_before") for c in ("pos", "neg")],
                         F.sum("__pos").over(whole).alias("__all"))
    inside = W.partitionBy(*by, "__part").orderBy("__at").rowsBetween(W.unboundedPreceding, W.currentRow)
    tp, fp = (F.sum(c).over(inside) + F.col(f"__{c}_before") for c in ("pos", "neg"))
    points = null_safe_join(ranged, starts, [*by, "__part"]).select(*by, "score", "pos", "neg", tp.alias("tp"), fp.alias("fp"), "__all")
    earlier_tp, earlier = F.col("tp") - F.col("pos"), F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg")
    return points.select(
        *by, "score", "tp", "fp", (F.col("__all") - F.col("tp")).alias("fn"), (F.col("tp") / (F.col("tp") + F.col("fp"))).alias("precision"),
        fn.safe_ratio(F.col("tp"), F.col("__all")).alias("recall"), fn.safe_ratio(F.col("pos"), F.col("__all")).alias("__gain"),
        F.when(earlier > 0, earlier_tp / F.nullif(earlier, F.lit(0))).otherwise(fn.d(1)).alias("__from")) \
        .withColumn("area", F.col("__gain") * (F.col("precision") + F.col("__from")) / 2).withColumn("step", F.col("__gain") * F.col("precision")).drop("__gain", "__from")


def micro_auprc(pairs: DataFrame, by: list[str] = (), **cells) -> DataFrame:
    """Area under the pooled precision-recall curve by trapezoids, and average precision; ``cells`` as in ``precision_recall``."""
    return precision_recall(pairs, by, **cells).groupBy(*by).agg(F.sum("area").alias("micro_auprc"), F.sum("step").alias("average_precision"), F.count("*").alias("points"))
