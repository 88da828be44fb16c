"""Evaluation, scoring and fusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from protlake.catalog import views as V
from protlake.catalog.registry import query, r6, rounded, table
from protlake.functions import scalar as fn
from protlake.operators import checks, labels as L, metrics as M, ranking, scoring as S
from protlake.plans import reports
from protlake.session import Scratch, shuffles_dropped

T = 0.5
STEPS = M.step_thresholds(0.01)
NINE = [0.05 + 0.1 * i for i in range(9)]
NINETY_NINE = M.even_grid(0.01, 0.99, 99)


def _grid_sql(values) -> str:
    rows = ", ".join(f"({k}, {v!r}::DOUBLE)" for k, v in enumerate(values))
    return f"grid(k, t) AS (VALUES {rows})"


_SAFE = "CASE WHEN {1} = 0 THEN 0.0::DOUBLE ELSE CAST({0} AS DOUBLE) / ({1}) END"
_P, _R = _SAFE.format("tp", "tp + fp"), _SAFE.format("tp", "tp + fn")


ALL_CELLS = "(SELECT count(*) FROM orders) * (SELECT count(*) FROM supplier)"


def _sweep_sql(grid, by: str = "", source: str = "pairs", score: str = "score", cells: str = "") -> str:
    """Threshold counters by a direct count at every threshold; ``cells`` of a group that have no row are negatives of score 0."""
    lead, rest = f"{by}, " if by else "", f" + CASE WHEN t <= 0 THEN {cells} - count(*) ELSE 0 END" if cells else ""
    return f"""{_grid_sql(grid)}, sw AS (SELECT {lead}k, t, count(*) FILTER (WHERE {score} >= t::FLOAT AND y) AS tp,
  count(*) FILTER (WHERE {score} >= t::FLOAT AND NOT y){rest} AS fp, count(*) FILTER (WHERE {score} < t::FLOAT AND y) AS fn FROM {source}, grid GROUP BY {lead}k, t),
pr AS (SELECT *, {_P} AS precision, {_R} AS recall FROM sw),
ff AS (SELECT *, {_SAFE.format('2 * precision * recall', 'precision + recall')} AS f1 FROM pr)"""


def _best_sql(by: str = "", prefix: str = "fmax", table_: str = "ff") -> str:
    lead = f"{by}, " if by else ""
    part = f"PARTITION BY {by} " if by else ""
    return f"""SELECT {lead}round(f1, 6) AS {prefix}, round(t, 6) AS {prefix}_threshold, round(precision, 6) AS {prefix}_precision, round(recall, 6) AS {prefix}_recall
FROM (SELECT *, row_number() OVER ({part}ORDER BY f1 DESC, k) AS rn FROM {table_}) WHERE rn = 1"""


def _weighted_sql(grid) -> str:
    return f"""{_grid_sql(grid)}, cell AS (SELECT pairs.*, ia FROM pairs JOIN terms ON terms.term = pairs.term),
sw AS (SELECT k, t, sum(CASE WHEN score >= t::FLOAT AND y THEN ia ELSE 0 END) AS tp, sum(CASE WHEN score >= t::FLOAT AND NOT y THEN ia ELSE 0 END) AS fp,
  sum(CASE WHEN score < t::FLOAT AND y THEN ia ELSE 0 END) AS fn FROM cell, grid GROUP BY k, t),
pr AS (SELECT *, tp / (tp + fp + 1e-12) AS precision, tp / (tp + fn + 1e-12) AS recall FROM sw),
ff AS (SELECT *, 2 * precision * recall / (precision + recall + 1e-12) AS f1 FROM pr)"""


@query("fmax", f"WITH {V.PAIRS}, {_sweep_sql(STEPS, cells=ALL_CELLS)} {_best_sql()}")
def fmax(spark, sf):
    return rounded(M.fmax(V.pairs(spark, sf), entries=V.entries(spark, sf), terms=V.terms(spark, sf)))


@query("fmax_by_aspect", f"WITH {V.PAIRS}, {V.TERMS}, nc AS (SELECT aspect, count(*) * (SELECT count(*) FROM orders) AS cells FROM terms GROUP BY 1), pc AS (SELECT pairs.*, cells FROM pairs JOIN nc ON nc.aspect = pairs.aspect), {_sweep_sql(STEPS, 'aspect', 'pc', cells='max(cells)')} {_best_sql('aspect')}")
def fmax_by_aspect(spark, sf):
    return rounded(M.fmax(V.pairs(spark, sf), by=["aspect"], entries=V.entries(spark, sf), terms=V.terms(spark, sf)))


@query("fmax_all_cells", f"""
WITH {V.PAIRS}, {V.TERMS}, nn AS (SELECT (SELECT count(*) FROM orders) * (SELECT count(*) FROM supplier) - (SELECT count(*) FROM pairs) AS missing),
{_sweep_sql(STEPS).replace("fp, count(*)", "fp0, count(*)").replace("pr AS (SELECT *,", "sx AS (SELECT *, fp0 + CASE WHEN t <= 0 THEN missing ELSE 0 END AS fp FROM sw, nn), pr AS (SELECT *,").replace("FROM sw), ff", "FROM sx), ff").replace("recall FROM sw)", "recall FROM sx)")}
SELECT k, round(t, 6) AS threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(f1, 6) AS f1 FROM ff""")
def fmax_all_cells(spark, sf):
    """Sweep over the whole entry x term matrix: unscored cells are negatives of score 0."""
    p = V.pairs(spark, sf)
    extra = M.implicit_cells(p, V.entries(spark, sf), V.terms(spark, sf), STEPS)
    return M.sweep(p, STEPS, implicit=extra).select("k", r6("threshold"), "tp", "fp", "fn", r6("f1"))


@query("ia_fmax", f"WITH {V.PAIRS}, {V.TERMS}, {_weighted_sql(NINE)} {_best_sql(prefix='ia_fmax')}")
def ia_fmax(spark, sf):
    return rounded(M.weighted_fmax(V.pairs(spark, sf), V.terms(spark, sf), NINE, entries=V.entries(spark, sf), terms=V.terms(spark, sf)))


@query("ia_fmax_fine", f"WITH {V.PAIRS}, {V.TERMS}, {_weighted_sql(NINETY_NINE)} {_best_sql(prefix='ia_fmax')}")
def ia_fmax_fine(spark, sf):
    return rounded(M.weighted_fmax(V.pairs(spark, sf), V.terms(spark, sf), NINETY_NINE, entries=V.entries(spark, sf), terms=V.terms(spark, sf)))


_TERM = """pt AS (SELECT term, count(*) FILTER (WHERE score >= 0.5::FLOAT AND y) AS tp, count(*) FILTER (WHERE score >= 0.5::FLOAT AND NOT y) AS fp,
  count(*) FILTER (WHERE score < 0.5::FLOAT AND y) AS fn FROM pairs GROUP BY term),
full_t AS (SELECT terms.term, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn FROM terms LEFT JOIN pt ON pt.term = terms.term)"""
_MICRO = f"""tm AS (SELECT *, {_P} AS p, {_R} AS r, {_SAFE.format('2 * tp', '2 * tp + fp + fn')} AS f FROM full_t),
ag AS (SELECT sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, avg(p) AS macro_precision, avg(r) AS macro_recall, avg(f) AS macro_f1,
  coalesce(avg(f) FILTER (WHERE tp + fn > 0), 0.0) AS macro_f1_positive_labels, count(*) AS label_count,
  count(*) FILTER (WHERE tp + fn > 0) AS label_count_with_positive FROM tm),
mm AS (SELECT *, {_P} AS precision, {_R} AS recall FROM ag)"""
_MICRO_COLS = """round(precision, 6) AS micro_precision, round(recall, 6) AS micro_recall,
  round(CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END, 6) AS micro_f1,
  round(macro_precision, 6) AS macro_precision, round(macro_recall, 6) AS macro_recall, round(macro_f1, 6) AS macro_f1,
  round(macro_f1_positive_labels, 6) AS macro_f1_positive_labels, label_count, label_count_with_positive"""


@query("micro_macro_f1", f"WITH {V.PAIRS}, {V.TERMS}, {_TERM}, {_MICRO} SELECT {_MICRO_COLS} FROM mm")
def micro_macro_f1(spark, sf):
    per = M.complete_terms(M.term_counts_at(V.pairs(spark, sf), T), V.terms(spark, sf))
    return rounded(M.micro_macro(per))


_SAMPLES = """ps AS (SELECT entry_id, count(*) FILTER (WHERE score >= 0.5::FLOAT AND y) AS tp, count(*) FILTER (WHERE score >= 0.5::FLOAT) AS p,
  count(*) FILTER (WHERE y) AS a FROM pairs GROUP BY 1)"""


@query("samples_f1", f"""WITH {V.PAIRS}, {_SAMPLES}
SELECT round(sum(CASE WHEN p + a = 0 THEN 0.0 ELSE 2.0 * tp / (p + a) END) / (SELECT count(*) FROM orders), 6) AS samples_f1 FROM ps""")
def samples_f1(spark, sf):
    return rounded(M.samples_f1(V.pairs(spark, sf), T, V.entries(spark, sf)))


_MACRO_SWEEP = f"""{_grid_sql(NINE)}, pk AS (SELECT term, k, t, count(*) FILTER (WHERE score >= t::FLOAT AND y) AS tp,
  count(*) FILTER (WHERE score >= t::FLOAT AND NOT y) AS fp, count(*) FILTER (WHERE score < t::FLOAT AND y) AS fn FROM pairs, grid GROUP BY 1, 2, 3),
mac AS (SELECT k, sum(CASE WHEN 2 * tp + fp + fn = 0 THEN 0.0 ELSE 2.0 * tp / (2 * tp + fp + fn) END) / (SELECT count(*) FROM terms) AS macro_f1 FROM pk GROUP BY k),
sw AS (SELECT k, t, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM pk GROUP BY 1, 2), pr AS (SELECT *, {_P} AS precision, {_R} AS recall FROM sw),
ff AS (SELECT pr.*, macro_f1, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS micro_f1 FROM pr JOIN mac ON mac.k = pr.k)"""


@query("threshold_sweep", f"WITH {V.PAIRS}, {V.TERMS}, {_MACRO_SWEEP} SELECT round(t, 6) AS threshold, round(micro_f1, 6) AS micro_f1, round(macro_f1, 6) AS macro_f1 FROM ff")
def threshold_sweep(spark, sf):
    return rounded(M.threshold_sweep(V.pairs(spark, sf), NINE, V.terms(spark, sf), entries=V.entries(spark, sf)))


@query("best_macro_threshold", f"WITH {V.PAIRS}, {V.TERMS}, {_MACRO_SWEEP} SELECT round(t, 6) AS threshold, round(macro_f1, 6) AS macro_f1 FROM ff ORDER BY macro_f1 DESC, k LIMIT 1")
def best_macro_threshold(spark, sf):
    return rounded(M.best_of_sweep(M.macro_sweep(V.pairs(spark, sf), NINE, V.terms(spark, sf), entries=V.entries(spark, sf)), "macro_f1"))


_ERR = """er AS (SELECT aspect, term, count(*) FILTER (WHERE y) AS true_count, count(*) FILTER (WHERE score >= 0.5::FLOAT) AS pred_count,
  count(*) FILTER (WHERE score >= 0.5::FLOAT AND y) AS tp, count(*) FILTER (WHERE score >= 0.5::FLOAT AND NOT y) AS fp,
  count(*) FILTER (WHERE score < 0.5::FLOAT AND y) AS fn FROM pairs GROUP BY 1, 2)"""


@query("error_table", f"""WITH {V.PAIRS}, {_ERR} SELECT aspect, term, true_count, pred_count, tp, fp, fn,
  round(fn / (true_count + 1e-12), 6) AS fn_rate, round(fp / (pred_count + 1e-12), 6) AS fp_rate FROM er""")
def error_table(spark, sf):
    return rounded(M.label_errors(V.pairs(spark, sf), T))


@query("error_summary", f"""WITH {V.PAIRS}, {_ERR}, n AS (SELECT aspect, count(DISTINCT entry_id) AS n FROM pairs GROUP BY 1)
SELECT er.aspect, 0.5::DOUBLE AS threshold, sum(tp)::BIGINT AS total_tp, sum(fp)::BIGINT AS total_fp, sum(fn)::BIGINT AS total_fn, sum(true_count)::BIGINT AS total_true_labels,
  sum(pred_count)::BIGINT AS total_predicted_labels, round(sum(true_count) / max(n)::DOUBLE, 6) AS avg_true_labels_per_protein,
  round(sum(pred_count) / max(n)::DOUBLE, 6) AS avg_predicted_labels_per_protein FROM er JOIN n ON n.aspect = er.aspect GROUP BY er.aspect""")
def error_summary(spark, sf):
    p = V.pairs(spark, sf)
    return rounded(M.error_summary(M.label_errors(p, T), p.select("aspect", "entry_id").distinct(), T))


@query("top_fn", f"WITH {V.PAIRS}, {_ERR} SELECT aspect, term, fn FROM er QUALIFY row_number() OVER (PARTITION BY aspect ORDER BY fn DESC, term) <= 15")
def top_fn(spark, sf):
    errors = M.label_errors(V.pairs(spark, sf), T)
    return ranking.top_k(errors, ["aspect"], [F.col("fn").desc(), F.col("term")], 15).select("aspect", "term", "fn")


@query("top_fp", f"WITH {V.PAIRS}, {_ERR} SELECT aspect, term, fp FROM er QUALIFY row_number() OVER (PARTITION BY aspect ORDER BY fp DESC, term) <= 15")
def top_fp(spark, sf):
    errors = M.label_errors(V.pairs(spark, sf), T)
    return ranking.top_k(errors, ["aspect"], [F.col("fp").desc(), F.col("term")], 15).select("aspect", "term", "fp")


@query("error_scatter", f"WITH {V.PAIRS}, {_ERR} SELECT aspect, term, true_count, round(fn / (true_count + 1e-12), 6) AS fn_rate FROM er")
def error_scatter(spark, sf):
    return rounded(M.label_errors(V.pairs(spark, sf), T).select("aspect", "term", "true_count", "fn_rate"))


@query("labels_per_protein", f"""WITH {V.PAIRS}, c AS (SELECT entry_id, count(*) FILTER (WHERE y) AS true_labels, count(*) FILTER (WHERE score >= 0.5::FLOAT) AS predicted_labels FROM pairs GROUP BY 1)
SELECT true_labels, predicted_labels, count(*) AS n FROM c GROUP BY 1, 2""")
def labels_per_protein(spark, sf):
    per = M.labels_per_entry(V.pairs(spark, sf), T)
    return per.groupBy("true_labels", "predicted_labels").agg(F.count("*").alias("n"))


@query("model_comparison", f"""
WITH {V.PAIRS}, {V.TERMS}, both_m AS (SELECT 'first' AS model, aspect, term, score, y FROM pairs UNION ALL SELECT 'second', aspect, term, second_score, y FROM pairs),
{_grid_sql(NINE)}, cell AS (SELECT both_m.*, ia FROM both_m JOIN terms ON terms.term = both_m.term),
sw AS (SELECT aspect, model, k, t, sum(CASE WHEN score >= t::FLOAT AND y THEN ia ELSE 0 END) AS wtp, sum(CASE WHEN score >= t::FLOAT AND NOT y THEN ia ELSE 0 END) AS wfp,
  sum(CASE WHEN score < t::FLOAT AND y THEN ia ELSE 0 END) AS wfn, count(*) FILTER (WHERE score >= t::FLOAT AND y) AS tp,
  count(*) FILTER (WHERE score >= t::FLOAT AND NOT y) AS fp, count(*) FILTER (WHERE score < t::FLOAT AND y) AS fn FROM cell, grid GROUP BY 1, 2, 3, 4),
pr AS (SELECT *, wtp / (wtp + wfp + 1e-12) AS wp, wtp / (wtp + wfn + 1e-12) AS wr, {_P} AS precision, {_R} AS recall FROM sw),
ff AS (SELECT *, 2 * wp * wr / (wp + wr + 1e-12) AS wf, {_SAFE.format('2 * precision * recall', 'precision + recall')} AS f1 FROM pr),
a AS (SELECT aspect, model, round(wf, 6) AS ia_fmax, round(t, 6) AS ia_fmax_threshold, round(wp, 6) AS ia_fmax_precision, round(wr, 6) AS ia_fmax_recall
  FROM ff QUALIFY row_number() OVER (PARTITION BY aspect, model ORDER BY wf DESC, k) = 1),
b AS (SELECT aspect, model, round(f1, 6) AS fmax, round(t, 6) AS fmax_threshold, round(precision, 6) AS fmax_precision, round(recall, 6) AS fmax_recall
  FROM ff QUALIFY row_number() OVER (PARTITION BY aspect, model ORDER BY f1 DESC, k) = 1)
SELECT * FROM a JOIN b USING (aspect, model)""")
def model_comparison(spark, sf):
    return rounded(_compared(spark, sf, NINE))


def _compared(spark, sf, grid):
    """Two models' scores against each other, over every cell of an aspect."""
    p = V.pairs(spark, sf)
    both = p.select("aspect", "entry_id", "term", "y", F.explode(F.array(
        F.struct(F.lit("first").alias("model"), "score"), F.struct(F.lit("second").alias("model"), F.col("second_score").alias("score")))).alias("s")) \
        .select("aspect", "entry_id", "term", "y", "s.*")
    every = V.terms(spark, sf).select("aspect", F.explode(F.array(F.lit("first"), F.lit("second"))).alias("model"), "term")
    return M.model_comparison(both, V.terms(spark, sf), grid, ["aspect", "model"], entries=V.entries(spark, sf), terms=every)


# --- every cell of the entry x term matrix, also at threshold 0 ---------------------------------------------------

FROM_ZERO = [0.0, *NINE]
_MISSING = "ms AS (SELECT terms.term, terms.aspect, ia, (SELECT count(*) FROM orders) - (SELECT count(*) FROM pairs p WHERE p.term = terms.term) AS missing FROM terms)"


@query("ia_fmax_all_cells", f"WITH {V.PAIRS}, {V.TERMS}, {_MISSING}, " + _weighted_sql(FROM_ZERO).replace(
    "AND NOT y THEN ia ELSE 0 END) AS fp", "AND NOT y THEN ia ELSE 0 END) + CASE WHEN t <= 0 THEN (SELECT sum(ia * missing) FROM ms) ELSE 0 END AS fp") +
    " SELECT k, round(t, 6) AS threshold, round(tp, 4) AS tp, round(fp, 4) AS fp, round(fn, 4) AS fn, round(precision, 6) AS precision, round(f1, 6) AS f1 FROM ff")
def ia_fmax_all_cells(spark, sf):
    """The weighted sweep behind Fmax, down to threshold 0."""
    weighted = M.weigh(M.term_buckets(V.pairs(spark, sf), FROM_ZERO, [], V.entries(spark, sf), V.terms(spark, sf), False), V.terms(spark, sf))
    rows = M.with_ratios(M.threshold_counts(weighted, FROM_ZERO), eps=True)
    return rows.select("k", r6("threshold"), *[F.round(c, 4).alias(c) for c in ("tp", "fp", "fn")], r6("precision"), r6("f1"))


@query("threshold_sweep_all_cells", f"WITH {V.PAIRS}, {V.TERMS}, {_MISSING}, " + _MACRO_SWEEP.replace(_grid_sql(NINE), _grid_sql(FROM_ZERO)).replace(
    "AND NOT y) AS fp", "AND NOT y) + CASE WHEN t <= 0 THEN (SELECT missing FROM ms WHERE ms.term = pairs.term) ELSE 0 END AS fp").replace(
    "GROUP BY 1, 2, 3)", "GROUP BY pairs.term, k, t)").replace("SELECT term, k, t, count", "SELECT pairs.term, k, t, count").replace(
    "sum(fp) AS fp, sum(fn) AS fn FROM pk", "sum(fp) + CASE WHEN t <= 0 THEN (SELECT coalesce(sum(missing), 0) FROM ms WHERE term NOT IN (SELECT term FROM pairs)) ELSE 0 END AS fp, sum(fn) AS fn FROM pk") +
    " SELECT round(t, 6) AS threshold, round(micro_f1, 6) AS micro_f1, round(macro_f1, 6) AS macro_f1 FROM ff")
def threshold_sweep_all_cells(spark, sf):
    return rounded(M.threshold_sweep(V.pairs(spark, sf), FROM_ZERO, V.terms(spark, sf), entries=V.entries(spark, sf)))


_CURVE = """st AS (SELECT aspect, score, count(*) FILTER (WHERE y) AS pos, count(*) FILTER (WHERE NOT y) AS neg FROM pairs GROUP BY 1, 2
  UNION ALL SELECT terms.aspect, 0::FLOAT, 0, count(*) * (SELECT count(*) FROM orders) - (SELECT count(*) FROM pairs p WHERE p.aspect = terms.aspect) FROM terms GROUP BY terms.aspect),
s2 AS (SELECT aspect, score, sum(pos)::BIGINT AS pos, sum(neg)::BIGINT AS neg FROM st GROUP BY 1, 2 HAVING sum(pos) + sum(neg) > 0),
cu AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY aspect) AS total FROM s2 WINDOW w AS (PARTITION BY aspect ORDER BY score DESC)),
pt AS (SELECT *, tp::DOUBLE / (tp + fp) AS precision, CASE WHEN total = 0 THEN 0 ELSE tp::DOUBLE / total END AS recall FROM cu),
ar AS (SELECT *, recall - lag(recall, 1, 0) OVER w AS gain, lag(precision, 1, 1) OVER w AS earlier FROM pt WINDOW w AS (PARTITION BY aspect ORDER BY score DESC))"""


@query("precision_recall", f"WITH {V.PAIRS}, {V.TERMS}, {_CURVE} SELECT aspect, round(score::DOUBLE, 6) AS score, tp::BIGINT AS tp, fp::BIGINT AS fp, (total - tp)::BIGINT AS fn, round(precision, 6) AS precision, round(recall, 6) AS recall FROM ar")
def precision_recall(spark, sf):
    """Every point of the pooled curve of each aspect; unscored cells are the last step, or part of it."""
    return rounded(M.precision_recall(V.pairs(spark, sf), ["aspect"], entries=V.entries(spark, sf), terms=V.terms(spark, sf)).drop("area", "step"))


@query("micro_auprc", f"WITH {V.PAIRS}, {V.TERMS}, {_CURVE} SELECT aspect, round(sum(gain * (precision + earlier) / 2), 6) AS micro_auprc, round(sum(gain * precision), 6) AS average_precision, count(*) AS points FROM ar GROUP BY 1")
def micro_auprc(spark, sf):
    return rounded(M.micro_auprc(V.pairs(spark, sf), ["aspect"], entries=V.entries(spark, sf), terms=V.terms(spark, sf)))


_LOGIT = "ln(least(greatest({0}::DOUBLE, 1e-7), 1.0 - 1e-7) / (1.0 - least(greatest({0}::DOUBLE, 1e-7), 1.0 - 1e-7)))"


@query("losses", f"""WITH {V.PAIRS}, x AS (SELECT aspect, {_LOGIT.format('score')} AS x, CASE WHEN y THEN 1.0::DOUBLE ELSE 0.0 END AS yy FROM pairs),
l AS (SELECT *, greatest(x, 0.0) - x * yy + ln(1.0 + exp(-abs(x))) AS bce, (1.0 - yy) * x + (1.0 + 2.0 * yy) * (ln(1.0 + exp(-abs(x))) + greatest(-x, 0.0)) AS w,
  CASE WHEN yy = 1 THEN 1.0 / (1.0 + exp(-x)) ELSE 1.0 - 1.0 / (1.0 + exp(-x)) END AS pt FROM x)
SELECT aspect, round(avg(bce), 6) AS bce, round(avg(w), 6) AS weighted_bce,
  round(avg(CASE WHEN yy = 1 THEN 0.25 ELSE 0.75 END * pow(greatest(1.0 - pt, 0.0), 2.0) * bce), 6) AS focal_bce FROM l GROUP BY aspect""")
def losses(spark, sf):
    p = V.pairs(spark, sf).withColumn("w", fn.d(3))
    return rounded(M.losses(p, fn.logit(F.col("score")), ["aspect"], "w"))


@query("mean_loss", "SELECT event_type, round(sum(value * (user_id % 8 + 1)) / sum(user_id % 8 + 1), 6) AS mean_loss FROM events GROUP BY 1")
def mean_loss(spark, sf):
    batches = table(spark, sf, "events").withColumn("size", F.col("user_id") % 8 + 1)
    return rounded(M.weighted_mean_loss(batches, "value", "size", ["event_type"]))


_MIX = "CAST({w} * {a}::DOUBLE + (1.0::DOUBLE - {w}) * {b}::DOUBLE AS FLOAT)"


@query("fuse_scores", f"WITH {V.PAIRS} SELECT entry_id, term, round(CAST(CAST(0.25 * score::DOUBLE + 0.75 * second_score::DOUBLE AS FLOAT) AS DOUBLE), 6) AS score FROM pairs")
def fuse_scores(spark, sf):
    p = V.pairs(spark, sf)
    second = p.select("entry_id", "term", F.col("second_score").alias("score"))
    return rounded(S.fuse(p.select("entry_id", "term", "score"), second, 1.0, 3.0))


@query("fuse_logits", f"""WITH {V.PAIRS}, l AS (SELECT entry_id, term, 0.5 * CAST({_LOGIT.format('score')} AS FLOAT)::DOUBLE + 0.5 * CAST({_LOGIT.format('second_score')} AS FLOAT)::DOUBLE AS x FROM pairs)
SELECT entry_id, term, round(CAST(x AS FLOAT)::DOUBLE, 4) AS logit, round(CAST(1.0 / (1.0 + exp(-x)) AS FLOAT)::DOUBLE, 4) AS score FROM l""")
def fuse_logits(spark, sf):
    p = V.pairs(spark, sf)
    side = [p.select("entry_id", "term", fn.logit(F.col(c)).cast("float").alias("logit")) for c in ("score", "second_score")]
    fused = S.fuse(*side, 1.0, 1.0, "logits")
    return fused.select("entry_id", "term", *[F.round(F.col(c).cast("double"), 4).alias(c) for c in ("logit", "score")])


@query("bundle_check", f"""WITH {V.PAIRS}, s AS (SELECT DISTINCT entry_id, term FROM pairs WHERE second_score >= 0.5::FLOAT),
d AS (SELECT (SELECT count(*) FROM (SELECT DISTINCT entry_id FROM pairs) a FULL JOIN (SELECT DISTINCT entry_id FROM s) b ON a.entry_id = b.entry_id WHERE a.entry_id IS NULL OR b.entry_id IS NULL) AS entries_differ,
 (SELECT count(*) FROM (SELECT DISTINCT term FROM pairs) a FULL JOIN (SELECT DISTINCT term FROM s) b ON a.term = b.term WHERE a.term IS NULL OR b.term IS NULL) AS terms_differ)
SELECT (SELECT count(*) FROM pairs) AS first_rows, (SELECT count(*) FROM s) AS second_rows, entries_differ, terms_differ,
  entries_differ = 0 AND terms_differ = 0 AND (SELECT count(*) FROM pairs) = (SELECT count(*) FROM s) AS compatible FROM d""")
def bundle_check(spark, sf):
    p = V.pairs(spark, sf)
    return checks.bundle_compatibility(p, p.where(F.col("second_score") >= 0.5))


_FUSION = f"""wts AS (SELECT unnest(generate_series(0, 10)) / 10.0::DOUBLE AS weight),
mixed AS (SELECT weight, {_MIX.format(w='weight', a='score', b='second_score')} AS score, y FROM pairs, wts)"""


@query("fusion_grid", f"WITH {V.PAIRS}, {_FUSION}, {_sweep_sql(STEPS, 'weight', 'mixed', cells=ALL_CELLS)} {_best_sql('weight').replace('SELECT weight,', 'SELECT round(weight, 6) AS weight,', 1)}")
def fusion_grid(spark, sf):
    return rounded(S.fusion_grid(V.pairs(spark, sf), "score", "second_score", entries=V.entries(spark, sf), terms=V.terms(spark, sf)))


@query("best_fusion_weight", f"""WITH {V.PAIRS}, {_FUSION}, {_sweep_sql(STEPS, 'weight', 'mixed', cells=ALL_CELLS)},
b AS (SELECT weight, f1 FROM ff QUALIFY row_number() OVER (PARTITION BY weight ORDER BY f1 DESC, k) = 1)
SELECT round(weight, 6) AS weight, round(f1, 6) AS fmax FROM b ORDER BY f1 DESC, weight LIMIT 1""")
def best_fusion_weight(spark, sf):
    return rounded(S.best_fusion_weight(S.fusion_grid(V.pairs(spark, sf), "score", "second_score", entries=V.entries(spark, sf), terms=V.terms(spark, sf))))


@query("join_targets", f"""WITH {V.PAIRS}, lb AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS entry_id, CAST(l_suppkey AS VARCHAR) AS term FROM lineitem WHERE l_tax > 0.05),
sc AS (SELECT entry_id, term, score FROM pairs WHERE score >= 0.2::FLOAT)
SELECT coalesce(sc.entry_id, lb.entry_id) AS entry_id, coalesce(sc.term, lb.term) AS term, round(coalesce(score, 0)::DOUBLE, 6) AS score, lb.term IS NOT NULL AS y
FROM sc FULL JOIN lb ON sc.entry_id = lb.entry_id AND sc.term = lb.term""")
def join_targets(spark, sf):
    scored = V.pairs(spark, sf).where(F.col("score") >= F.lit(0.2).cast("float")).select("entry_id", "term", "score")
    lab = table(spark, sf, "lineitem").where("l_tax > 0.05D").select(
        F.col("l_orderkey").cast("string").alias("entry_id"), F.col("l_suppkey").cast("string").alias("term"))
    return rounded(M.join_targets(scored, lab))


@query("clamped_evaluation", f"""WITH {V.PAIRS}, {V.TERMS}, cl AS (SELECT entry_id, term, aspect, y, CAST(least(greatest(score::DOUBLE, 1e-7), 1.0 - 1e-7) AS FLOAT) AS score FROM pairs),
{_TERM.replace('FROM pairs', 'FROM cl')}, {_MICRO}, {_sweep_sql(STEPS, source='cl', cells=ALL_CELLS).replace('pr AS', 'pr2 AS').replace('FROM pr)', 'FROM pr2)')},
bb AS ({_best_sql()}) SELECT {_MICRO_COLS}, bb.*, 0.5::DOUBLE AS metric_threshold, 0.01::DOUBLE AS fmax_threshold_step FROM mm, bb""")
def clamped_evaluation(spark, sf):
    return rounded(S.evaluate(V.pairs(spark, sf), V.terms(spark, sf), T, entries=V.entries(spark, sf)))


@query("fusion_report", f"""WITH {V.PAIRS}, md AS (SELECT 'graph' AS model, term, CAST(least(greatest(score::DOUBLE, 1e-7), 1.0 - 1e-7) AS FLOAT) AS score, y FROM pairs
UNION ALL SELECT 'sequence', term, CAST(least(greatest(second_score::DOUBLE, 1e-7), 1.0 - 1e-7) AS FLOAT), y FROM pairs
UNION ALL SELECT 'fused', term, CAST(least(greatest(CAST(0.5 * score::DOUBLE + 0.5 * second_score::DOUBLE AS FLOAT)::DOUBLE, 1e-7), 1.0 - 1e-7) AS FLOAT), y FROM pairs),
{_sweep_sql(STEPS, 'model', 'md', cells=ALL_CELLS)}, b AS (SELECT * FROM ff QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, k) = 1)
SELECT model, round(f1, 6) AS fmax, round(t, 6) AS fmax_threshold, round(f1 - (SELECT f1 FROM b WHERE model = 'graph'), 6) AS fmax_delta FROM b""")
def fusion_report(spark, sf):
    with Scratch(spark, "fusion") as scratch:
        with shuffles_dropped(spark):
            p = scratch.table(V.pairs(spark, sf).select("entry_id", "term", "score", "second_score", "y"))  # three tables come from it
        second = p.select("entry_id", "term", F.col("second_score").alias("score"))
        report = reports.fusion_report(p.select("entry_id", "term", "score"), second, p.where("y").select("entry_id", "term"),
                                       V.terms(spark, sf), 1.0, 1.0, entries=V.entries(spark, sf))
    return rounded(report.select("model", "fmax", "fmax_threshold", "fmax_delta"))


# --- scorers ----------------------------------------------------------------------------------------------------

_DOT = "list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"
_W = """wl AS (SELECT label, i, avg(embedding[i]::DOUBLE) AS w FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i) GROUP BY 1, 2),
wv AS (SELECT label, list(w ORDER BY i) AS w FROM wl GROUP BY 1)"""


def _weights(spark, sf):
    """Mean vector of each label as the weight vector of one term; bias from the label."""
    from protlake.operators.sequences import mean_pool
    return mean_pool(table(spark, sf, "embeddings"), ["label"]).select(
        F.col("label").cast("string").alias("term"), F.col("embedding").alias("w"), (F.col("label") / 10.0).cast("double").alias("b"))


def _features(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("entry_id"), "embedding")


@query("linear_scores", f"""WITH {_W} SELECT CAST(vec_id AS VARCHAR) AS entry_id, CAST(wv.label AS VARCHAR) AS term,
  round({_DOT.format(a='embedding', b='w')} + wv.label / 10.0, 6) AS logit FROM embeddings, wv""")
def linear_scores(spark, sf):
    return rounded(S.linear_scores(_features(spark, sf), _weights(spark, sf)))


@query("linear_scores_blocked", f"""WITH {_W} SELECT CAST(vec_id AS VARCHAR) AS entry_id, CAST(wv.label AS VARCHAR) AS term,
  round({_DOT.format(a='embedding', b='w')} + wv.label / 10.0, 6) AS logit FROM embeddings, wv""")
def linear_scores_blocked(spark, sf):
    """The route for weight matrices too large to ship."""
    return rounded(S.linear_scores(_features(spark, sf), _weights(spark, sf), broadcast_limit=0))


@query("label_vector_scores", f"""WITH {_W} SELECT CAST(vec_id AS VARCHAR) AS entry_id, CAST(wv.label AS VARCHAR) AS term,
  round(1.0 / (1.0 + exp(-{_DOT.format(a='embedding', b='w')})), 6) AS score FROM embeddings, wv""")
def label_vector_scores(spark, sf):
    scores = S.label_vector_scores(_features(spark, sf), _weights(spark, sf))
    return rounded(scores.select("entry_id", "term", fn.sigmoid(F.col("logit")).alias("score")))


@query("two_layer_scores", f"""WITH {_W}, h AS (SELECT vec_id, wv.label, greatest({_DOT.format(a='embedding', b='w')} + wv.label / 10.0, 0.0) AS h FROM embeddings, wv)
SELECT CAST(vec_id AS VARCHAR) AS entry_id, n_name AS term, round(sum(h * (((n_nationkey * 7 + label * 3) % 11 - 5) / 10.0)) + n_regionkey / 10.0, 6) AS logit
FROM h, nation GROUP BY vec_id, n_name, n_regionkey""")
def two_layer_scores(spark, sf):
    hidden = _weights(spark, sf).select(F.col("term").cast("int").alias("unit"), "w", "b")
    out = table(spark, sf, "nation").select(
        F.col("n_name").alias("term"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda j: (
            ((F.col("n_nationkey") * 7 + j * 3) % 11 - 5) / 10.0).cast("double")).alias("w"), (F.col("n_regionkey") / 10.0).cast("double").alias("b"))
    return rounded(S.two_layer_scores(_features(spark, sf), hidden, out))


@query("calibrated_logits", f"""WITH {V.PAIRS}, pri AS (SELECT term, least(greatest(count(DISTINCT entry_id) FILTER (WHERE y) / (SELECT count(*) FROM orders)::DOUBLE, 1e-6), 1 - 1e-6) AS prior FROM pairs GROUP BY 1)
SELECT entry_id, pairs.term, round(({_LOGIT.format('score')} + 0.5 * ln(prior / (1.0 - prior))) / 2.0, 6) AS logit FROM pairs JOIN pri ON pri.term = pairs.term""")
def calibrated_logits(spark, sf):
    p = V.pairs(spark, sf)
    lab = p.where("y").select(F.lit("ALL").alias("aspect"), "entry_id", "term")
    vocab = V.terms(spark, sf).select(F.lit("ALL").alias("aspect"), "term")
    priors = L.label_priors(lab, vocab, V.entries(spark, sf))
    logits = p.select("entry_id", "term", fn.logit(F.col("score")).alias("logit"))
    return rounded(S.calibrate(logits, priors, 0.5, 2.0).select("entry_id", "term", "logit"))
