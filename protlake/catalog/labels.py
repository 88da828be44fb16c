"""Label, vocabulary, split and audit queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from protlake.catalog import views as V
from protlake.catalog.registry import query, rounded, table
from protlake.functions import scalar as fn
from protlake.session import staged
from protlake.operators import audit, checks, labels as L, ranking, reshape, splits as S

RATIOS = (0.7, 0.15, 0.15)
SEED = 2026


def _counts(spark, sf):
    return L.term_counts(V.labels(spark, sf))


@query("label_vocab", f"""
WITH {V.LAB}, {V.CNT}
SELECT aspect, term, n, CAST(row_number() OVER (PARTITION BY aspect ORDER BY term) - 1 AS INTEGER) AS term_index FROM cnt WHERE n >= 20""")
def label_vocab(spark, sf):
    return L.vocabulary(_counts(spark, sf), 20)


@query("label_term_counts_distinct", f"""
WITH {V.LAB} SELECT aspect, term, count(DISTINCT entry_id) AS n FROM lab GROUP BY aspect, term""")
def label_term_counts_distinct(spark, sf):
    return L.term_counts(V.labels(spark, sf), distinct=True)


@query("label_freq_filter", f"""
WITH {V.LAB}, {V.CNT}
SELECT aspect, count(*) AS terms_raw, count(*) FILTER (WHERE n >= 20) AS terms_kept, count(*) FILTER (WHERE n < 20) AS terms_removed,
  round(CAST(100.0 * count(*) FILTER (WHERE n >= 20) AS DOUBLE) / count(*), 6) AS kept_pct FROM cnt GROUP BY aspect""")
def label_freq_filter(spark, sf):
    return rounded(L.frequency_filter_summary(_counts(spark, sf), 20))


@query("label_cardinality", f"""
WITH {V.LAB}, c AS (SELECT aspect, entry_id, count(DISTINCT term) AS n_labels FROM lab GROUP BY 1, 2)
SELECT aspect, n_labels, count(*) AS n FROM c GROUP BY 1, 2""")
def label_cardinality(spark, sf):
    return L.cardinality(V.labels(spark, sf)).groupBy("aspect", "n_labels").agg(F.count("*").alias("n"))


@query("term_frequency_histogram", f"""
WITH {V.LAB}, {V.CNT}
SELECT aspect, CAST(CASE WHEN n >= 200 THEN 11 ELSE floor(n / 20.0) + 1 END AS BIGINT) AS bucket, count(*) AS n FROM cnt GROUP BY 1, 2""")
def term_frequency_histogram(spark, sf):
    return L.histogram(_counts(spark, sf), ["aspect"], "n", 0, 200, 10)


@query("label_encode", f"""
WITH {V.LAB}, {V.CNT}, voc AS (SELECT aspect, term, row_number() OVER (PARTITION BY aspect ORDER BY term) - 1 AS k FROM cnt WHERE n >= 20)
SELECT DISTINCT lab.aspect, entry_id, CAST(k AS INTEGER) AS term_index FROM lab JOIN voc ON lab.aspect = voc.aspect AND lab.term = voc.term""")
def label_encode(spark, sf):
    lab = V.labels(spark, sf)
    return L.encode_labels(lab, L.vocabulary(L.term_counts(lab), 20))


@query("label_projection", f"""
WITH {V.LAB}, {V.CNT}
SELECT aspect, term, entry_id FROM lab WHERE aspect = 'MFO' AND term IN (SELECT term FROM cnt WHERE aspect = 'MFO' AND n >= 60)""")
def label_projection(spark, sf):
    lab = V.labels(spark, sf)
    return L.project_labels(lab, L.vocabulary(L.term_counts(lab), 60), "MFO").select("aspect", "term", "entry_id")


@query("eligible_entries", f"""
WITH {V.LAB}, {V.CNT}, {V.ENT}
SELECT DISTINCT lab.aspect, lab.entry_id FROM lab JOIN cnt ON lab.aspect = cnt.aspect AND lab.term = cnt.term AND n >= 60
JOIN ent ON ent.entry_id = lab.entry_id AND coalesce(residue_count, 0) <= 15""")
def eligible_entries(spark, sf):
    lab = V.labels(spark, sf)
    return L.eligible_entries(lab, L.vocabulary(L.term_counts(lab), 60), V.entries(spark, sf), 15)


@query("eligible_by_scenario", f"""
WITH {V.LAB}, {V.CNT}, {V.ENT}, m AS (SELECT unnest([20, 50, 60, 80]) AS m), c AS (SELECT unnest([8, 15, 30]) AS c),
b AS (SELECT lab.aspect, lab.entry_id, max(n) AS best, max(coalesce(residue_count, 0)) AS rc FROM lab JOIN cnt USING (aspect, term)
      JOIN ent ON ent.entry_id = lab.entry_id GROUP BY 1, 2),
v AS (SELECT aspect, m, count(*) FILTER (WHERE n >= m) AS vocab_size FROM cnt, m GROUP BY 1, 2)
SELECT v.aspect, v.m AS min_term_frequency, c AS max_residues, vocab_size, count(*) FILTER (WHERE best >= v.m) AS eligible_uncapped,
  count(*) FILTER (WHERE best >= v.m AND rc <= c) AS eligible_capped, count(*) FILTER (WHERE best >= v.m AND rc > c) AS removed_by_cap,
  CASE WHEN count(*) FILTER (WHERE best >= v.m) > 0 THEN round(CAST(count(*) FILTER (WHERE best >= v.m AND rc > c) AS DOUBLE)
    / count(*) FILTER (WHERE best >= v.m), 6) ELSE 0.0 END AS removed_fraction
FROM v JOIN b ON b.aspect = v.aspect, c GROUP BY 1, 2, 3, 4""")
def eligible_by_scenario(spark, sf):
    lab = V.labels(spark, sf)
    return rounded(L.scenario_counts(lab, L.term_counts(lab), V.entries(spark, sf), [20, 50, 60, 80], [8, 15, 30]))


@query("scenario_split_counts", f"""
WITH {V.LAB}, {V.CNT}, {V.ENT}, m AS (SELECT unnest([20, 50, 60]) AS m),
b AS (SELECT aspect, entry_id, max(n) AS best FROM lab JOIN cnt USING (aspect, term) WHERE entry_id IN (SELECT entry_id FROM ent) GROUP BY 1, 2),
e AS (SELECT aspect, m, CAST(count(*) FILTER (WHERE best >= m) AS BIGINT) AS eligible_entries FROM b, m GROUP BY 1, 2),
f AS (SELECT *, eligible_entries * 0.8::DOUBLE AS a, eligible_entries * 0.1::DOUBLE AS b, eligible_entries * 0.1::DOUBLE AS c FROM e),
g AS (SELECT *, eligible_entries - CAST(floor(a) + floor(b) + floor(c) AS BIGINT) AS rest FROM f),
h AS (SELECT *, 1 + (CASE WHEN b - floor(b) > a - floor(a) THEN 1 ELSE 0 END) + (CASE WHEN c - floor(c) > a - floor(a) THEN 1 ELSE 0 END) AS ra FROM g)
SELECT aspect, m AS min_term_frequency, eligible_entries,
  CAST(floor(a) AS BIGINT) + CASE WHEN ra <= rest THEN 1 ELSE 0 END AS train_count,
  CAST(floor(b) AS BIGINT) + CASE WHEN (CASE WHEN ra = 1 THEN 2 ELSE 1 END) <= rest THEN 1 ELSE 0 END AS val_count,
  CAST(floor(c) AS BIGINT) + CASE WHEN (CASE WHEN ra = 3 THEN 2 ELSE 3 END) <= rest THEN 1 ELSE 0 END AS test_count FROM h""")
def scenario_split_counts(spark, sf):
    """Split sizes per scenario; the sizes do not depend on which ids fall where."""
    lab = V.labels(spark, sf)
    rows = L.scenario_counts(lab, L.term_counts(lab), V.entries(spark, sf), [20, 50, 60], [1]) \
        .select("aspect", "min_term_frequency", F.col("eligible_uncapped").alias("eligible_entries"))
    return S.split_sizes(rows, "eligible_entries", (0.8, 0.1, 0.1))


@query("top_terms", f"""
WITH {V.LAB}, {V.CNT}
SELECT aspect, term, n FROM cnt QUALIFY row_number() OVER (PARTITION BY aspect ORDER BY n DESC, term) <= 100""")
def top_terms(spark, sf):
    return L.top_terms(_counts(spark, sf), 100)


@query("term_aspect", f"""
WITH {V.LAB} SELECT c.c_custkey, c.c_mktsegment, coalesce(d.aspect, 'Unknown') AS aspect
FROM customer c LEFT JOIN (SELECT DISTINCT term, aspect FROM lab) d ON d.term = 'Brand#' || CAST(c_custkey % 40 AS VARCHAR) || '-' || CAST(c_nationkey AS VARCHAR)""")
def term_aspect(spark, sf):
    rows = table(spark, sf, "customer").withColumn(
        "term", F.concat(F.lit("Brand#"), (F.col("c_custkey") % 40).cast("string"), F.lit("-"), F.col("c_nationkey").cast("string")))
    return L.with_aspect(rows, L.term_dimension(V.labels(spark, sf))).select("c_custkey", "c_mktsegment", "aspect")


_TOTALS = f"""{V.LAB}, {V.CNT}, voc AS (SELECT aspect, term FROM cnt WHERE n >= 20),
tot AS (SELECT aspect, term, count(DISTINCT entry_id) AS c FROM lab GROUP BY 1, 2), nn AS (SELECT count(*) AS n FROM orders)"""


@query("pos_weight", f"""
WITH {_TOTALS} SELECT aspect, term, round(least(pow(greatest((n - c) / CAST(c AS DOUBLE), 1.0), 0.5), 15.0), 6) AS pos_weight
FROM voc JOIN tot USING (aspect, term), nn""")
def pos_weight(spark, sf):
    lab = V.labels(spark, sf)
    return rounded(L.positive_weights(lab, L.vocabulary(L.term_counts(lab), 20), V.entries(spark, sf), 0.5, 15.0))


@query("clipped_weight", f"""
WITH {_TOTALS} SELECT aspect, term, round(least(greatest((n - c) / (c + 1e-6), 1.0), 100.0), 6) AS pos_weight FROM voc JOIN tot USING (aspect, term), nn""")
def clipped_weight(spark, sf):
    lab = V.labels(spark, sf)
    return rounded(L.clipped_weights(lab, L.vocabulary(L.term_counts(lab), 20), V.entries(spark, sf)))


@query("label_prior", f"""
WITH {_TOTALS} SELECT aspect, term, round(least(greatest(c / CAST(n AS DOUBLE), 1e-6), 1 - 1e-6), 6) AS prior FROM voc JOIN tot USING (aspect, term), nn""")
def label_prior(spark, sf):
    lab = V.labels(spark, sf)
    return rounded(L.label_priors(lab, L.vocabulary(L.term_counts(lab), 20), V.entries(spark, sf)))


@query("weight_summary", f"""
WITH {_TOTALS}, w AS (SELECT aspect, greatest((n - c) / CAST(c AS DOUBLE), 1.0) AS w FROM voc JOIN tot USING (aspect, term), nn)
SELECT aspect, count(*) AS label_count, count(*) FILTER (WHERE w > 1.0) AS weighted_label_count, round(min(w), 6) AS min,
  round(max(w), 6) AS max, round(avg(w), 6) AS mean FROM w GROUP BY aspect""")
def weight_summary(spark, sf):
    lab = V.labels(spark, sf)
    w = L.positive_weights(lab, L.vocabulary(L.term_counts(lab), 20), V.entries(spark, sf))
    return rounded(L.value_summary(w, ["aspect"], "pos_weight"))


_STATS = """count({0}) AS {1}count, min({0})::DOUBLE AS {1}min, round(quantile_cont({0}, 0.5)::DOUBLE, 6) AS {1}p50,
  round(quantile_cont({0}, 0.9)::DOUBLE, 6) AS {1}p90, round(quantile_cont({0}, 0.95)::DOUBLE, 6) AS {1}p95,
  round(quantile_cont({0}, 0.99)::DOUBLE, 6) AS {1}p99, max({0})::DOUBLE AS {1}max, round(avg({0}), 6) AS {1}mean"""


@query("aspect_label_overview", f"""
WITH {V.LAB}, {V.ENT}, a AS (SELECT unnest(['BPO', 'CCO', 'MFO']) AS aspect),
c AS (SELECT aspect, entry_id, count(DISTINCT term) AS n FROM lab GROUP BY 1, 2),
f AS (SELECT a.aspect, ent.entry_id, coalesce(c.n, 0) AS n FROM ent CROSS JOIN a LEFT JOIN c ON c.aspect = a.aspect AND c.entry_id = ent.entry_id),
t AS (SELECT aspect, count(DISTINCT term) AS unique_terms_raw FROM lab GROUP BY 1)
SELECT f.aspect, count(*) FILTER (WHERE n > 0) AS entries_with_any_label, count(*) FILTER (WHERE n = 0) AS entries_without_label,
  max(unique_terms_raw) AS unique_terms_raw, {_STATS.format('n', 'labels_per_entry_')} FROM f JOIN t ON t.aspect = f.aspect GROUP BY f.aspect""")
def aspect_label_overview(spark, sf):
    return rounded(audit.aspect_overview(V.entries(spark, sf), V.labels(spark, sf), ["BPO", "CCO", "MFO"]))


@query("audit_overview", f"""
WITH {V.ENT}, s AS (SELECT count(*)::DOUBLE AS entry_count, (count(*) FILTER (WHERE coalesce(residue_count, 0) = 0))::DOUBLE AS residue_count_zero,
  (count(*) FILTER (WHERE coalesce(fragment_count, 0) = 0))::DOUBLE AS fragment_count_zero,
  {_STATS.format('coalesce(residue_count, 0)', 'residue_count_')}, {_STATS.format('coalesce(fragment_count, 0)', 'fragment_count_')} FROM ent)
SELECT metric, value FROM (SELECT COLUMNS(*)::DOUBLE FROM s) UNPIVOT (value FOR metric IN (COLUMNS(*)))""")
def audit_overview(spark, sf):
    return rounded(audit.overview(V.entries(spark, sf)))


@query("sketched_quantiles", """SELECT o_orderpriority, q, TRUE AS within_bound, count(*) AS n FROM orders, (SELECT unnest([0.1, 0.5, 0.9, 0.99]::DOUBLE[]) AS q) GROUP BY 1, 2""")
def sketched_quantiles(spark, sf):
    """Sketches of eight parts of the table, stored and merged on read: is the exact rank of each answer within the bound?"""
    orders = table(spark, sf, "orders").select("o_orderpriority", F.col("o_totalprice").cast("double").alias("v"), F.pmod(F.xxhash64("o_orderkey"), F.lit(8)).alias("part"))
    stored = staged(ranking.value_sketches(orders, ["o_orderpriority", "part"], "v"), "sketches")
    found = ranking.sketched_quantiles(stored, ["o_orderpriority"], [0.1, 0.5, 0.9, 0.99])
    ranks = orders.join(found, "o_orderpriority").groupBy("o_orderpriority", "q").agg(
        F.count_if(F.col("v") < F.col("quantile")).alias("below"), F.count_if(F.col("v") <= F.col("quantile")).alias("upto"), F.count("*").alias("n"))
    q, bound = F.col("q") * F.col("n"), F.lit(ranking.SKETCH_BOUND) * F.col("n") + 1
    return ranks.select("o_orderpriority", "q", ((F.col("below") - bound <= q) & (q <= F.col("upto") + bound)).alias("within_bound"), "n")


@query("numeric_summary", f"SELECT o_orderpriority, {_STATS.format('o_totalprice', '')} FROM orders GROUP BY o_orderpriority")
def numeric_summary(spark, sf):
    return rounded(ranking.numeric_summary(table(spark, sf, "orders"), ["o_orderpriority"], "o_totalprice"))


@query("exact_quantile_overall", """
SELECT q, round(CASE q WHEN 0.1 THEN quantile_cont(l_extendedprice, 0.1) WHEN 0.5 THEN quantile_cont(l_extendedprice, 0.5)
  ELSE quantile_cont(l_extendedprice, 0.9) END, 6) AS quantile FROM lineitem, (SELECT unnest([0.1, 0.5, 0.9])::DOUBLE AS q) GROUP BY q""")
def exact_quantile_overall(spark, sf):
    return rounded(ranking.exact_quantiles(table(spark, sf, "lineitem"), [], "l_extendedprice", [0.1, 0.5, 0.9]))


# --- splits ----------------------------------------------------------------------------------------------------

def _sizes_sql(source: str, key: str) -> str:
    return f"""{source}, f AS (SELECT {key}, n, n * (0.7 / 1.0)::DOUBLE AS a, n * 0.15::DOUBLE AS b, n * 0.15::DOUBLE AS c FROM cn),
g AS (SELECT *, n - CAST(floor(a) + floor(b) + floor(c) AS BIGINT) AS rest,
  1 + (CASE WHEN b - floor(b) > a - floor(a) THEN 1 ELSE 0 END) + (CASE WHEN c - floor(c) > a - floor(a) THEN 1 ELSE 0 END) AS ra FROM f),
sizes AS (SELECT {key}, n, CAST(floor(a) AS BIGINT) + CASE WHEN ra <= rest THEN 1 ELSE 0 END AS tr,
  CAST(floor(b) AS BIGINT) + CASE WHEN (CASE WHEN ra = 1 THEN 2 ELSE 1 END) <= rest THEN 1 ELSE 0 END AS va FROM g)"""


_PRIORITY_SIZES = _sizes_sql("WITH cn AS (SELECT o_orderpriority, count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1)", "o_orderpriority")


@query("split_sizes", _PRIORITY_SIZES + "SELECT o_orderpriority, n, tr AS train_count, va AS val_count, n - tr - va AS test_count FROM sizes")
def split_sizes(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count_distinct("o_orderkey").alias("n"))
    return S.split_sizes(counts, "n", RATIOS)


@query("rounded_split_sizes", """
WITH c AS (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY 1, 2)
SELECT c_mktsegment, c_nationkey, n, round_even(n * 0.7::DOUBLE, 0)::BIGINT AS train_count, round_even(n * 0.15::DOUBLE, 0)::BIGINT AS val_count,
  n - round_even(n * 0.7::DOUBLE, 0)::BIGINT - round_even(n * 0.15::DOUBLE, 0)::BIGINT AS test_count FROM c""")
def rounded_split_sizes(spark, sf):
    counts = table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    return S.split_sizes(counts, "n", RATIOS, S.rounded_sizes)


_RANKED = f"""rk AS (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority
  ORDER BY md5('{SEED}:' || CAST(o_orderkey AS VARCHAR)), o_orderkey) AS r FROM (SELECT DISTINCT o_orderpriority, o_orderkey FROM orders))"""


@query("hash_split", _PRIORITY_SIZES + f", {_RANKED}" + """ SELECT o_orderpriority, o_orderkey,
  CASE WHEN r <= tr THEN 'train' WHEN r <= tr + va THEN 'val' ELSE 'test' END AS split FROM rk JOIN sizes USING (o_orderpriority)""")
def hash_split(spark, sf):
    return S.hash_split(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderkey", RATIOS, SEED)


@query("threshold_split", f"""
WITH u AS (SELECT o_orderkey, CAST('0x' || substr(md5('{SEED}:' || CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM orders)
SELECT o_orderkey, CASE WHEN u < 0.7 THEN 'train' WHEN u < 0.7::DOUBLE + 0.15::DOUBLE THEN 'val' ELSE 'test' END AS split FROM u""")
def threshold_split(spark, sf):
    return S.threshold_split(table(spark, sf, "orders").select("o_orderkey"), "o_orderkey", RATIOS, SEED)


@query("hash_sample", f"WITH {_RANKED} SELECT o_orderpriority, o_orderkey FROM rk WHERE r <= 200")
def hash_sample(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderpriority", "o_orderkey").distinct()
    return S.hash_sample(orders, ["o_orderpriority"], "o_orderkey", 200, SEED)


_LAB_IDS = f"{V.LAB}, ids AS (SELECT DISTINCT aspect, entry_id FROM lab)"
_LAB_SPLIT = f"""{_LAB_IDS}, cn AS (SELECT aspect, count(*) AS n FROM ids GROUP BY 1)"""
_LAB_SIZES = _sizes_sql("WITH " + _LAB_SPLIT, "aspect") + f""", rk AS (SELECT aspect, entry_id, row_number() OVER (PARTITION BY aspect
  ORDER BY md5('{SEED}:' || entry_id), entry_id) AS r FROM ids),
spl AS (SELECT aspect, entry_id, CASE WHEN r <= tr THEN 'train' WHEN r <= tr + va THEN 'val' ELSE 'test' END AS split FROM rk JOIN sizes USING (aspect))"""


def _label_split(spark, sf, lab):
    return S.hash_split(lab.select("aspect", "entry_id"), ["aspect"], "entry_id", RATIOS, SEED)


@query("split_overview", _LAB_SIZES + f""", {V.CNT}, v AS (SELECT aspect, count(*) AS labels FROM cnt WHERE n >= 20 GROUP BY 1)
SELECT spl.aspect, count(*) AS proteins, max(labels) AS labels, count(*) FILTER (WHERE split = 'train') AS train,
  count(*) FILTER (WHERE split = 'val') AS validation, count(*) FILTER (WHERE split = 'test') AS test FROM spl JOIN v USING (aspect) GROUP BY 1""")
def split_overview(spark, sf):
    lab = V.labels(spark, sf)
    return S.split_overview(_label_split(spark, sf, lab), L.vocabulary(L.term_counts(lab), 20))


@query("split_summary", _LAB_SIZES + f""", {V.CNT}, v AS (SELECT aspect, count(*) AS labels FROM cnt WHERE n >= 20 GROUP BY 1)
SELECT spl.aspect, count(*) AS entry_count, count(*) FILTER (WHERE split = 'train') AS train_count, count(*) FILTER (WHERE split = 'val') AS val_count,
  count(*) FILTER (WHERE split = 'test') AS test_count, max(labels) AS vocab_size, 0.7::DOUBLE AS train_ratio, 0.15::DOUBLE AS val_ratio,
  0.15::DOUBLE AS test_ratio, {SEED} AS seed FROM spl JOIN v USING (aspect) GROUP BY 1""")
def split_summary(spark, sf):
    lab = V.labels(spark, sf)
    return rounded(S.split_summary(_label_split(spark, sf, lab), L.vocabulary(L.term_counts(lab), 20), RATIOS, SEED))


@query("split_ground_truth", _LAB_SIZES + f""", {V.CNT}
SELECT DISTINCT lab.entry_id, lab.term, lab.aspect FROM lab JOIN spl ON spl.aspect = lab.aspect AND spl.entry_id = lab.entry_id AND split = 'test'
JOIN cnt ON cnt.aspect = lab.aspect AND cnt.term = lab.term AND n >= 20""")
def split_ground_truth(spark, sf):
    lab = V.labels(spark, sf)
    test = _label_split(spark, sf, lab).where(F.col("split") == "test")
    return L.split_ground_truth(test, lab, L.vocabulary(L.term_counts(lab), 20))


_CAPPED = f"""WITH {_LAB_IDS}, pick AS (SELECT * FROM (SELECT aspect, entry_id, row_number() OVER (PARTITION BY aspect
  ORDER BY md5('{SEED}:' || entry_id), entry_id) AS r FROM ids) WHERE r <= 500)"""


@query("capped_sample_split", _CAPPED + """ SELECT aspect, entry_id, CASE WHEN r <= 350 THEN 'train' WHEN r <= 425 THEN 'val' ELSE 'test' END AS split FROM pick""")
def capped_sample_split(spark, sf):
    return S.capped_split(V.labels(spark, sf), 500, RATIOS, SEED)


@query("align_counts", """
SELECT count(*) FILTER (WHERE l.doc_id IS NULL) AS left_only, count(*) FILTER (WHERE d.doc_id IS NULL) AS right_only,
  count(*) FILTER (WHERE l.doc_id IS NOT NULL AND d.doc_id IS NOT NULL) AS both
FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON l.doc_id = d.doc_id""")
def align_counts(spark, sf):
    return checks.alignment_counts(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id")


@query("missing_sequences", """
WITH g AS (SELECT CAST(doc_id AS VARCHAR) AS entry_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
SELECT count(*) AS missing, (SELECT string_agg(entry_id, ',' ORDER BY entry_id) FROM (SELECT entry_id FROM g ORDER BY entry_id LIMIT 5)) AS first_ids FROM g""")
def missing_sequences(spark, sf):
    ids = [table(spark, sf, t).select(F.col("doc_id").cast("string").alias("entry_id")) for t in ("documents", "labels")]
    return checks.missing_sequences(*ids).withColumn("first_ids", F.array_join("first_ids", ","))


@query("overlay_mask", """
SELECT d.doc_id, l.doc_id IS NOT NULL AS has_label, coalesce(quality, 0) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")
def overlay_mask(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality", F.lit(True).alias("hit"))
    return table(spark, sf, "documents").select("doc_id").join(lab, "doc_id", "left") \
        .select("doc_id", F.coalesce("hit", F.lit(False)).alias("has_label"), F.coalesce("quality", F.lit(0)).alias("quality"))


# --- report reshapes --------------------------------------------------------------------------------------------

@query("aspect_pivot", """
SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O,
  count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1""")
def aspect_pivot(spark, sf):
    counts = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    return reshape.pivot_first(counts, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"], "n").fillna(0)


@query("ordered_pivot", """
SELECT n_name, n_nationkey AS ord, count(c_custkey) FILTER (WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 0) AS building,
  count(c_custkey) FILTER (WHERE c_mktsegment = 'MACHINERY' AND c_acctbal > 0) AS machinery
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2""")
def ordered_pivot(spark, sf):
    order = table(spark, sf, "nation").select("n_name", F.col("n_nationkey").alias("ord"))
    counts = table(spark, sf, "customer").where("c_acctbal > 0").join(order, F.col("c_nationkey") == F.col("ord")) \
        .groupBy("n_name", F.lower("c_mktsegment").alias("seg")).agg(F.count("*").alias("n"))
    return reshape.ordered_pivot(counts, order, "n_name", "seg", ["building", "machinery"], "n").fillna(0, ["building", "machinery"])


@query("baseline_delta", """
WITH s AS (SELECT o_orderpriority, o_orderstatus, avg(o_totalprice) AS v FROM orders GROUP BY 1, 2)
SELECT s.o_orderpriority, s.o_orderstatus, round(s.v, 4) AS v, round(s.v - b.v, 4) AS delta FROM s JOIN s b ON b.o_orderpriority = s.o_orderpriority AND b.o_orderstatus = 'F'""")
def baseline_delta(spark, sf):
    s = table(spark, sf, "orders").groupBy("o_orderpriority", "o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    d = reshape.delta_to_baseline(s, ["o_orderpriority"], "v", F.col("o_orderstatus") == "F")
    return d.select("o_orderpriority", "o_orderstatus", F.round("v", 4).alias("v"), F.round("delta", 4).alias("delta"))


@query("stacked_reports", f"""
SELECT c_custkey AS id, c_acctbal AS value, 'customer' AS source, CASE c_mktsegment WHEN 'BUILDING' THEN 'B' WHEN 'MACHINERY' THEN 'M' ELSE c_mktsegment END AS kind FROM customer
UNION ALL SELECT s_suppkey, s_acctbal, 'supplier', NULL FROM supplier""")
def stacked_reports(spark, sf):
    a = reshape.project(table(spark, sf, "customer"), {"c_custkey": "id", "c_acctbal": "value", "c_mktsegment": "kind"}, source="customer")
    a = a.withColumn("kind", reshape.relabel(F.col("kind"), {"BUILDING": "B", "MACHINERY": "M"}))
    b = reshape.project(table(spark, sf, "supplier"), {"s_suppkey": "id", "s_acctbal": "value"}, source="supplier")
    return reshape.stack_tables(a, b)


@query("aspect_order", f"""WITH {V.LAB}, {V.CNT} SELECT aspect, CASE aspect WHEN 'BPO' THEN 1 WHEN 'CCO' THEN 2 ELSE 3 END AS position, count(*) AS terms FROM cnt GROUP BY 1, 2""")
def aspect_order(spark, sf):
    terms = _counts(spark, sf).groupBy("aspect").agg(F.count("*").alias("terms"))
    return terms.select("aspect", fn.aspect_order(F.col("aspect")).alias("position"), "terms").orderBy("position")
