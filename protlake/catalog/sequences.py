"""Sequence, vector and history queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from protlake import constants as C
from protlake.catalog import views as V
from protlake.catalog.registry import query, r6, rounded, table
from protlake.functions import scalar as fn
from protlake.operators import audit, checks, epochs as E, fragments as FR, labels as L, sequences as Q
from protlake.session import scratch_path
from protlake.streaming import incremental as INC
from protlake.streaming.versions import Versions

ALPHABET = "abcdefghijklmnopqrstuvwxyz"


def _texts(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("entry_id"), F.lower("text").alias("sequence"))


_CHARS = "ch AS (SELECT CAST(doc_id AS VARCHAR) AS entry_id, string_split(lower(text), '') AS c FROM documents)"
_KMERS = f"""{_CHARS}, km AS (SELECT entry_id, len(c) - 1 AS total, unnest(list_transform(generate_series(1, len(c) - 1), lambda i: c[i] || c[i + 1])) AS kmer FROM ch WHERE len(c) >= 2),
kf AS (SELECT entry_id, kmer, count(*) AS n, max(total) AS total FROM km WHERE regexp_full_match(kmer, '[a-z][a-z]') GROUP BY 1, 2)"""


@query("kmer_freq", f"WITH {_KMERS} SELECT entry_id, kmer, n, round(n / total::DOUBLE, 6) AS freq FROM kf")
def kmer_freq(spark, sf):
    return rounded(Q.kmer_frequencies(_texts(spark, sf), 2, alphabet=ALPHABET))


@query("kmer_vectors", f"""WITH {_KMERS} SELECT entry_id, CAST((ascii(kmer[1]) - 97) * 26 + ascii(kmer[2]) - 97 AS INTEGER) AS slot, round((n / total::DOUBLE)::FLOAT::DOUBLE, 6) AS freq FROM kf""")
def kmer_vectors(spark, sf):
    """Dense vectors, shown by their non-zero slots."""
    v = Q.kmer_vectors(_texts(spark, sf), 2, alphabet=ALPHABET)
    return rounded(v.select("entry_id", F.posexplode("kmer_vector").alias("slot", "freq")).where("freq > 0"))


@query("kmer_vocabulary_coverage", f"""WITH {_KMERS}, v AS (SELECT chr(97 + CAST(floor(i / 26) AS INTEGER)) || chr(97 + CAST(i % 26 AS INTEGER)) AS kmer, i FROM (SELECT unnest(generate_series(0, 675)) AS i))
SELECT v.kmer, CAST(i AS INTEGER) AS kmer_index, count(kf.entry_id) AS entries FROM v LEFT JOIN kf ON kf.kmer = v.kmer GROUP BY 1, 2""")
def kmer_vocabulary_coverage(spark, sf):
    freq = Q.kmer_frequencies(_texts(spark, sf), 2, alphabet=ALPHABET).groupBy("kmer").agg(F.count("*").alias("entries"))
    return Q.kmer_vocabulary(spark, 2, ALPHABET).join(freq, "kmer", "left").fillna(0, ["entries"])


_PROSE = r"a-zA-Z \.,\n"


@query("alphabet_filter", rf"SELECT CAST(doc_id AS VARCHAR) AS entry_id, length(text) AS n FROM documents WHERE length(text) > 0 AND NOT regexp_matches(text, '[^{_PROSE}]')")
def alphabet_filter(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("entry_id"), F.col("text").alias("sequence"))
    return Q.standard_only(docs, alphabet=_PROSE).select("entry_id", F.length("sequence").cast("bigint").alias("n"))


@query("rejected_characters", rf"""WITH x AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '[{_PROSE}]', '', 'g'), '')) AS c FROM documents WHERE regexp_matches(text, '[^{_PROSE}]'))
SELECT CAST(doc_id AS VARCHAR) AS entry_id, count(DISTINCT c) AS kinds FROM x GROUP BY 1""")
def rejected_characters(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("entry_id"), F.col("text").alias("sequence"))
    return Q.rejected(docs, alphabet=_PROSE).select("entry_id", F.size("odd_characters").cast("bigint").alias("kinds"))


@query("length_statistics", """SELECT count(*) AS n, round(avg(length(text)), 6) AS mean_length, round(quantile_cont(length(text), 0.5)::DOUBLE, 6) AS median_length,
  min(length(text)) AS min_length, max(length(text)) AS max_length, round(stddev_pop(length(text)), 6) AS std_length FROM documents""")
def length_statistics(spark, sf):
    return rounded(Q.length_statistics(table(spark, sf, "documents"), "text"))


@query("null_counts", """WITH j AS (SELECT d.doc_id, quality, toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
SELECT count(*) FILTER (WHERE doc_id IS NULL) AS doc_id, count(*) FILTER (WHERE quality IS NULL) AS quality, count(*) FILTER (WHERE toxic IS NULL) AS toxic FROM j""")
def null_counts(spark, sf):
    return Q.null_counts(table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left"))


@query("chunk_windows", """WITH w AS (SELECT CAST(doc_id AS VARCHAR) AS entry_id, n_chars AS n, unnest(generate_series(0, greatest(n_chars - 129, 0), 872)) AS s FROM documents WHERE n_chars > 0)
SELECT entry_id, CAST(s // 872 AS INTEGER) AS "window", CAST(s AS INTEGER) AS start, CAST(least(s + 1000, n) AS INTEGER) AS "end" FROM w""")
def chunk_windows(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("entry_id"), "n_chars")
    return Q.windows(docs, 1000, 128, F.col("n_chars"))


_LONG = "lo AS (SELECT vec_id, label, i - 1 AS dim, embedding[i]::DOUBLE AS v FROM embeddings, (SELECT unnest(generate_series(1, 64)) AS i))"


@query("mean_pool", f"WITH {_LONG} SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(v), 6) AS v FROM lo GROUP BY 1, 2")
def mean_pool(spark, sf):
    return rounded(Q.mean_pool(table(spark, sf, "embeddings"), ["label"]).select("label", F.posexplode("embedding").alias("dim", "v")))


@query("merge_windows", f"""WITH w AS (SELECT label, vec_id % 3 * 6 AS start, embedding FROM embeddings),
r AS (SELECT label, start + j AS position, k, embedding[j * 8 + k + 1]::DOUBLE AS v FROM w, (SELECT unnest(generate_series(0, 7)) AS j), (SELECT unnest(generate_series(0, 7)) AS k))
SELECT CAST(label AS VARCHAR) AS entry_id, CAST(position AS BIGINT) AS position, CAST(k AS INTEGER) AS dim, round(avg(v), 6) AS v FROM r GROUP BY 1, 2, 3""")
def merge_windows(spark, sf):
    """Each vector is one window of eight rows of width eight, at one of three overlapping starts."""
    rows = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda j: F.slice("embedding", j * 8 + 1, F.lit(8)))
    chunks = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("entry_id"), (F.col("vec_id") % 3 * 6).alias("start"), rows.alias("chunk"))
    return rounded(Q.merge_windows(chunks).select("entry_id", "position", F.posexplode("embedding").alias("dim", "v")))


@query("standardise", f"""WITH {_LONG}, s AS (SELECT dim, avg(v) AS m, stddev_pop(v) AS d FROM lo WHERE vec_id % 10 < 7 GROUP BY 1)
SELECT vec_id, CAST(lo.dim AS INTEGER) AS dim, round((v - m) / CASE WHEN d = 0 THEN 1 ELSE d END, 5) AS v FROM lo JOIN s ON s.dim = lo.dim""")
def standardise(spark, sf):
    e = table(spark, sf, "embeddings")
    out = Q.standardise(e, Q.fit_scaler(e.where("vec_id % 10 < 7")))
    return out.select("vec_id", F.posexplode("embedding").alias("dim", "v")).withColumn("v", F.round("v", 5))


@query("vector_widths", "SELECT count(*) AS vectors, count(DISTINCT len(embedding)) AS widths, CAST(min(len(embedding)) AS INTEGER) AS min_width, CAST(max(len(embedding)) AS INTEGER) AS max_width, min(len(embedding)) = 64 AND count(DISTINCT len(embedding)) = 1 AS uniform FROM embeddings")
def vector_widths(spark, sf):
    return checks.vector_widths(table(spark, sf, "embeddings"), "embedding", 64)


@query("completeness", "SELECT count(DISTINCT doc_id) AS found, CAST(5000 AS BIGINT) AS expected, CASE WHEN count(DISTINCT doc_id) = 0 THEN 'missing' WHEN count(DISTINCT doc_id) < 5000 THEN 'partial' ELSE 'complete' END AS status FROM labels")
def completeness(spark, sf):
    return checks.completeness(table(spark, sf, "labels"), "doc_id", 5000)


@query("vector_audit", """WITH v AS (SELECT vec_id, len(embedding) AS w, list_bool_and(list_transform(embedding, lambda e: isfinite(e * CASE WHEN vec_id % 97 = 0 THEN 'inf'::FLOAT ELSE 1 END))) AS f FROM embeddings)
SELECT count(*) AS sampled, count(*) FILTER (WHERE NOT f) AS nonfinite_embedding FROM v""")
def vector_audit(spark, sf):
    broken = table(spark, sf, "embeddings").withColumn("embedding", F.transform("embedding", lambda e: e * F.when(
        F.col("vec_id") % 97 == 0, F.lit(float("inf"))).otherwise(F.lit(1.0))))
    return audit.vector_audit_summary(audit.vector_audit(broken, ["embedding"], "vec_id"), ["embedding"])


@query("vector_sample_audit", """SELECT CAST(vec_id AS VARCHAR) AS vec_id, CAST(len(embedding) AS INTEGER) AS embedding_width, TRUE AS embedding_finite FROM embeddings ORDER BY md5('7:' || CAST(vec_id AS VARCHAR)), vec_id LIMIT 50""")
def vector_sample_audit(spark, sf):
    rows = table(spark, sf, "embeddings").withColumn("vec_id", F.col("vec_id").cast("string"))
    return audit.vector_audit(rows, ["embedding"], "vec_id", 50, 7)


@query("feature_matrix", """SELECT CAST(e.vec_id AS VARCHAR) AS entry_id, CAST(len(embedding) AS INTEGER) AS width, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings e JOIN labels l ON l.doc_id = e.vec_id WHERE quality = 1""")
def feature_matrix(spark, sf):
    cohort = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("entry_id"), F.when(F.col("quality") == 1, "ok").otherwise("not_found").alias("af_status"))
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("entry_id"), "embedding")
    return Q.feature_matrix(cohort, emb).select("entry_id", F.size("embedding").alias("width"), r6(F.get("embedding", 0), "first"))


@query("label_vectors", f"""WITH {V.LAB}, {V.CNT}, voc AS (SELECT aspect, term, row_number() OVER (PARTITION BY aspect ORDER BY term) - 1 AS k FROM cnt WHERE n >= 60)
SELECT DISTINCT lab.aspect, entry_id, CAST(k AS INTEGER) AS slot FROM lab JOIN voc ON voc.term = lab.term AND voc.aspect = lab.aspect""")
def label_vectors(spark, sf):
    """Dense label vectors of every aspect, shown by their set slots."""
    lab = V.labels(spark, sf)
    vocab = L.vocabulary(L.term_counts(lab), 60)
    dense = L.label_vector(lab, vocab)
    return dense.select("aspect", "entry_id", F.posexplode("label_vector").alias("slot", "v")).where("v = 1").select("aspect", "entry_id", "slot")


@query("split_arrays", f"""WITH {V.LAB}, {V.CNT}, voc AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS k FROM cnt WHERE aspect = 'MFO' AND n >= 60),
on_ AS (SELECT entry_id, count(DISTINCT k) AS n_on, CAST(sum(DISTINCT k) AS BIGINT) AS slots FROM lab JOIN voc ON voc.term = lab.term WHERE aspect = 'MFO' GROUP BY 1)
SELECT CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'val' ELSE 'test' END AS split, o_orderkey AS ord, CAST(o_orderkey AS VARCHAR) AS entry_id,
  round(o_totalprice::DOUBLE, 6) AS price, (SELECT count(*) FROM voc) AS width, coalesce(n_on, 0) AS n_on, coalesce(slots, 0) AS slots FROM orders LEFT JOIN on_ ON entry_id = CAST(o_orderkey AS VARCHAR)""")
def split_arrays(spark, sf):
    """Split ids with features and label vectors, zero vectors included."""
    from protlake.operators import splits
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("entry_id"), F.col("o_totalprice").cast("double").alias("p"))
    split = F.when(F.col("o_orderkey") % 10 < 8, "train").when(F.col("o_orderkey") % 10 == 8, "val").otherwise("test")
    lab = V.labels(spark, sf).where("aspect = 'MFO'")
    vectors = L.label_vector(lab, L.vocabulary(L.term_counts(lab), 60), orders)
    out = splits.split_arrays(orders.select(split.alias("split"), F.col("o_orderkey").alias("ord"), "entry_id"),
                              orders.select("entry_id", F.array("p").alias("embedding")), vectors)
    slots = F.aggregate(F.transform("label_vector", lambda v, i: F.when(v == 1, i).otherwise(0).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
    return out.select("split", "ord", "entry_id", r6(F.get("embedding", F.lit(0)), "price"), F.size("label_vector").cast("long").alias("width"),
                      F.size(F.filter("label_vector", lambda v: v == 1)).cast("long").alias("n_on"), slots.alias("slots"))


# --- fragment roll-up on lines ----------------------------------------------------------------------------------

@query("weighted_rollup", """
SELECT l_orderkey, round(sum(l_discount * l_quantity) FILTER (WHERE l_linenumber <> 3 AND l_returnflag <> 'N') / nullif(sum(l_quantity) FILTER (WHERE l_linenumber <> 3 AND l_returnflag <> 'N'), 0), 10) AS mean_value,
  max(CASE WHEN l_linenumber = 3 THEN NULL ELSE l_discount END) AS max_value, count(*) AS fragments FROM lineitem GROUP BY 1""")
def weighted_rollup(spark, sf):
    value = F.when(F.col("l_linenumber") != 3, F.col("l_discount"))
    weight = F.when(F.col("l_returnflag") == "N", 0.0).otherwise(F.col("l_quantity"))
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(
        F.round(FR.weighted_average(value, weight), 10).alias("mean_value"), F.max(value).alias("max_value"), F.count("*").alias("fragments"))


@query("distinct_errors", """SELECT o_orderkey, string_agg(e, ' | ' ORDER BY i) AS errors FROM (SELECT o_orderkey, e, min(i) AS i FROM (
  SELECT o_orderkey, unnest([o_orderstatus, CASE WHEN o_totalprice > 200000 THEN 'large' END, o_orderstatus, '']) AS e, unnest([1, 2, 3, 4]) AS i FROM orders) WHERE e IS NOT NULL AND e <> '' GROUP BY 1, 2) GROUP BY 1""")
def distinct_errors(spark, sf):
    texts = F.array("o_orderstatus", F.when(F.col("o_totalprice") > 200000, "large"), "o_orderstatus", F.lit(""))
    return table(spark, sf, "orders").select("o_orderkey", FR.distinct_errors(texts).alias("errors")).distinct()


@query("json_props", "SELECT event_id, CAST(json_extract(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark, sf):
    return table(spark, sf, "events").select("event_id", F.from_json("props", "k INT").k.alias("k"))


# --- histories: user = run, event = epoch, value = metric -------------------------------------------------------

def _history(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("run"), F.col("event_id").alias("epoch"), "value")


@query("best_epoch", """SELECT user_id AS run, event_id AS epoch, value, epochs_completed FROM (SELECT *, max(event_id) OVER (PARTITION BY user_id) AS epochs_completed,
  row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn = 1""")
def best_epoch(spark, sf):
    return E.best_epoch(_history(spark, sf), ["run"], "value")


_FOLD = """h AS (SELECT user_id, event_id, {sign} * value AS v, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
f AS (SELECT user_id, event_id, n, v AS best, TRUE AS better, 0 AS since, event_id AS best_epoch FROM h WHERE n = 1
 UNION ALL SELECT h.user_id, h.event_id, h.n, CASE WHEN h.v > f.best + {delta} THEN h.v ELSE f.best END, h.v > f.best + {delta},
  CASE WHEN h.v > f.best + {delta} THEN 0 ELSE f.since + 1 END, CASE WHEN h.v > f.best + {delta} THEN h.event_id ELSE f.best_epoch END
 FROM f JOIN h ON h.user_id = f.user_id AND h.n = f.n + 1)"""


@query("improvements", f"WITH RECURSIVE {_FOLD.format(sign=1, delta='5.0::DOUBLE')} SELECT user_id AS run, event_id AS epoch, best AS value, n FROM f WHERE better")
def improvements(spark, sf):
    return E.improvements(_history(spark, sf), ["run"], "max", 5.0).select("run", "epoch", F.col("v").alias("value"), "n")


_STOP = """, s AS (SELECT user_id, min(n) AS stop FROM f WHERE since >= {p} GROUP BY 1), t AS (SELECT user_id, max(n) AS total FROM h GROUP BY 1)
SELECT t.user_id AS run, total AS epochs_total, coalesce(stop, total) AS epochs_run, CASE WHEN stop IS NOT NULL THEN f.event_id END AS stop_epoch, f.best_epoch,
  {sign} * f.best AS best_value, stop IS NOT NULL AS stopped_early FROM t LEFT JOIN s ON s.user_id = t.user_id JOIN f ON f.user_id = t.user_id AND f.n = coalesce(stop, total)"""


@query("early_stop", f"WITH RECURSIVE {_FOLD.format(sign=1, delta='5.0::DOUBLE')}{_STOP.format(p=10, sign=1)}")
def early_stop(spark, sf):
    return E.early_stop(_history(spark, sf), ["run"], 10, "max", 5.0)


@query("early_stop_loss", f"WITH RECURSIVE {_FOLD.format(sign=-1, delta='0.0::DOUBLE')}{_STOP.format(p=15, sign=-1)}")
def early_stop_loss(spark, sf):
    return E.early_stop(_history(spark, sf), ["run"], 15, "min")


@query("arriving_early_stop", f"WITH RECURSIVE {_FOLD.format(sign=1, delta='5.0::DOUBLE')}{_STOP.format(p=10, sign=1)}")
def arriving_early_stop(spark, sf):
    """The same over epochs that arrive in four files, one batch each; the query is stopped after two of them and started again from its checkpoint."""
    path, out, check = (scratch_path(spark, n) for n in ("epochs", "stops", "check"))
    history = _history(spark, sf).select("run", "epoch", "value")
    top = history.agg(F.max("epoch")).first()[0]
    parts = [history.where(F.floor(F.col("epoch") * 4 / F.lit(top + 1)) == i) for i in range(4)]
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        for two in (parts[:2], parts[2:]):
            for part in two:
                part.coalesce(1).write.mode("append").parquet(path)
            INC.running_stops(INC.new_rows(spark, path, history.schema, max_files=1), ["run"], 10, out, check, mode="max", min_delta=5.0).awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return Versions(spark, out).read()
