"""Files written from the given tables and read back, manifests, run reports and incremental runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from protlake import schemas
from protlake.catalog import views as V
from protlake.catalog.registry import query, rounded, table
from protlake.operators import checks, epochs as E, fragments as FR, labels as L, metrics as M, splits as S
from protlake.plans import protein_tables as PT, reports
from protlake.session import scratch_path
from protlake.sources import runs, sinks, structures as ST, text
from protlake.streaming import incremental as INC
from protlake.streaming.versions import Versions

# --- text files -------------------------------------------------------------------------------------------------


def _taxonomy_path(spark, sf):
    path = scratch_path(spark, "taxonomy")
    table(spark, sf, "customer").select(
        F.concat(F.lit(" C"), F.col("c_custkey").cast("string")).alias("EntryID"), F.concat(F.col("c_nationkey").cast("string"), F.lit(" ")).alias("taxonomyID")) \
        .write.csv(path, sep="\t", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return path


@query("taxonomy_scan", "SELECT 'C' || CAST(c_custkey AS VARCHAR) AS entry_id, CAST(c_nationkey AS VARCHAR) AS taxonomy_id FROM customer WHERE c_nationkey IN (3, 7, 11)")
def taxonomy_scan(spark, sf):
    return text.read_taxonomy(spark, _taxonomy_path(spark, sf), ["3", "7", "11"]).drop("ord")


@query("taxonomy_first", "SELECT 'C' || CAST(c_custkey AS VARCHAR) AS entry_id, CAST(c_nationkey AS VARCHAR) AS taxonomy_id FROM customer WHERE c_nationkey IN (3, 7, 11) ORDER BY c_custkey LIMIT 20")
def taxonomy_first(spark, sf):
    """First rows in file order after the filter; the table is written in key order."""
    path = scratch_path(spark, "taxonomy")
    table(spark, sf, "customer").orderBy("c_custkey").select(
        F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("EntryID"), F.col("c_nationkey").cast("string").alias("taxonomyID")) \
        .write.csv(path, sep="\t", header=True)
    return text.read_taxonomy(spark, path, ["3", "7", "11"], 20).drop("ord")


def _annotation_path(spark, sf):
    path = scratch_path(spark, "annotations")
    V.labels(spark, sf).select(F.col("entry_id").alias("EntryID"), "term", "aspect").write.csv(path, sep="\t", header=True)
    return path


@query("annotation_scan", f"WITH {V.LAB} SELECT entry_id, term, aspect FROM lab WHERE entry_id IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders WHERE o_orderstatus = 'F')")
def annotation_scan(spark, sf):
    ids = table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").cast("string").alias("entry_id"))
    return text.drop_incomplete(text.read_annotations(spark, _annotation_path(spark, sf), ids)).select("entry_id", "term", "aspect")


def _fasta_path(spark, sf):
    """Letters of each document wrapped at 60; a second record of every fifth id wins over the first."""
    path = scratch_path(spark, "fasta")
    docs = table(spark, sf, "documents").select("doc_id", F.upper(F.regexp_replace("text", "[^A-Za-z]", "")).alias("s"))

    def record(body):
        return F.concat(F.lit(">D"), F.col("doc_id").cast("string"), F.lit(" first > part\n"), F.regexp_replace(body, "(.{60})", "$1\n"))

    # every seventh document has one more record under a blank header
    unnamed = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit(">\n"), F.col("s")))
    both = docs.select("doc_id", F.posexplode(F.array(record(F.col("s")), unnamed, F.when(F.col("doc_id") % 5 == 0, record(F.concat(F.lit("X"), F.col("s")))))).alias("k", "value"))
    both.where("value IS NOT NULL").orderBy("k", "doc_id").select("value").write.text(path)
    return path


@query("fasta_scan", """SELECT 'D' || CAST(doc_id AS VARCHAR) AS entry_id, CASE WHEN doc_id % 5 = 0 THEN 'X' ELSE '' END || upper(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS sequence FROM documents""")
def fasta_scan(spark, sf):
    return text.read_fasta(spark, _fasta_path(spark, sf))


@query("fasta_quality", """SELECT count(*) + count(*) FILTER (WHERE doc_id % 5 = 0) + count(*) FILTER (WHERE doc_id % 7 = 0) AS records, count(*) FILTER (WHERE doc_id % 5 = 0) AS duplicate_ids, count(*) FILTER (WHERE doc_id % 7 = 0) AS missing_ids,
  count(*) FILTER (WHERE length(regexp_replace(text, '[^A-Za-z]', '', 'g')) = 0) AS empty_sequences FROM documents""")
def fasta_quality(spark, sf):
    return text.fasta_quality(text.read_fasta_records(spark, _fasta_path(spark, sf)))


def _obo_path(spark, sf):
    """A part is a term; its parents are two other parts; every thirteenth is obsolete."""
    path = scratch_path(spark, "obo")
    k = F.col("p_partkey").cast("long")

    def term(n):
        return F.concat(F.lit("GO:"), F.lpad(n.cast("string"), 7, "0"))

    stanza = F.concat(F.lit("[Term]\nid: "), term(k), F.lit("\nname: "), F.col("p_name"), F.lit("\nis_a: "), term(F.floor(k / 2)), F.lit(" ! up\nis_a: "), term(F.floor(k / 3)),
                      F.when(k % 13 == 0, "\nis_obsolete: true").otherwise(""), F.lit("\n\nis_a: GO:9999999 after the blank line\n\n[Typedef]\nid: part_of\nis_a: GO:0000001\n"))
    table(spark, sf, "part").select(stanza.alias("value")).write.text(path)
    return path


_OBO = """ob AS (SELECT DISTINCT 'GO:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS child, 'GO:' || lpad(CAST(unnest([p_partkey // 2, p_partkey // 3]) AS VARCHAR), 7, '0') AS parent
  FROM part WHERE p_partkey % 13 <> 0)"""


@query("obo_scan", f"WITH {_OBO} SELECT child, parent FROM ob")
def obo_scan(spark, sf):
    return text.read_obo_edges(spark, _obo_path(spark, sf))


_EDGES = f"""WITH {_OBO}, v AS (SELECT 'GO:' || lpad(CAST(p_partkey AS VARCHAR), 7, '0') AS term, row_number() OVER (ORDER BY p_partkey) - 1 AS k FROM part)
SELECT DISTINCT CAST(a.k AS INTEGER) AS child_index, CAST(b.k AS INTEGER) AS parent_index FROM ob JOIN v a ON a.term = child JOIN v b ON b.term = parent WHERE child <> parent"""


@query("ontology_edges", _EDGES)
@query("ontology_edges_all", _EDGES)
def ontology_edges(spark, sf):
    """Edges between the indices of all parts; two names from the time when one of them had a part of the vocabulary."""
    counts = table(spark, sf, "part").select(
        F.lit("BPO").alias("aspect"), F.concat(F.lit("GO:"), F.lpad(F.col("p_partkey").cast("string"), 7, "0")).alias("term"), F.lit(1).alias("n"))
    return text.vocabulary_edges(text.read_obo_edges(spark, _obo_path(spark, sf)), L.vocabulary(counts))


@query("weights_scan", "SELECT 'T' || CAST(p_partkey AS VARCHAR) AS term, p_retailprice / 100.0 + 1 AS ia FROM part")
def weights_scan(spark, sf):
    path = scratch_path(spark, "weights")
    price = F.col("p_retailprice") / 100.0
    table(spark, sf, "part").select(F.posexplode(F.array(price, price + 1)).alias("k", "w"), "p_partkey").orderBy("k", "p_partkey") \
        .select(F.concat(F.lit("T"), F.col("p_partkey").cast("string"), F.lit(" \t "), F.col("w").cast("string"))).write.text(path)
    return rounded(text.read_weights(spark, path))


@query("vocabulary_json", """SELECT CAST(p_size AS VARCHAR) AS vocabulary, p_brand AS term, CAST(row_number() OVER (PARTITION BY p_size ORDER BY p_brand) - 1 AS INTEGER) AS term_index FROM (SELECT DISTINCT p_size, p_brand FROM part)""")
def vocabulary_json(spark, sf):
    """One vocabulary per part size in one of the three shapes."""
    terms = table(spark, sf, "part").groupBy("p_size").agg(F.array_sort(F.collect_set("p_brand")).alias("t"))
    k = F.col("p_size") % 3
    doc = F.when(k == 0, F.to_json(F.struct(F.col("t").alias("terms")))).when(k == 1, F.to_json("t")) \
        .otherwise(F.to_json(F.map_from_arrays("t", F.transform("t", lambda _: F.lit(2)))))
    return terms.select(F.col("p_size").cast("string").alias("vocabulary"), F.posexplode(runs.vocabulary_terms(doc)).alias("term_index", "term"))


@query("entries_metadata", f"WITH {V.LAB} SELECT entry_id, aspect, term FROM lab")
def entries_metadata(spark, sf):
    path = scratch_path(spark, "entries")
    maps = V.labels(spark, sf).withColumn("ord", F.col("term"))
    L.aspect_lists(maps).write.json(path)
    entries = spark.read.json(path, schema="entry_id STRING, labels MAP<STRING, ARRAY<STRING>>")
    return L.explode_labels(entries).select("entry_id", "aspect", "term")


@query("rows_for_ids", "SELECT l_orderkey AS entry_id, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def rows_for_ids(spark, sf):
    path = scratch_path(spark, "rows")
    table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entry_id"), "l_linenumber", "l_quantity").write.parquet(path)
    ids = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("entry_id")).distinct()
    return text.read_for_ids(spark, path, ids)


@query("count_equal", "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F'")
def count_equal(spark, sf):
    return text.count_equal(spark, f"{sf}/orders.parquet", "o_orderstatus", "F")


@query("split_files", """WITH r AS (SELECT o_orderpriority, o_orderkey, md5('5:' || CAST(o_orderkey AS VARCHAR)) AS h FROM (SELECT DISTINCT o_orderpriority, o_orderkey FROM orders)),
q AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY h, o_orderkey) AS k, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM r)
SELECT upper(substr(o_orderpriority, 1, 1) || 'P') AS aspect, CASE WHEN k <= round_even(n * 0.7::DOUBLE, 0)::BIGINT THEN 'train' WHEN k <= round_even(n * 0.7::DOUBLE, 0)::BIGINT + round_even(n * 0.15::DOUBLE, 0)::BIGINT THEN 'val' ELSE 'test' END AS split,
  CAST(o_orderkey AS VARCHAR) AS entry_id FROM q""")
def split_files(spark, sf):
    """Written as id lists in folders, mirrored for a second consumer and read back."""
    path, copy = scratch_path(spark, "splits"), scratch_path(spark, "mirror")
    ids = table(spark, sf, "orders").select(F.concat(F.substring("o_orderpriority", 1, 1), F.lit("P")).alias("aspect"), F.col("o_orderkey").cast("string").alias("entry_id"))
    parts = S.hash_split(ids, ["aspect"], "entry_id", (0.7, 0.15, 0.15), 5, S.rounded_sizes)
    vocab = L.vocabulary(L.term_counts(V.labels(spark, sf)), 20)
    sinks.write_splits(parts, vocab, (0.7, 0.15, 0.15), 5, path)
    sinks.mirror_splits(spark, path, copy, vocab)
    return text.read_split_ids(spark, f"{copy}/ids").drop("ord")


_TRUTH = f"WITH {V.LAB} SELECT DISTINCT entry_id AS \"EntryID\", term, aspect FROM lab"


@query("ground_truth_file", _TRUTH)
@query("ground_truth_all", _TRUTH)
def ground_truth_file(spark, sf):
    """Labels of all aspects as written and read back; two names from the time when one of them had a single aspect."""
    path = scratch_path(spark, "truth")
    sinks.write_ground_truth(V.labels(spark, sf), path)
    return spark.read.csv(path, sep="\t", header=True, schema="EntryID STRING, term STRING, aspect STRING")


@query("report_file", "SELECT n_name AS name, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def report_file(spark, sf):
    path = scratch_path(spark, "report")
    rows = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    sinks.write_report(rows.groupBy(F.col("n_name").alias("name")).agg(F.count("*").alias("customers")), path)
    return text.read_csv_report(spark, path, "name STRING, customers BIGINT")


@query("bundle_file", f"WITH {V.PAIRS} SELECT aspect, entry_id, term, round(score::DOUBLE, 6) AS score FROM pairs")
def bundle_file(spark, sf):
    path = scratch_path(spark, "bundle")
    sinks.write_bundle(V.pairs(spark, sf).select("aspect", "entry_id", "term", "score"), path)
    return rounded(runs.read_bundle(spark, path))


@query("missing_artifacts", "SELECT count(*) FILTER (WHERE p_size % 2 = 0) AS missing FROM (SELECT DISTINCT p_size FROM part)")
def missing_artifacts(spark, sf):
    """Files for odd sizes only are written; the listing shows what is not there."""
    path = scratch_path(spark, "artifacts")
    sizes = table(spark, sf, "part").select("p_size").distinct()
    sizes.where("p_size % 2 = 1").withColumn("value", F.lit("x")).write.partitionBy("p_size").text(path)
    present = text.list_files(spark, path).select(F.regexp_extract("path", r"(p_size=\d+)", 1).alias("path"))
    return checks.artifact_gaps(sizes.select(F.concat(F.lit("p_size="), F.col("p_size").cast("string")).alias("graph_path")), present, "graph_path")


# --- training logs and run reports ------------------------------------------------------------------------------

def _log_lines(spark, sf):
    """Each user is a run, each event an epoch; every tenth line lacks its metric, other lines are noise."""
    e = table(spark, sf, "events")
    good = F.concat(F.lit("epoch="), F.col("event_id").cast("string"), F.lit(" train_loss=0.5 val_loss="), (F.col("value") / 10).cast("string"),
                    F.when(F.col("event_id") % 10 == 0, "").otherwise(F.concat(F.lit(" val_fmax="), F.col("value").cast("string"))), F.lit(" test_fmax=0.25 eta=2026-01-01T00:00:00"))
    return e.select(F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run"), F.upper("event_type").alias("aspect"),
                    F.explode(F.array(good, F.lit("saving epoch=1 checkpoint"))).alias("value"))


@query("training_log", """SELECT 'run' || CAST(user_id AS VARCHAR) AS run, upper(event_type) AS aspect, event_id AS epoch, round(value / 10, 6) AS val_loss,
  CASE WHEN event_id % 10 <> 0 THEN round(value, 6) END AS val_fmax FROM events""")
def training_log(spark, sf):
    logs = runs.parse_log_lines(_log_lines(spark, sf))
    return rounded(runs.log_metrics(logs, ["val_loss", "val_fmax"]))


@query("training_log_files", """SELECT 'run' || CAST(user_id % 16 AS VARCHAR) AS run, upper(event_type) AS aspect, count(*) AS epochs, max(event_id) AS last_epoch FROM events GROUP BY 1, 2""")
def training_log_files(spark, sf):
    """Logs written below run and aspect folders; both names come back from the path."""
    path = scratch_path(spark, "logs")
    number = F.regexp_extract("run", "([0-9]+)$", 1).cast("long") % 16
    _log_lines(spark, sf).select(F.concat(F.lit("run"), number.cast("string")).alias("r"), F.lower("aspect").alias("a"), "value") \
        .write.partitionBy("r", "a").option("fileExtension", "log").text(path)
    raw = spark.read.option("recursiveFileLookup", "true").text(path).select("value", F.expr("_metadata.file_path").alias("p"))
    lines = raw.select(F.regexp_extract("p", "/r=([^/]+)/", 1).alias("run"), F.upper(F.regexp_extract("p", "/a=([^/]+)/", 1)).alias("aspect"), "value")
    return runs.parse_log_lines(lines).groupBy("run", "aspect").agg(F.count("*").alias("epochs"), F.max("epoch").alias("last_epoch"))


@query("log_value_types", """SELECT key, count(int_value) AS ints, count(double_value) AS doubles, count(string_value) AS strings FROM (
 SELECT 'epoch' AS key, event_id::BIGINT AS int_value, NULL::DOUBLE AS double_value, NULL::VARCHAR AS string_value FROM events
 UNION ALL SELECT 'train_loss', NULL, 0.5, NULL FROM events UNION ALL SELECT 'val_loss', NULL, value / 10, NULL FROM events
 UNION ALL SELECT 'val_fmax', NULL, value, NULL FROM events WHERE event_id % 10 <> 0 UNION ALL SELECT 'test_fmax', NULL, 0.25, NULL FROM events UNION ALL SELECT 'eta', NULL, NULL, 'x' FROM events) GROUP BY key""")
def log_value_types(spark, sf):
    return runs.log_values(runs.parse_log_lines(_log_lines(spark, sf))).groupBy("key").agg(
        F.count("int_value").alias("ints"), F.count("double_value").alias("doubles"), F.count("string_value").alias("strings"))


@query("results_mart", """WITH b AS (SELECT *, CASE WHEN event_id % 10 <> 0 THEN value END AS vf, max(event_id) OVER (PARTITION BY user_id, event_type) AS done FROM events)
SELECT 'run' || CAST(user_id AS VARCHAR) AS run, upper(event_type) AS aspect, event_id AS best_epoch, round(vf, 6) AS best_val_fmax, 0.25::DOUBLE AS best_test_fmax, round(value / 10, 6) AS best_val_loss,
  done AS epochs_completed, CASE WHEN user_id % 2 = 0 THEN 'label_dot' ELSE 'flat_linear' END AS model_head
FROM b QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY coalesce(vf, '-inf'::DOUBLE) DESC, event_id) = 1""")
def results_mart(spark, sf):
    logs = runs.log_metrics(runs.parse_log_lines(_log_lines(spark, sf)), reports.RUN_METRICS)
    configs = table(spark, sf, "events").where("user_id % 2 = 0").select(
        F.concat(F.lit("run"), F.col("user_id").cast("string")).alias("run"), F.lit("label_dot").alias("model_head")).distinct()
    return rounded(reports.results_mart(logs, configs).drop("best_test_loss"))


@query("run_rollup", """WITH r AS (SELECT 'run' || CAST(user_id AS VARCHAR) || '-' || CAST(event_id // 1000 AS VARCHAR) AS run, event_id, value FROM events),
h AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY value DESC, event_id) AS rb, row_number() OVER (PARTITION BY run ORDER BY event_id DESC) AS rl FROM r)
SELECT a.run, a.event_id AS best_epoch, b.event_id AS final_epoch, round(a.value, 6) AS best_val_fmax, round(b.value, 6) AS final_val_fmax
FROM h a JOIN h b ON b.run = a.run AND b.rl = 1 WHERE a.rb = 1""")
def run_rollup(spark, sf):
    """Run summaries with their history list, as a run writes them; a run covers at most a thousand epochs."""
    e = table(spark, sf, "events").withColumn("run", F.concat(
        F.lit("run"), F.col("user_id").cast("string"), F.lit("-"), F.floor(F.col("event_id") / 1000).cast("string")))
    history = F.transform(F.array_sort(F.collect_list(F.struct("event_id", "value"))),
                          lambda s: F.struct(s.event_id.alias("epoch"), F.create_map(F.lit("fmax"), s.value).alias("val")))
    docs = e.groupBy("run").agg(F.max_by("event_id", F.struct(F.col("value"), -F.col("event_id"))).alias("best_epoch"), history.alias("history")) \
        .select("run", F.to_json(F.struct("best_epoch", "history")).alias("t"))
    parsed = docs.select("run", F.from_json("t", schemas.RUN_SUMMARY).alias("s")).select("run", "s.*")
    return rounded(E.run_rollup(parsed, ["run"]).select("run", "best_epoch", "final_epoch", "best_val_fmax", "final_val_fmax"))


# --- manifests --------------------------------------------------------------------------------------------------

def _proteins(spark, sf):
    base = V.sequences(spark, sf)
    ann = base.select("entry_id", F.posexplode(F.array(F.lit("BPO"), F.lit("MFO"), F.lit("MFO"))).alias("ord", "aspect")) \
        .withColumn("term", F.concat(F.lit("GO:"), F.col("ord").cast("string"), F.substring("entry_id", 9, 1)))
    tax = base.select(F.col("entry_id").alias("ord"), "entry_id", "taxonomy_id")
    return PT.protein_table(tax, base.select("entry_id", "sequence"), ann)


def _manifest(spark, sf):
    """Metadata JSON per entry: its two fragments and an isoform; some entries have none, some files are missing or broken."""
    src = V.fragment_source(spark, sf)
    vec = F.col("vec_id")

    def url(kind):
        return F.concat(F.lit("https://files/"), F.col("model_entity_id"), F.lit(kind))

    rec = F.struct(
        F.when(vec % 2 == 0, F.col("entry_id")).otherwise(F.concat(F.lit(" "), F.lower("entry_id"))).alias("uniprotAccession"), F.col("model_entity_id").alias("modelEntityId"),
        F.when(vec % 2 == 0, 1).otherwise(11).alias("sequenceStart"), F.when(vec % 2 == 0, 21).otherwise(31).alias("sequenceEnd"), F.lit(6).alias("latestVersion"),
        F.array((vec % 3 + 3).cast("long"), F.lit(6).cast("long")).alias("allVersions"), F.when(vec % 4 != 1, F.aggregate("rs", F.lit(0.0), lambda a, r: a + r.plddt) / 21).alias("globalMetricValue"),
        url(".pdb").alias("pdbUrl"), url(".json").alias("paeDocUrl"))
    iso = F.struct(F.concat(F.col("entry_id"), F.lit("-2")).alias("uniprotAccession"), F.lit("iso").alias("modelEntityId"))
    docs = src.where("(vec_id div 2) % 9 <> 4").groupBy("entry_id").agg(F.to_json(F.array_sort(F.collect_list(F.struct("f", rec.alias("r"))))).alias("raw"), F.to_json(F.first(iso)).alias("iso"))
    value = F.concat(F.lit("["), F.array_join(F.regexp_extract_all(F.col("raw"), F.lit(r'\{"f":\d+,"r":(\{.*?\})\}'), F.lit(1)), ","), F.lit(","), F.col("iso"), F.lit("]"))
    meta = ST.parse_metadata(docs.select("entry_id", F.concat(F.lit("/meta/"), F.col("entry_id")).alias("path"), value.alias("value")), F.col("entry_id"))
    pae = src.where("vec_id % 10 <> 3").select(F.concat("model_entity_id", F.lit(".json")).alias("name"), F.concat(F.lit("/pae/"), F.col("model_entity_id")).alias("path"),
                                               F.when(vec % 10 == 6, "{bad json").otherwise(V.pae_text(V.pae_matrix(F.col("rs")), vec)).alias("value"))
    pdb = src.where("vec_id % 10 <> 5").select(F.concat("model_entity_id", F.lit(".pdb")).alias("name"), F.concat(F.lit("/pdb/"), F.col("model_entity_id")).alias("path"))
    proteins = _proteins(spark, sf)
    return proteins, *PT.fragment_tables(proteins, meta, pae, pdb)


@query("protein_table", f"""WITH {V.STRUCT_CTE}, e AS (SELECT entry_id, max(taxonomy_id) AS taxonomy_id, string_agg(aa, '' ORDER BY f, i) FILTER (WHERE f = 1 OR i > 11) AS sequence FROM res GROUP BY 1)
SELECT entry_id, taxonomy_id, sequence, 'GO:0' || entry_id[9] AS bpo, '' AS cco, 'GO:1' || entry_id[9] || ',GO:2' || entry_id[9] AS mfo FROM e""")
def protein_table(spark, sf):
    p = _proteins(spark, sf)
    return p.select("entry_id", "taxonomy_id", "sequence", *[F.array_join(f"go_terms_{a}", ",").alias(a) for a in ("bpo", "cco", "mfo")])


_FRAGS = f"""{V.STRUCT_CTE}, fm AS (SELECT r.entry_id, r.model_entity_id, r.vec_id, 21 AS len, CASE WHEN r.vec_id % 4 <> 1 THEN avg(plddt) END AS g, r.vec_id % 10 = 5 AS nopdb, r.vec_id % 10 = 3 AS nopae, r.vec_id % 10 = 6 AS badpae
  FROM res r WHERE (r.vec_id // 2) % 9 <> 4 GROUP BY 1, 2, 3),
pm AS (SELECT vec_id, avg(v) AS pm, max(v) AS px FROM pae GROUP BY 1)"""


@query("fragment_manifest", f"""WITH {_FRAGS} SELECT entry_id, model_entity_id, CAST(CASE WHEN fm.vec_id % 2 = 0 THEN 1 ELSE 11 END AS BIGINT) AS sequence_start, CAST(len AS BIGINT) AS fragment_length, round(g, 6) AS global_metric_value,
  CASE WHEN nopae OR badpae THEN NULL ELSE round(pm, 6) END AS pae_mean, CASE WHEN badpae THEN 'parse_error' WHEN nopdb OR nopae THEN 'download_error' ELSE 'ok' END AS fragment_status, NOT nopdb AS has_pdb
FROM fm JOIN pm ON pm.vec_id = fm.vec_id""")
def fragment_manifest(spark, sf):
    _, frags, _ = _manifest(spark, sf)
    return rounded(frags.select("entry_id", "model_entity_id", "sequence_start", "fragment_length", "global_metric_value", "pae_mean", "fragment_status",
                                F.col("pdb_path").isNotNull().alias("has_pdb")))


@query("manifest_failures", f"""WITH {_FRAGS} SELECT entry_id, model_entity_id, stage, status FROM (
 SELECT entry_id, model_entity_id, 'download_pdb' AS stage, 'download_error' AS status FROM fm WHERE nopdb UNION ALL SELECT entry_id, model_entity_id, 'download_pae', 'download_error' FROM fm WHERE nopae
 UNION ALL SELECT entry_id, model_entity_id, 'parse_pae', 'parse_error' FROM fm WHERE badpae UNION ALL SELECT DISTINCT entry_id, NULL, 'metadata', 'not_found' FROM frag WHERE (vec_id // 2) % 9 = 4)""")
def manifest_failures(spark, sf):
    return _manifest(spark, sf)[2].select("entry_id", "model_entity_id", "stage", "status")


_INDEX = f"""{_FRAGS}, ix AS (SELECT e.entry_id, count(fm.vec_id) AS n, round(sum(g * len) / sum(CASE WHEN g IS NOT NULL THEN len END), 6) AS plddt,
  round(sum(CASE WHEN NOT nopae AND NOT badpae THEN pm * len END) / sum(CASE WHEN NOT nopae AND NOT badpae THEN len END), 6) AS pae, max(CASE WHEN NOT nopae AND NOT badpae THEN px END) AS pae_max,
  count(*) FILTER (WHERE NOT nopdb) AS pdbs, CASE WHEN count(fm.vec_id) = 0 THEN 'not_found' WHEN bool_or(nopdb OR nopae OR badpae) THEN 'partial_error' ELSE 'ok' END AS status
  FROM (SELECT DISTINCT entry_id FROM frag) e LEFT JOIN fm ON fm.entry_id = e.entry_id LEFT JOIN pm ON pm.vec_id = fm.vec_id GROUP BY 1)"""


@query("training_index", f"""WITH {_INDEX} SELECT entry_id, n AS af_fragment_count, n > 0 AS af_found, status AS af_status, plddt AS af_mean_plddt, pae AS af_pae_mean, pae_max AS af_pae_max, CASE WHEN n = 0 THEN 0 ELSE pdbs END AS pdb_count FROM ix""")
def training_index(spark, sf):
    index = PT.training_index(*_manifest(spark, sf))
    return rounded(index.select("entry_id", "af_fragment_count", "af_found", "af_status", "af_mean_plddt", "af_pae_mean", "af_pae_max", F.size("af_pdb_paths").cast("bigint").alias("pdb_count")))


@query("run_counts", f"""WITH {_INDEX} SELECT count(*) AS entries, count(*) FILTER (WHERE n > 0) AS found, count(*) FILTER (WHERE status = 'ok') AS ok, count(*) FILTER (WHERE status = 'partial_error') AS partial,
  count(*) FILTER (WHERE status = 'not_found') AS not_found, (SELECT count(*) FILTER (WHERE nopdb) + count(*) FILTER (WHERE nopae) + count(*) FILTER (WHERE badpae) FROM fm) + count(*) FILTER (WHERE status = 'not_found') AS failures FROM ix""")
def run_counts(spark, sf):
    proteins, frags, failures = _manifest(spark, sf)
    return FR.run_counts(PT.training_index(proteins, frags, failures), failures)


@query("requested_fragments", f"""WITH {_INDEX}, ok AS (SELECT fm.* FROM fm JOIN ix ON ix.entry_id = fm.entry_id AND ix.status = 'ok')
SELECT entry_id, model_entity_id, CAST(CASE WHEN vec_id % 2 = 0 THEN 1 ELSE 11 END AS BIGINT) AS sequence_start, vec_id % 8 <> 2 AS found FROM ok""")
def requested_fragments(spark, sf):
    """Fragments asked for by usable entries; some rows are taken out of the manifest first."""
    proteins, frags, failures = _manifest(spark, sf)
    index = PT.training_index(proteins, frags, failures)
    drop = table(spark, sf, "embeddings").where("vec_id % 8 = 2").select(
        F.concat(F.lit("P"), F.lpad(F.floor(F.col("vec_id") / 2).cast("string"), 8, "0"), F.lit("-F1")).alias("model_entity_id"))
    found, missing = FR.requested_fragments(index, frags.join(drop, "model_entity_id", "left_anti"))
    start = F.when(F.col("model_entity_id").endswith("-F1"), 1).otherwise(11).cast("bigint")
    return found.select("entry_id", "model_entity_id", "sequence_start", F.lit(True).alias("found")).unionByName(
        missing.select("entry_id", "model_entity_id", start.alias("sequence_start"), F.lit(False).alias("found")))


@query("usable_fragments", f"WITH {_FRAGS} SELECT entry_id, model_entity_id FROM fm WHERE NOT nopdb AND NOT nopae AND NOT badpae")
def usable_fragments(spark, sf):
    return FR.usable_fragments(_manifest(spark, sf)[1]).select("entry_id", "model_entity_id")


@query("usable_entries", f"WITH {_INDEX} SELECT entry_id FROM ix WHERE status = 'ok'")
def usable_entries(spark, sf):
    return FR.usable_entries(PT.training_index(*_manifest(spark, sf))).select("entry_id")


# --- incremental runs -------------------------------------------------------------------------------------------

def _stream(spark, sf, name):
    """The table as a folder of eight files, read as a stream."""
    path = scratch_path(spark, f"in-{name}")
    rows = table(spark, sf, name)
    rows.repartition(8).write.parquet(path)
    return INC.new_rows(spark, path, spark.read.parquet(path).schema, max_files=2)


@query("incremental_status", "SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def incremental_status(spark, sf):
    out, check = scratch_path(spark, "status"), scratch_path(spark, "check")
    INC.running_counts(_stream(spark, sf, "events"), ["event_type"], out, check).awaitTermination()
    return Versions(spark, out).read()


@query("incremental_append", "SELECT event_id, user_id, value * 2 AS doubled FROM events WHERE event_type <> 'error'")
def incremental_append(spark, sf):
    """The same input is offered twice; the checkpoint lets the second run add nothing."""
    out, check = scratch_path(spark, "append"), scratch_path(spark, "check")
    stream = _stream(spark, sf, "events")
    for _ in range(2):
        INC.append_new(stream, out, check, lambda s: s.where("event_type <> 'error'").select("event_id", "user_id", (F.col("value") * 2).alias("doubled"))).awaitTermination()
    return spark.read.parquet(out)


@query("incremental_replay", "SELECT event_id, user_id, value * 2 AS doubled FROM events WHERE event_type <> 'error'")
def incremental_replay(spark, sf):
    """The first run's checkpoint is lost, and the second one is offered all inputs again: the keys of the written rows keep them out."""
    out = scratch_path(spark, "keyed")
    stream = _stream(spark, sf, "events")
    for _ in range(2):
        INC.append_keyed(stream, out, scratch_path(spark, "check"), ["event_id"],
                         lambda s: s.where("event_type <> 'error'").select("event_id", "user_id", (F.col("value") * 2).alias("doubled")), buckets=16).awaitTermination()
    return Versions(spark, out).read()


@query("incremental_snapshot", "SELECT CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) AS BIGINT) AS clicks, count(*) AS n FROM events")
def incremental_snapshot(spark, sf):
    """The newest version has the rows of all batches."""
    out, check = scratch_path(spark, "snapshot"), scratch_path(spark, "check")
    INC.snapshot_each_batch(_stream(spark, sf, "events"), out, check).awaitTermination()
    return Versions(spark, out).read().agg(F.count_if(F.col("event_type") == "click").alias("clicks"), F.count("*").alias("n"))


_EVENT_GRID = M.step_thresholds(0.05)


@query("incremental_fmax", f"""WITH p AS (SELECT CAST((event_id * 37 % 1000) / 1000.0 AS FLOAT) AS score, event_type = 'click' OR value > 60 AS y FROM events),
grid(k, t) AS (VALUES {', '.join(f'({k}, {v!r}::DOUBLE)' for k, v in enumerate(_EVENT_GRID))}),
sw AS (SELECT k, t, count(*) FILTER (WHERE score >= t::FLOAT AND y) AS tp, count(*) FILTER (WHERE score >= t::FLOAT AND NOT y) + CASE WHEN t <= 0 THEN (SELECT count(*) * count(DISTINCT event_type) FROM events) - count(*) ELSE 0 END AS fp, count(*) FILTER (WHERE score < t::FLOAT AND y) AS fn FROM p, grid GROUP BY 1, 2),
pr AS (SELECT *, CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END AS r FROM sw)
SELECT round(CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END, 6) AS fmax, round(t, 6) AS fmax_threshold, round(p, 6) AS fmax_precision, round(r, 6) AS fmax_recall FROM pr
ORDER BY CASE WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END DESC, k LIMIT 1""")
def incremental_fmax(spark, sf):
    out, check = scratch_path(spark, "buckets"), scratch_path(spark, "check")
    s = _stream(spark, sf, "events").select(((F.col("event_id") * 37 % 1000) / 1000.0).cast("float").alias("score"),
                                            ((F.col("event_type") == "click") | (F.col("value") > 60)).alias("y"))
    INC.running_buckets(s, _EVENT_GRID, [], out, check).awaitTermination()
    # every event is an entry with a cell for each event type
    cells = table(spark, sf, "events").agg(F.count("*") * F.count_distinct("event_type")).scalar()
    return rounded(INC.metrics_on_read(Versions(spark, out).read(), _EVENT_GRID, cells=cells))
