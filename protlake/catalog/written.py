"""Sinks, readers and checks through their own functions: tables are written, read back and shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from protlake import schemas
from protlake.catalog import sources as CS, structures as CT, views as V
from protlake.catalog.registry import query, r6, rounded, table
from protlake.functions import scalar as fn
from protlake.operators import contacts as K, epochs as E, fragments as FR, labels as L, ranking, sequences as Q
from protlake.plans import protein_tables as PT, reports
from protlake.session import Scratch, delete_tree, scratch_path, small_files
from protlake.sources import layout, runs, sinks, structures as ST


@query("clustered_rows", "SELECT l_orderkey AS entry_id, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_custkey % 50 = 0)")
def clustered_rows(spark, sf):
    """Rows of a key set out of a table clustered by key; files without one of the keys are not opened."""
    path = scratch_path(spark, "clustered")
    layout.write_clustered(table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entry_id"), "l_linenumber", "l_quantity"), path, "entry_id", 16)
    return layout.read_clustered(spark, path, table(spark, sf, "orders").where("o_custkey % 50 = 0").select(F.col("o_orderkey").alias("entry_id")), "entry_id")


@query("observed_counts", f"""WITH {CS._INDEX} SELECT count(*) AS rows, count(*) FILTER (WHERE n > 0) AS found, count(*) FILTER (WHERE status = 'ok') AS ok,
  count(*) FILTER (WHERE status = 'partial_error') AS partial, count(*) FILTER (WHERE status = 'not_found') AS not_found, count(*) AS written FROM ix""")
def observed_counts(spark, sf):
    """The training index with its run counts from the pass that writes it; an empty index would be refused and leave nothing."""
    path, index = scratch_path(spark, "index"), PT.training_index(*CS._manifest(spark, sf))
    status = {s: F.count_if(F.col("af_status") == v) for s, v in (("ok", "ok"), ("partial", "partial_error"), ("not_found", "not_found"))}
    seen = layout.write_observed(index, path, {"rows": F.count(F.lit(1)), "found": F.count_if("af_found"), **status}, layout.non_empty)
    return spark.read.parquet(path).agg(*[F.lit(n).cast("bigint").alias(c) for c, n in seen.items()], F.count("*").alias("written"))


@query("manifest_written", f"""WITH {CS._INDEX} SELECT entry_id, model_entity_id, row_number() OVER (ORDER BY entry_id, model_entity_id) - 1 AS place FROM fm""")
def manifest_written(spark, sf):
    """The manifest as written, in entry order and then by model."""
    proteins, frags, _ = CS._manifest(spark, sf)
    path = scratch_path(spark, "manifest")
    sinks.write_manifest(frags, proteins.select("entry_id", F.col("entry_id").alias("ord")), path)
    # the files' order is the order of the rows
    back = spark.read.parquet(path).select("entry_id", "model_entity_id", F.expr("_metadata.file_path").alias("f"), F.expr("_metadata.row_index").alias("i"))
    return ranking.numbered(back, [], ["f", "i"], "place").select("entry_id", "model_entity_id", "place")


@query("failures_written", f"""WITH {CS._INDEX}, bad AS (SELECT entry_id, 1 AS k FROM fm WHERE nopdb UNION ALL SELECT entry_id, 1 FROM fm WHERE nopae UNION ALL SELECT entry_id, 1 FROM fm WHERE badpae
  UNION ALL SELECT entry_id, 1 FROM ix WHERE status = 'not_found') SELECT entry_id, count(*) AS failures, 7::BIGINT AS columns FROM bad GROUP BY 1""")
def failures_written(spark, sf):
    """The failure log as written with its declared columns, by entry."""
    path = scratch_path(spark, "failures")
    sinks.write_failures(CS._manifest(spark, sf)[2], path)
    back = spark.read.csv(path, header=True)
    return back.groupBy("entry_id").agg(F.count("*").alias("failures"), F.lit(len(back.columns)).cast("bigint").alias("columns"))


@query("table_written", "SELECT CAST(o_orderkey AS VARCHAR) AS entry_id, upper(substr(o_orderpriority, 1, 1)) || 'P' AS aspect, 'T' || CAST(o_custkey AS VARCHAR) AS term FROM orders")
def table_written(spark, sf):
    """A table under its declared schema, partitioned by aspect; another column is left out."""
    path = scratch_path(spark, "table")
    rows = table(spark, sf, "orders").select(F.col("o_orderkey").alias("entry_id"), F.concat(F.upper(F.substring("o_orderpriority", 1, 1)), F.lit("P")).alias("aspect"),
                                             F.concat(F.lit("T"), F.col("o_custkey").cast("string")).alias("term"), "o_clerk" if "o_clerk" in table(spark, sf, "orders").columns else "o_orderstatus")
    sinks.write_table(rows, path, schemas.ANNOTATION, partition_by=["aspect"])
    return spark.read.parquet(path).select("entry_id", "aspect", "term")


@query("vocabulary_written", f"WITH {V.LAB}, {V.CNT} SELECT aspect, term, row_number() OVER (PARTITION BY aspect ORDER BY term) - 1 AS term_index FROM cnt WHERE n >= 60")
def vocabulary_written(spark, sf):
    path = scratch_path(spark, "vocabulary")
    sinks.write_vocabulary(L.vocabulary(L.term_counts(V.labels(spark, sf)), 60), path)
    return spark.read.json(path).select("aspect", "term", "term_index")


def _one_file_each(spark, rows, by, name: str) -> str:
    """Text rows with one file called ``name`` in every folder by=…; gives the path."""
    path = scratch_path(spark, "runs")
    rows.repartition(*by).write.partitionBy(*by).text(path)
    at = spark._jvm.org.apache.hadoop.fs.Path
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.globStatus(at(f"{path}{'/*' * len(by)}/part-*")):  # a few hundred
        files.rename(status.getPath(), at(status.getPath().getParent(), name))
    return path


@query("run_logs", "SELECT 'run' || CAST(user_id % 40 AS VARCHAR) AS run, upper(event_type) AS aspect, count(*) AS epochs, max(event_id) AS last_epoch, round(min(value / 10), 6) AS best_loss FROM events GROUP BY 1, 2")
def run_logs(spark, sf):
    """Logs of 40 runs, a train.log below each run and aspect folder, through the reader."""
    number = F.regexp_extract("run", "([0-9]+)$", 1).cast("long") % 40
    lines = CS._log_lines(spark, sf).select(F.concat(F.lit("run"), number.cast("string")).alias("r"), F.lower("aspect").alias("a"), "value")
    logs = runs.log_metrics(runs.read_training_logs(spark, _one_file_each(spark, lines, ["r", "a"], "train.log")), ["val_loss"])
    folder = lambda c: F.regexp_replace(c, "^[^=]*=", "")  # noqa: E731  folders are named r=… and a=…
    return rounded(logs.groupBy(folder("run").alias("run"), folder("aspect").alias("aspect")).agg(
        F.count("*").alias("epochs"), F.max("epoch").alias("last_epoch"), F.min("val_loss").alias("best_loss")))


@query("run_configs", "SELECT 'run' || CAST(s_suppkey AS VARCHAR) AS run, CASE WHEN s_suppkey % 2 = 0 THEN 'label_dot' END AS model_head, s_nationkey::BIGINT AS hidden FROM supplier")
def run_configs(spark, sf):
    """One run_config.json per supplier, through the reader; the folder names the run."""
    head = F.when(F.col("s_suppkey") % 2 == 0, "label_dot")
    docs = table(spark, sf, "supplier").select(F.concat(F.lit("run"), F.col("s_suppkey").cast("string")).alias("r"),
                                               F.to_json(F.struct(head.alias("model_head"), F.col("s_nationkey").alias("hidden"))).alias("value"))
    found = runs.read_run_configs(spark, _one_file_each(spark, docs, ["r"], "run_config.json"), "model_head STRING, hidden BIGINT")
    return found.withColumn("run", F.regexp_replace("run", "^r=", ""))


@query("entries_read", """SELECT CAST(o_orderkey AS VARCHAR) AS entry_id, 'g/' || CAST(o_orderkey AS VARCHAR) AS graph_path, CAST(o_custkey % 9 AS INTEGER) AS fragment_count, upper(substr(o_orderpriority, 1, 1)) || 'P' AS aspect,
  'T' || CAST(o_custkey AS VARCHAR) AS term FROM orders""")
def entries_read(spark, sf):
    """Entries metadata through its reader, labels as rows."""
    path = scratch_path(spark, "entries")
    aspect = F.concat(F.upper(F.substring("o_orderpriority", 1, 1)), F.lit("P"))
    table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("entry_id"), F.lit("9606").alias("taxonomy_id"), F.concat(F.lit("g/"), F.col("o_orderkey").cast("string")).alias("graph_path"),
        (F.col("o_custkey") % 9).cast("int").alias("fragment_count"), F.lit(5).alias("residue_count"),
        F.create_map(aspect, F.array(F.concat(F.lit("T"), F.col("o_custkey").cast("string")))).alias("labels")).write.json(path)
    return L.explode_labels(spark.read.json(path, schema=schemas.ENTRIES_METADATA), keep=("entry_id", "graph_path", "fragment_count"))


@query("masked_pool", "WITH lo AS (SELECT label, vec_id, unnest(embedding)::DOUBLE AS v, unnest(generate_series(0, len(embedding) - 1)) AS dim FROM embeddings WHERE vec_id % 4 <> 1) SELECT label, CAST(dim AS INTEGER) AS dim, round(avg(v), 6) AS v FROM lo GROUP BY 1, 2")
def masked_pool(spark, sf):
    """Pooled vectors of the rows that a mask keeps."""
    pooled = Q.mean_pool(table(spark, sf, "embeddings"), ["label"], mask=F.col("vec_id") % 4 != 1)
    return rounded(pooled.select("label", F.posexplode("embedding").alias("dim", "v")))


@query("first_usable_entries", f"WITH {CS._INDEX} SELECT entry_id FROM ix WHERE status = 'ok' ORDER BY entry_id LIMIT 25")
def first_usable_entries(spark, sf):
    """The first usable entries; the limit is the feature."""
    return FR.usable_entries(PT.training_index(*CS._manifest(spark, sf)), 25).select("entry_id")


@query("ranked_trials", "SELECT p_partkey AS trial, p_retailprice AS score, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part")
def ranked_trials(spark, sf):
    trials = table(spark, sf, "part").select(F.col("p_partkey").alias("trial"), F.col("p_retailprice").alias("score"))
    return E.ranked_trials(trials, "score", ties=["trial"])


@query("sequence_matrix", """SELECT CAST(e.vec_id AS VARCHAR) AS entry_id, CAST(len(embedding) AS INTEGER) AS width, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total
FROM embeddings e WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = e.vec_id AND quality = 1)""")
def sequence_matrix(spark, sf):
    cohort = table(spark, sf, "labels").select(F.col("doc_id").cast("string").alias("entry_id"), F.when(F.col("quality") == 1, "ok").otherwise("not_found").alias("af_status"))
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("entry_id"), "embedding")
    total = F.aggregate("embedding", fn.d(0), lambda s, v: s + v.cast("double"))
    return reports.sequence_matrix(cohort, emb).select("entry_id", F.size("embedding").alias("width"), F.round(total, 5).alias("total"))


@query("index_lists", f"""WITH {CS._INDEX} SELECT e.entry_id, coalesce(string_agg(model_entity_id, ',' ORDER BY model_entity_id) FILTER (WHERE model_entity_id IS NOT NULL), '') AS models, count(model_entity_id) AS n
FROM (SELECT DISTINCT entry_id FROM frag) e LEFT JOIN fm ON fm.entry_id = e.entry_id GROUP BY 1""")
def index_lists(spark, sf):
    """Ordered lists of the training index; its versions must be sorted and distinct."""
    index = PT.training_index(*CS._manifest(spark, sf))
    versions = F.coalesce("af_model_versions", F.array().cast("array<bigint>"))
    fine = F.array_sort(F.array_distinct(versions)) == versions
    models = F.coalesce("af_model_entity_ids", F.array().cast("array<string>"))
    return index.select("entry_id", F.when(fine, F.array_join(models, ",")).alias("models"), F.size(models).cast("bigint").alias("n"))


FILES = 8192  # fragments whose files are written, listed by the driver and parsed at a time


def _files(spark, rows, path: str):
    """One text file per fragment, below a folder that names it."""
    rows.select("model_entity_id", "value").repartition("model_entity_id").write.partitionBy("model_entity_id").option("lineSep", "\n").text(path)
    read = ST.read_files(spark, path, nested=True)
    return read.select(F.regexp_extract("path", "/model_entity_id=([^/]+)/", 1).alias("model_entity_id"), "value")


def _from_files(spark, requests, path: str):
    """One row per fragment of ``requests``, parsed from its two files below ``path``."""
    pdb = _files(spark, requests.select("model_entity_id", F.col("pdb_text").alias("value")), f"{path}/pdb")
    pae = _files(spark, requests.select("model_entity_id", F.col("pae_text").alias("value")), f"{path}/pae").select("model_entity_id", ST.error_matrix(F.col("value")).alias("matrix"))
    parsed = ST.parse_structures(pdb).select("model_entity_id", "residues").join(pae, "model_entity_id")
    found = fn.once(parsed, contacts=K.row_contacts(10.0, 8.0)("residues.x", "residues.y", "residues.z"))
    total = F.aggregate("residues", fn.d(0), lambda s, r: s + r.x + r.y + r.z)
    return found.select("model_entity_id", F.size("residues").cast("bigint").alias("residues"), F.round(total, 4).alias("sum_xyz"),
                        F.round(fn.array_sum(F.flatten("matrix")), 4).alias("sum_pae"), F.size("contacts.source").cast("bigint").alias("contacts"))


@query("structure_files", CT._with("""SELECT res.model_entity_id, count(*) AS residues, round(sum(x + y + z), 4) AS sum_xyz, (SELECT round(sum(v), 4) FROM pae WHERE pae.model_entity_id = res.model_entity_id) AS sum_pae,
  (SELECT count(*) FROM edge WHERE edge.model_entity_id = res.model_entity_id) AS contacts FROM res GROUP BY 1"""))
def structure_files(spark, sf):
    """Coordinates and errors parsed from a file for each fragment; small files share a task up to a byte limit.

    The driver holds the list of all files that a read opens, so fragments are dealt into groups of about ``FILES`` by their name. A group's files are
    deleted once its rows are stored.
    """
    groups = max(1, -(-table(spark, sf, "embeddings").count() // FILES))
    texts = V.requests(spark, sf).select("model_entity_id", "pdb_text", "pae_text", F.pmod(F.xxhash64("model_entity_id"), F.lit(groups)).cast("int").alias("group"))
    rows = scratch_path(spark, "structure-rows")
    with Scratch(spark, "structure-files") as scratch, small_files(spark):
        dealt = scratch.table(texts.repartition(groups, "group"), by=["group"])
        for g in range(groups):
            files = f"{scratch.folder}/group-{g}"
            _from_files(spark, dealt.where(F.col("group") == g), files).repartition(1).write.mode("append").parquet(rows)
            delete_tree(spark, files)
    return spark.read.parquet(rows)
