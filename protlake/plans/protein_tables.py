"""Protein table, fragment manifest and training index."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from protlake import schemas
from protlake.operators import fragments as fr
from protlake.operators.labels import aspect_lists
from protlake.session import staged
from protlake.sources import structures


def protein_table(taxonomy: DataFrame, sequences: DataFrame, annotations: DataFrame, strict: bool = True) -> DataFrame:
    """Taxonomy joined with its sequence and term lists; an entry without a sequence is an error when strict."""
    joined = taxonomy.join(sequences, "entry_id", "left" if strict else "inner")
    if strict:
        message = F.concat(F.lit("no sequence for entry "), F.col("entry_id"))
        joined = joined.withColumn("sequence", F.coalesce("sequence", F.raise_error(message).cast("string")))
    lists = aspect_lists(annotations)
    out = joined.join(lists, "entry_id", "left")
    return out.select("ord", "entry_id", "taxonomy_id", "sequence", *[
        F.coalesce(F.try_element_at("labels", F.lit(a)), F.array().cast("array<string>")).alias(f"go_terms_{a.lower()}")
        for a in ("BPO", "CCO", "MFO")])


def fragment_tables(proteins: DataFrame, metadata: DataFrame, pae_files: DataFrame, pdb_files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(fragments, failures).

    ``metadata`` = (entry_id, metadata_path, rec_ord, record) for entries that have a metadata file;
    ``pae_files`` = (name, path, value) and ``pdb_files`` = (name, path) of the artifacts on disk, where ``name`` is
    the last part of the path.
    """
    records = fr.exact_accession(metadata, "record.uniprotAccession") \
        .join(proteins.select("entry_id", "taxonomy_id"), "entry_id") \
        .select("entry_id", "taxonomy_id", "metadata_path", "rec_ord", *fr.fragment_columns(),
                F.element_at(F.split("record.pdbUrl", "/"), -1).alias("pdb_name"),
                F.element_at(F.split("record.paeDocUrl", "/"), -1).alias("pae_name"))
    pae = pae_files.select(F.col("name").alias("pae_name"), F.col("path").alias("pae_path"),
                           fr.matrix_summary(structures.error_matrix(F.col("value"))).alias("pae"))
    pdb = pdb_files.select(F.col("name").alias("pdb_name"), F.col("path").alias("pdb_path"))
    joined = records.join(pdb, "pdb_name", "left").join(pae, "pae_name", "left")
    no_pdb, no_pae = F.col("pdb_path").isNull(), F.col("pae_path").isNull()
    bad_pae = ~no_pae & F.col("pae").isNull()
    problems = F.filter(F.array(
        F.when(no_pdb, F.struct(F.lit("download_pdb").alias("stage"), F.lit("download_error").alias("status"),
                                F.lit("structure file is missing").alias("error"))),
        F.when(no_pae, F.struct(F.lit("download_pae").alias("stage"), F.lit("download_error").alias("status"),
                                F.lit("structure-error file is missing").alias("error"))),
        F.when(bad_pae, F.struct(F.lit("parse_pae").alias("stage"), F.lit("parse_error").alias("status"),
                                 F.lit("structure-error file is not a filled matrix").alias("error")))), lambda p: p.isNotNull())
    full = staged(joined.withColumn("problems", problems), "fragments")
    status = F.when(F.exists("problems", lambda p: p.status == "parse_error"), "parse_error") \
        .when(F.size("problems") > 0, "download_error").otherwise("ok")
    table = fr.conform(full.select("*", "pae.*").withColumn("fragment_status", status).withColumn(
        "download_error", fr.distinct_errors(F.transform("problems", lambda p: p.error))),
        schemas.FRAGMENT_MANIFEST + ", rec_ord INT")
    failed = full.select("entry_id", "taxonomy_id", "model_entity_id", F.explode("problems").alias("p")) \
        .select("entry_id", "taxonomy_id", "model_entity_id", "p.*")
    without = proteins.join(records.select("entry_id").distinct(), "entry_id", "left_anti").select(
        "entry_id", "taxonomy_id", F.lit(None).cast("string").alias("model_entity_id"), F.lit("metadata").alias("stage"),
        F.lit("not_found").alias("status"), F.lit("no exact metadata record").alias("error"))
    return table, fr.conform(failed.unionByName(without), schemas.FAILURE_LOG)


def training_index(proteins: DataFrame, fragments: DataFrame, failures: DataFrame) -> DataFrame:
    """One row per protein in the training-index schema."""
    rolled = fr.roll_up(fragments, "rec_ord" if "rec_ord" in fragments.columns else "model_entity_id")
    failed = failures.groupBy("entry_id").agg(
        F.count("*").alias("n_failures"), F.max(F.when(F.col("stage") == "metadata", F.col("status"))).alias("fetch"),
        fr.distinct_errors(F.transform(F.array_sort(F.collect_list(F.struct(
            F.coalesce("model_entity_id", F.lit("")).alias("m"), "stage", "error"))), lambda s: s.error)).alias("download_error"))
    joined = proteins.join(rolled, "entry_id", "left").join(failed, "entry_id", "left")
    out = joined.withColumn("sequence_length", F.length("sequence")) \
        .withColumn("af_found", F.coalesce("af_fragment_count", F.lit(0)) > 0) \
        .withColumn("af_fragment_count", F.coalesce("af_fragment_count", F.lit(0))) \
        .withColumn("af_status", fr.entry_status(F.coalesce("fetch", F.lit("ok")), F.coalesce("n_failures", F.lit(0))))
    for c in ("af_model_versions", "af_model_entity_ids", "af_pdb_paths", "af_pae_paths"):
        out = out.withColumn(c, F.coalesce(c, F.array().cast("array<bigint>" if c == "af_model_versions" else "array<string>")))
    return fr.conform(out, schemas.TRAINING_INDEX)
