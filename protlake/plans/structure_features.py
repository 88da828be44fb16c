"""Residue, edge and fragment feature tables from structure files, and the structure (surface) features."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from protlake import schemas
from protlake.functions import scalar as fn
from protlake.operators import contacts, fragments as fr
from protlake.session import arrow_batches, staged
from protlake.sources import structures

KEY = ["entry_id", "model_entity_id"]
FRAGMENTS = 64  # in an Arrow batch


def parsed_fragments(requests: DataFrame) -> DataFrame:
    """One row per fragment with residues, error matrix, alignment and ``error``.

    ``requests`` = (entry_id, taxonomy_id, model_entity_id, sequence, sequence_start, sequence_end, pdb_text, pae_text).
    Everything here stays inside the fragment's row; no shuffle.
    """
    texts = structures.parse_structures(requests, "pdb_text", matrix=structures.error_matrix(F.col("pae_text"))).drop("pdb_text", "pae_text")
    n = F.size("residues")
    error = F.coalesce("pdb_error", F.when(F.col("matrix").isNull(), "structure-error matrix is missing")
                       .when(F.size("matrix") != n, "structure-error matrix does not match the residue count")
                       .when(~fn.is_square(F.col("matrix"), n), "structure-error matrix is not square"))
    spelled = fn.once(texts, error=error, letters=structures.residue_string(F.col("residues")))
    status = structures.alignment_status(F.col("letters"), F.col("sequence"), F.col("sequence_start"), F.col("sequence_end"))
    placed = fn.once(spelled, alignment_status=status)
    offset = structures.alignment_offset(F.col("alignment_status"), F.col("letters"), F.col("sequence"), F.col("sequence_start"))
    return placed.withColumn("offset", offset).drop("letters")


def fragment_failures(parsed: DataFrame) -> DataFrame:
    bad = parsed.where(F.col("error").isNotNull()).withColumn("stage", F.lit("features")).withColumn("status", F.lit("parse_error"))
    return fr.conform(bad, schemas.FAILURE_LOG)


def with_contacts(parsed: DataFrame, radius: float, strict_radius: float) -> DataFrame:
    """Adds ``contacts`` and ``edges`` to each fragment's row (see ``contacts.row_contacts``); nothing leaves the row."""
    coordinates = [F.when(F.col("error").isNull(), F.col(f"residues.{c}")) for c in "xyz"]
    found = fn.once(parsed, contacts=contacts.row_contacts(radius, strict_radius)(*coordinates))
    return found.withColumn("edges", contacts.row_edges(F.col("contacts"), F.col("matrix")))


def residue_rows(parsed: DataFrame) -> DataFrame:
    """Residues with position, confidence flags, their matrix row and its statistics; with degrees if the contacts have been searched."""
    good = parsed.where(F.col("error").isNull())
    parts = [F.col("residues"), F.col("matrix").alias("pae_row")]
    if "contacts" in parsed.columns:
        parts += [F.col(f"contacts.{c}").cast("array<bigint>").alias(f"contact_{c}") for c in ("degree", "strict_degree")]
    flat = good.select(
        "entry_id", "taxonomy_id", "model_entity_id", "alignment_status", "offset", F.size("residues").alias("total"),
        F.explode(F.arrays_zip(*parts)).alias("__z")) \
        .select("*", "__z.residues.*", "__z.*").drop("__z", "residues").withColumnRenamed("contact_strict_degree", "strict_contact_degree")
    bins = fn.confidence_bin(F.col("plddt"))
    return fn.once(flat, s=fr.row_statistics(F.col("pae_row"))).withColumn("seq_position", F.col("residue_index") + F.col("offset")) \
        .withColumn("plddt_bin", bins) \
        .withColumns({f"is_plddt_{b}": F.col("plddt_bin") == b for b in ("very_low", "low", "confident", "very_high")}) \
        .withColumn("pae_row_mean", F.col("s.mean")).withColumn("pae_row_min", F.col("s.min")) \
        .withColumn("pae_row_p90", F.col("s.p90")) \
        .withColumn("sequence_position_fraction", F.col("residue_index") / F.col("total")).drop("s", "offset", "total")


def edge_rows(searched: DataFrame, strict_radius: float) -> DataFrame:
    """Contact pairs of each fragment with both error directions and both positions."""
    pairs = searched.where(F.col("error").isNull()).select(*KEY, "taxonomy_id", "offset", F.inline("edges"))
    out = contacts.edge_flags(pairs, strict_radius).select(
        "*", *[(F.col(end) + F.col("offset")).alias(f"{end}_seq_position") for end in ("source", "target")],
        ((F.col("pae_lr") + F.col("pae_rl")) / 2.0).alias("pae_mean_pair")).withColumnsRenamed(
        {"source": "source_residue_index", "target": "target_residue_index", "distance": "distance_ca"})
    return fr.conform(out, schemas.EDGES)


def residue_table(residues: DataFrame) -> DataFrame:
    return fr.conform(residues, schemas.RESIDUES)


def fragment_table(parsed: DataFrame, residues: DataFrame, radius: float, strict_radius: float) -> DataFrame:
    """27-column fragment summary. Degrees sum to twice the edges, so the residue table alone carries the counts."""
    n = F.count("*")
    edges, strict = F.sum("contact_degree") / 2, F.sum("strict_contact_degree") / 2
    stats = residues.groupBy("entry_id", "taxonomy_id", "model_entity_id").agg(
        n.alias("residue_count"), F.min("seq_position").alias("coverage_start"), F.max("seq_position").alias("coverage_end"),
        F.first("alignment_status").alias("alignment_status"), F.avg("plddt").alias("mean_plddt"),
        F.percentile("plddt", F.lit(0.5)).alias("median_plddt"),
        *[contacts.bin_fraction("plddt", b).alias(f"fraction_plddt_{b}") for b in ("very_low", "low", "confident", "very_high")],
        F.avg("contact_degree").alias("mean_contact_degree"), F.max("contact_degree").alias("max_contact_degree"),
        F.avg("strict_contact_degree").alias("mean_strict_contact_degree"), edges.cast("bigint").alias("contact_edge_count"),
        strict.cast("bigint").alias("strict_contact_edge_count"), contacts.contact_density(edges, n).alias("contact_density"),
        contacts.contact_density(strict, n).alias("strict_contact_density"),
        contacts.radius_of_gyration().alias("radius_of_gyration"))
    pae = parsed.where(F.col("error").isNull()).select(*KEY, fr.matrix_summary(F.col("matrix")).alias("p"))
    return stats.join(pae, KEY).select(
        "entry_id", "taxonomy_id", "model_entity_id", "residue_count", "coverage_start", "coverage_end", "alignment_status",
        "mean_plddt", "median_plddt", "fraction_plddt_very_low", "fraction_plddt_low", "fraction_plddt_confident",
        "fraction_plddt_very_high", "mean_contact_degree", "max_contact_degree", "mean_strict_contact_degree",
        "contact_edge_count", "strict_contact_edge_count", "contact_density", "strict_contact_density",
        fn.d(radius).alias("contact_threshold"), fn.d(strict_radius).alias("strict_contact_threshold"), "p.*", "radius_of_gyration")


def feature_tables(requests: DataFrame, radius: float = 10.0, strict_radius: float = 8.0) -> dict[str, DataFrame]:
    """residues, edges, fragments and failures. Files are parsed and contacts searched once, in the fragment's row, and staged."""
    with arrow_batches(requests.sparkSession, FRAGMENTS):
        parsed = staged(with_contacts(parsed_fragments(requests), radius, strict_radius), "parsed")
    residues = residue_table(residue_rows(parsed))
    return {"residues": residues, "edges": edge_rows(parsed, strict_radius), "fragments": fragment_table(parsed, residues, radius, strict_radius),
            "failures": fragment_failures(parsed)}


def structure_features(residues: DataFrame, dssp: DataFrame, areas: DataFrame) -> DataFrame:
    """(entry_id, model_entity_id, residue_index, features[10], dssp_mask, sasa_mask).

    ``dssp`` and ``areas`` are keyed (model_entity_id, chain_id, residue_number, insertion_code). Fragments with
    neither modality give no rows.
    """
    at = ["model_entity_id", "chain_id", "residue_number", "insertion_code"]
    keyed = residues.select("entry_id", "residue_index", *at).withColumn("chain_id", structures.chain_or_default(F.col("chain_id"))) \
        .withColumn("insertion_code", F.coalesce("insertion_code", F.lit("")))
    # of residues sharing one key the last in the file receives the values
    last = keyed.groupBy("entry_id", *at).agg(F.max("residue_index").alias("__last"))
    joined = keyed.join(last, ["entry_id", *at]).join(dssp, at, "left").join(areas, at, "left")
    owner = F.col("residue_index") == F.col("__last")
    has_dssp, has_area = owner & F.col("aa").isNotNull(), owner & F.col("area").isNotNull()
    zero = F.array_repeat(fn.d(0), 9)
    full = fn.structure_vector(F.col("aa"), F.col("code"), F.col("accessibility"), F.col("phi"), F.col("psi"), fn.d(0))
    vector = F.concat(F.when(has_dssp, F.slice(full, 1, 9)).otherwise(zero), F.array(F.when(has_area, F.col("area")).otherwise(fn.d(0))))
    rows = joined.select("entry_id", "model_entity_id", "residue_index", vector.cast("array<float>").alias("features"),
                         has_dssp.alias("dssp_mask"), has_area.alias("sasa_mask"))
    covered = rows.groupBy("entry_id", "model_entity_id").agg(F.max(F.col("dssp_mask") | F.col("sasa_mask")).alias("any"))
    return rows.join(covered.where("any").drop("any"), ["entry_id", "model_entity_id"], "left_semi")
