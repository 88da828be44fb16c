"""Protein graph tables from residue and edge tables of overlapping fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from protlake import constants as C
from protlake.functions import scalar as fn
from protlake.operators import contacts
from protlake.operators.ranking import best_per_group


def resolved(rows: DataFrame, column: str = "seq_position") -> DataFrame:
    """Rows with a usable integer position above zero."""
    return rows.withColumn(column, F.col(column).try_cast("int")).where(F.col(column) > 0)


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c).cast("double"), fn.d(0))


def best_residues(residues: DataFrame) -> DataFrame:
    """One residue per (entry, position): highest confidence, lowest mean error, then model id and index."""
    order = [_zero("plddt").desc(), _zero("pae_row_mean"), F.coalesce("model_entity_id", F.lit("")), F.col("residue_index")]
    return best_per_group(resolved(residues.where(F.trim("entry_id") != "")), ["entry_id", "seq_position"], order)


def number_nodes(selected: DataFrame) -> DataFrame:
    """Dense node number by position and fragment number by sorted model id, both per entry."""
    w = W.partitionBy("entry_id")
    return selected.withColumn("node", F.row_number().over(w.orderBy("seq_position")) - 1) \
        .withColumn("fragment", F.dense_rank().over(w.orderBy(F.coalesce("model_entity_id", F.lit("")))) - 1)


def surviving_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose two ends are exactly the selected residues of the edge's own fragment, with node numbers."""
    model = F.coalesce("model_entity_id", F.lit(""))
    usable = edges.withColumn("model_entity_id", model) \
        .withColumn("source_seq_position", F.col("source_seq_position").try_cast("int")) \
        .withColumn("target_seq_position", F.col("target_seq_position").try_cast("int")) \
        .where(F.col("source_seq_position") != F.col("target_seq_position"))

    def side(name: str) -> DataFrame:
        return nodes.select("entry_id", model.alias("model_entity_id"), F.col("seq_position").alias(f"{name}_seq_position"),
                            F.col("residue_index").alias(f"{name}_residue_index"), F.col("node").alias(f"{name}_node"))

    for name in ("source", "target"):
        usable = usable.join(side(name), ["entry_id", "model_entity_id", f"{name}_seq_position", f"{name}_residue_index"])
    return usable


def best_edges(edges: DataFrame) -> DataFrame:
    """One edge per unordered position pair: lowest pair error, distance, model id, then residue indexes."""
    low, high = F.least("source_seq_position", "target_seq_position"), F.greatest("source_seq_position", "target_seq_position")
    keyed = edges.withColumn("__low", low).withColumn("__high", high)
    order = [_zero("pae_mean_pair"), _zero("distance_ca"), F.col("model_entity_id"), F.col("source_residue_index"),
             F.col("target_residue_index")]
    return best_per_group(keyed, ["entry_id", "__low", "__high"], order).drop("__low", "__high")


def node_table(nodes: DataFrame, edges: DataFrame, lengths: DataFrame) -> DataFrame:
    """Numbered nodes with coordinates and the 32 base features. ``lengths`` = (entry_id, sequence_length)."""
    deg = contacts.with_degrees(nodes.drop("contact_degree", "strict_contact_degree"), edges, ["entry_id"], "node",
                                ends=("source_node", "target_node"))
    full = deg.join(lengths.select("entry_id", "sequence_length"), "entry_id", "left")
    base = fn.base_node_vector(
        F.col("residue_name1"), F.col("plddt"), F.col("is_plddt_very_low"), F.col("is_plddt_low"),
        F.col("is_plddt_confident"), F.col("is_plddt_very_high"), F.col("pae_row_mean"), F.col("pae_row_min"),
        F.col("pae_row_p90"), F.col("contact_degree"), F.col("strict_contact_degree"), F.col("seq_position"),
        F.coalesce("sequence_length", F.lit(0)), F.col("sequence_position_fraction"))
    return full.select(
        "entry_id", "node", "fragment", "model_entity_id", "seq_position", "residue_index",
        F.coalesce("residue_number", F.lit(0)).alias("residue_number"), _zero("x").alias("x"), _zero("y").alias("y"),
        _zero("z").alias("z"), _zero("plddt").alias("plddt"), _zero("pae_row_mean").alias("pae_row_mean"),
        _zero("pae_row_p90").alias("pae_row_p90"), "contact_degree", "strict_contact_degree", base.alias("base"))


def edge_table(edges: DataFrame) -> DataFrame:
    """Directed edges, two per contact, with the six edge features."""
    vec = fn.edge_vector(F.col("distance_ca"), F.col("seq_separation"), F.col("pae_mean_pair"),
                         F.col("is_sequential_neighbor"), F.col("is_short_range_sequence"), F.col("is_strict_contact"))
    flat = edges.select("entry_id", "source_node", "target_node", "model_entity_id", vec.alias("edge_attr"))
    return contacts.symmetrise(flat, ("source_node", "target_node")).select(
        "entry_id", F.col("source_node").alias("source"), F.col("target_node").alias("target"), "model_entity_id", "edge_attr")


def summary_table(nodes: DataFrame) -> DataFrame:
    """Thirteen values per protein. Each edge adds one to two degrees, so the edge count is half their sum; fragment
    numbers are dense from zero."""
    n, fragments = F.count("*"), F.max("fragment") + 1
    edge_count = F.sum("contact_degree") / 2
    vec = F.array(
        n.cast("double"), fragments.cast("double"), F.avg("plddt"), F.percentile("plddt", F.lit(0.5)),
        *[contacts.bin_fraction("plddt", b) for b in ("very_low", "low", "confident", "very_high")],
        F.avg("contact_degree"), contacts.contact_density(edge_count, n), F.avg("pae_row_mean"),
        F.percentile("pae_row_p90", F.lit(0.9)), contacts.radius_of_gyration())
    return nodes.groupBy("entry_id").agg(vec.alias("graph_feat"), n.alias("residue_count"),
                                         fragments.alias("fragment_count"))


def unresolved_entries(entries: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries for which no residue could be placed."""
    return entries.select("entry_id").join(nodes.select("entry_id").distinct(), "entry_id", "left_anti") \
        .withColumn("error", F.lit("no resolved residue positions"))


def overlay_embedding(nodes: DataFrame, embeddings: DataFrame, width: int = C.EMBEDDING_WIDTH) -> DataFrame:
    """Residue embeddings by (entry, position); the mask tells presence, nothing is padded."""
    checked = embeddings.withColumn("embedding", require_width(F.col("embedding"), width)) \
        .select("entry_id", "seq_position", "embedding")
    return nodes.join(checked, ["entry_id", "seq_position"], "left") \
        .withColumn("has_embedding", F.col("embedding").isNotNull())


def overlay_structure(nodes: DataFrame, features: DataFrame, use_dssp: bool = True, use_sasa: bool = True,
                      width: int = C.STRUCTURE_WIDTH) -> DataFrame:
    """Structure features by (fragment, residue). Values are copied when either modality is on; masks follow it."""
    if not (use_dssp or use_sasa):
        return nodes.withColumn("structure", F.lit(None).cast("array<double>")) \
            .withColumn("has_dssp", F.lit(False)).withColumn("has_sasa", F.lit(False))
    masks = {"dssp": use_dssp, "sasa": use_sasa}
    side = features.select(
        "model_entity_id", "residue_index", require_width(F.col("features"), width).alias("structure"),
        *[(F.coalesce(f"{m}_mask", F.lit(True)) if f"{m}_mask" in features.columns else F.lit(True)).alias(f"__{m}") for m in masks])
    out = nodes.join(side, ["model_entity_id", "residue_index"], "left")
    for m, on in masks.items():
        seen = F.col("structure").isNotNull() & F.coalesce(f"__{m}", F.lit(True)) if on else F.lit(False)
        out = out.withColumn(f"has_{m}", seen).drop(f"__{m}")
    return out


def require_width(vector: Column, width: int) -> Column:
    """The vector, or an error when its width differs; NULL passes."""
    text = F.concat(F.lit(f"expected vectors of width {width}, got "), F.size(vector).cast("string"))
    return F.when(vector.isNull() | (F.size(vector) == width), vector).otherwise(F.raise_error(text).cast("array<double>"))


def node_features(nodes: DataFrame, structure_width: int = C.STRUCTURE_WIDTH, embedding_width: int = C.EMBEDDING_WIDTH) -> DataFrame:
    """One dense vector per node, zero where a block is absent; made only when a consumer needs it."""
    def block(name: str, width: int) -> Column:
        return F.coalesce(F.col(name).cast("array<float>"), F.array_repeat(F.lit(0.0).cast("float"), width))
    return nodes.withColumn("x", F.concat("base", block("structure", structure_width), block("embedding", embedding_width)))


def pooled(nodes: DataFrame, summary: DataFrame, vector: str = "base") -> DataFrame:
    """Mean node vector per entry followed by the protein summary."""
    from protlake.operators.sequences import mean_pool
    mean = mean_pool(nodes, ["entry_id"], vector)
    return mean.join(summary.select("entry_id", "graph_feat"), "entry_id") \
        .select("entry_id", F.concat(F.col(vector), F.col("graph_feat").cast("array<double>")).alias("pooled"))


def ontology_penalty(pairs: DataFrame, vectors: DataFrame, weight: float) -> DataFrame:
    """Mean squared difference of child and parent vectors times the weight. ``pairs`` = (child, parent)."""
    child = vectors.select(F.col("term").alias("child"), F.col("w").alias("__c"))
    parent = vectors.select(F.col("term").alias("parent"), F.col("w").alias("__p"))
    both = pairs.join(child, "child").join(parent, "parent")
    squares = fn.array_sum(F.zip_with("__c", "__p", lambda a, b: F.pow(a.cast("double") - b, fn.d(2))))
    return both.agg(F.count("*").alias("relation_count"),
                    F.coalesce(F.sum(squares) / F.sum(F.size("__c")) * fn.d(weight), fn.d(0)).alias("penalty"))
