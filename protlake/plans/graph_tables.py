"""Protein graph tables, modality overlays and the normalised copy."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from protlake.functions import scalar as fn
from protlake.operators import graphs
from protlake.session import staged


def graph_tables(residues: DataFrame, edges: DataFrame, entries: DataFrame) -> dict[str, DataFrame]:
    """nodes, edges, summary and errors. ``entries`` = (entry_id, sequence_length)."""
    numbered = staged(graphs.number_nodes(graphs.best_residues(residues)), "nodes")
    kept = staged(graphs.best_edges(graphs.surviving_edges(edges, numbered)), "kept-edges")
    nodes = graphs.node_table(numbered, kept, entries)
    return {"nodes": nodes, "edges": graphs.edge_table(kept), "summary": graphs.summary_table(nodes),
            "errors": graphs.unresolved_entries(entries, nodes)}


def overlaid(nodes: DataFrame, structure: DataFrame | None, embeddings: DataFrame | None, use_dssp: bool = True,
             use_sasa: bool = True, **widths: int) -> DataFrame:
    out = nodes
    if structure is not None:
        out = graphs.overlay_structure(out, structure, use_dssp, use_sasa)
    if embeddings is not None:
        out = graphs.overlay_embedding(out, embeddings, **widths)
    return out


def normalised(tables: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The same tables on compact numeric ranges; keys, topology and labels unchanged."""
    return {**tables,
            "nodes": tables["nodes"].withColumn("base", fn.normalised_node(F.col("base"))),
            "edges": tables["edges"].withColumn("edge_attr", fn.normalised_edge(F.col("edge_attr"))),
            "summary": tables["summary"].withColumn("graph_feat", fn.normalised_summary(F.col("graph_feat")))}
