"""Training-results mart, late-fusion report and the aligned sequence matrix."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from protlake.operators import checks, epochs, metrics, reshape, scoring
from protlake.operators.sequences import feature_matrix
from protlake.session import Scratch, settings, shuffles_dropped, staged

RUN_METRICS = ["val_fmax", "test_fmax", "val_loss", "test_loss"]


def results_mart(epoch_metrics: DataFrame, configs: DataFrame | None = None) -> DataFrame:
    """Best epoch per (run, aspect) with the run's configuration; the head defaults to ``flat_linear``."""
    best = epochs.best_epoch(epoch_metrics.select("run", "aspect", "epoch", *RUN_METRICS), ["run", "aspect"]).select(
        "run", "aspect", F.col("epoch").alias("best_epoch"), *[F.col(m).alias(f"best_{m}") for m in RUN_METRICS], "epochs_completed")
    if configs is None:
        return best
    out = best.join(configs, "run", "left")
    return out.withColumn("model_head", F.coalesce("model_head", F.lit("flat_linear"))) if "model_head" in configs.columns else out


def fusion_report(graph: DataFrame, sequence: DataFrame, labels: DataFrame, terms: DataFrame, graph_weight: float,
                  sequence_weight: float, space: str = "probabilities", threshold: float = 0.5, step: float = 0.01, *, entries: DataFrame) -> DataFrame:
    """Metrics of the graph scores, the sequence scores and their fusion over all entry x term cells, with deltas to the graph row.

    Labels that a table doesn't score count as missed by it; a scored entry outside of ``entries`` is an error.
    One table is joined and then counted after the other, and what each of these steps writes goes before the next, so the disk holds the shuffle files
    of one step.
    """
    spark = graph.sparkSession
    # entries and labels are both dealt by entry, so the scores that met the one meet the other where they are
    by_entry = settings(spark, {"spark.sql.requireAllClusterKeysForCoPartition": "false"})
    labels = labels.select("entry_id", "term").repartition("entry_id")
    rows = []
    with shuffles_dropped(spark), by_entry, Scratch(spark, "fused") as both:
        entries = staged(entries.select("entry_id", *[c for c in entries.columns if c == "model"]), "fusion-entries")
        fused = both.table(scoring.fuse(graph, sequence, graph_weight, sequence_weight, space).select("entry_id", "term", "score"))
        for name, t in {"graph": graph, "sequence": sequence, "fused": fused}.items():
            with Scratch(spark, "fusion-pairs") as one:
                pairs = one.table(metrics.join_targets(t.select("entry_id", "term", "score"), labels, entries=entries)
                                  .select(F.lit(name).alias("model"), "entry_id", "term", "score", "y"))
                vocab = terms.select("term", F.lit(name).alias("model"))
                rows.append(scoring.evaluate(pairs, vocab, threshold, step, ["model"], entries=entries))
    return reshape.delta_to_baseline(reshape.stack_tables(*rows), ["metric_threshold"], "fmax", F.col("model").startswith("graph"), "fmax_delta")


def sequence_matrix(index: DataFrame, embeddings: DataFrame, width: int | None = None) -> DataFrame:
    """Embedding rows of the usable cohort after a width check; ragged vectors are an error."""
    rows = feature_matrix(index, embeddings)
    checks.require(checks.vector_widths(rows, "embedding", width), "uniform", True, "embedding widths differ")
    return rows
