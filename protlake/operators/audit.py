"""Preprocessing audit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from protlake.functions import scalar as fn
from protlake.operators import reshape
from protlake.operators.ranking import first_n, null_safe_join, numeric_summary


def overview(entries: DataFrame) -> DataFrame:
    """(metric, value): entry count, zero counts and the numeric summaries of residue and fragment counts."""
    out = entries.agg(F.count("*").alias("entry_count"),
                      F.count_if(F.coalesce("residue_count", F.lit(0)) == 0).alias("residue_count_zero"),
                      F.count_if(F.coalesce("fragment_count", F.lit(0)) == 0).alias("fragment_count_zero"))
    rows = reshape.metric_rows(out)
    for c in ("residue_count", "fragment_count"):
        filled = entries.select(F.coalesce(c, F.lit(0)).alias(c))
        stats = numeric_summary(filled, [], c)
        rows = rows.unionByName(reshape.metric_rows(stats.select(*[F.col(s).alias(f"{c}_{s}") for s in stats.columns])))
    return rows


def aspect_overview(entries: DataFrame, labels: DataFrame, aspects: list[str]) -> DataFrame:
    """Label coverage per aspect; entries without labels count as zero in the statistics."""
    per_entry = labels.groupBy("aspect", "entry_id").agg(F.count_distinct("term").alias("n_labels"))
    every = entries.select("entry_id", F.explode(F.array(*map(F.lit, aspects))).alias("aspect"))
    full = every.join(per_entry, ["aspect", "entry_id"], "left").fillna(0, ["n_labels"])
    stats = numeric_summary(full, ["aspect"], "n_labels")
    covered = full.groupBy("aspect").agg(F.count_if(F.col("n_labels") > 0).alias("entries_with_any_label"),
                                         F.count_if(F.col("n_labels") == 0).alias("entries_without_label"))
    terms = labels.groupBy("aspect").agg(F.count_distinct("term").alias("unique_terms_raw"))
    named = stats.select("aspect", *[F.col(c).alias(f"labels_per_entry_{c}") for c in stats.columns if c != "aspect"])
    return null_safe_join(covered, terms, ["aspect"], "left").join(named, "aspect").fillna(0, ["unique_terms_raw"])


def vector_audit(rows: DataFrame, vectors: list[str], id_col: str, sample: int | None = None, seed: int = 0) -> DataFrame:
    """Width and finite flag of each vector, for all rows or for a stable sample of them."""
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    picked = first_n(rows, [h, F.col(id_col)], sample)
    cols = [c for v in vectors for c in (F.size(v).alias(f"{v}_width"),
                                         F.coalesce(fn.all_finite(F.col(v)), F.lit(False)).alias(f"{v}_finite"))]
    return picked.select(id_col, *cols)


def vector_audit_summary(audit: DataFrame, vectors: list[str]) -> DataFrame:
    return audit.agg(F.count("*").alias("sampled"), *[F.count_if(~F.col(f"{v}_finite")).alias(f"nonfinite_{v}") for v in vectors])
