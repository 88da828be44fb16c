"""Fragment metadata, structure-error summaries and the roll-up of fragments to entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from protlake import schemas
from protlake.functions import scalar as fn
from protlake.operators.ranking import first_n


def exact_accession(records: DataFrame, accession: str = "uniprotAccession") -> DataFrame:
    """Records of the entry itself; isoform accessions differ and drop out."""
    return records.where(F.upper(F.trim(accession)) == F.upper("entry_id"))


def fragment_columns(record: str = "record") -> list[Column]:
    """Typed fragment columns of one metadata record. A missing end counts as start for the length but is stored as 1."""
    def r(name: str) -> Column:
        return F.col(f"{record}.{name}")
    return [
        F.coalesce(F.nullif(r("modelEntityId"), F.lit("")), r("entryId")).alias("model_entity_id"),
        r("uniprotAccession").alias("uniprot_accession"),
        fn.or_default(r("sequenceStart"), 1).cast("bigint").alias("sequence_start"),
        fn.or_default(r("sequenceEnd"), 1).cast("bigint").alias("sequence_end"),
        fn.fragment_length(r("sequenceStart"), r("sequenceEnd")).cast("bigint").alias("fragment_length"),
        F.coalesce(r("latestVersion"), F.lit(0)).cast("bigint").alias("latest_version"),
        r("modelCreatedDate").alias("model_created_date"),
        r("globalMetricValue").alias("global_metric_value"),
        r("fractionPlddtVeryLow").alias("fraction_plddt_very_low"),
        r("fractionPlddtLow").alias("fraction_plddt_low"),
        r("fractionPlddtConfident").alias("fraction_plddt_confident"),
        r("fractionPlddtVeryHigh").alias("fraction_plddt_very_high"),
        F.filter(F.coalesce(r("allVersions"), F.array().cast("array<bigint>")), lambda v: v.isNotNull()).alias("all_versions"),
    ]


def matrix_summary(matrix: Column) -> Column:
    """STRUCT(pae_mean, pae_median, pae_p90, pae_max) of a nested array; NULL when it has no cell."""
    def of(v: Column) -> Column:
        def with_ranks(q: Column) -> Column:
            return F.when(F.size(v) > 0, F.struct(fn.array_mean(v).alias("pae_mean"), F.get(q, F.lit(0)).alias("pae_median"),
                                                  F.get(q, F.lit(1)).alias("pae_p90"), F.array_max(v).alias("pae_max")))
        return F.get(F.transform(F.array(fn.array_quantiles(v, [0.5, 0.9])), with_ranks), F.lit(0))

    return F.get(F.transform(F.array(F.flatten(matrix)), of), F.lit(0))


def row_statistics(row: Column) -> Column:
    return F.struct(fn.array_mean(row).alias("mean"), F.array_min(row).alias("min"), fn.array_quantile(row, 0.9).alias("p90"))


def weighted_average(value: Column, weight: Column) -> Column:
    """Aggregate: weighted mean over rows with a value and a positive weight; NULL without any."""
    ok = value.isNotNull() & (weight > 0)
    return F.sum(F.when(ok, value * weight)) / F.nullif(F.sum(F.when(ok, weight.cast("double"))), fn.d(0))


def distinct_errors(ordered: Column) -> Column:
    """Distinct non-empty texts of an ordered array joined by `` | ``; NULL when none."""
    return F.nullif(F.array_join(F.array_distinct(F.filter(ordered, lambda e: e.isNotNull() & (e != ""))), " | "), F.lit(""))


WEIGHTED = {
    "global_metric_value": "af_mean_plddt",
    "fraction_plddt_very_low": "af_fraction_plddt_very_low",
    "fraction_plddt_low": "af_fraction_plddt_low",
    "fraction_plddt_confident": "af_fraction_plddt_confident",
    "fraction_plddt_very_high": "af_fraction_plddt_very_high",
    "pae_mean": "af_pae_mean", "pae_median": "af_pae_median", "pae_p90": "af_pae_p90",
}


def roll_up(fragments: DataFrame, ord_col: str = "model_entity_id") -> DataFrame:
    """One row per entry. Lists follow ``ord_col``; they are cells of the result and as long as the entry has fragments."""
    def ordered(c: str) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.struct(F.col(ord_col).alias("o"), F.col(c).alias("v")))), lambda s: s.v)

    def present(c: str) -> Column:
        return F.filter(ordered(c), lambda v: v.isNotNull() & (v != ""))

    return fragments.groupBy("entry_id").agg(
        F.count("*").alias("af_fragment_count"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("all_versions")))).alias("af_model_versions"),
        ordered("model_entity_id").alias("af_model_entity_ids"),
        present("pdb_path").alias("af_pdb_paths"), present("pae_path").alias("af_pae_paths"),
        F.max("metadata_path").alias("af_metadata_path"),
        *[weighted_average(F.col(c), F.col("fragment_length")).alias(n) for c, n in WEIGHTED.items()],
        F.max("pae_max").alias("af_pae_max"))


def entry_status(fetch_status: Column, failure_count: Column) -> Column:
    return F.when(fetch_status != "ok", fetch_status).when(failure_count > 0, "partial_error").otherwise("ok")


def run_counts(index: DataFrame, failures: DataFrame) -> DataFrame:
    """Entries, found, status counts and failures of a run in one row."""
    return index.agg(
        F.count("*").alias("entries"), F.count_if("af_found").alias("found"),
        F.count_if(F.col("af_status") == "ok").alias("ok"),
        F.count_if(F.col("af_status") == "partial_error").alias("partial"),
        F.count_if(F.col("af_status") == "not_found").alias("not_found")) \
        .withColumn("failures", failures.agg(F.count("*")).scalar())


def usable_entries(index: DataFrame, first: int | None = None, order: list[Column] = ()) -> DataFrame:
    """Entries that have structures and a sequence; with ``first`` only so many of them, in ``order`` (by default of their ids)."""
    usable = index.where((F.col("af_status") == "ok") & (F.trim("entry_id") != "") & (F.length("sequence") > 0))
    return first_n(usable, list(order) or [F.col("entry_id")], first)


def usable_fragments(fragments: DataFrame) -> DataFrame:
    return fragments.where((F.col("fragment_status") == "ok") & (F.coalesce("pdb_path", F.lit("")) != ""))


def requested_fragments(index: DataFrame, fragments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(found, missing): model ids listed by usable entries, with and without a fragment row (last row wins)."""
    wanted = usable_entries(index).select("entry_id", "taxonomy_id", "sequence",
                                          F.posexplode("af_model_entity_ids").alias("model_ord", "model_entity_id"))
    payload = [c for c in fragments.columns if c not in ("entry_id", "model_entity_id", "taxonomy_id", "ord")]
    order = F.col("ord") if "ord" in fragments.columns else F.coalesce("pdb_path", F.lit(""))
    latest = fragments.where((F.col("entry_id") != "") & (F.col("model_entity_id") != "")) \
        .groupBy("entry_id", "model_entity_id").agg(F.max_by(F.struct(*payload), order).alias("f"))
    keys = ["entry_id", "model_entity_id"]
    return wanted.join(latest, keys).select(*wanted.columns, "f.*"), wanted.join(latest, keys, "left_anti")


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """Columns of a declared schema in order; absent ones NULL, extra ones dropped."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in schemas.struct(ddl).fields])
