"""Declared schemas: nothing is inferred from a first batch."""

from pyspark.sql import types as T


TAXONOMY = "entry_id STRING, taxonomy_id STRING"
ANNOTATION = "entry_id STRING, term STRING, aspect STRING"

METADATA_RECORD = (
    "STRUCT<uniprotAccession: STRING, modelEntityId: STRING, entryId: STRING, sequenceStart: INT, "
    "sequenceEnd: INT, latestVersion: INT, allVersions: ARRAY<BIGINT>, modelCreatedDate: STRING, "
    "globalMetricValue: DOUBLE, fractionPlddtVeryLow: DOUBLE, fractionPlddtLow: DOUBLE, "
    "fractionPlddtConfident: DOUBLE, fractionPlddtVeryHigh: DOUBLE, pdbUrl: STRING, paeDocUrl: STRING>"
)

FRAGMENT_MANIFEST = """
    entry_id STRING, taxonomy_id STRING, model_entity_id STRING, uniprot_accession STRING,
    sequence_start BIGINT, sequence_end BIGINT, fragment_length BIGINT, latest_version BIGINT,
    model_created_date STRING, global_metric_value DOUBLE, fraction_plddt_very_low DOUBLE,
    fraction_plddt_low DOUBLE, fraction_plddt_confident DOUBLE, fraction_plddt_very_high DOUBLE,
    pdb_path STRING, pae_path STRING, metadata_path STRING, pae_mean DOUBLE, pae_median DOUBLE,
    pae_p90 DOUBLE, pae_max DOUBLE, all_versions ARRAY<BIGINT>, fragment_status STRING,
    download_error STRING
"""

TRAINING_INDEX = """
    entry_id STRING, taxonomy_id STRING, sequence STRING, sequence_length BIGINT,
    go_terms_bpo ARRAY<STRING>, go_terms_cco ARRAY<STRING>, go_terms_mfo ARRAY<STRING>,
    af_status STRING, af_found BOOLEAN, af_fragment_count BIGINT, af_model_versions ARRAY<BIGINT>,
    af_model_entity_ids ARRAY<STRING>, af_pdb_paths ARRAY<STRING>, af_pae_paths ARRAY<STRING>,
    af_metadata_path STRING, af_mean_plddt DOUBLE, af_fraction_plddt_very_low DOUBLE,
    af_fraction_plddt_low DOUBLE, af_fraction_plddt_confident DOUBLE,
    af_fraction_plddt_very_high DOUBLE, af_pae_mean DOUBLE, af_pae_median DOUBLE,
    af_pae_p90 DOUBLE, af_pae_max DOUBLE, download_error STRING
"""

FAILURE_LOG = """
    entry_id STRING, taxonomy_id STRING, model_entity_id STRING, stage STRING, status STRING,
    http_status INT, error STRING
"""

RESIDUES = """
    entry_id STRING, taxonomy_id STRING, model_entity_id STRING, residue_index INT,
    seq_position INT, chain_id STRING, residue_number INT, insertion_code STRING,
    residue_name3 STRING, residue_name1 STRING, x DOUBLE, y DOUBLE, z DOUBLE, plddt DOUBLE,
    plddt_bin STRING, is_plddt_very_low BOOLEAN, is_plddt_low BOOLEAN, is_plddt_confident BOOLEAN,
    is_plddt_very_high BOOLEAN, pae_row_mean DOUBLE, pae_row_min DOUBLE, pae_row_p90 DOUBLE,
    contact_degree BIGINT, strict_contact_degree BIGINT, sequence_position_fraction DOUBLE,
    alignment_status STRING
"""

EDGES = """
    entry_id STRING, taxonomy_id STRING, model_entity_id STRING, source_residue_index INT,
    target_residue_index INT, source_seq_position INT, target_seq_position INT, distance_ca DOUBLE,
    seq_separation INT, pae_lr DOUBLE, pae_rl DOUBLE, pae_mean_pair DOUBLE,
    is_sequential_neighbor BOOLEAN, is_short_range_sequence BOOLEAN, is_strict_contact BOOLEAN
"""

ENTRIES_METADATA = (
    "entry_id STRING, taxonomy_id STRING, graph_path STRING, fragment_count INT, "
    "residue_count INT, labels MAP<STRING, ARRAY<STRING>>"
)

RUN_SUMMARY = (
    "best_epoch BIGINT, best_val_loss DOUBLE, checkpoint_metric STRING, best_checkpoint_metric DOUBLE, "
    "stopped_early BOOLEAN, loss_function STRING, lr_scheduler STRING, "
    "history ARRAY<STRUCT<epoch: BIGINT, train: MAP<STRING, DOUBLE>, val: MAP<STRING, DOUBLE>, "
    "test: MAP<STRING, DOUBLE>>>"
)


def struct(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl)
