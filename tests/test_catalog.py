"""A few registered queries against their SQL at the smallest scale; the whole set is compared by the driver."""

import glob
import os

import pytest

import __spark_entry__ as entry_module

SF = "/root/testdata/sf0.001"
SAMPLE = ["fmax", "fmax_all_cells", "ia_fmax", "hash_split", "eligible_by_scenario", "numeric_summary", "contact_edges", "graph_summary",
          "early_stop", "training_index", "fasta_scan", "kmer_freq", "structure_features", "incremental_append"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")


@pytest.fixture(scope="module")
def duck():
    import duckdb
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def canon(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return str(v)
    return f"{float(v):.9g}"


@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_sql(spark, duck, name):
    got = entry_module.queries()[name](spark, SF)
    want = duck.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(got.columns) == sorted(names)
    a = sorted(tuple(canon(r[c]) for c in names) for r in got.collect())
    b = sorted(tuple(canon(v) for v in r) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", ["ground_truth_file", "ontology_edges", "unresolved_entries", "precision_recall", "clustered_rows", "observed_counts", "manifest_written",
                                  "structure_files", "run_configs", "sketched_quantiles", "threshold_sweep_all_cells"])
def test_whole_table_queries_match_sql(spark, duck, name):
    test_query_matches_sql(spark, duck, name)


def test_registry_is_consistent():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def test_entry_has_rows(spark):
    assert entry_module.entry(spark).count() == 1


def test_structure_files_come_in_groups(spark, tmp_path, monkeypatch):
    """The driver never lists the files of more than one group of fragments, and each group's files go once its rows are stored."""
    import random

    import duckdb

    from protlake.catalog import written
    from protlake.sources import structures as ST

    draw = random.Random(4)
    rows = [(i, i % 3, [draw.uniform(-0.2, 0.2) for _ in range(64)]) for i in range(24)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    listed, read = [], ST.read_files

    def seen(*args, **kwargs):
        files = read(*args, **kwargs)
        listed.append(len(files.inputFiles()))
        return files

    monkeypatch.setattr(written, "FILES", 5, raising=False)
    monkeypatch.setattr(written.ST, "read_files", seen)
    left = lambda: glob.glob(f"{spark.conf.get('spark.checkpoint.dir')}/**/model_entity_id=*", recursive=True)
    before = left()
    got = entry_module.queries()["structure_files"](spark, str(tmp_path)).collect()
    assert sum(listed) == 48 and max(listed) <= 12
    assert sorted(left()) == sorted(before)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.execute(entry_module.oracle_sql()["structure_files"])
    names = [d[0] for d in want.description]
    assert sorted(tuple(canon(r[c]) for c in names) for r in got) == sorted(tuple(canon(v) for v in r) for r in want.fetchall())
