"""Registration, and each stage of the pipeline on its own input."""

from __future__ import annotations

import os

import pytest

import __spark_entry__ as entry_module
import corpus_pipeline
from tests.llm.support import near_classes, repeats
from tests.llm.test_documents import check_packing, targets

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")
NAMES = [n for n in entry_module.queries() if n.startswith("op") and "_" in n and n[2:].split("_")[0].isdigit()]


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in NAMES) == list(range(1, 14)) and "pipeline" in entry_module.queries()


@pytest.mark.parametrize("name", [n for n in NAMES if n in entry_module.oracle_sql()])
def test_query_matches_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(entry_module.oracle_sql()[name])
    names = [d[0] for d in want.description]
    got = entry_module.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(names)
    assert sorted(str(tuple(r[c] for c in names)) for r in got.collect()) == sorted(map(str, want.fetchall()))


def test_mixing_query(spark):
    got = entry_module.queries()["op9_source_mixing"](spark, SF).collect()
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes, taken = {}, {}
    for r in got:
        sizes[source[r.doc_id]], taken[source[r.doc_id]] = r.source_size, taken.get(source[r.doc_id], 0) + r.taken
        assert r.taken <= 2 * r.size
    want = targets(sizes)
    assert all(abs(taken[s] - want[s]) <= 1 for s in sizes) and len(got) == len(source)


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stage = dict(corpus_pipeline.STAGES)
    assert list(stage) == ["quality", "near_dedup", "suffix_dedup", "mix", "pack"]

    def step(name, df):
        from protlake.session import staged

        return staged(stage[name](spark, df, SF), f"test-{name}")

    def texts(df):
        return [(r.doc_id, r.text) for r in df.collect()]

    good = step("quality", docs)
    scores = {r.doc_id: r.keep for r in entry_module.queries()["op3_quality_cotraining"](spark, SF).collect()}
    assert sorted(d for d, _ in texts(good)) == sorted(d for d, keep in scores.items() if keep)
    one = step("near_dedup", good)
    assert sorted(d for d, _ in texts(one)) == sorted(set(near_classes(texts(good)).values()))
    cut = step("suffix_dedup", one)
    hit = repeats(texts(one))
    before, after = dict(texts(one)), dict(texts(cut))
    assert all(after[d] == t for d, t in before.items() if d not in hit)
    assert not repeats(texts(cut)) or len(repeats(texts(cut))) < len(hit)
    mix = step("mix", cut)
    assert {d for d, _ in texts(mix)} <= set(after)
    assert good.columns == one.columns == cut.columns == mix.columns == docs.columns
    from protlake.llm.packing import CAPACITIES
    check_packing(step("pack", mix).collect(), texts(mix), CAPACITIES)
