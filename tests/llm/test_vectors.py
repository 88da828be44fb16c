"""Both vector searches against all inner products."""

from __future__ import annotations

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from protlake.llm import multiprobe, topk

SF = "/root/testdata/sf0.01"
NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, query_id string, score string, cell string"


def rows():
    rng = np.random.default_rng(1)
    out = [(i, [float(x) for x in rng.normal(size=8)], "mine", "mine", "mine") for i in range(150)]
    out += [(200 + i, out[7][1], "mine", "mine", "mine") for i in range(30)]  # ties
    out += [out[3], (None, out[1][1], None, None, None), (300, None, None, None, None), (301, [], None, None, None), (302, [0.0] * 8, None, None, None),
            (303, [None] + [1.0] * 7, None, None, None), (304, [NAN] + [1.0] * 7, None, None, None), (305, [INF] + [1.0] * 7, None, None, None), (320, [1.0] * 3, None, None, None)]
    return out


def usable(row, zero):
    return row[0] is not None and row[1] and all(x is not None and math.isfinite(x) for x in row[1]) and (zero or any(row[1]))


def brute(table, quantise, zero, k=20):
    vectors = {r[0]: np.array(r[1], np.float32).astype(float) for r in table if usable(r, zero)}
    if quantise:
        vectors = {i: np.floor(64 * v).astype(np.int64) for i, v in vectors.items()}
    out = []
    for q in (i for i in vectors if i % 20 == 0):
        found = sorted((-(vectors[q] @ v), i) for i, v in vectors.items() if i != q and len(v) == len(vectors[q]))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found)]
    return sorted(out)


def test_top_scores_are_exact(spark):
    table = rows()
    df = spark.createDataFrame(table, SCHEMA)
    got = sorted(map(tuple, topk.top_scores(df, df.filter("vec_id % 20 = 0"), bins=16).collect()))
    assert got == brute(table, True, True)
    nothing = df.limit(0)
    assert topk.top_scores(nothing, nothing).count() == 0 and topk.top_scores(df, nothing).count() == 0


def test_neighbours_of_odd_rows(spark):
    table = rows()
    df = spark.createDataFrame(table, SCHEMA)
    got = [tuple(r) for r in multiprobe.nearest(df, df.filter("vec_id % 20 = 0")).collect()]
    want = brute(table, False, False)
    truth = {(q, i): s for q, _, i, s in brute(table, False, False, 1000)}
    assert all(abs(truth[q, i] - s) < 1e-9 for q, _, i, s in got)
    assert {q for q, *_ in got} <= {q for q, *_ in want}
    assert 200 in {i for q, _, i, _ in got} and not {i for *_, i, _ in got} & {300, 301, 302, 303, 304, 305}
    by_query = {}
    for q, n, i, s in sorted(got):
        by_query.setdefault(q, []).append((n, -s, i))
    for found in by_query.values():
        assert [n for n, *_ in found] == list(range(1, len(found) + 1)) and [f[1:] for f in found] == sorted(f[1:] for f in found)
    nothing = df.limit(0)
    assert multiprobe.nearest(nothing, nothing).count() == 0 and multiprobe.nearest(df, nothing).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")
def test_recall_on_given_rows(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    table = [(r.vec_id, r.embedding) for r in df.collect()]
    want = {(q, i) for q, _, i, _ in brute(table, False, False)}
    got = {(r.query_id, r.vec_id) for r in multiprobe.nearest(df, df.filter("vec_id % 20 = 0")).collect()}
    print("recall", len(got & want) / len(want))
    assert len(got & want) >= 0.9 * len(want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="given tables are not here")
@pytest.mark.parametrize("stretch", ["one by 3", "one by 20", "half to three halves", "log-normal 0.5", "log-normal 1"])
def test_recall_with_uneven_norms(spark, stretch):
    table = sorted((r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect())
    by = np.random.default_rng(5).uniform(0.5, 1.5, len(table)) if stretch.startswith("half") else np.ones(len(table))
    if stretch.startswith("log"):
        by = np.random.default_rng(6).lognormal(0, float(stretch.split()[-1]), len(table))
    if stretch.startswith("one"):
        by[77] = float(stretch.split()[-1])
    table = [(i, [float(np.float32(x * f)) for x in v]) for (i, v), f in zip(table, by, strict=True)]
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>").repartition(3)
    want = {(q, i) for q, _, i, _ in brute(table, False, False)}
    rows = multiprobe.nearest(df, df.filter("vec_id % 20 = 0")).collect()
    got = {(r.query_id, r.vec_id) for r in rows}
    print("recall", stretch, len(got & want) / len(want))
    assert len(rows) == len(want)
    assert len(got & want) >= 0.9 * len(want)


def test_short_queries_go_on_to_all_vectors(spark):
    rng = np.random.default_rng(2)
    table = [(i, [float(np.float32(x)) for x in rng.normal(size=16) * (1 if i % 20 else -1) + (9 if i % 20 else -9)]) for i in range(200)]
    table += [(1000 + 20 * i, [1.0, float(i), 2.0]) for i in range(5)]  # fewer candidates than k
    df = spark.createDataFrame(table, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in multiprobe.nearest(df, df.filter("vec_id % 20 = 0"), probes=1).collect())
    want = brute(table, False, False)
    assert [(q, n) for q, n, *_ in got] == [(q, n) for q, n, *_ in want]
    assert all(abs(a[3] - b[3]) < 1e-9 for a, b in zip(got, want, strict=True) if a[0] >= 1000)


def test_scores_beyond_doubles_are_exact(spark):
    rng = np.random.default_rng(7)
    table = [(i, [float(x) for x in rng.uniform(-1, 1, 8) * (1e6 if i in (3, 20, 44) else 1.0)]) for i in range(80)] + [(99, [3.7e6] * 8), (140, [3.7e6] * 7 + [3.7e6 + 1 / 64])]
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>")
    got = [tuple(r) for r in topk.top_scores(df, df.filter("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()]
    whole = {i: [int(np.floor(64 * x)) for x in v] for i, v in table}
    want = []
    for q in sorted(i for i in whole if i % 20 == 0):
        best = sorted((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q)[:20]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == want and max(abs(r[3]) for r in got) > 2**53


def test_clusters_are_searched_in_a_part_of_the_table(spark):
    shares = []
    for n in (4000, 20_000):
        rng = np.random.default_rng(n)
        centres = rng.normal(size=(200, 32))
        x = centres[np.arange(n) % 200] + 0.25 * rng.normal(size=(n, 32))
        x = (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32)
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(4)
        asked = df.filter(f"vec_id % {n // 100} = 0")
        rows = multiprobe.usable(df).withColumn("span", F.lit(0))
        *_, recall, share = multiprobe.fitted(rows, multiprobe.usable(asked), {0: 1.0}, 20, multiprobe.TABLES, multiprobe.SEED)
        shares.append(share)
        got = {(r.query_id, r.vec_id) for r in multiprobe.nearest(df, asked).collect()}
        ids = np.arange(0, n, n // 100)
        scores = x[ids].astype(float) @ x.astype(float).T
        scores[np.arange(len(ids)), ids] = -np.inf
        want = {(int(q), int(i)) for q, row in zip(ids, np.argsort(-scores, axis=1)[:, :20]) for i in row}
        print("share", n, share, "recall", len(got & want) / len(want))
        assert len(got & want) >= 0.9 * len(want) and recall >= multiprobe.RECALL
    assert max(shares) <= 0.3 and shares[1] <= shares[0]
