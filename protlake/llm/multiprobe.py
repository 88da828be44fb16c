"""Approximate nearest neighbours by multiprobe p-stable hashing.

A table has K hash functions floor((a.x + b) / w) with Gaussian a, which is 2-stable: the projected distance of two points is distributed like
their distance. Vectors are cut into narrow norm ranges. Inside a range largest inner products become smallest distances by dividing its vectors by
its largest norm and appending one component that makes them unit vectors (queries: zero); so a few long vectors don't push the others away from the
queries. A query's cells are the same numbers in all ranges, so one visit to a cell searches it in each of them. A query visits its own cell and then perturbed cells in the order of the estimated chance to hold a
neighbour: the smaller the summed squares of the distances to the crossed cell borders, the sooner. Candidates of all tables are scored exactly.

How many functions a table has, how wide they are and how many cells a query visits is fitted: for a bounded sample of the queries the true
neighbours among all vectors are found, and of the settings under which enough of them lie in visited cells the one that scores the smallest share of a bounded
sample of the vectors is taken. The closer the neighbours, be it in clusters or because the table grows, the smaller the share.

Cells are dealt by hash into groups, as many as the table has blocks of rows; a group with many rows, as of one large cell, is split. A query travels once to
each group that holds a cell it visits, with the list of these cells. A first look into a few cells gives a score that k rows reach, and from then on no group hands on
lower ones, so what a query gets back does not grow with the groups. Queries that found fewer than k rows go on: first to all cells next to their own, then to all vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from protlake.llm.textkit import mix
from protlake.llm.vectors import best_of, matrix, usable
from protlake.session import staged

TABLES = 2
SETTINGS = [(functions, width) for functions in (4, 6, 8) for width in (0.75, 1.0, 1.5, 2.0, 3.0)]
VISITS = (4, 8, 16, 32, 64, 100, 150, 200, 300, 450, 729, 1200, 2000)
RECALL = 0.95  # wanted of the sampled queries' neighbours
SAMPLED_QUERIES, SAMPLED_VECTORS = 128, 4096  # about so many, by hash of the id
BLOCK = 4096
FIRST = 8  # cells of the first look
RANGES = 8  # norm ranges from one power of two to the next
SEED = 20240715
FOUND_TYPE = pa.list_(pa.struct([("vec_id", pa.int64()), ("score", pa.float64())]))


def _functions(table: int, size: int, functions: int, width: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([seed, table, size])
    return rng.normal(size=(size + 1, functions)), rng.uniform(0, width, functions)


def _unit(v: np.ndarray, norms: np.ndarray) -> np.ndarray:
    scaled = v / norms[:, None]
    rest = np.sqrt(np.maximum(0.0, 1.0 - (scaled * scaled).sum(axis=1)))
    return np.column_stack((scaled, rest))


def _cell(codes: np.ndarray) -> np.ndarray:
    """One number for each row of integer hash values (last axis)."""
    out = np.zeros(codes.shape[:-1], np.uint64)
    for j in range(codes.shape[-1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + codes[..., j].astype(np.int64).view(np.uint64))
    return out.view(np.int64)


def probed_cells(at: np.ndarray, probes: int) -> np.ndarray:
    """Cells that queries visit, best first. ``at``: hash values of the queries before rounding down."""
    base = np.floor(at)
    below = at - base
    steps = np.array(list(product((0, -1, 1), repeat=at.shape[1])), np.int64)
    crossed = np.stack((np.zeros_like(below), (1 - below) ** 2, below ** 2), axis=-1)  # by step: 0, 1, -1
    price = np.zeros((len(at), len(steps)))
    for j in range(at.shape[1]):
        price += crossed[:, j, :][:, steps[:, j]]
    order = np.argsort(price, axis=1, kind="stable")[:, :probes]
    return _cell(base.astype(np.int64)[:, None, :] + steps[order])


def _sampled(rows: DataFrame, wanted: int, seed: int) -> DataFrame:
    """About ``wanted`` rows, chosen by hash of vec_id."""
    share = min(1.0, wanted / max(rows.count(), 1))
    return rows.filter(F.pmod(F.xxhash64("vec_id", F.lit(seed)), F.lit(2**31)) < F.lit(share * 2.0**31))


def _true_neighbours(rows: DataFrame, asked: dict[int, tuple[np.ndarray, np.ndarray]], k: int) -> list:
    """Exact neighbours of a few queries (by vector length: ids, vectors) among all rows; a task gives its k best for each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple] = {}
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for size in asked.keys() & set(sizes.tolist()):
                part = batch.filter(pa.array(sizes == size))
                new = part.column(0).to_numpy(), matrix(part.column(1)), part.column(2).to_numpy()
                q_ids, q = asked[size]
                if size in held:
                    new = tuple(np.concatenate(x) for x in zip(held[size], new, strict=True))
                scores = q @ new[1].T
                scores[q_ids[:, None] == new[0][None, :]] = -np.inf
                _, col = best_of(scores, k)
                keep = np.unique(col)  # at most k rows for each query
                held[size] = tuple(x[keep] for x in new)
        for size, (ids, v, spans) in held.items():
            q_ids, q = asked[size]
            scores = q @ v.T
            scores[q_ids[:, None] == ids[None, :]] = -np.inf
            row, col = best_of(scores, k)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(col) + 1) * size, pa.int32()), pa.array(v[col].reshape(-1)))
            yield pa.RecordBatch.from_arrays([pa.array(q_ids[row]), pa.array(ids[col]), pa.array(scores[row, col]), pa.array(spans[col].astype(np.int32)), flat],
                                             names=["query_id", "vec_id", "score", "span", "v"])

    found = rows.select("vec_id", "v", "span").mapInArrow(run, "query_id long, vec_id long, score double, span int, v array<double>")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("n", F.row_number().over(best)).filter(F.col("n") <= k).collect()


def fitted(rows: DataFrame, asked: DataFrame, longest: dict[int, float], k: int, tables: int, seed: int) -> tuple[int, float, int, float, float]:
    """(functions, width, probes, recall, share): the setting that scores the smallest share at ``RECALL``, else the one of highest recall.

    ``rows`` (vec_id, v, span) and ``asked`` (vec_id, v) are sampled as the constants say.
    """
    def by_size(some: list) -> dict[int, list]:
        out: dict[int, list] = {}
        for r in some:
            out.setdefault(len(r.v), []).append(r)
        return out

    few = by_size(_sampled(asked, SAMPLED_QUERIES, 1).collect())
    queries = {size: (np.array([r.vec_id for r in found]), np.array([r.v for r in found])) for size, found in few.items()}
    near, seen = by_size(_true_neighbours(rows, queries, k)) if queries else {}, by_size(_sampled(rows, SAMPLED_VECTORS, 2).collect())

    def units(some: list) -> np.ndarray:
        return _unit(np.array([r.v for r in some]), np.array([longest[r.span] for r in some]))

    parts = [(size, *queries[size], near[size], units(near[size]), units(seen[size])) for size in queries if size in near and size in seen]
    tried = []
    for functions, width in SETTINGS:
        most = min(3**functions, max(VISITS))
        total, visited, count, scored = 0, np.zeros(most), 0, np.zeros(most)
        for size, ids, q, found, found_units, seen_units in parts:
            unit = np.column_stack((q / np.linalg.norm(q, axis=1)[:, None], np.zeros(len(q))))
            first, first_seen = np.full(len(found), most), np.full((len(q), len(seen_units)), most)
            place = {int(i): n for n, i in enumerate(ids)}
            of = np.array([place[r.query_id] for r in found])
            for t in range(tables):
                a, b = _functions(t, size, functions, width, seed)
                lists = probed_cells((unit @ a + b) / width, most)
                cells, all_cells = (_cell(np.floor((u @ a + b) / width).astype(np.int64)) for u in (found_units, seen_units))
                for n in range(len(q)):
                    order = np.argsort(lists[n], kind="stable")
                    ranked = lists[n][order]

                    def visit(wanted: np.ndarray) -> np.ndarray:
                        at = np.minimum(np.searchsorted(ranked, wanted), most - 1)
                        return np.where(ranked[at] == wanted, order[at], most)

                    mine = of == n
                    first[mine] = np.minimum(first[mine], visit(cells[mine]))
                    first_seen[n] = np.minimum(first_seen[n], visit(all_cells))
            total, count = total + len(found), count + first_seen.size
            visited += np.cumsum(np.bincount(first, minlength=most + 1)[:most])
            scored += np.cumsum(np.bincount(first_seen.reshape(-1), minlength=most + 1)[:most])
        for probes in [p for p in VISITS if p < most] + [most]:
            recall, share = visited[probes - 1] / max(total, 1), scored[probes - 1] / max(count, 1)
            tried.append((functions, width, probes, float(recall), float(share)))
    good = [x for x in tried if x[3] >= RECALL]
    return min(good, key=lambda x: (x[4], x[2])) if good else max(tried, key=lambda x: (x[3], -x[4]))


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, tables: int = TABLES, functions: int | None = None, width: float | None = None,
            probes: int | None = None, seed: int = SEED) -> DataFrame:
    """``query_id``, ``rank``, ``vec_id``, ``score``: for each query the k vectors found with the largest inner products.

    ``vectors`` and ``queries`` have ``vec_id`` and ``embedding``; a query doesn't find its own id. Ties go to the smaller vec_id. Vectors that are null, zero or hold a null or non-finite component take
    no part; vectors of another length than the query's aren't candidates. Every vector is indexed. What is not given of ``functions``, ``width`` and ``probes`` is
    fitted on bounded samples (see ``fitted``). A query has fewer than k rows only if there are fewer candidates. Other columns are not read.
    """
    # norms beyond these bounds fall into the outermost ranges
    measured = usable(vectors).filter("exists(v, x -> x <> 0)").withColumn(
        "norm", F.expr("greatest(least(sqrt(aggregate(v, 0D, (s, x) -> s + x * x)), 1e300D), 1e-300D)"))
    rows = staged(measured.withColumn("span", F.floor(F.log2("norm") * RANGES + 0.5).cast("int")), "probe-vectors")
    asked = usable(queries).filter("exists(v, x -> x <> 0)")
    # at most RANGES rows for each power of two a norm can have
    longest = {r.span: r.norm for r in rows.groupBy("span").agg(F.max("norm").alias("norm")).collect()}
    if not (functions and width and probes):
        chosen = fitted(rows, asked, longest, k, tables, seed)
        functions, width, probes = functions or chosen[0], width or chosen[1], probes or chosen[2]
    groups, block = max(1, -(-rows.count() // BLOCK)), BLOCK

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                v = matrix(part.column(1))
                unit = _unit(v, np.array([longest[x] for x in part.column(2).to_pylist()]))
                for t in range(tables):
                    a, b = _functions(t, int(size), functions, width, seed)
                    cells = _cell(np.floor((unit @ a + b) / width).astype(np.int64))
                    group = (mix(cells.view(np.uint64)) % np.uint64(groups)).astype(np.int32) + t * groups
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(group), pa.array(np.full(len(v), size, np.int32)), pa.array(cells), part.column(0), part.column(1)],
                        names=["grp", "dim", "cell", "vec_id", "v"])

    def probe(batches: Iterator[pa.RecordBatch], probes: int) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).value_lengths().to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                for low in range(0, part.num_rows, 256):
                    some = part.slice(low, 256)
                    v = matrix(some.column(1))
                    unit = np.column_stack((v / np.linalg.norm(v, axis=1)[:, None], np.zeros(len(v))))
                    for t in range(tables):
                        a, b = _functions(t, int(size), functions, width, seed)
                        cells = probed_cells((unit @ a + b) / width, probes)
                        group = (mix(cells.view(np.uint64)) % np.uint64(groups)).astype(np.int64)
                        # one row for each query and group it has to visit
                        owner = np.repeat(np.arange(len(v)), cells.shape[1])
                        order = np.lexsort((group.reshape(-1), owner))
                        owner, of, listed = owner[order], group.reshape(-1)[order], cells.reshape(-1)[order]
                        start = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (of[1:] != of[:-1])))
                        for a_row in range(0, len(start), 4096):
                            rows_of = start[a_row:a_row + 4096]
                            end = start[a_row + 4096] if a_row + 4096 < len(start) else len(owner)
                            at = np.append(rows_of, end) - rows_of[0]
                            yield pa.RecordBatch.from_arrays(
                                [pa.array((of[rows_of] + t * groups).astype(np.int32)), pa.array(np.full(len(rows_of), size, np.int32)),
                                 *[some.column(i).take(pa.array(owner[rows_of])) for i in range(3)], pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(listed[rows_of[0]:end]))],
                                names=["grp", "dim", "query_id", "v", "floor", "cells"])

    indexed = staged(rows.select("vec_id", "v", "span").mapInArrow(index, "grp int, dim int, cell long, vec_id long, v array<double>"), "probe-index")
    # one row per group and vector length, whatever the data: how many parts the group needs
    parts = indexed.groupBy("grp", "dim").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("parts"))
    parts = staged(parts, "probe-parts")
    dealt = indexed.join(parts, ["grp", "dim"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")

    def visits(asked: DataFrame, probes: int | None) -> DataFrame:
        if probes:
            to = (asked.select("vec_id", "v", "floor").mapInArrow(lambda batches: probe(batches, probes), "grp int, dim int, query_id long, v array<double>, floor double, cells array<long>")
                  .join(parts, ["grp", "dim"]))
        else:  # the groups of one table hold all vectors
            to = (asked.select(F.col("vec_id").alias("query_id"), "v", "floor", F.size("v").alias("dim")).join(parts.filter(F.col("grp") < groups), "dim")
                  .select("grp", "dim", "query_id", "v", "floor", F.lit(None).cast("array<long>").alias("cells"), "parts"))
        return to.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        none = pa.table({"query_id": pa.array([], pa.int64()), "found": pa.array([], FOUND_TYPE)})
        if not left.num_rows or not right.num_rows:
            return none
        left, right = left.combine_chunks(), right.combine_chunks()
        ids, cells = left["vec_id"].to_numpy(), left["cell"].to_numpy()
        order = np.lexsort((ids, cells))
        v, ids, cells = matrix(left["v"])[order], ids[order], cells[order]
        starts = np.flatnonzero(np.append(True, cells[1:] != cells[:-1]))
        ends = np.append(starts[1:], len(cells))
        known = cells[starts]
        by_id = np.argsort(ids, kind="stable")
        column = np.empty(len(ids), np.int64)
        column[by_id] = np.arange(len(ids))
        out = []
        for low in range(0, right.num_rows, 512):
            some = right.slice(low, 512).combine_chunks()
            q, asked_ids = matrix(some["v"]), some["query_id"].to_numpy()
            lists = some["cells"].combine_chunks()
            scores = np.full((len(q), len(ids)), -np.inf)
            if lists.null_count:  # of all queries or of none: all cells
                at = []
                scores[:, column] = np.round(q @ v.T, 12)
            else:
                owner = np.repeat(np.arange(len(q)), lists.value_lengths().to_numpy())
                wanted = lists.flatten().to_numpy()
                at = np.minimum(np.searchsorted(known, wanted), len(known) - 1)
                hit = known[at] == wanted
                owner, at = owner[hit], at[hit]
                order = np.argsort(at, kind="stable")
                owner, at = owner[order], at[order]
            cut = np.flatnonzero(np.append(True, at[1:] != at[:-1])) if len(at) else []
            for i, s in enumerate(cut):
                e = cut[i + 1] if i + 1 < len(cut) else len(at)
                c = at[s]
                # equal up to rounding: a tie, whatever block the product comes from
                scores[np.ix_(owner[s:e], column[starts[c]:ends[c]])] = np.round(q[owner[s:e]] @ v[starts[c]:ends[c]].T, 12)
            own = np.searchsorted(ids[by_id], asked_ids)
            own_there = np.flatnonzero((own < len(ids)) & (ids[by_id][np.minimum(own, len(ids) - 1)] == asked_ids))
            scores[own_there, own[own_there]] = -np.inf
            row, col = best_of(scores, k, some["floor"].to_numpy() - 1e-9)
            exact = np.einsum("ij,ij->i", q[row], v[by_id[col]])
            some_found, at = np.unique(row, return_index=True)
            pairs = pa.StructArray.from_arrays([pa.array(ids[by_id[col]]), pa.array(exact)], names=["vec_id", "score"])
            out.append(pa.table({"query_id": asked_ids[some_found], "found": pa.ListArray.from_arrays(pa.array(np.append(at, len(row)), pa.int32()), pairs)}))
        return pa.concat_tables(out) if out else none

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def answers(asked: DataFrame, probes: int | None) -> DataFrame:
        found = (dealt.groupBy("grp", "dim", "part").cogroup(visits(asked, probes).groupBy("grp", "dim", "part"))
                 .applyInArrow(search, "query_id long, found array<struct<vec_id:long,score:double>>"))
        # lists of at most k from each group visited; a vector stands once in each table, so the first k of them are among this many
        every = F.array_sort(F.transform(F.flatten(F.collect_list("found")), lambda f: F.struct((-f.score).alias("down"), f.vec_id.alias("vec_id"))))
        best_found = found.groupBy("query_id").agg(F.slice(every, 1, k * tables).alias("found"))
        distinct = best_found.select("query_id", F.inline("found")).groupBy("query_id", "vec_id").agg((-F.min("down")).alias("score"))
        return distinct.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    # a score that k rows reach, if the first cells have so many
    reached = staged(answers(asked.withColumn("floor", F.lit(float("-inf"))), min(FIRST, probes)).filter(F.col("rank") == k).select("query_id", F.col("score").alias("floor")), "probe-floors")
    asked = asked.join(reached, asked["vec_id"] == reached["query_id"], "left").select("vec_id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    settled = []
    for further in (probes, 3 ** functions, None):
        some = staged(answers(asked, further), "probe-answers")
        if further is None:
            settled.append(some)
            break
        # the k-th row is there or the query is short
        full = some.filter(F.col("rank") == k).select("query_id")
        settled.append(some.join(full, "query_id", "left_semi"))
        asked = staged(asked.join(full, asked["vec_id"] == full["query_id"], "left_anti"), "probe-short")
        if asked.isEmpty():
            break
    return reduce(DataFrame.unionByName, settled).select("query_id", "rank", "vec_id", "score")
