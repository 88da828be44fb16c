"""Residue contacts: cell lists inside a fragment's row, distance-bounded self-join for points in rows of their own, degrees and shape."""

from __future__ import annotations

from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from protlake.functions import scalar as fn


def _half_neighbourhood() -> Column:
    """Own cell and the 13 forward neighbours: every unordered cell pair is visited once."""
    offsets = [o for o in product((-1, 0, 1), repeat=3) if o >= (0, 0, 0)]
    cells = ", ".join("named_struct('ox', {}L, 'oy', {}L, 'oz', {}L)".format(*o) for o in offsets)
    return F.expr(f"array({cells})")


def pairs_within(points: DataFrame, group: list[str], index: str, radius: float,
                 coords: tuple[str, str, str] = ("x", "y", "z")) -> DataFrame:
    """Pairs ``source < target`` of one group at distance <= radius.

    Cells have the side of the radius, so partners lie in the same or an adjacent cell and the search is an
    equi-join on (group, cell); AQE splits a crowded cell. Only ids and coordinates travel through it.
    """
    if radius <= 0:
        raise ValueError("radius must be positive")
    x, y, z = coords
    base = points.select(*group, F.col(index).alias("i"), F.col(x).cast("double").alias("px"),
                         F.col(y).cast("double").alias("py"), F.col(z).cast("double").alias("pz"))
    cells = base.select("*", *[F.floor(F.col(p) / fn.d(radius)).alias(c)
                               for p, c in (("px", "cx"), ("py", "cy"), ("pz", "cz"))])
    left = cells.select(*group, "cx", "cy", "cz", F.struct("i", "px", "py", "pz").alias("a"))
    right = cells.withColumn("o", F.explode(_half_neighbourhood())).select(
        *group, (F.col("cx") + F.col("o.ox")).alias("cx"), (F.col("cy") + F.col("o.oy")).alias("cy"),
        (F.col("cz") + F.col("o.oz")).alias("cz"), F.struct("i", "px", "py", "pz").alias("b"),
        ((F.col("o.ox") == 0) & (F.col("o.oy") == 0) & (F.col("o.oz") == 0)).alias("own"))
    dist = fn.distance(F.col("a.px"), F.col("a.py"), F.col("a.pz"), F.col("b.px"), F.col("b.py"), F.col("b.pz"))
    joined = left.join(right, [*group, "cx", "cy", "cz"]) \
        .where((~F.col("own") & (F.col("a.i") != F.col("b.i"))) | (F.col("a.i") < F.col("b.i"))) \
        .where(dist <= fn.d(radius))
    return joined.select(*group, F.least("a.i", "b.i").alias("source"), F.greatest("a.i", "b.i").alias("target"),
                         dist.alias("distance"))


POINTS = 1 << 14  # points searched together
CONTACTS = "struct<source: array<int>, target: array<int>, distance: array<double>, degree: array<int>, strict_degree: array<int>>"


def cell_pairs(group: np.ndarray, xyz: np.ndarray, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions i < j and distances of all points of one group at distance <= radius, in order of (i, j).

    Points are sorted by group and grid cell; the partners of a point are runs of the sorted order, one for each forward
    neighbour cell and one for the rest of its own. Points without finite coordinates have no partner.
    """
    usable = np.flatnonzero(np.isfinite(xyz).all(axis=1))
    if not len(usable):
        return usable, usable, np.zeros(0)
    cell = np.floor(xyz[usable] / radius)
    # a free cell on either side keeps neighbours of one group, row or layer apart from the next
    numbers = [np.unique(cell[:, a], return_inverse=True) for a in range(3)]
    steps = [np.concatenate(([1], np.cumsum(np.where(np.diff(v) == 1, 1, 2)) + 1)) for v, _ in numbers]
    c = [s[inv].astype(np.int64) for s, (_, inv) in zip(steps, numbers)]
    wide = [int(x.max()) + 2 for x in c]
    stride = (wide[1] * wide[2], wide[2], 1)
    key = group[usable].astype(np.int64) * (wide[0] * stride[0]) + c[0] * stride[0] + c[1] * stride[1] + c[2]
    order = np.argsort(key, kind="stable")
    key, at = key[order], usable[order]
    place = np.arange(len(at))
    found_i, found_j = [], []
    for o in product((-1, 0, 1), repeat=3):
        if o < (0, 0, 0):
            continue
        if o == (0, 0, 0):
            first, last = place + 1, np.searchsorted(key, key, side="right")
        else:
            there = key + o[0] * stride[0] + o[1] * stride[1] + o[2]
            first, last = np.searchsorted(key, there, side="left"), np.searchsorted(key, there, side="right")
        many = last - first
        i = np.repeat(place, many)
        j = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(first, many)
        found_i.append(at[i])
        found_j.append(at[j])
    i, j = np.concatenate(found_i), np.concatenate(found_j)
    d = xyz[i] - xyz[j]
    distance = np.sqrt(d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2])
    near = distance <= radius
    low, high, distance = np.minimum(i[near], j[near]), np.maximum(i[near], j[near]), distance[near]
    order = np.lexsort((high, low))
    return low[order], high[order], distance[order]


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(values, kind))


def row_contacts(radius: float, strict_radius: float):
    """Column function of (x, y, z), one array of coordinates per row: pairs of positions from 1 within ``radius``, and the degrees of all positions.

    Everything stays in the row; a null array has no points.
    """
    if radius <= 0:
        raise ValueError("radius must be positive")

    def search(x: pa.Array, y: pa.Array, z: pa.Array) -> pa.Array:
        sizes = x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        starts = ends - sizes
        xyz = np.stack([np.asarray(c.flatten().to_numpy(zero_copy_only=False), np.float64) for c in (x, y, z)], axis=1)
        group = np.repeat(np.arange(len(sizes)), sizes)
        parts = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        row = 0
        while row < len(sizes):
            more = max(row + 1, int(np.searchsorted(ends, starts[row] + POINTS, side="right")))
            a, b = starts[row], ends[more - 1]
            i, j, d = cell_pairs(group[a:b] - row, xyz[a:b], radius)
            parts.append((i + a, j + a, d))
            row = more
        i, j, d = (np.concatenate(p) for p in zip(*parts))
        strict = d <= strict_radius
        degree = np.bincount(i, minlength=len(xyz)) + np.bincount(j, minlength=len(xyz))
        strict_degree = np.bincount(i[strict], minlength=len(xyz)) + np.bincount(j[strict], minlength=len(xyz))
        pairs = np.bincount(group[i], minlength=len(sizes))
        base = starts[group[i]] - 1
        ints = pa.int32()
        return pa.StructArray.from_arrays(
            [_lists(i - base, pairs, ints), _lists(j - base, pairs, ints), _lists(d, pairs, pa.float64()), _lists(degree, sizes, ints), _lists(strict_degree, sizes, ints)],
            names=["source", "target", "distance", "degree", "strict_degree"])

    search.__annotations__ = {"x": pa.Array, "y": pa.Array, "z": pa.Array, "return": pa.Array}
    return F.arrow_udf(search, CONTACTS)


def row_edges(contacts: Column, matrix: Column) -> Column:
    """ARRAY of (source, target, distance, pae_lr, pae_rl): the pairs with both of their cells of the row's own error matrix."""
    cell = lambda a, b: F.get(F.get(matrix, a - 1), b - 1)
    return F.transform(F.arrays_zip(contacts.source.alias("source"), contacts.target.alias("target"), contacts.distance.alias("distance")), lambda e: F.struct(
        e.source.alias("source"), e.target.alias("target"), e.distance.alias("distance"),
        cell(e.source, e.target).alias("pae_lr"), cell(e.target, e.source).alias("pae_rl")))


def edge_flags(edges: DataFrame, strict_radius: float) -> DataFrame:
    sep = F.col("target") - F.col("source")
    return edges.select(
        "*", sep.alias("seq_separation"), (sep == 1).alias("is_sequential_neighbor"),
        (sep <= 5).alias("is_short_range_sequence"), (F.col("distance") <= strict_radius).alias("is_strict_contact"))


def degrees(edges: DataFrame, group: list[str], strict: str = "is_strict_contact",
            ends: tuple[str, str] = ("source", "target"), name: str = "node") -> DataFrame:
    """Contact and strict-contact degree of every residue that has an edge."""
    both = edges.select(*group, F.explode(F.array(*[F.col(e) for e in ends])).alias(name), F.col(strict).alias("__s"))
    return both.groupBy(*group, name).agg(F.count("*").alias("contact_degree"),
                                          F.count_if(F.col("__s")).alias("strict_contact_degree"))


def with_degrees(nodes: DataFrame, edges: DataFrame, group: list[str], node: str,
                 ends: tuple[str, str] = ("source", "target")) -> DataFrame:
    """Nodes with their degrees, zero when isolated."""
    deg = degrees(edges, group, ends=ends, name=node)
    return nodes.join(deg, [*group, node], "left").fillna(0, ["contact_degree", "strict_contact_degree"])


def contact_density(edge_count: Column, node_count: Column) -> Column:
    possible = node_count * (node_count - 1) / 2
    return F.when(possible > 0, edge_count / possible).otherwise(fn.d(0))


def radius_of_gyration(x: str = "x", y: str = "y", z: str = "z") -> Column:
    """Aggregate: root mean squared distance from the centre."""
    return F.sqrt(F.var_pop(x) + F.var_pop(y) + F.var_pop(z))


def bin_fraction(plddt: str, name: str) -> Column:
    return F.avg(F.when(fn.confidence_bin(F.col(plddt)) == name, fn.d(1)).otherwise(fn.d(0)))


def edge_type_counts(edges: DataFrame, group: list[str]) -> DataFrame:
    return edges.groupBy(*group).agg(
        F.count_if("is_strict_contact").alias("strict_edges"),
        F.count_if("is_sequential_neighbor").alias("sequential_edges"),
        F.count("*").alias("all_edges"))


def strongest_edge_type(edges: DataFrame, group: list[str], ends: tuple[str, str]) -> DataFrame:
    """2 for a strict contact, 1 for any other, one row per unordered residue pair."""
    return edges.groupBy(*group, F.least(*ends).alias("low"), F.greatest(*ends).alias("high")).agg(
        F.max(F.when(F.col("is_strict_contact"), 2).otherwise(1)).alias("edge_type"))


def symmetrise(edges: DataFrame, ends: tuple[str, str]) -> DataFrame:
    """Each undirected edge as two directed ones with equal attributes."""
    a, b = ends
    rest = [c for c in edges.columns if c not in ends]
    both = F.explode(F.array(F.struct(F.col(a).alias(a), F.col(b).alias(b)),
                             F.struct(F.col(b).alias(a), F.col(a).alias(b))))
    return edges.select(*rest, both.alias("__e")).select(f"__e.{a}", f"__e.{b}", *rest)
