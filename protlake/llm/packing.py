"""Packing documents into training sequences of several permitted lengths by best fit.

Pieces are dealt by hash into groups of bounded size, which pack on their own; a group's last, half-full bins are the only loss against
one global packing. In a group pieces go from long to short. A piece goes to the open bin with the least room that holds it. If none
does, a bin is opened at the capacity with the least cost per word, seen with the pieces still to come: each permitted capacity is
filled greedily from the remaining lengths and the cheapest one wins. At the end every bin shrinks to the
smallest capacity that holds its contents.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from protlake.llm.keys import spread
from protlake.llm.mixing import WORD, words
from protlake.session import staged

CAPACITIES = (256, 512, 1024, 2048, 4096, 8192)
GROUP = 1024  # pieces packed together
PER_BIN, QUADRATIC = 16.0, 65536.0


def cost(capacity: int) -> float:
    """Cost of one sequence: its length, a fixed part, and a part that grows with the square (attention)."""
    return capacity + PER_BIN + capacity * capacity / QUADRATIC


def _filled(capacity: int, lengths: list[int], counts: dict[int, int], first: int) -> int:
    """Words in a bin of ``capacity`` that starts with ``first`` and takes the longest remaining pieces that fit."""
    room, used = capacity - first, {first: 1}
    at = bisect_right(lengths, room) - 1
    while room > 0 and at >= 0:
        n = lengths[at]
        take = min(counts[n] - used.get(n, 0), room // n)
        if take > 0:
            room -= take * n
            used[n] = used.get(n, 0) + take
        at = min(at - 1, bisect_right(lengths, room) - 1)
    return capacity - room


def best_fit(sizes: Sequence[int], capacities: Sequence[int] = CAPACITIES) -> tuple[list[int], list[int], list[int]]:
    """Bin number and offset of each piece, and capacity of each bin. Every size is from 1 to the largest capacity."""
    capacities = sorted(capacities)
    counts: dict[int, int] = {}
    for n in sizes:
        counts[n] = counts.get(n, 0) + 1
    lengths = sorted(counts)
    rooms: list[tuple[int, int]] = []  # (room, bin), in order
    limit: list[int] = []
    load: list[int] = []
    bins, offsets = [0] * len(sizes), [0] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        n = sizes[i]
        at = bisect_left(rooms, (n, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            options = [c for c in capacities if c >= n]
            room = min(options, key=lambda c: (cost(c) / _filled(c, lengths, counts, n), c))
            b = len(limit)
            limit.append(room)
            load.append(0)
        bins[i], offsets[i] = b, load[b]
        load[b] += n
        if room > n:
            insort(rooms, (room - n, b))
        counts[n] -= 1
        if not counts[n]:
            del counts[n]
            lengths.pop(bisect_left(lengths, n))
    return bins, offsets, [next(c for c in capacities if c >= used) for used in load]


def packed(docs: DataFrame, capacities: Sequence[int] = CAPACITIES, group: int = GROUP, with_text: bool = False) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece`` (from 0), ``words``, ``bin_id``, ``capacity``, ``bin_offset`` and, if asked for, ``text``.

    A document longer than the largest capacity becomes several pieces, all full but the last. ``bin_id`` is unique over the table; pieces of a
    bin lie at ``bin_offset`` without gaps and don't exceed ``capacity``. A null, empty or blank text is one piece of no words with no bin.
    Null and repeated doc_ids are packed like others. Piece texts are their words; a text of one piece stays as it is. Other columns are not read.
    """
    top = max(capacities)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sized = source.select("doc_id", *(["text"] if with_text else []), words(F.col("text")).alias("size"))
    count = F.greatest(F.lit(1), F.ceil(F.col("size") / top)).cast("int")
    pieces = sized.withColumn("piece", F.explode(F.sequence(F.lit(0), count - 1)))
    start = F.col("piece").cast("long") * top
    columns = ["doc_id", "piece", F.least(F.lit(top), F.col("size") - start).cast("int").alias("words")]
    if with_text:
        part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), start.cast("int") + 1, F.lit(top)), " ")
        columns.append(F.when(F.col("size") <= top, F.col("text")).otherwise(part).alias("text"))
    pieces = staged(pieces.select(*columns), "pieces")  # read several times: texts are split once
    groups = max(1, -(-pieces.count() // group))
    # pieces without words need no bin; equal pieces, which share a hash, are told apart by a number
    blank = pieces.filter("words = 0").select("*", *[F.lit(None).cast(kind).alias(c) for c, kind in (("bin_id", "long"), ("capacity", "int"), ("bin_offset", "int"))])
    hashed = spread(pieces.filter("words > 0").withColumn("key", F.xxhash64(F.col("doc_id").cast("string"), "piece", "words")), "key", max(1, group // 4))
    dealt = hashed.withColumn("key", F.pmod("key", F.lit(groups)).cast("int"))
    schema = "doc_id long, piece int, words int, bin_id long, capacity int, bin_offset int" + (", text string" if with_text else "")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["words", "doc_id", "piece"], ascending=[False, True, True], kind="stable", ignore_index=True)
        bins, offsets, limits = best_fit(part["words"].tolist(), capacities)
        part = part.assign(bin_id=[int(part["key"].iloc[0]) * (1 << 32) + b for b in bins], capacity=[limits[b] for b in bins], bin_offset=offsets)
        return part[["doc_id", "piece", "words", "bin_id", "capacity", "bin_offset"] + (["text"] if with_text else [])]

    return dealt.groupBy("key").applyInPandas(run, schema).unionByName(blank)
