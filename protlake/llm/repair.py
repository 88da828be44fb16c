"""Repair of conversations to turns system? (user assistant)* by depth-first branch-and-bound.

A node of the search is (step, what the kept rows end with). Edits lead to further nodes; an explicit stack holds the open ones, the one whose edit is first in ASCII
on top. The bound of a node is what the rows behind it cost at least, whatever the audit; a path is dropped when its cost and bound exceed the best finished repair, the
incumbent (or equal its cost with a larger audit). A table per node keeps the best (cost, audit) that has reached it and drops worse paths. When the stack is empty the
incumbent is proved best.

Rows travel sorted by conversation and turn, in ranges that divide a long conversation. A conversation that lies inside one range, and in one segment of bounded size, is
repaired at once. For the others each segment is searched from every state to every state, the segments' costs and audits are chained in order, and the
repaired texts pass through the hash segment by segment; no task holds a whole conversation but for its audit, one letter a row, which is a cell of the result.
"""

from __future__ import annotations

import hashlib
import math
import os
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from protlake.llm import textkit as tk
from protlake.session import Scratch, staged

SEGMENT, SEGMENT_LETTERS = 512, 1 << 20  # rows and letters of a segment
START, SYSTEM, USER, ASSISTANT = range(4)  # what the kept rows end with
ENDS = (START, ASSISTANT)
COST = {"rerole": 2, "delete": 3, "insert": 2, "truncated": 1}
NEEDED = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
ROLE = {USER: "user", ASSISTANT: "assistant"}
FOLLOWS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = ("su", "ua", "au")
BLANK = re.compile("[\x20\x09-\x0D]*")
WHITE = "\x20\x09\x0A\x0B\x0C\x0D"

ITEMS = "array<struct<turn:long,role:string,text:string,n:long,first:boolean>>"
ITEM_TYPE = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("n", pa.int64()), ("first", pa.bool_())]))
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")
FOUND = "key string, conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

Step = tuple[int, str, int]  # rows that must go; or 0, a row's role initial and whether it is truncated


def fault(item: dict) -> str:
    """First fault of a row: blank, duplicate, truncated or none."""
    if BLANK.fullmatch(item["text"]):
        return "blank"
    if not item["first"]:
        return "duplicate"
    return "" if item["text"].rstrip(WHITE)[-1] in ".!?" else "truncated"


def steps_of(items: Iterable[dict]) -> list[Step]:
    """The search's steps. An item is ``n`` equal rows; all but the first of them are duplicates."""
    steps: list[Step] = []
    for item in items:
        kind, n = fault(item), item["n"]
        if kind in ("blank", "duplicate"):
            steps.append((n, "", 0))
        else:
            steps.append((0, item["role"][:1], int(kind == "truncated")))
            if n > 1:
                steps.append((n - 1, "", 0))
    return steps


def edits_from(steps: list[Step], cost: int, audit: str, p: int, state: int) -> list[tuple[int, str, int, int]]:
    """What every possible edit leads to, as (cost, audit, step, state)."""
    ways = [(cost + COST["insert"], audit + "I", p, NEEDED[state])]
    if p < len(steps):
        gone, role, truncated = steps[p]
        ways.append((cost + COST["delete"] * (gone or 1), audit + "D", p + 1, state))
        if not gone:
            ways.append((cost + COST["rerole"] + truncated, audit + "R", p + 1, NEEDED[state]))
            kept = FOLLOWS.get(role, {}).get(state)
            if kept is not None:
                ways.append((cost + truncated, audit + "K", p + 1, kept))
    return ways


def suffix_bounds(steps: list[Step], goals: frozenset[int]) -> list[list[float]]:
    """For every step and state the least cost of going on to one of ``goals``."""
    after = [0 if s in goals else math.inf for s in range(4)]
    bounds = []
    for p in range(len(steps), -1, -1):
        here = after if p == len(steps) else [min(c + after[t] for c, _, q, t in edits_from(steps, 0, "", p, s) if q > p) for s in range(4)]
        for _ in range(2):  # two insertions at most pay
            here = [min(here[s], COST["insert"] + here[NEEDED[s]]) for s in range(4)]
        bounds.append(after := here)
    return bounds[::-1]


def search(steps: list[Step], entry: int, goals: Iterable[int]) -> tuple[int, str] | None:
    """Least (cost, audit) from ``entry`` over all steps to one of ``goals``; None if there is no way. One letter stands for all rows of a step that must go."""
    n, goals = len(steps), frozenset(goals)
    least = suffix_bounds(steps, goals)
    if least[0][entry] == math.inf:
        return None
    best: tuple[int, str] | None = None
    table: dict[tuple[int, int], tuple[int, str]] = {(0, entry): (0, "")}
    stack = [(0, "", 0, entry)]
    while stack:
        cost, audit, p, state = stack.pop()
        if table[p, state] != (cost, audit):
            continue  # a better path has come to this node since
        if p == n and state in goals and (best is None or (cost, audit) < best):
            best = (cost, audit)
        for way in sorted(edits_from(steps, cost, audit, p, state), key=lambda w: w[1], reverse=True):
            cost, audit, p, state = way
            bound = cost + least[p][state]
            if bound == math.inf or best is not None and (bound > best[0] or bound == best[0] and audit > best[1][:len(audit)]):
                continue
            known = table.get((p, state))
            if known is None or (cost, audit) < known:
                table[p, state] = (cost, audit)
                stack.append(way)
    return best


def edited(items: Iterable[dict], audit: str, state: int) -> tuple[str, list[str], int]:
    """The audit with a letter for every row, the repaired rows as ``role:text``, and the state they end in."""
    letters, rows, edits = [], [], iter(audit)

    def inserted() -> str:
        """Carries out insertions; gives the next other edit."""
        nonlocal state
        for edit in edits:
            if edit != "I":
                return edit
            state = NEEDED[state]
            letters.append(edit)
            rows.append(f"{ROLE[state]}:")
        return ""

    for item in items:
        left = item["n"]
        if fault(item) not in ("blank", "duplicate"):
            edit, left = inserted(), left - 1
            letters.append(edit)
            if edit == "R":
                state = NEEDED[state]
                rows.append(f"{ROLE[state]}:{item['text']}")
            elif edit == "K":
                state = FOLLOWS[item["role"][:1]][state]
                rows.append(f"{item['role']}:{item['text']}")
        if left:
            letters.append(inserted() * left)
    inserted()
    return "".join(letters), rows, state


class Tally:
    """Counts over the rows of a conversation, in order, whole or segment by segment."""

    def __init__(self):
        self.least = self.most = self.last_turn = self.last_role = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0

    def add(self, items: Iterable[dict]) -> None:
        for item in items:
            turn, role, n, kind = item["turn"], item["role"][:1], item["n"], fault(item)
            if turn is not None and turn != self.last_turn:
                self.turns += 1
                self.least, self.most, self.last_turn = turn if self.least is None else self.least, turn, turn
            self.illegal += n - 1 + (self.last_role is not None and self.last_role + role not in LEGAL)
            self.last_role = role
            self.blank += n * (kind == "blank")
            self.duplicate += n * (kind == "duplicate") + (n - 1) * (kind in ("", "truncated"))
            self.truncated += kind == "truncated"

    def counts(self) -> list[int]:
        gaps = 0 if self.least is None else min(self.most - self.least + 1 - self.turns, 2**63 - 1)
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal]


def repaired(items: list[dict]) -> list:
    """Counts, cost, audit and hash of one conversation."""
    cost, audit = search(steps_of(items), START, ENDS)
    letters, rows, _ = edited(items, audit, START)
    tally = Tally()
    tally.add(items)
    return [*tally.counts(), cost, letters, hashlib.sha256("\n".join(rows).encode("utf-8", "surrogatepass")).hexdigest()]


def damaged(conversations: DataFrame, every: int = 20) -> DataFrame:
    """Equal rows after the damage as one (``key``, ``conv_id``, ``turn``, ``role``, ``text``, ``n``); a dropped row has n = 0 and nothing else."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("conv_id").alias("key"),
                                text("role").alias("role"), text("text").alias("text"), F.concat_ws(":", text("conv_id"), text("turn")).alias("name"))
    harm = rows.select("*", (F.crc32(F.col("name").cast("binary")) % every).alias("h"))
    gone = F.col("h") == 0

    def unless_gone(c: Column) -> Column:
        return F.when(~gone, c)

    return harm.select(
        "key", "conv_id", unless_gone(F.col("turn")).alias("turn"), unless_gone(F.when(F.col("h") == 4, "user").otherwise(F.col("role"))).alias("role"),
        unless_gone(F.when(F.col("h") == 1, "").when(F.col("h") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))).alias("text"),
        F.when(gone, 0).when(F.col("h") == 3, 2).otherwise(1).alias("m")).groupBy("key", "conv_id", "turn", "role", "text").agg(F.sum("m").alias("n"))


def _segments(items: DataFrame, limit: int, letters: int) -> DataFrame:
    """Repaired conversations (``seg`` is null), and the segments of those that a range does not hold whole or in one segment."""
    ordered = items.repartitionByRange("key", "turn", "role", "text").sortWithinPartitions("key", "turn", "role", "text")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, number = TaskContext.get().partitionId() << 40, 0
        name: tuple | None = None
        rows: list[dict] = []
        cut, size = True, 0  # the first and the last conversation of a range may go on in another

        def out(whole: bool) -> pa.RecordBatch:
            nonlocal number
            number += 1
            real = [r for r in rows if r["n"]]
            found = repaired(real) if whole else [None] * 8
            values = [*name, None if whole else base + number, None if whole else real, *found]
            kinds = [pa.string(), pa.int64(), pa.int64(), ITEM_TYPE, *[pa.int64()] * 6, pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)],
                                              names=["key", "conv_id", "seg", "items", *COUNTS, "cost", "audit", "repaired_sha256"])

        for batch in batches:
            for key, conv_id, turn, role, text, n, first in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name is not None and name[0] != key:
                    yield out(not cut)
                    rows, size, cut = [], 0, False
                elif rows and (len(rows) >= limit or size >= letters):
                    cut = True
                    yield out(False)
                    rows, size = [], 0
                name = (key, conv_id)
                rows.append({"turn": turn, "role": role or "", "text": text or "", "n": n, "first": first})
                size += len(text or "")
        if name is not None:
            yield out(False)

    return ordered.select("key", "conv_id", "turn", "role", "text", "n", "first").mapInArrow(
        walk, f"key string, conv_id long, seg long, items {ITEMS}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string")


WAYS = "array<struct<entry:int,leave:int,cost:long,audit:string>>"
WAY_TYPE = pa.list_(pa.struct([("entry", pa.int32()), ("leave", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Best way through each segment, from every state to every state."""
    for batch in batches:
        for key, seg, items in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            steps, ways = steps_of(items), []
            for entry in range(4):
                for leave in range(4):
                    found = search(steps, entry, (leave,))
                    if found:
                        ways.append({"entry": entry, "leave": leave, "cost": found[0], "audit": found[1]})
            yield pa.RecordBatch.from_arrays([pa.array([key]), pa.array([seg]), pa.array([ways], WAY_TYPE)], names=["key", "seg", "ways"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The states before and after each segment on the best way through its conversation; rows come sorted by (key, seg).

    Of the audits so far only what differs between the states is held, and four steps back for each segment.
    """
    def chosen(key: str, segs: list[int], back: list[dict], live: dict) -> pa.RecordBatch:
        state = min((live[s], s) for s in ENDS if s in live)[1]
        total, leaves, entries = live[state][0], [], []
        for step in reversed(back):
            leaves.append(state)
            state = step[state]
            entries.append(state)
        n = len(segs)
        return pa.RecordBatch.from_arrays([pa.array([key] * n), pa.array(segs, pa.int64()), pa.array(entries[::-1], pa.int32()), pa.array(leaves[::-1], pa.int32()),
                                           pa.array([total] * n, pa.int64())], names=["key", "seg", "entry", "leave", "total"])

    name, segs, back, live = None, [], [], {}
    for batch in batches:
        for key, seg, ways in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != name:
                if name is not None:
                    yield chosen(name, segs, back, live)
                name, segs, back, live = key, [], [], {START: (0, "")}
            after: dict[int, tuple[int, str, int]] = {}
            for w in ways:
                if w["entry"] in live:
                    cost, audit = live[w["entry"]]
                    way = (cost + w["cost"], audit + w["audit"], w["entry"])
                    if w["leave"] not in after or way < after[w["leave"]]:
                        after[w["leave"]] = way
            same = len(os.path.commonprefix([a for _, a, _ in after.values()]))
            live = {s: (cost, audit[same:]) for s, (cost, audit, _) in after.items()}
            segs.append(seg)
            back.append({s: entry for s, (_, _, entry) in after.items()})
    if name is not None:
        yield chosen(name, segs, back, live)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each divided conversation; its segments come sorted by (key, seg) and pass through the hash one after the other."""
    name: tuple | None = None
    tally, letters, digest, began, total = Tally(), [], hashlib.sha256(), False, 0

    def row() -> pa.RecordBatch:
        values = [*name, *tally.counts(), total, "".join(letters), digest.hexdigest()]
        kinds = [pa.string(), *[pa.int64()] * 7, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=["key", "conv_id", *COUNTS, "cost", "audit", "repaired_sha256"])

    for batch in batches:
        for key, conv_id, _, items, entry, audit, cost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if name is None or name[0] != key:
                if name is not None:
                    yield row()
                name, tally, letters, digest, began, total = (key, conv_id), Tally(), [], hashlib.sha256(), False, cost
            tally.add(items)
            some, rows, _ = edited(items, audit, entry)
            letters.append(some)
            for r in rows:
                digest.update((("\n" if began else "") + r).encode("utf-8", "surrogatepass"))
                began = True
    if name is not None:
        yield row()


def repairs(conversations: DataFrame, every: int = 20, segment: int = SEGMENT, segment_letters: int = SEGMENT_LETTERS) -> DataFrame:
    """One row per ``conv_id``, null included: ``gaps``, ``blank``, ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit``, ``repaired_sha256`` of the damaged conversation.

    The damage is chosen by the checksum of ``conv_id:turn`` modulo ``every`` (see ``damaged``). Null values count as one space, but a null turn stays null: it comes first and does not
    count for gaps. Rows of one turn are ordered by role, then text; repeated rows are duplicates. A conversation without rows after the damage has zeros, an empty
    audit and the hash of nothing. Gaps beyond a long are its largest value. Only ``conv_id``, ``turn``, ``role`` and ``text`` are read.
    """
    spark = conversations.sparkSession
    with Scratch(spark, "repair") as scratch:
        rows = scratch.table(damaged(conversations, every))
        word = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
        named = rows.withColumn("what", F.when(F.col("n") > 0, word))
        firsts = named.filter("n > 0").groupBy("key", "what").agg(F.min(F.struct("turn")).alias("least"))
        marked = scratch.table(named.join(firsts, ["key", "what"], "left").withColumn("first", F.coalesce(F.struct("turn") == F.col("least"), F.lit(False))).drop("what", "least"))
        with tk.batches(spark, 1 << 10):
            found = scratch.table(_segments(marked, segment, segment_letters))
        parts = found.filter("seg is not null").select("key", "conv_id", "seg", "items")
        with tk.batches(spark, 16):  # segments hold up to a megabyte of text
            ways = scratch.table(parts.select("key", "seg", "items").mapInArrow(_ways, f"key string, seg long, ways {WAYS}"))
            chain = scratch.table(ways.repartition("key").sortWithinPartitions("key", "seg").mapInArrow(_chain, "key string, seg long, entry int, leave int, total long"))
        chosen = ways.join(chain, ["key", "seg"]).select(
            "key", "seg", "entry", "total", F.expr("filter(ways, w -> w.entry = entry and w.leave = leave)[0].audit").alias("audit"))
        divided = (parts.join(chosen, ["key", "seg"]).select("key", "conv_id", "seg", "items", "entry", "audit", "total")
                   .repartition("key").sortWithinPartitions("key", "seg").mapInArrow(_joined, FOUND))
        whole = found.filter("seg is null").drop("seg", "items")
        with tk.batches(spark, 16):
            return staged(whole.unionByName(divided).select("conv_id", *COUNTS, "cost", "audit", "repaired_sha256"), "repair-found")
