"""Near-duplicate classes by BagMinHash signatures over multisets of word shingles.

A document is the multiset of its five-word shingles. A shingle of count c is the union of the unit weights [0, 1), [1, 2), [2, 4),
[4, 8), ... below c, and every such dyadic block carries its own Poisson process, seeded by shingle and block: its points have an
arrival time, a signature component and a unit slot, and a point counts when its slot lies below c. A component's value is its
earliest point; two multisets agree in a component with a probability equal to their weighted Jaccard similarity. Points are made in order of
arrival and only up to the time by which every component is filled, so the work after the first point of each block does not grow
with the document.

Signatures are cut into bands; documents that share a band are candidates, and the exact multiset overlap of the texts decides.
Every document is verified against the first document (leader) of each of its band buckets, which links groups of near copies with
about as many pairs as members. Where the documents under one leader still lie in different classes, those outside the largest class are
compared with all others exactly, in blocks of bounded size inside tasks; only links that are found leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from protlake.llm import textkit as tk
from protlake.llm.keys import with_text_ids
from protlake.operators.ranking import best_per_group
from protlake.session import Scratch, staged

BANDS, ROWS = 24, 5
BLOCK = 256  # documents on either side of an exact block comparison

SIGNATURE_SCHEMA = "doc_id long, shingles long, content_a long, content_b long, bands array<long>"


def _uniform(seed: np.ndarray) -> np.ndarray:
    return ((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _units(doc: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (document, shingle) and their counts."""
    order = np.lexsort((shingle, doc))
    doc, shingle = doc[order], shingle[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (shingle[1:] != shingle[:-1])
    at = np.flatnonzero(new)
    return doc[at], shingle[at], np.diff(np.append(at, len(doc)))


def bag_signatures(doc: np.ndarray, shingle: np.ndarray, docs: int, size: int) -> np.ndarray:
    """Signatures of ``docs`` multisets: component values as raw time bits, shape (docs, size).

    A document without shingles has infinite values throughout.
    """
    doc, shingle, count = _units(doc, shingle)
    total = np.bincount(doc, weights=count, minlength=docs)
    blocks = [(doc, tk.mix(shingle), np.zeros(len(doc), np.int64), np.ones(len(doc), np.int64), count)]
    low = 1
    while len(more := np.flatnonzero(count > low)):
        blocks.append((doc[more], tk.mix(shingle[more] + np.uint64(low * 0x9E3779B97F4A7C15 % 2**64)),
                       np.full(len(more), low), np.full(len(more), low), count[more]))
        low *= 2
    owner, seed, base, width, limit = (np.concatenate(x) for x in zip(*blocks, strict=True))
    out = np.full((docs, size), np.inf)
    open_docs, spread = total > 0, np.log(size) + 3.0
    while open_docs.any():
        # by this time each component of a document has a point with a high probability; otherwise go on to twice the time
        horizon = np.where(open_docs, spread / np.maximum(total, 1), -1.0)
        live = np.flatnonzero(open_docs[owner])
        rate, state = width[live] * float(size), seed[live]
        time = -np.log(_uniform(state)) / rate
        keep = time <= horizon[owner[live]]
        live, rate, state, time = live[keep], rate[keep], state[keep], time[keep]
        while len(live):
            state = tk.mix(state + np.uint64(0xD1B54A32D192ED03))
            component = (state % np.uint64(size)).astype(np.int64)
            slot = base[live] + ((state >> np.uint64(20)) % width[live].astype(np.uint64)).astype(np.int64)
            good = slot < limit[live]
            np.minimum.at(out.reshape(-1), owner[live[good]] * size + component[good], time[good])
            state = tk.mix(state + np.uint64(0x8CB92BA72F3D8DD7))
            time = time - np.log(_uniform(state)) / rate
            keep = time <= horizon[owner[live]]
            live, rate, state, time = live[keep], rate[keep], state[keep], time[keep]
        filled = (out <= np.maximum(horizon, 0)[:, None]).all(axis=1)
        open_docs &= ~filled
        spread *= 2
    return out.view(np.uint64)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def _signature_rows(ids: list, texts: list, bands: int, rows: int, k: int) -> pa.RecordBatch:
    words = tk.Words(texts, tk.NON_WORD, lower=True)
    doc, hashes = tk.shingles(words, k)
    n, size = len(texts), bands * rows
    values = tk.mix(bag_signatures(doc, hashes, n, size) + np.arange(size, dtype=np.uint64))
    keys = np.zeros((n, bands), np.uint64)
    for b in range(bands):
        key = np.full(n, b + 1, np.uint64)
        for r in range(rows):
            key = tk.mix(key * np.uint64(0x9E3779B97F4A7C15) + values[:, b * rows + r])
        keys[:, b] = key
    content = []
    for step in (0xA0761D6478BD642F | 1, 0xE7037ED1A0B428DB | 1):
        prefix, inverse = tk.sequence_prefix(words.hash, step)
        content.append(_signed(tk.span_hash(prefix, inverse, words.first[:-1], words.first[1:])))
    flat = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * bands, pa.int32()), pa.array(_signed(keys).reshape(-1)))
    return pa.RecordBatch.from_arrays(
        [pa.array(ids, pa.int64()), pa.array(np.bincount(doc, minlength=n).astype(np.int64)), pa.array(content[0]), pa.array(content[1]), flat],
        names=["doc_id", "shingles", "content_a", "content_b", "bands"])


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, k: int = 5) -> DataFrame:
    """One row per document: shingle count, content hash and band keys. Needs ``doc_id`` and ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for a, b in tk.grouped(texts):
                yield _signature_rows(ids[a:b], texts[a:b], bands, rows, k)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SIGNATURE_SCHEMA)


def _bag(text: str | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    _, hashes = tk.shingles(tk.Words([text], tk.NON_WORD, lower=True), k)
    return np.unique(hashes, return_counts=True)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets given as (sorted values, counts); 0 if either is empty."""
    _, at, bt = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    shared = int(np.minimum(a[1][at], b[1][bt]).sum())
    union = int(a[1].sum() + b[1].sum()) - shared
    return shared / union if shared else 0.0


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """``id`` and ``t`` of the documents named in ``ids``. Both sides grow with the data, so neither is to be broadcast."""
    source = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("t"))
    return source.join(ids.hint("merge"), "id", "left_semi")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float, k: int = 5) -> DataFrame:
    """Of the pairs (a, b), those whose texts have at least ``threshold`` weighted Jaccard similarity, with ``similarity``.

    The pairs of one b stand together after the join, so its bag is made once per run.
    """
    joined = (pairs.join(texts.select(F.col("id").alias("a"), F.col("t").alias("ta")).hint("merge"), "a")
              .join(texts.select(F.col("id").alias("b"), F.col("t").alias("tb")).hint("merge"), "b").select("a", "b", "ta", "tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bag = None, None
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            out = np.zeros(len(a))
            for i in range(len(a)):
                if last != b[i]:
                    last, bag = b[i], _bag(batch.column(3)[i].as_py(), k)
                out[i] = overlap(_bag(batch.column(2)[i].as_py(), k), bag)
            keep = pa.array(np.flatnonzero(out >= threshold - 1e-12))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(out).take(keep)], names=["a", "b", "similarity"])

    return joined.mapInArrow(run, "a long, b long, similarity double")


def block_overlap(texts: list, left: np.ndarray, right: np.ndarray, k: int) -> np.ndarray:
    """Weighted Jaccard similarity of every left text with every right one.

    The j-th occurrence of a shingle is a unit of its own, so the shared weight of two bags is a product of 0/1 rows; units of a single text need no column.
    """
    units, owners = [], []
    for a, b in tk.grouped(texts):
        doc, shingle, count = _units(*tk.shingles(tk.Words(texts[a:b], tk.NON_WORD, lower=True), k))
        occurrence = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
        units.append(tk.mix(np.repeat(shingle, count) + occurrence.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        owners.append(np.repeat(doc, count) + a)
    unit, owner = np.concatenate(units), np.concatenate(owners)
    size = np.bincount(owner, minlength=len(texts)).astype(np.float64)
    order = np.argsort(unit, kind="stable")
    unit, owner = unit[order], owner[order]
    new = np.append(True, unit[1:] != unit[:-1]) if len(unit) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    common = np.bincount(column, minlength=1)[column] > 1 if len(unit) else np.zeros(0, bool)
    column, owner = column[common], owner[common]
    column = np.cumsum(np.append(True, column[1:] != column[:-1])) - 1 if len(column) else column
    shared = np.zeros((len(left), len(right)))
    at, step = 0, 8192
    while at < len(column):
        to = int(np.searchsorted(column, column[at] + step))
        rows = np.zeros((len(texts), step), np.float32)
        rows[owner[at:to], column[at:to] - column[at]] = 1
        shared += rows[left] @ rows[right].T
        at = to
    union = size[left][:, None] + size[right][None, :] - shared
    return np.divide(shared, union, out=np.zeros_like(shared), where=union > 0)


def cross_links(star: DataFrame, roots: DataFrame, texts: DataFrame, threshold: float, k: int, scratch: Scratch, block: int = BLOCK) -> DataFrame:
    """Links (a, b) between documents under one leader that lie in different classes; at least one for any two classes that have one.

    ``star``: pairs (a, b) of a document and its leader, ``roots``: classes so far. Documents of a leader's largest class meet only
    those outside of it. Both sides are dealt into parts of about ``block`` documents, and every pair of parts is one group.
    """
    placed = star.join(roots.select(F.col("id").alias("a"), "root").hint("merge"), "a", "left").select(F.col("b").alias("leader"), "a", F.coalesce("root", "a").alias("root"))
    sizes = placed.groupBy("leader", "root").agg(F.count(F.lit(1)).alias("n")).groupBy("leader").agg(
        F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("all"), F.count(F.lit(1)).alias("classes")).filter("classes > 1")
    # written first: a join on plain shuffles is split where one leader has most of the documents
    parts = scratch.table(sizes.select("leader", F.col("top.root").alias("major"), F.ceil((F.col("all") - F.col("top.n")) / block).cast("int").alias("left_parts"),
                                       F.ceil(F.col("all") / block).cast("int").alias("right_parts")))
    rest = placed.join(parts.hint("merge"), "leader").join(texts.select(F.col("id").alias("a"), "t").hint("merge"), "a")
    own = [F.pmod(F.xxhash64("a", F.lit(i)), F.col(c)).cast("int") for i, c in enumerate(("left_parts", "right_parts"))]
    as_left = F.transform(F.sequence(F.lit(0), F.col("right_parts") - 1), lambda p: F.struct(own[0].alias("x"), p.alias("y"), F.lit(True).alias("left")))
    as_right = F.transform(F.sequence(F.lit(0), F.col("left_parts") - 1), lambda p: F.struct(p.alias("x"), own[1].alias("y"), F.lit(False).alias("left")))
    places = F.when(F.col("root") == F.col("major"), as_right).otherwise(F.concat(as_left, as_right))
    dealt = rest.withColumn("place", F.explode(places)).select("leader", "place.x", "place.y", "a", "root", "place.left", "t")

    def run(group: pa.Table) -> pa.Table:
        ids, root, side = (group[c].to_numpy() for c in ("a", "root", "left"))
        left, right = np.flatnonzero(side), np.flatnonzero(~side)
        if not len(left) or not len(right):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        close = block_overlap(group["t"].to_pylist(), left, right, k) >= threshold - 1e-12
        i, j = np.nonzero(close & (root[left][:, None] != root[right][None, :]))
        pairs = np.stack((root[left[i]], root[right[j]]), axis=1)
        _, first = np.unique(pairs, axis=0, return_index=True)
        return pa.table({"a": ids[left[i[first]]], "b": ids[right[j[first]]]})

    return dealt.groupBy("leader", "x", "y").applyInArrow(run, "a long, b long")


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Smallest reachable id (``root``) of every ``id`` that stands in an edge (a, b).

    Labels pass along the edges and then jump to their label's label; each round ends in files, so lineage stays short.
    """
    both = scratch.table(edges.select(F.col("a").alias("id"), F.col("b").alias("other")).union(edges.select("b", "a")).distinct())
    labels = scratch.table(both.groupBy("id").agg(F.min("other").alias("m")).select("id", F.least("id", "m").alias("root")))
    while True:
        near = both.join(labels.select(F.col("id").alias("other"), "root"), "other").groupBy("id").agg(F.min("root").alias("near"))
        best = labels.join(near, "id").select("id", F.col("root").alias("old"), F.least("root", "near").alias("mid"))
        jumped = best.join(labels.select(F.col("id").alias("mid"), F.col("root").alias("far")), "mid", "left")
        after = scratch.table(jumped.select("id", "old", F.least("mid", F.coalesce("far", "mid")).alias("root")))
        labels = after.select("id", "root")
        if after.filter("root <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, threshold: float = 0.8, k: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per document: ``doc_id``, ``class_id`` (the smallest doc_id of its class) and ``kept`` (whether it is that document).

    Words are runs of letters and digits, in lower case. Documents with the same words in the same order are one class from the
    start; other links are pairs of weighted Jaccard similarity ``threshold`` or more over ``k``-word shingles, and classes are the
    connected parts. A text with fewer than ``k`` words is one shingle. A null, empty or wordless text is a class of its own.
    A null doc_id takes no part and has a null class (kept). Rows that repeat a doc_id share its class. Other columns are not read.
    """
    with Scratch(docs.sparkSession, "minhash") as scratch, tk.batches(docs.sparkSession):
        sig = scratch.table(signatures(docs, bands, rows, k))
        usable = sig.filter("doc_id is not null and shingles > 0")
        copies = scratch.table(usable.groupBy("content_a", "content_b").agg(F.min("doc_id").alias("first_copy")))
        firsts = usable.join(copies.select(F.col("first_copy").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi")
        buckets = scratch.table(firsts.select("doc_id", F.explode("bands").alias("band")))
        leaders = buckets.groupBy("band").agg(F.min("doc_id").alias("leader"), F.max("doc_id").alias("last")).filter("leader < last")
        star = scratch.table(buckets.join(leaders.select("band", "leader").hint("merge"), "band").filter("doc_id <> leader")
                             .select(F.col("doc_id").alias("a"), F.col("leader").alias("b")).distinct())
        texts = scratch.table(texts_of(docs, star.select(F.col("a").alias("id")).union(star.select("b")).distinct()))
        links = scratch.table(verified(star, texts, threshold, k).select("a", "b"))
        roots = components(links, scratch)
        found = scratch.table(cross_links(star, roots, texts, threshold, k, scratch))
        if not found.isEmpty():
            roots = components(links.union(found), scratch)
        classes = copies.join(roots.withColumnRenamed("id", "first_copy"), "first_copy", "left").select(
            F.col("content_a").alias("ca"), F.col("content_b").alias("cb"), F.coalesce("root", "first_copy").alias("class_id"))
        named = (sig.withColumn("usable", F.expr("doc_id is not null and shingles > 0"))
                 .join(classes, (F.col("content_a") == F.col("ca")) & (F.col("content_b") == F.col("cb")) & F.col("usable"), "left"))
        own = F.coalesce("class_id", "doc_id")
        return staged(named.select("doc_id", own.alias("class_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept")), "minhash-classes")


def deduplicated(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs`` with one document of each class: the one with the smallest doc_id and, of several texts under it, the smallest hash.

    Different texts under one doc_id are different documents, the further ones in order behind all doc_ids; a row goes only if a row of its own class stays. Of
    rows that repeat a doc_id and its text one stays, by the hash of its other columns. Columns stay as they are, whatever their names. Rows without a doc_id stay.
    """
    named, repeated = with_text_ids(docs.filter("doc_id is not null"))
    kept = (near_duplicates(named.select(F.col("__id").alias("doc_id"), "text"), threshold).filter("kept").select(F.col("doc_id").alias("__kept")).distinct().hint("merge"))
    one = named.join(kept, F.col("__id") == F.col("__kept"), "left_semi")
    if repeated:
        one = best_per_group(one, ["__id"], [F.sha2(F.to_json(F.struct(*docs.columns)), 256)])
    return one.select(*docs.columns).unionByName(docs.filter("doc_id is null"))
