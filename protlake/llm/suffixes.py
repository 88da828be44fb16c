"""Repeated passages across documents by a sparse suffix array.

Only suffixes that begin at minimiser positions are kept: in every window of ``length`` words the k-word run with the smallest hash
is the window's anchor, so two equal windows have their anchors at the same place and about one word in twenty starts a suffix.
Suffixes are sorted over the cluster by the hash of their first k words, then by place; neighbours with equal heads from different documents
survive. A surviving match is then extended to the left and right: first by one hash of everything that the anchor's windows cover
(equal for whole copies), then, for suffixes that share the head but not all around it, window by window.

A window of ``length`` words is repeated when an earlier document (smaller doc_id) holds the same words; the repeated part of a document is the
union of its repeated windows. The earliest document keeps its passage, and repeats inside one document don't count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from protlake.llm import textkit as tk
from protlake.llm.keys import with_text_ids
from protlake.session import Scratch, staged

LENGTH, HEAD = 50, 10
SORTED_ROWS = 400_000  # suffixes in one sorted part

_INDEX = np.uint64((1 << 28) - 1)


def _window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values."""
    have, out = 1, values
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:len(out) - rest], out[rest:]) if rest else out


def _around(prefix: np.ndarray, inverse: np.ndarray, first: np.ndarray, last: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Hash of the words [first, last) that an anchor's windows cover, and of the anchor's place in them."""
    return tk.mix(tk.span_hash(prefix, inverse, first, last) + place.astype(np.uint64))


def anchors_of(texts: list, length: int = LENGTH, head: int = HEAD) -> dict[str, np.ndarray]:
    """Anchors of all windows of the texts.

    ``doc``: number of the text; ``pos``: the anchor's word; ``lo``, ``hi``: first and last start of the windows it
    stands for; ``head``: hash of its k words; ``around``: hash of all words that those windows cover, and of its place in them.
    """
    words = tk.Words(texts, tk.SPACE)
    n = len(words.hash)
    if n < length:
        return {c: np.zeros(0, np.int64) for c in ("doc", "pos", "lo", "hi", "head", "around")}
    prefix, inverse = tk.sequence_prefix(words.hash)
    at = np.arange(n - head + 1)
    grams = tk.span_hash(prefix, inverse, at, at + head)
    ranked = (grams & ~_INDEX) | at.astype(np.uint64)  # equal runs: the leftmost
    anchor = (_window_min(ranked, length - head + 1) & _INDEX).astype(np.int64)
    start = np.flatnonzero(words.doc[:n - length + 1] == words.doc[length - 1:])
    anchor = anchor[start]
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    lo, pos = start[first], anchor[first]
    hi = start[np.append(first[1:], len(start)) - 1] if len(first) else first
    doc = words.doc[lo]
    around = _around(prefix, inverse, lo, hi + length, pos - lo)
    base = words.first[doc]
    return {"doc": doc, "pos": pos - base, "lo": lo - base, "hi": hi - base, "head": grams[pos].view(np.int64), "around": around.view(np.int64)}


def suffixes(docs: DataFrame, length: int = LENGTH, head: int = HEAD) -> DataFrame:
    """The sparse suffixes of all documents, unsorted."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in tk.grouped(texts):
                found = anchors_of(texts[a:b], length, head)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(found["head"]), pa.array(found["around"]), pa.array(ids[a:b][found["doc"]], pa.int64()),
                     *[pa.array(found[c].astype(np.int32)) for c in ("pos", "lo", "hi")]], names=["head", "around", "doc_id", "pos", "lo", "hi"])

    return _texts(docs).mapInArrow(run, "head long, around long, doc_id long, pos int, lo int, hi int")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def shared_suffixes(found: DataFrame, scratch: Scratch) -> DataFrame:
    """Sort the suffixes and keep those whose head another document has too.

    Parts are ranges of (head, document, place), so a frequent head spreads over several parts. Heads at a part's borders, at most two a
    part, are settled together afterwards.
    """
    spark = found.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-found.count() // SORTED_ROWS))
    ordered = found.repartitionByRange(parts, "head", "doc_id", "pos").sortWithinPartitions("head", "doc_id", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [b for b in batches if b.num_rows]
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        heads, ids = table["head"].to_numpy(), table["doc_id"].to_numpy()
        start = np.flatnonzero(np.append(True, heads[1:] != heads[:-1]))
        run_of = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(heads))))
        shared = ids[start] != ids[np.append(start[1:], len(ids)) - 1]
        border = np.zeros(len(start), bool)
        border[[0, -1]] = True
        keep = np.flatnonzero((shared | border)[run_of])
        out = table.take(pa.array(keep))
        out = out.append_column("shared", pa.array(shared[run_of[keep]])).append_column("border", pa.array(border[run_of[keep]]))
        yield from out.to_batches(max_chunksize=50_000)

    near = scratch.table(ordered.mapInArrow(run, "head long, around long, doc_id long, pos int, lo int, hi int, shared boolean, border boolean"))
    across = (near.filter("border").groupBy("head").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("head"))
    columns = ["head", "around", "doc_id", "pos", "lo", "hi"]
    return near.filter("shared").select(*columns).union(near.filter("border and not shared").join(across, "head", "left_semi").select(*columns))


def _windows(texts: DataFrame, length: int) -> DataFrame:
    """Hash and start of the windows in ``ranges`` (array of lo, hi, pos, around, copied) of each text.

    ``around``, of a range with ``copied``, and the place in the range (``nth``) go along. Ranges of another text under the same doc_id are
    passed over.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts, ranges = (batch.column(i).to_pylist() for i in range(3))
            for a, b in tk.grouped(texts):
                words = tk.Words(texts[a:b], tk.SPACE)
                prefix, inverse = tk.sequence_prefix(words.hash)
                spans = [(i, r["lo"], r["hi"], r["pos"], r["around"], r["copied"]) for i in range(b - a) for r in ranges[a + i]]
                doc, lo, hi, pos, around, copied = (np.array(x, np.int64) for x in zip(*spans, strict=True))
                first, last = words.first[doc] + lo, words.first[doc] + hi + length
                own = last <= words.first[doc + 1]  # always, unless one doc_id stands for several texts
                own[own] = _around(prefix, inverse, first[own], last[own], (pos - lo)[own]).view(np.int64) == around[own]
                doc, lo, hi, around, copied = doc[own], lo[own], hi[own], around[own], copied[own]
                width = hi - lo + 1
                nth = np.arange(width.sum()) - np.repeat(np.cumsum(width) - width, width)
                owner, start = np.repeat(doc, width), np.repeat(lo, width) + nth
                begin = words.first[owner] + start
                hashes = tk.span_hash(prefix, inverse, begin, begin + length)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes.view(np.int64)), pa.array(np.array(ids[a:b], np.int64)[owner]), pa.array(start.astype(np.int32)),
                     pa.array(np.repeat(around, width), mask=np.repeat(copied == 0, width)), pa.array(nth.astype(np.int32))],
                    names=["words", "doc_id", "start", "around", "nth"])

    return texts.mapInArrow(run, "words long, doc_id long, start int, around long, nth int")


SPANS_SCHEMA = "doc_id long, spans array<struct<start:int,end:int>>, repeated_words long, first_docs array<long>"


def _merged(spans: DataFrame) -> DataFrame:
    """Union of the word ranges (start, end) of each document and the documents they come from: ``first_doc`` or, if that is null, ``first_docs``."""
    grouped = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("spans"), F.collect_set("first_doc").alias("one"),
                                          F.collect_set("first_docs").alias("several"))
    grouped = grouped.withColumn("first_docs", F.array_union("one", F.flatten("several")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, totals = [], []
            for row in batch.column(1):
                s = np.sort(row.values.field("start").to_numpy())
                e = np.sort(row.values.field("end").to_numpy())
                cut = np.flatnonzero(s[1:] > e[:-1])  # a gap: as many ends as starts lie before it
                firsts, lasts = s[np.append(0, cut + 1)], e[np.append(cut, len(e) - 1)]
                out.append([{"start": int(x), "end": int(y)} for x, y in zip(firsts, lasts, strict=True)])
                totals.append(int((lasts - firsts).sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(totals, pa.int64()), batch.column(2)],
                names=["doc_id", "spans", "repeated_words", "first_docs"])

    return grouped.select("doc_id", "spans", F.array_sort("first_docs").alias("first_docs")).mapInArrow(run, SPANS_SCHEMA)


def repeated_passages(docs: DataFrame, length: int = LENGTH, head: int = HEAD) -> DataFrame:
    """One row per document with a passage of ``length`` words or more that an earlier document holds.

    ``doc_id``, ``spans`` (word ranges [start, end), merged, in order), ``repeated_words``, ``first_docs`` (the earliest holders).
    Words are runs outside [\\x20\\x09-\\x0D], compared exactly. Null, empty and shorter texts and rows without a doc_id have no
    passages; rows that repeat a doc_id are one document. Other columns are not read.
    """
    if not 1 <= head < length:
        raise ValueError("head must lie below length")
    with Scratch(docs.sparkSession, "suffixes") as scratch, tk.batches(docs.sparkSession):
        shared = shared_suffixes(scratch.table(suffixes(docs, length, head)), scratch)
        # written first: a join on plain shuffles is split where one passage holds most of the rows
        firsts = scratch.table(shared.groupBy("around").agg(F.min("doc_id").alias("first_doc"), (F.max("doc_id") > F.min("doc_id")).alias("copied")))
        placed = scratch.table(shared.join(firsts, "around"))

        rest = placed.filter("doc_id = first_doc").select("head", "doc_id", "lo", "hi", "pos", "around", "copied")
        # written like firsts, so that the join below is one on plain shuffles and a head with most of the rows is split
        rest = scratch.table(rest)
        several = scratch.table(rest.groupBy("head").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).filter("a < b").select("head"))
        ranges = (rest.join(several, "head", "left_semi").drop("head").distinct()
                  .groupBy("doc_id").agg(F.collect_list(F.struct("lo", "hi", "pos", "around", "copied")).alias("ranges")))
        # ids with ranges grow with the data: no side is to be broadcast
        windows = scratch.table(_windows(_texts(docs).join(ranges.hint("merge"), "doc_id").select("doc_id", "text", "ranges"), length))
        earliest = scratch.table(windows.groupBy("words").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc")).filter("first_doc < last_doc"))
        single = scratch.table(windows.join(earliest, "words").filter("doc_id > first_doc").select("doc_id", "start", "first_doc", "around", "nth"))

        # where the first of equal surroundings has windows of a still earlier document, the others have them of that document as well;
        # a set has at most one row for each window of an anchor
        held = scratch.table(single.filter("around is not null").groupBy("around").agg(F.collect_set(F.struct("nth", "first_doc")).alias("held")))
        earlier = F.array_distinct(F.col("held.first_doc"))
        first_docs = F.when(F.size("held") <= F.col("hi") - F.col("lo"), F.array_append(earlier, F.col("first_doc"))).otherwise(earlier)
        whole = (placed.filter("doc_id > first_doc").join(held, "around", "left")
                 .select("doc_id", F.col("lo").alias("start"), (F.col("hi") + length).alias("end"),
                         F.when(F.col("held").isNull(), F.col("first_doc")).alias("first_doc"), F.when(F.col("held").isNotNull(), first_docs).alias("first_docs")))
        single = single.select("doc_id", "start", (F.col("start") + length).alias("end"), "first_doc", F.lit(None).cast("array<long>").alias("first_docs"))
        return staged(_merged(whole.union(single)), "suffix-spans")


@F.pandas_udf(T.StringType())
def _cut(texts, spans):
    out = []
    for text, ranges in zip(texts, spans, strict=True):
        if text is None or ranges is None:
            out.append(None)
            continue
        data = text.encode("utf-8", "surrogatepass")
        starts, _, _ = tk.split_words(data, tk.SPACE)
        borders = np.append(starts, len(data))
        kept, at = [], 0
        for r in ranges:
            kept.append(data[at:borders[min(r["start"], len(starts))]])
            at = borders[min(r["end"], len(starts))]
        kept.append(data[at:])
        out.append(b"".join(kept).decode("utf-8", "surrogatepass"))
    import pandas as pd
    return pd.Series(out)


def cut(text: Column, spans: Column) -> Column:
    """``text`` without the word ranges ``spans``; each range goes with the white space behind its words. Null without spans."""
    return _cut(text, spans)


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with repeated passages cut from the text (and n_chars, if there, set anew).

    A document of which no word is left goes; one without repeats stays as it is, and so do null and empty texts and rows without a doc_id. Different texts under one doc_id are
    different documents, the further ones later than all doc_ids; a text loses only its own passages. Columns stay.
    """
    named, _ = with_text_ids(docs, "__doc")
    spans = repeated_passages(named.select(F.col("__doc").alias("doc_id"), "text"), length).select(F.col("doc_id").alias("__id"), F.col("spans").alias("__spans"))
    joined = named.join(spans.hint("merge"), F.col("__doc") == F.col("__id"), "left")
    hit = F.col("__spans").isNotNull()
    joined = joined.withColumn("__cut", cut(F.when(hit, F.col("text").cast("string")), F.col("__spans")))
    joined = joined.filter(~hit | F.col("__cut").rlike(r"[^\x20\x09-\x0D]"))
    columns = [F.when(hit, F.col("__cut")).otherwise(F.col(c)).alias(c) if c == "text"
               else F.when(hit, F.length("__cut")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return joined.select(*columns)
