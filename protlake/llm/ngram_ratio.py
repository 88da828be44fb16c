"""Quality rules and the hashed n-gram log-likelihood ratio of a trusted target against the raw corpus.

One pass counts hashed n-grams in all documents (the raw corpus) and, of the documents that the labels call good, in the trusted target. Single words and runs of
symbols make one multinomial, pairs of adjacent words another. The ratio of a slot is the logarithm of its target count over the count
that the raw corpus would give a text of the target's size, both smoothed by the same number, so slots with little evidence count little. A document's score in each
order is the sum over its n-grams, divided by their number. A part of the trusted documents is kept out of the target; the threshold of each order is the score
that all but a given share of those reach, and every document is judged by these two numbers. Every trusted document is in one of the two parts.

A table has 2**bits slots of four bytes, ``bits`` growing with the logarithm of the corpus between two fixed bounds, so what is sent to the tasks is bounded.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from protlake.llm import textkit as tk
from protlake.session import Scratch, staged

LEAST_BITS, MOST_BITS = 18, 22
SMOOTHING = 2.0  # added to the target's count of a slot and to the count expected of it
LOSS = (0.01, 0.005)  # share of held-out trusted documents below the threshold, by order
HELD_OUT = 3  # one in so many trusted documents is kept out of the target
BROADCAST = 500_000  # trusted ids up to which they are sent to every task; beyond, the texts are dealt by id and counted there
STEP = 1e-4  # width of a score step in the search for a threshold

_SYMBOL = np.zeros(256, bool)
_SYMBOL[33:127] = [not chr(c).isalnum() for c in range(33, 127)]
_COUNTED = np.zeros(256, bool)
_COUNTED[[ord(c) for c in "#*$%&|<>"]] = True
_LINE = np.zeros(256, bool)
_LINE[10] = True
_SYMBOL_SEED, _PAIR_STEP = np.uint64(0x8EBC6AF09C88C6E3), np.uint64(0x589965CC75374CC3)


def ngrams(texts: list) -> list[tuple[np.ndarray, np.ndarray]]:
    """Text number and hash of every n-gram, for each order: words in lower case with runs of symbols, and pairs of adjacent words."""
    words, symbols = tk.Words(texts, tk.NON_WORD, lower=True), tk.Words(texts, ~_SYMBOL)
    one = np.concatenate((words.doc, symbols.doc)), np.concatenate((words.hash, tk.mix(symbols.hash ^ _SYMBOL_SEED)))
    near = words.doc[1:] == words.doc[:-1]
    pair = tk.mix(words.hash[:-1] * _PAIR_STEP + words.hash[1:])
    return [one, (words.doc[1:][near], pair[near])]


def slots(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _per_text(mask: np.ndarray, words: tk.Words) -> np.ndarray:
    total = np.concatenate(([0], np.cumsum(mask)))
    return total[words.offsets[1:] - 1] - total[words.offsets[:-1]]


def _repeats(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Which entries share text and key with another, and which of them are not the first."""
    order = np.lexsort((np.arange(len(key)), key, doc))
    same = np.zeros(len(key) + 1, bool)
    same[1:-1] = (key[order][1:] == key[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    found = np.zeros((2, len(key)), bool)
    found[0, order], found[1, order] = same[:-1] | same[1:], same[:-1]
    return found


def base_counts(texts: list, window: int = 5) -> dict[str, np.ndarray]:
    """The rule counts of each text."""
    words = tk.Words(texts, tk.SPACE)
    raw = np.frombuffer(b"\n".join((t or "").encode("utf-8", "surrogatepass") for t in texts) + b"\n", np.uint8)
    prefix, inverse = tk.sequence_prefix(words.hash)
    many = np.maximum(words.count - window + 1, 0)
    doc = np.repeat(np.arange(len(texts)), many)
    start = words.first[:-1][doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
    again, _ = _repeats(doc, tk.span_hash(prefix, inverse, start, start + window))
    cover = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(cover, start[again], 1)
    np.add.at(cover, start[again] + window, -1)
    covered = np.cumsum(cover)[:-1] > 0
    begin, end, line = tk.split_words(raw.tobytes(), _LINE)
    filled = np.concatenate(([0], np.cumsum(~tk.SPACE[raw])))
    own = np.searchsorted(words.offsets, begin, side="right") - 1
    worded = filled[end] > filled[begin]
    _, later = _repeats(own[worded], line[worded])
    n = len(texts)
    return {"n_words": words.count, "word_chars": _per_text(~tk.SPACE[raw] & ((raw & 0xC0) != 0x80), words), "n_symbols": _per_text(_COUNTED[raw], words),
            "n_dup_lines": np.bincount(own[worded][later], minlength=n), "n_repeat_words": np.bincount(words.doc[covered], minlength=n)}


def _bits(docs: DataFrame) -> int:
    """Slots grow with the square root of the letters from 2**18 up to 2**34 letters on."""
    letters = docs.agg(F.sum(F.length(F.col("text").cast("string")))).first()[0] or 0
    return min(MOST_BITS, LEAST_BITS + max(0, math.ceil((math.log2(max(letters, 1)) - 34) / 2)))


def trusted_ids(labels: DataFrame, held_out: int = HELD_OUT) -> DataFrame:
    """``id`` and ``part`` (1: target, 2: held out) of all documents that all their labels call good and not toxic."""
    good = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("id")).agg(
        F.min(F.coalesce(F.col("quality") == 1, F.lit(False)) & F.coalesce(F.col("toxic") == 0, F.lit(False))).alias("good")).filter("good")
    return good.select("id", F.when(F.pmod(F.xxhash64("id", F.lit(1)), F.lit(held_out)) == 0, 2).otherwise(1).alias("part"))


def _marked(rows: DataFrame, trusted: DataFrame) -> DataFrame:
    """``t``, ``part`` (0: not trusted) of all ``rows`` (id, t). Many ids make hash tables by key range, without a sort of the texts; AQE splits a partition that a frequent id makes large."""
    side = F.broadcast(trusted) if trusted.count() <= BROADCAST else trusted.hint("shuffle_hash")
    return rows.join(side, "id", "left").select("t", F.coalesce("part", F.lit(0)).alias("part"))


def slot_counts(marked: DataFrame, bits: int) -> DataFrame:
    """``place`` (order * 2**bits + slot), ``raw`` and ``target`` counts over all documents (text, part)."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(2 << bits, np.int64), np.zeros(2 << bits, np.int64)
        for batch in batches:
            texts, part = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b in tk.grouped(texts):
                for order, (doc, hashes) in enumerate(ngrams(texts[a:b])):
                    place = slots(hashes, bits) + (order << bits)
                    for counts, of in ((raw, place), (target, place[(part[a:b] == 1)[doc]])):
                        at, times = np.unique(of, return_counts=True)
                        counts[at] += times
        at = np.flatnonzero(raw)
        for k in range(0, len(at), 1 << 16):
            some = at[k:k + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(raw[some]), pa.array(target[some])], names=["place", "raw", "target"])

    return marked.select("t", "part").mapInArrow(count, "place int, raw long, target long").groupBy("place").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))


def ratios(counts: DataFrame, bits: int, smoothing: float = SMOOTHING) -> np.ndarray:
    """Log-likelihood ratios by order and slot, 0 where the corpus has nothing. ``counts`` has at most 2 * 2**bits rows."""
    found = counts.toArrow()
    raw, target = np.zeros(2 << bits), np.zeros(2 << bits)
    place = found["place"].to_numpy()
    raw[place], target[place] = found["raw"].to_numpy(), found["target"].to_numpy()
    out = np.zeros((2, 1 << bits), np.float32)
    for order in range(2):
        r, t = raw[order << bits:(order + 1) << bits], target[order << bits:(order + 1) << bits]
        if r.sum():
            out[order] = np.log((t + smoothing) / (r * (t.sum() / r.sum()) + smoothing))
    return out


def _threshold(scores: DataFrame, name: str, loss: float) -> float | None:
    """The upper end of the score steps that together hold at most ``loss`` of the rows; a pass over counts by step, so reruns agree."""
    steps = scores.filter(f"{name} is not null").groupBy(F.floor(F.col(name) / STEP).alias("step")).count()
    total = steps.agg(F.sum("count")).first()[0]
    if not total:
        return None
    below = 0
    for step, count in steps.orderBy("step").toLocalIterator():  # of a bounded range
        below += count
        if below > loss * total:
            return step * STEP
    return None


SCORES = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score_1 double, score_2 double"


def judged(docs: DataFrame, labels: DataFrame, loss: tuple[float, float] = LOSS, smoothing: float = SMOOTHING, held_out: int = HELD_OUT) -> DataFrame:
    """One row per document: ``doc_id``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``, ``n_repeat_words``, ``base_failed``, ``kept`` and both scores.

    Words are runs without ASCII white space. ``base_failed``: fewer than 10 words, or over a fifth of the words in repeated five-word windows. ``kept`` needs the base rules and, in each order
    that the document has n-grams of, a score at or above the threshold. Null and empty texts have no words and fail; rows with a null doc_id are judged like others and never
    trusted; repeated rows stay and count in the corpus. A document with contradicting labels is not trusted; without labels all scores are 0 and the base rules alone decide.
    Of ``docs`` only ``doc_id`` and ``text`` are read, of ``labels`` ``doc_id``, ``quality`` and ``toxic``.
    """
    spark = docs.sparkSession
    with Scratch(spark, "ngram-ratio") as scratch, tk.batches(spark):
        trusted = scratch.table(trusted_ids(labels, held_out))
        rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("t"))
        bits = _bits(docs)
        table = ratios(scratch.table(slot_counts(_marked(rows, trusted), bits)), bits, smoothing)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for a, b in tk.grouped(texts):
                    base = base_counts(texts[a:b])
                    found = []
                    for order, (doc, hashes) in enumerate(ngrams(texts[a:b])):
                        many = np.bincount(doc, minlength=b - a)
                        total = np.bincount(doc, weights=table[order][slots(hashes, bits)], minlength=b - a)
                        found.append(pa.array(total / np.maximum(many, 1), mask=many == 0))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(v.astype(np.int64)) for v in base.values()], *found],
                                                     names=["doc_id", *base, "score_1", "score_2"])

        scores = staged(rows.mapInArrow(score, SCORES), "ngram-ratio-scores")
        held = trusted.filter("part = 2")
        tested = scratch.table(scores.join(held, scores.doc_id == held.id).select("score_1", "score_2"))
        limits = [_threshold(tested, f"score_{i + 1}", share) for i, share in enumerate(loss)]

    def passes(order: int) -> Column:
        limit = limits[order - 1]
        return F.lit(True) if limit is None else F.coalesce(F.col(f"score_{order}") >= F.lit(limit), F.lit(True))

    failed = (F.col("n_words") < 10) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 20)
    return scores.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~failed & passes(1) & passes(2)).alias("kept"), "score_1", "score_2")
