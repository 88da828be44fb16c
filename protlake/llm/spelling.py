"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

The words are sorted by length and by the counts of their commonest letters and cut into blocks. Two words one edit apart differ by at most two
in the squared distance of their letter counts (a replaced letter is one less and one more, an inserted one is one more), and by at most one in length. So
blocks of equal or adjacent length meet; inside a task a matrix product of the count vectors gives all squared distances of a pair of sub-blocks, pairs
at 1 or 2 remain, and comparing the letters themselves decides. Blocks and sub-blocks whose ranges of letter counts lie more than two apart in the squared distance
hold no such pair and are passed over; that bound is exact. Of each pair of blocks only sums by word leave the task.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from protlake.llm import textkit as tk
from protlake.session import Scratch, staged

LEAST_LETTERS, LEAST_COUNT = 5, 3
BLOCK, BLOCK_BYTES, SUB = 8192, 1 << 20, 256  # words and bytes of a block, words of a sub-block
SORTED_BY = 12  # letters whose counts order the words of a length
SALTS = 16
HELD = 1 << 18  # distinct words a task holds before it hands its counts on
PIECE = 1 << 20  # letters of a text that are split at a time
DAMAGED_IN = 97  # every run whose checksum this divides loses a letter

RUN = re.compile("[A-Za-zÀ-ÿ]+")
BLOCK_SCHEMA = "block long, length int, words array<string>, counts array<long>, low array<int>, high array<int>"


def runs(text: str) -> Counter:
    """Counts of the runs of letters in ``text``, with A-Z in lower case. Long texts are split piece by piece, at ends of runs."""
    text = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes: ASCII letters only
    if len(text) <= PIECE:
        return Counter(RUN.findall(text))
    found, at = Counter(), 0
    while at < len(text):
        rest = RUN.match(text, min(at + PIECE, len(text)))
        end = rest.end() if rest else at + PIECE
        found.update(RUN.findall(text, at, end))
        at = end
    return found


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, damaged_in: int = DAMAGED_IN) -> DataFrame:
    """``word``, ``n`` of the damaged runs with at least ``least_letters`` letters that occur at least ``least_count`` times."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, int] = {}

        def given() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])

        for batch in batches:
            for number, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not text.is_valid:
                    continue
                seed = zlib.crc32(f"{'' if number is None else number}:".encode())
                for word, n in runs(text.as_py()).items():
                    if len(word) < least_letters:  # damage only shortens
                        continue
                    h = zlib.crc32(word.encode(), seed)
                    if h % damaged_in == 0:
                        word = word[:(k := h % len(word))] + word[k + 1:]
                    if len(word) >= least_letters:
                        held[word] = held.get(word, 0) + n
                if len(held) >= HELD:
                    yield given()
                    held.clear()
        if held:
            yield given()

    counted = docs.select(F.col("doc_id").cast("string").alias("id"), F.col("text").cast("string").alias("t")).mapInArrow(count, "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_count)


def _blocks(words: DataFrame) -> DataFrame:
    """``words`` (word, n) in blocks of one length, with the least and largest count of each of the commonest letters."""
    letters = [r.c for r in words.select(F.explode(F.split("word", "")).alias("c")).filter("c <> ''").groupBy("c").count()
               .orderBy(F.desc("count"), "c").limit(SORTED_BY).collect()]  # of an alphabet of 90
    counts = F.array(*[(F.length("word") - F.length(F.replace("word", F.lit(c)))).cast("int") for c in letters]) if letters else F.array().cast("array<int>")
    order = words.select(F.length("word").alias("length"), counts.alias("c"), "word", "n").repartitionByRange("length", "c", "word").sortWithinPartitions("length", "c", "word")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, number, rows = TaskContext.get().partitionId(), 0, []

        def block() -> pa.RecordBatch:
            c = np.array([r[1] for r in rows], np.int32).reshape(len(rows), -1)
            out = [[(at << 32) + number], [rows[0][0]], [[r[2] for r in rows]], [[r[3] for r in rows]], [c.min(0).tolist()], [c.max(0).tolist()]]
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32())]
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names=["block", "length", "words", "counts", "low", "high"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and (row[0] != rows[0][0] or len(rows) >= min(BLOCK, 1 + BLOCK_BYTES // row[0])):
                    yield block()
                    number, rows = number + 1, []
                rows.append(row)
        if rows:
            yield block()

    return order.mapInArrow(cut, BLOCK_SCHEMA)


def _apart(low_a: Column, high_a: Column, low_b: Column, high_b: Column) -> Column:
    """Least squared distance of two points in two boxes."""
    gaps = F.zip_with(F.zip_with(low_b, high_a, lambda x, y: x - y), F.zip_with(low_a, high_b, lambda x, y: x - y), lambda x, y: F.greatest(x, y, F.lit(0)))
    return F.aggregate(gaps, F.lit(0), lambda s, g: s + g * g)


def _meetings(blocks: DataFrame) -> DataFrame:
    """Pairs of block numbers (a, b) of equal or adjacent length that may hold near words. Of the blocks only their boxes are read."""
    salt = F.pmod(F.xxhash64("block"), F.lit(SALTS)).cast("int")
    left = blocks.select(F.col("block").alias("a"), F.col("length").alias("la"), F.col("low").alias("low_a"), F.col("high").alias("high_a"), salt.alias("salt"),
                         F.explode(F.array(F.col("length"), F.col("length") + 1)).alias("lb"))
    right = blocks.select(F.col("block").alias("b"), F.col("length").alias("lb"), F.col("low").alias("low_b"), F.col("high").alias("high_b"),
                          F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    near = _apart(F.col("low_a"), F.col("high_a"), F.col("low_b"), F.col("high_b")) <= 2
    return left.join(right, ["lb", "salt"]).filter((F.col("la") < F.col("lb")) | (F.col("a") <= F.col("b"))).filter(near).select("a", "b")


def _letters(words: list[bytes]) -> np.ndarray:
    """Words of one length as rows of letter codes."""
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1)


def _counts(codes: np.ndarray, used: np.ndarray) -> np.ndarray:
    place = np.full(256, -1)
    place[used] = np.arange(len(used))
    rows = np.repeat(np.arange(len(codes)), codes.shape[1])
    return np.bincount(rows * len(used) + place[codes.ravel()], minlength=len(codes) * len(used)).reshape(len(codes), -1)


def _one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows are one edit apart, by the letters; ``b`` has as many letters as ``a`` or one more."""
    n = a.shape[1]
    if b.shape[1] == n:
        return (a != b).sum(axis=1) == 1
    front, back = a == b[:, :-1], (a == b[:, 1:])[:, ::-1]
    lead = np.where(front.all(axis=1), n, front.argmin(axis=1))
    trail = np.where(back.all(axis=1), n, back.argmin(axis=1))
    return lead + trail >= n


def near_words(a: list[bytes], b: list[bytes] | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions (i in ``a``, j in ``b``) of all words one edit apart; without ``b`` the pairs i < j inside ``a``."""
    x = _letters(a)
    y = x if b is None else _letters(b)
    used = np.union1d(np.unique(x), np.unique(y))
    cx = _counts(x, used)
    cy = cx if b is None else _counts(y, used)
    nx, ny = (cx * cx).sum(axis=1), (cy * cy).sum(axis=1)
    exact = np.float32 if max(nx.max(), ny.max()) < 1 << 22 else np.float64
    starts_x, starts_y = np.arange(0, len(x), SUB), np.arange(0, len(y), SUB)
    low_x, high_x = np.minimum.reduceat(cx, starts_x), np.maximum.reduceat(cx, starts_x)
    low_y, high_y = np.minimum.reduceat(cy, starts_y), np.maximum.reduceat(cy, starts_y)
    # with the norms as two more columns the product is the squared distance itself
    fx = np.column_stack((-2 * cx, nx, np.ones_like(nx))).astype(exact)
    fy = np.ascontiguousarray(np.column_stack((cy, np.ones_like(ny), ny)).astype(exact).T)
    found_i, found_j = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, (1 << 22) // x.shape[1])
    for p, s in enumerate(starts_x):
        gap = np.maximum(np.maximum(low_y - high_x[p], low_x[p] - high_y), 0)
        for q in np.flatnonzero((gap * gap).sum(axis=1) <= 2):
            t = starts_y[q]
            if b is None and t < s:
                continue
            square = fx[s:s + SUB] @ fy[:, t:t + SUB]
            at = np.flatnonzero(square <= 2)
            i, j = np.divmod(at[square.ravel()[at] > 0], square.shape[1])
            i, j = i + s, j + t
            if b is None and s == t:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), step):
                good = _one_edit(x[i[k:k + step]], y[j[k:k + step]])
                found_i.append(i[k:k + step][good])
                found_j.append(j[k:k + step][good])
    return np.concatenate(found_i), np.concatenate(found_j)


NEAR_SCHEMA = "word string, n_near long, n long, form string"


def _sums(words: list[str], counts: np.ndarray, own: np.ndarray, other: np.ndarray) -> pa.RecordBatch:
    """For each word with a near one: how many, and the one of largest count, ties to the smaller word."""
    rank = np.empty(len(words), np.int64)
    rank[sorted(range(len(words)), key=words.__getitem__)] = np.arange(len(words))
    order = np.lexsort((rank[other], -counts[other], own))
    own, other = own[order], other[order]
    word, first, many = np.unique(own, return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays([pa.array([words[i] for i in word], pa.string()), pa.array(many.astype(np.int64)), pa.array(counts[other[first]]),
                                       pa.array([words[i] for i in other[first]], pa.string())], names=["word", "n_near", "n", "form"])


def _cells(cell: pa.ListScalar) -> np.ndarray:
    """A list cell as an array, without a Python scalar for each entry on the way."""
    return cell.values.to_numpy(zero_copy_only=False)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(batch.num_rows):
            a, b, words_a, words_b, counts_a, counts_b = (c[k] for c in batch.columns)
            words, counts = _cells(words_a).tolist(), _cells(counts_a)
            first = [w.encode("latin-1") for w in words]
            if a == b:
                i, j = near_words(first, None)
            else:
                others = _cells(words_b).tolist()
                i, j = near_words(first, [w.encode("latin-1") for w in others])
                words, counts, j = words + others, np.concatenate((counts, _cells(counts_b))), j + len(words)
            if len(i):
                yield _sums(words, counts, np.concatenate((i, j)), np.concatenate((j, i)))


def _roots(forms: DataFrame, scratch: Scratch) -> DataFrame:
    """The last ``root`` on the way from each ``word`` over its ``form``; pointers jump, so the rounds are the logarithm of the longest way."""
    links = scratch.table(forms.select("word", F.col("form").alias("root")))
    while True:
        far = links.select(F.col("word").alias("root"), F.col("root").alias("far"))
        after = scratch.table(links.join(far, "root", "left").select("word", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved")))
        links = after.select("word", "root")
        if after.filter("moved").isEmpty():
            return links


def variants(docs: DataFrame, least_letters: int = LEAST_LETTERS, least_count: int = LEAST_COUNT, damaged_in: int = DAMAGED_IN) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n``, ``root``: the words of all texts with their spelling variants.

    Words are runs of the letters A-Z, a-z and U+00C0 to U+00FF, A-Z in lower case; a run whose checksum with the doc_id ``damaged_in`` divides loses one letter. Two
    words are near if one inserted, deleted or replaced letter turns one into the other; a word's form is its near word of largest count (ties: the smaller one) if that
    is at least twice its own, and its root is the last word on the way over forms, at least doubling at each step. Null and empty texts have no words; a null doc_id counts
    as an empty one; repeated rows count again. Only ``doc_id`` and ``text`` are read.
    """
    spark = docs.sparkSession
    with Scratch(spark, "spelling") as scratch:
        with tk.batches(spark):
            words = scratch.table(word_counts(docs, least_letters, least_count, damaged_in))
        with tk.batches(spark, 1 << 15):
            blocks = scratch.table(_blocks(words))
        pairs = scratch.table(_meetings(blocks))
        a = blocks.select(F.col("block").alias("a"), F.col("words").alias("words_a"), F.col("counts").alias("counts_a"))
        b = blocks.select(F.col("block").alias("b"), F.col("words").alias("words_b"), F.col("counts").alias("counts_b"))
        with tk.batches(spark, 4):
            met = pairs.join(a, "a").join(b, "b").select("a", "b", "words_a", "words_b", "counts_a", "counts_b").mapInArrow(_met, NEAR_SCHEMA)
            best = F.min(F.struct((-F.col("n")).alias("n"), F.col("form")))
            near = scratch.table(met.groupBy("word").agg(F.sum("n_near").alias("n_near"), best.alias("best")))
        joined = words.join(near, "word", "left").withColumn("real", -F.col("best.n") >= 2 * F.col("n"))
        forms = scratch.table(joined.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(F.col("real"), F.col("best.form")).alias("form"),
                                            F.when(F.col("real"), -F.col("best.n")).alias("form_n")))
        roots = _roots(forms.filter("form is not null"), scratch)
        return staged(forms.join(roots, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root")), "spelling-variants")
