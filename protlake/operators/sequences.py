"""Sequence operators: alphabet filter, k-mers, windows, pooling, standardisation."""

from __future__ import annotations

from typing import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, functions as F

from protlake import constants as C
from protlake.functions import scalar as fn


def standard_only(seqs: DataFrame, sequence: str = "sequence", alphabet: str = C.STANDARD_RESIDUES) -> DataFrame:
    """Non-empty sequences made of the alphabet only."""
    s = F.col(sequence)
    return seqs.where((F.length(s) > 0) & ~s.rlike(f"[^{alphabet}]"))


def rejected(seqs: DataFrame, sequence: str = "sequence", alphabet: str = C.STANDARD_RESIDUES) -> DataFrame:
    """The other non-empty sequences with their offending characters, sorted."""
    s = F.col(sequence)
    odd = F.array_sort(F.array_distinct(F.regexp_extract_all(s, F.lit(f"(?s)([^{alphabet}])"), F.lit(1))))
    return seqs.where((F.length(s) > 0) & s.rlike(f"[^{alphabet}]")).withColumn("odd_characters", odd)


def length_statistics(seqs: DataFrame, sequence: str = "sequence") -> DataFrame:
    """Length statistics; lengths are small integers, so the exact median's buffer stays small."""
    n = F.length(sequence)
    return seqs.agg(F.count("*").alias("n"), F.avg(n).alias("mean_length"), F.percentile(n, F.lit(0.5)).alias("median_length"),
                    F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.stddev_pop(n).alias("std_length"))


def null_counts(df: DataFrame) -> DataFrame:
    return df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])


def _word(number: Column, k: int, alphabet: str) -> Column:
    """The number-th k-letter word in alphabet order."""
    base = len(alphabet)
    return F.concat(*[F.substring(F.lit(alphabet), (F.floor(number / base ** (k - 1 - i)) % base + 1).cast("int"), F.lit(1)) for i in range(k)])


def kmer_vocabulary(spark, k: int = 2, alphabet: str = C.STANDARD_RESIDUES) -> DataFrame:
    """All k-letter words in order with their index; built by arithmetic on the word number."""
    return spark.range(len(alphabet) ** k).select(_word(F.col("id"), k, alphabet).alias("kmer"), F.col("id").cast("int").alias("kmer_index"))


def _kmer_slots(text: str, codes: np.ndarray, base: int, k: int) -> np.ndarray:
    """Vocabulary slot of every in-alphabet k-mer of one text; ``codes`` maps code points to letters, -1 elsewhere."""
    points = np.frombuffer(text.encode("utf-32-le"), dtype="<u4")
    letters = codes[np.minimum(points, len(codes) - 1)]
    n = len(letters) - k + 1
    if n <= 0:
        return np.empty(0, dtype="int64")
    parts = [letters[i:i + n] for i in range(k)]
    inside = np.logical_and.reduce([p >= 0 for p in parts])
    return sum(p * base ** (k - 1 - i) for i, p in enumerate(parts))[inside]


def _letter_codes(alphabet: str) -> np.ndarray:
    codes = np.full(max(map(ord, alphabet)) + 2, -1, dtype="int64")
    codes[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
    return codes


def kmer_frequencies(seqs: DataFrame, k: int = 2, sequence: str = "sequence", alphabet: str = C.STANDARD_RESIDUES) -> DataFrame:
    """(entry_id, kmer, n, freq): frequencies over all k-mers of the sequence, in-alphabet ones kept.

    One row per entry, so counting needs no shuffle. Array counting per Arrow batch is several hundred times
    cheaper per character than exploding k-mers into rows.
    """
    codes, base = _letter_codes(alphabet), len(alphabet)

    def count(batches):
        for pdf in batches:
            counts = [np.bincount(_kmer_slots(t, codes, base, k)) for t in pdf["text"]]
            slots = [np.flatnonzero(c) for c in counts]
            yield pd.DataFrame({"entry_id": pdf["entry_id"], "total": pdf["total"], "slots": slots,
                                "counts": [c[s] for c, s in zip(counts, slots)]})

    src = seqs.where(F.length(sequence) >= k).select(
        "entry_id", F.col(sequence).alias("text"), (F.length(sequence) - (k - 1)).cast("bigint").alias("total"))
    rows = src.mapInPandas(count, "entry_id string, total bigint, slots array<bigint>, counts array<bigint>") \
        .select("entry_id", "total", F.inline(F.arrays_zip(F.col("slots").alias("slot"), F.col("counts").alias("n"))))
    return rows.select("entry_id", _word(F.col("slot"), k, alphabet).alias("kmer"), "n", (F.col("n") / F.col("total")).alias("freq"))


def kmer_vectors(seqs: DataFrame, k: int = 2, sequence: str = "sequence", alphabet: str = C.STANDARD_RESIDUES) -> DataFrame:
    """(entry_id, kmer_vector ARRAY<FLOAT>) over the k-mer vocabulary; short sequences are all zero."""
    codes, base = _letter_codes(alphabet), len(alphabet)

    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = []
            for t in texts:
                slots = _kmer_slots(t or "", codes, base, k)
                total = max(len(t or "") - k + 1, 1)
                out.append((np.bincount(slots, minlength=base ** k) / total).astype("float32"))
            yield pd.Series(out)

    vector = F.pandas_udf(vectors, "array<float>")
    return seqs.select("entry_id", vector(F.col(sequence)).alias("kmer_vector"))


def windows(seqs: DataFrame, size: int, overlap: int, length: Column | None = None) -> DataFrame:
    """One row per window: entry_id, window number, start, end (half-open)."""
    n = F.length("sequence") if length is None else length
    return seqs.select("entry_id", F.posexplode(fn.sequence_windows(n, size, overlap)).alias("window", "w")) \
        .select("entry_id", "window", "w.start", "w.end")


def _mean_vector(vector: str) -> Column:
    return vector_to_array(Summarizer.mean(array_to_vector(F.col(vector).cast("array<double>"))))


def mean_pool(rows: DataFrame, keys: list[str], vector: str = "embedding", mask: Column | None = None) -> DataFrame:
    """Element-wise mean per key; the aggregation buffer is one vector per key and map task. With ``mask`` only rows where it holds count."""
    used = rows if mask is None else rows.where(mask)
    return used.where(F.col(vector).isNotNull()).groupBy(*keys).agg(_mean_vector(vector).alias(vector))


def merge_windows(chunks: DataFrame) -> DataFrame:
    """Per-position mean over overlapping windows. ``chunks`` = (entry_id, start, chunk ARRAY<ARRAY<FLOAT>>)."""
    rows = chunks.select("entry_id", "start", F.posexplode("chunk").alias("__i", "embedding")) \
        .select("entry_id", (F.col("start") + F.col("__i")).alias("position"), "embedding")
    return mean_pool(rows, ["entry_id", "position"])


def fit_scaler(train: DataFrame, vector: str = "embedding") -> DataFrame:
    """One row: mean and population standard deviation per dimension of the training rows."""
    v = array_to_vector(F.col(vector).cast("array<double>"))
    s = train.agg(Summarizer.metrics("mean", "variance", "count").summary(v).alias("s"))
    n = F.col("s.count").cast("double")
    shrink = F.when(n > 1, (n - 1) / n).otherwise(fn.d(0))
    return s.select(
        vector_to_array("s.mean").alias("mean"),
        F.transform(vector_to_array("s.variance"), lambda x: F.sqrt(x * shrink)).alias("std"))


def standardise(rows: DataFrame, scaler: DataFrame, vector: str = "embedding") -> DataFrame:
    """(x - mean) / std for every row; a zero deviation divides by one."""
    fitted = rows.withColumn("__s", scaler.select(F.struct("mean", "std").alias("s")).scalar())
    centred = F.zip_with(vector, "__s.mean", lambda a, m: a.cast("double") - m)
    scaled = F.zip_with(centred, "__s.std", lambda a, s: a / F.when(s == 0, fn.d(1)).otherwise(s))
    return fitted.withColumn(vector, scaled).drop("__s")


def feature_matrix(cohort: DataFrame, vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """Embedding rows of the usable entries of a cohort; entries without an embedding are skipped."""
    usable = cohort.where((F.col("af_status") == "ok") & (F.trim("entry_id") != ""))
    return vectors.where(F.col(vector).isNotNull()).join(usable.select("entry_id").distinct(), "entry_id", "left_semi")
