"""Deterministic splits and samples by md5 order: same ids, ratios and seed give the same split anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from protlake.operators.ranking import GROUP_LIMIT, hash_rank, top_k

SPLITS = ("train", "val", "test")


def normalise_ratios(ratios: tuple[float, ...]) -> tuple[float, ...]:
    total = float(sum(ratios))
    if total <= 0:
        raise ValueError("split ratios must sum to a positive value")
    return tuple(r / total for r in ratios)


def largest_remainder(n: Column, ratios: tuple[float, float, float]) -> Column:
    """ARRAY<BIGINT> of split sizes: floors first, leftovers by largest remainder (then larger ratio, then
    earlier split); a positive ratio gets at least one item when there are enough."""
    r = normalise_ratios(ratios)
    shares = F.transform(
        F.array(*[F.struct(F.lit(i).alias("i"), F.lit(x).alias("r")) for i, x in enumerate(r)]),
        lambda p: F.struct(p.i.alias("i"), p.r.alias("r"), F.floor(p.r * n).cast("bigint").alias("whole"),
                           (p.r * n - F.floor(p.r * n)).alias("part")))
    sizes = _let(shares, lambda s: _let(
        F.transform(F.array_sort(F.transform(s, lambda p: F.struct(-p.part, -p.r, p.i.alias("i")))), lambda q: q.i),
        lambda order: F.transform(s, lambda p: p.whole + F.when(
            F.array_position(order, p.i) <= n - F.aggregate(s, F.lit(0).cast("bigint"), lambda acc, q: acc + q.whole), 1).otherwise(0))))
    positive = [i for i, x in enumerate(r) if x > 0]
    return F.aggregate(F.array(*map(F.lit, positive)), sizes, lambda acc, i: _donate(acc, i, n >= len(positive)))


def _let(value: Column, body) -> Column:
    """Bind a value once, so nested uses do not repeat its expression."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _donate(sizes: Column, i: Column, enough: Column) -> Column:
    """Give split ``i`` one item of the largest split when it has none."""
    biggest = F.array_max(sizes)
    donor = F.array_position(sizes, biggest) - 1
    moved = F.transform(sizes, lambda v, k: F.when(k == i, v + 1).when(k == donor, v - 1).otherwise(v))
    return F.when(enough & (F.get(sizes, i) == 0) & (biggest > 1), moved).otherwise(sizes)


def rounded_sizes(n: Column, ratios: tuple[float, float, float]) -> Column:
    """Report variant: half-even rounding for the first two splits, the rest to the last."""
    r = normalise_ratios(ratios)
    a, b = F.bround(n * F.lit(r[0])).cast("bigint"), F.bround(n * F.lit(r[1])).cast("bigint")
    return F.array(a, b, n - a - b)


def split_sizes(counts: DataFrame, count: str, ratios: tuple[float, float, float], rule=largest_remainder) -> DataFrame:
    s = counts.withColumn("__s", rule(F.col(count), ratios))
    return s.select(*counts.columns, *[F.element_at("__s", i + 1).cast("bigint").alias(f"{n}_count")
                                       for i, n in enumerate(SPLITS)])


def hash_split(ids: DataFrame, keys: list[str], id_col: str, ratios: tuple[float, float, float], seed: int,
               rule=largest_remainder, prefix: int = 3) -> DataFrame:
    """Exact-size split of distinct non-blank ids per key: (keys…, id, split)."""
    unique = ids.where(F.trim(F.col(id_col).cast("string")) != "").select(*keys, id_col).distinct()
    ranked = hash_rank(unique, keys, id_col, seed, prefix, lambda n: rule(n, ratios))
    a, b = F.element_at("group_info", 1), F.element_at("group_info", 2)
    name = F.when(F.col("hash_rank") <= a, SPLITS[0]).when(F.col("hash_rank") <= a + b, SPLITS[1]).otherwise(SPLITS[2])
    return ranked.select(*keys, id_col, name.alias("split"))


def threshold_split(ids: DataFrame, id_col: str, ratios: tuple[float, float, float], seed: int) -> DataFrame:
    """Approximate-size split without any shuffle: the id's hash decides alone."""
    r = normalise_ratios(ratios)
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string"))), 1, 8), 16, 10) \
        .cast("double") / F.lit(float(16 ** 8))
    name = F.when(u < r[0], SPLITS[0]).when(u < r[0] + r[1], SPLITS[1]).otherwise(SPLITS[2])
    return ids.withColumn("split", name)


def hash_sample(ids: DataFrame, keys: list[str], id_col: str, size: int, seed: int) -> DataFrame:
    """Fixed-size sample without replacement per key, stable for a seed. Large samples use exact bucket ranks."""
    if size > GROUP_LIMIT:
        return hash_rank(ids, keys, id_col, seed).where(F.col("hash_rank") <= size).select(*ids.columns)
    h = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(id_col).cast("string")))
    return top_k(ids.withColumn("__h", h), keys, [F.col("__h"), F.col(id_col)], size).drop("__h")


def capped_split(eligible: DataFrame, sample_per_aspect: int, ratios: tuple[float, float, float], seed: int) -> DataFrame:
    """Sample at most so many entries per aspect, then split them."""
    ids = eligible.select("aspect", "entry_id").distinct()
    picked = hash_sample(ids, ["aspect"], "entry_id", sample_per_aspect, seed) if sample_per_aspect > 0 else ids
    return hash_split(picked, ["aspect"], "entry_id", ratios, seed)


def split_summary(split: DataFrame, vocab: DataFrame, ratios: tuple[float, float, float], seed: int) -> DataFrame:
    """One row per aspect: entries, per-split counts, vocabulary size, ratios, seed."""
    counts = split.groupBy("aspect").agg(
        F.count("*").alias("entry_count"), *[F.count_if(F.col("split") == s).alias(f"{s}_count") for s in SPLITS])
    sizes = vocab.groupBy("aspect").agg(F.count("*").alias("vocab_size"))
    out = counts.join(sizes, "aspect", "left").fillna(0, ["vocab_size"])
    for name, value in zip(SPLITS, normalise_ratios(ratios)):
        out = out.withColumn(f"{name}_ratio", F.lit(value))
    return out.withColumn("seed", F.lit(seed))


def split_overview(split: DataFrame, vocab: DataFrame) -> DataFrame:
    counts = split.groupBy("aspect").pivot("split", list(SPLITS)).count()
    labels = vocab.groupBy("aspect").agg(F.count("*").alias("labels"))
    total = sum((F.coalesce(s, F.lit(0)) for s in SPLITS[1:]), F.coalesce(SPLITS[0], F.lit(0)))
    return counts.join(labels, "aspect", "left").select(
        "aspect", total.alias("proteins"), "labels", "train", F.col("val").alias("validation"), "test")


def split_arrays(split_ids: DataFrame, features: DataFrame, label_vectors: DataFrame) -> DataFrame:
    """Training arrays in split order: (split, ord, entry_id, embedding, label_vector).

    ``split_ids`` = (split, ord, entry_id). An id without a feature or label row is an error; sort by (split, ord) when writing.
    """
    joined = split_ids.join(features.select("entry_id", "embedding"), "entry_id", "left") \
        .join(label_vectors.select("entry_id", "label_vector"), "entry_id", "left")
    message = F.concat(F.lit("no feature or label row for split id "), F.col("entry_id"))
    whole = F.col("embedding").isNotNull() & F.col("label_vector").isNotNull()
    return joined.where(F.when(whole, True).otherwise(F.raise_error(message).cast("boolean"))).select("split", "ord", "entry_id", "embedding", "label_vector")
