"""Labels in long form ``(entry_id, term, aspect)``: counts, vocabularies, eligibility, scenarios."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from protlake import constants as C
from protlake.operators.ranking import numbered, top_k


def explode_labels(entries: DataFrame, labels: str = "labels", keep: tuple[str, ...] = ("entry_id",)) -> DataFrame:
    """MAP<aspect, ARRAY<term>> to long rows; repeated terms stay repeated."""
    return entries.select(*keep, F.explode(labels).alias("aspect", "terms")) \
        .select(*keep, "aspect", F.explode("terms").alias("term"))


def aspect_lists(labels: DataFrame, order: str = "ord") -> DataFrame:
    """One row per entry: MAP<aspect, ARRAY<term>> with terms in input order, duplicates kept."""
    lists = labels.groupBy("entry_id", "aspect").agg(
        F.array_sort(F.collect_list(F.struct(order, "term"))).alias("__t")) \
        .select("entry_id", F.struct("aspect", F.transform("__t", lambda s: s.term).alias("terms")).alias("__e"))
    return lists.groupBy("entry_id").agg(F.map_from_entries(F.collect_list("__e")).alias("labels"))


def term_counts(labels: DataFrame, distinct: bool = False) -> DataFrame:
    """(aspect, term, n). Repeats inside an entry count again unless ``distinct``."""
    rows = labels.dropDuplicates(["entry_id", "aspect", "term"]) if distinct else labels
    return rows.groupBy("aspect", "term").agg(F.count("*").alias("n"))


def vocabulary(counts: DataFrame, min_count: int = 1) -> DataFrame:
    """Terms with enough occurrences and their index in sorted order per aspect.

    The terms of an aspect are numbered over several tasks (``ranking.numbered``).
    """
    return numbered(counts.where(F.col("n") >= min_count).select("aspect", "term", "n"), ["aspect"], ["term"], "term_index") \
        .withColumn("term_index", F.col("term_index").cast("int"))


def encode_labels(labels: DataFrame, vocab: DataFrame) -> DataFrame:
    """Sparse label matrix: distinct (aspect, entry_id, term_index) of in-vocabulary labels."""
    return labels.join(vocab.select("aspect", "term", "term_index"), ["aspect", "term"]) \
        .select("aspect", "entry_id", "term_index").distinct()


def label_vector(labels: DataFrame, vocab: DataFrame, entries: DataFrame | None = None) -> DataFrame:
    """Dense 0/1 vector per aspect and entry, on demand only; as wide as the aspect's vocabulary.

    With ``entries`` every one of them has a row in every aspect, all zero without an in-vocabulary label.
    """
    width = vocab.groupBy("aspect").agg((F.max("term_index") + 1).alias("__width"))
    on = encode_labels(labels, vocab).groupBy("aspect", "entry_id").agg(F.array_sort(F.collect_set("term_index")).alias("__on"))
    if entries is not None:
        aspects = width.agg(F.collect_list("aspect")).scalar()
        every = entries.select("entry_id").distinct().withColumn("aspect", F.explode(aspects))
        on = every.join(on, ["aspect", "entry_id"], "left").withColumn("__on", F.coalesce("__on", F.array().cast("array<int>")))
    # runs of zeros between the set slots, so the work is the width and not width times labels
    one, zero = F.lit(1.0).cast("float"), F.lit(0.0).cast("float")
    before = F.concat(F.array(F.lit(-1)), F.col("__on"))
    runs = F.flatten(F.transform("__on", lambda i, n: F.concat(F.array_repeat(zero, i - F.get(before, n) - 1), F.array(one))))
    last = F.coalesce(F.get("__on", F.size("__on") - 1), F.lit(-1))
    dense = F.concat(runs, F.array_repeat(zero, (F.col("__width") - last - 1).cast("int")))
    return on.join(width, "aspect").select("aspect", "entry_id", dense.alias("label_vector"))


def project_labels(labels: DataFrame, vocab: DataFrame, aspect: str | None = None) -> DataFrame:
    """In-vocabulary labels, optionally of one aspect."""
    rows = labels if aspect is None else labels.where(F.col("aspect") == aspect)
    return rows.join(vocab.select("aspect", "term"), ["aspect", "term"], "left_semi")


def frequency_filter_summary(counts: DataFrame, min_count: int) -> DataFrame:
    """Terms before and after the frequency filter, with the kept percentage."""
    kept = F.count_if(F.col("n") >= min_count)
    return counts.groupBy("aspect").agg(
        F.count("*").alias("terms_raw"), kept.alias("terms_kept"), (F.count("*") - kept).alias("terms_removed"),
        (kept * 100.0 / F.count("*")).cast("double").alias("kept_pct"))


def cardinality(labels: DataFrame) -> DataFrame:
    """Labels per entry and aspect."""
    return labels.groupBy("aspect", "entry_id").agg(F.count_distinct("term").alias("n_labels"))


def histogram(df: DataFrame, keys: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """Fixed-width histogram; bucket 0 and bins+1 hold values outside the range."""
    bucket = F.width_bucket(F.col(value).cast("double"), F.lit(float(low)), F.lit(float(high)), F.lit(bins))
    return df.groupBy(*keys, bucket.alias("bucket")).agg(F.count("*").alias("n"))


def eligible_entries(labels: DataFrame, vocab: DataFrame, entries: DataFrame, max_residues: int | None = None) -> DataFrame:
    """Distinct (aspect, entry_id) with an in-vocabulary label and, if capped, few enough residues."""
    hit = project_labels(labels, vocab).select("aspect", "entry_id").distinct()
    if max_residues is None:
        return hit.join(entries.select("entry_id"), "entry_id", "left_semi").select("aspect", "entry_id")
    small = entries.where(F.coalesce("residue_count", F.lit(0)) <= max_residues)
    return hit.join(small.select("entry_id"), "entry_id", "left_semi").select("aspect", "entry_id")


def entry_best_frequency(labels: DataFrame, counts: DataFrame, entries: DataFrame) -> DataFrame:
    """(aspect, entry_id, best_n, residue_count): an entry passes min frequency m exactly when best_n >= m."""
    best = labels.join(counts, ["aspect", "term"]).groupBy("aspect", "entry_id").agg(F.max("n").alias("best_n"))
    return best.join(entries.select("entry_id", F.coalesce("residue_count", F.lit(0)).alias("residue_count")), "entry_id")


def scenario_counts(labels: DataFrame, counts: DataFrame, entries: DataFrame, min_counts: list[int],
                    caps: list[int]) -> DataFrame:
    """Every (aspect, min frequency, cap) scenario from one pass: one conditional count per scenario."""
    best = entry_best_frequency(labels, counts, entries)
    named = [(m, c) for m in sorted(set(min_counts)) for c in sorted(set(caps))]
    aggs = [F.count_if(F.col("best_n") >= m).alias(f"u{m}") for m in sorted(set(min_counts))]
    aggs += [F.count_if((F.col("best_n") >= m) & (F.col("residue_count") <= c)).alias(f"c{m}_{c}") for m, c in named]
    wide = best.groupBy("aspect").agg(*aggs)
    vocab = counts.groupBy("aspect").agg(
        *[F.count_if(F.col("n") >= m).alias(f"v{m}") for m in sorted(set(min_counts))])
    rows = F.explode(F.array(*[
        F.struct(F.lit(m).alias("min_term_frequency"), F.lit(c).alias("max_residues"),
                 F.col(f"v{m}").alias("vocab_size"), F.coalesce(f"u{m}", F.lit(0)).alias("eligible_uncapped"),
                 F.coalesce(f"c{m}_{c}", F.lit(0)).alias("eligible_capped")) for m, c in named]))
    removed = F.col("eligible_uncapped") - F.col("eligible_capped")
    return vocab.join(wide, "aspect", "left").select("aspect", rows.alias("s")).select("aspect", "s.*") \
        .withColumn("removed_by_cap", removed) \
        .withColumn("removed_fraction", F.when(F.col("eligible_uncapped") > 0, removed / F.col("eligible_uncapped"))
                    .otherwise(F.lit(0.0)))


def top_terms(counts: DataFrame, k: int = 100) -> DataFrame:
    return top_k(counts, ["aspect"], [F.col("n").desc(), F.col("term")], k)


def term_dimension(annotations: DataFrame) -> DataFrame:
    """Distinct (term, aspect)."""
    return annotations.select("term", "aspect").dropDuplicates()


def with_aspect(rows: DataFrame, dimension: DataFrame) -> DataFrame:
    """Aspect of each term, ``Unknown`` when the dimension lacks it."""
    one = dimension.groupBy("term").agg(F.min("aspect").alias("aspect"))
    return rows.join(one, "term", "left").withColumn("aspect", F.coalesce("aspect", F.lit("Unknown")))


def _label_totals(labels: DataFrame, entries: DataFrame) -> DataFrame:
    """(aspect, term, c, n_entries): entries carrying each term, and all entries."""
    per_term = labels.dropDuplicates(["aspect", "entry_id", "term"]).groupBy("aspect", "term").agg(F.count("*").alias("c"))
    return per_term.withColumn("n_entries", entries.agg(F.count("*")).scalar())


def positive_weights(labels: DataFrame, vocab: DataFrame, entries: DataFrame, power: float = 1.0,
                     cap: float | None = None) -> DataFrame:
    """Negatives over positives per term, at least 1, raised to ``power``, optionally capped; unseen terms get 1."""
    ratio = F.greatest((F.col("n_entries") - F.col("c")) / F.col("c"), F.lit(1.0))
    weight = F.pow(ratio, F.lit(float(power))) if power != 1.0 else ratio
    weight = F.least(weight, F.lit(float(cap))) if cap is not None else weight
    unseen = F.lit(1.0) if cap is None else F.lit(min(1.0, float(cap)))
    return vocab.select("aspect", "term").join(_label_totals(labels, entries), ["aspect", "term"], "left") \
        .select("aspect", "term", F.coalesce(weight, unseen).alias("pos_weight"))


def clipped_weights(labels: DataFrame, vocab: DataFrame, entries: DataFrame, low: float | None = 1.0,
                    high: float | None = 100.0) -> DataFrame:
    """(n - c) / (c + 1e-6), clipped unless the bounds are None."""
    c = F.coalesce("c", F.lit(0))
    w = (F.col("__n") - c) / (c + F.lit(1e-6))
    w = F.greatest(w, F.lit(float(low))) if low is not None else w
    w = F.least(w, F.lit(float(high))) if high is not None else w
    return vocab.select("aspect", "term").join(_label_totals(labels, entries).drop("n_entries"), ["aspect", "term"], "left") \
        .withColumn("__n", entries.agg(F.count("*")).scalar()).select("aspect", "term", w.alias("pos_weight"))


def label_priors(labels: DataFrame, vocab: DataFrame, entries: DataFrame) -> DataFrame:
    """Share of entries per term, kept away from 0 and 1."""
    prior = F.coalesce("c", F.lit(0)) / F.greatest(F.col("__n"), F.lit(1))
    bounded = F.least(F.greatest(prior, F.lit(C.PRIOR_CLAMP)), F.lit(1.0 - C.PRIOR_CLAMP))
    return vocab.select("aspect", "term").join(_label_totals(labels, entries).drop("n_entries"), ["aspect", "term"], "left") \
        .withColumn("__n", entries.agg(F.count("*")).scalar()).select("aspect", "term", bounded.alias("prior"))


def value_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, how many exceed one, min, max, mean."""
    v = F.col(value)
    return df.groupBy(*keys).agg(F.count("*").alias("label_count"), F.count_if(v > 1.0).alias("weighted_label_count"),
                                 F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean"))


def split_ground_truth(split: DataFrame, labels: DataFrame, vocab: DataFrame | None = None) -> DataFrame:
    """Distinct (entry_id, term, aspect) of the entries of a split, sorted at the sink."""
    rows = labels.join(split.select("aspect", "entry_id"), ["aspect", "entry_id"], "left_semi")
    if vocab is not None:
        rows = rows.join(vocab.select("aspect", "term"), ["aspect", "term"], "left_semi")
    return rows.select("entry_id", "term", "aspect").distinct()
