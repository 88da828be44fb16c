"""Mixing sources to target weights with DataFrame operations only.

Each source's documents are permuted by hash and laid end to end as one stream of words; the mix takes a stretch of the stream, going round again
where a target lies above the source's size. The stretch is cut into blocks, and whole documents belong to the block in which
they begin. Output shards get exact numbers of blocks from every source by a splitting tree: a node halves its quotas
with multivariate hypergeometric draws until a leaf is one shard. A shard's blocks of a source are a range of ranks of a
random permutation of the source's blocks, so shards are disjoint; inside a shard rows have a random order key.

No document list of a source meets in one task: places in the stream come from sums over hash buckets (about the square root of the number of
rows of them) and a window inside each bucket.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from protlake.llm.keys import spread
from protlake.session import staged

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
LEAST_SHARDS, SHARD_WORDS = 8, 1 << 24  # shards are a power of two, as many as have at most so many words each, but not fewer
BLOCKS_PER_SHARD = 256
RUNS = 16  # a shard's order is written in so many parts
SEED = 20240601


def words(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """``sizes`` (source, source_size) with ``source_no`` and ``target``.

    Sources by code point, null last, take the weights in turn and share ``share`` times all words by weight; a target stops at ``cap`` times
    its source's size and the excess goes to the others by weight. In order of cap / weight the capped sources come first, and the level of the others
    is the highest of the levels that follow if all sources before are capped.
    """
    whole = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("source_no", F.row_number().over(whole.orderBy(F.col("source").asc_nulls_last())) - 1)
    turn = F.array(*[F.lit(float(w)) for w in weights])
    ranked = (ranked.withColumn("weight", F.element_at(turn, (F.col("source_no") % len(weights) + 1).cast("int")))
              .withColumn("top", cap * F.col("source_size")))
    before = whole.orderBy(F.col("top") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    level = ((share * F.sum("source_size").over(whole) - F.coalesce(F.sum("top").over(before), F.lit(0.0)))
             / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    out = ranked.withColumn("level", level).withColumn("level", F.max("level").over(whole))
    return out.select("source", "source_no", "source_size", F.least("top", F.col("level") * F.col("weight")).cast("double").alias("target"))


# x of the n drawn from good + bad are good: the weights of x around the mode by their ratios, then the quantile u
_HYPERGEOMETRIC = """
transform(array(named_struct(
    'lo', greatest(0L, p.n - p.bad, cast(floor((p.n + 1D) * (p.good + 1D) / (p.good + p.bad + 2D)) as bigint) - p.reach),
    'hi', least(p.n, p.good, cast(floor((p.n + 1D) * (p.good + 1D) / (p.good + p.bad + 2D)) as bigint) + p.reach))), r ->
  transform(array(aggregate(sequence(r.lo, r.hi), named_struct('w', 1D, 't', 0D),
      (z, x) -> named_struct('w', z.w * ((p.good - x) * 1D * (p.n - x)) / ((x + 1D) * (p.bad - p.n + x + 1)), 't', z.t + z.w), z -> z.t)), t ->
    aggregate(sequence(r.lo, r.hi), named_struct('w', 1D, 'c', 0D, 'x', r.lo),
      (z, x) -> named_struct('w', z.w * ((p.good - x) * 1D * (p.n - x)) / ((x + 1D) * (p.bad - p.n + x + 1)), 'c', z.c + z.w,
                             'x', if(z.c + z.w <= p.u * t, least(x + 1, r.hi), z.x)), z -> z.x))[0])[0]"""

_LEFT_HALF = f"""
aggregate(quotas, named_struct('total', aggregate(quotas, 0L, (s, q) -> s + q), 'draws', (aggregate(quotas, 0L, (s, q) -> s + q) + 1) div 2,
                               'out', cast(array() as array<bigint>)),
  (s, q) -> transform(array(named_struct('good', q, 'bad', s.total - q, 'n', s.draws,
      'reach', cast(ceil(9 * sqrt(s.draws * 1D * q / greatest(s.total, 1L) * (1 - q * 1D / greatest(s.total, 1L)))) as bigint) + 12,
      'u', (pmod(xxhash64(seed, level, node, size(s.out)), 9007199254740992L) + 0.5D) / 9007199254740992D)), p ->
    transform(array({_HYPERGEOMETRIC}), x -> named_struct('total', s.total - q, 'draws', s.draws - x, 'out', concat(s.out, array(x))))[0])[0],
  s -> s.out)"""


def splitting_tree(quotas: DataFrame, levels: int, seed: int = SEED) -> DataFrame:
    """One row with ``quotas`` (blocks of each source) becomes 2**levels rows ``node``, ``quotas`` whose quotas add up to it.

    Each half has half of the node's blocks (the left one more, if odd), of each source as many as a draw without replacement gives.
    """
    nodes = quotas.select(F.lit(0).alias("node"), "quotas")
    for level in range(levels):
        halves = nodes.withColumn("seed", F.lit(seed)).withColumn("level", F.lit(level)).withColumn("left", F.expr(_LEFT_HALF))
        both = F.array(F.struct((F.col("node") * 2).alias("node"), F.col("left").alias("quotas")),
                       F.struct((F.col("node") * 2 + 1).alias("node"), F.expr("zip_with(quotas, left, (q, l) -> q - l)").alias("quotas")))
        nodes = halves.select(F.explode(both).alias("half")).select("half.*")
    return nodes


def permuted(x: str, n: str, key: str, rounds: int = 24) -> Column:
    """A random permutation of 0..n-1 without a sort: in each round x and its mirror image about a random point may change places."""
    return F.expr(f"""aggregate(sequence(1, {rounds}), cast({x} as bigint), (v, r) ->
        if(pmod(xxhash64({key}, r, greatest(v, pmod(pmod(xxhash64({key}, r), {n}) - v, {n})), 1), 2) = 1, pmod(pmod(xxhash64({key}, r), {n}) - v, {n}), v))""")


def mixed(docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, cap: float = CAP, shards: int | None = None, seed: int = SEED) -> DataFrame:
    """All rows of ``docs`` with what the mix takes of them, one output row for each time it takes some.

    ``payload`` (the row), ``row`` (its place: source number, bucket, number; unique), ``size``, ``source_size``, ``target``, ``pass``,
    ``words`` (the words taken in this pass, counted from the text's start), ``shard`` and ``place`` (order in the shard). A row the mix leaves out comes once, with null
    ``pass`` and ``shard`` and no words. Only the last document of a source's stretch is cut, so each source gives round(target) words and a document gives at most
    ceil(cap) times its own. Needs ``doc_id``, ``source`` and ``text``; null texts have no words, a null source is a source of its own, null and
    repeated doc_ids are allowed (equal rows may stand for each other), an empty table gives no rows. ``shards`` is a power of two; without it as many
    as the mix has ``SHARD_WORDS`` words, ``LEAST_SHARDS`` at least.
    """
    buckets = max(1, math.isqrt(docs.count()))
    key = F.xxhash64(F.lit(seed), F.col("doc_id").cast("string"))
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("payload"), F.col("doc_id").alias("__id"), F.col("source").cast("string").alias("source"),
                       words(F.col("text").cast("string")).alias("size"), key.alias("order"))
    rows = spread(rows, "order", 4 * buckets).withColumn("bucket", F.pmod(F.xxhash64("order", F.lit(1)), F.lit(buckets)).cast("int"))
    # one small row for each source and bucket: few files, whatever the number of shuffle partitions
    sums = staged(rows.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size")).coalesce(1 + buckets // 1024), "mix-buckets")
    goals = staged(targets(sums.groupBy("source").agg(F.sum("bucket_size").alias("source_size")), weights, share, cap)
                   .withColumn("stretch", F.round("target").cast("long")), "mix-targets")

    if shards is None:
        shards = LEAST_SHARDS
        while shards * SHARD_WORDS < (goals.agg(F.sum("stretch")).first()[0] or 0):
            shards *= 2
    levels = shards.bit_length() - 1
    if shards < 1 or 2 ** levels != shards:
        raise ValueError("shards must be a power of two")

    # blocks of each source, and the shard of every block
    all_words = F.sum("stretch").over(Window.partitionBy(F.lit(0)))
    per_block = F.greatest(F.lit(1), F.ceil(all_words / (shards * BLOCKS_PER_SHARD))).cast("long")
    sources = staged(goals.withColumn("block_words", per_block).withColumn("blocks", F.ceil(F.col("stretch") / F.col("block_words")).cast("long")), "mix-sources")
    quotas = sources.agg(F.expr("transform(array_sort(collect_list(struct(source_no, blocks))), s -> s.blocks)").alias("quotas"))
    leaves = splitting_tree(quotas, levels, seed).select(F.col("node").alias("shard"), F.posexplode("quotas").alias("source_no", "quota"))
    upto = Window.partitionBy("source_no").orderBy("shard")
    ranks = (leaves.withColumn("to", F.sum("quota").over(upto)).withColumn("of", F.sum("quota").over(Window.partitionBy("source_no"))).filter("quota > 0")
             .select("shard", "source_no", "of", F.explode(F.expr("sequence(to - quota, to - 1)")).alias("rank")))
    blocks = staged(ranks.select("source_no", "shard", permuted("rank", "of", f"{seed}, source_no").alias("block")), "mix-blocks")

    # place of each document in its source's stream
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = staged(sums.join(sources, sums["source"].eqNullSafe(sources["source"])).select(
        sums["source"].alias("source"), "bucket", "source_no", "source_size", "target", "stretch", "block_words",
        F.coalesce(F.sum("bucket_size").over(before), F.lit(0)).alias("base")), "mix-bases")
    inside = Window.partitionBy("source", "bucket").orderBy("order", "__id", "size")
    streamed = (rows.withColumn("number", F.row_number().over(inside))
                .withColumn("ahead", F.coalesce(F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))))
    placed = streamed.join(base, streamed["source"].eqNullSafe(base["source"]) & (streamed["bucket"] == base["bucket"])).select(
        "payload", F.struct("source_no", streamed["bucket"].alias("bucket"), "number").alias("row"), "size", "source_size", "target", "source_no", "stretch", "block_words", "order",
        (F.col("base") + F.col("ahead")).alias("at"))
    passes = F.expr(f"""transform(filter(sequence(0, {math.ceil(cap)}), p -> at + p * source_size < stretch),
        p -> named_struct('pass', p, 'words', least(size, stretch - at - p * source_size), 'block', (at + p * source_size) div block_words))""")
    taken = placed.withColumn("take", F.explode_outer(passes)).select("*", "take.pass", F.coalesce("take.words", F.lit(0)).alias("words"), "take.block")
    joined = taken.join(blocks.withColumnRenamed("source_no", "b_source").withColumnRenamed("block", "b_block"),
                        (F.col("source_no") == F.col("b_source")) & (F.col("block") == F.col("b_block")), "left")
    return joined.select("payload", "row", "size", "source_size", "target", "pass", "words", "shard",
                         F.when(F.col("shard").isNotNull(), F.xxhash64(F.lit(seed), "shard", "order", "pass")).alias("place"))


def first_words(text: Column, n: Column) -> Column:
    """The first ``n`` words of a text, joined by single spaces."""
    return F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), n.cast("int")), " ")


def mixture(docs: DataFrame, **how) -> DataFrame:
    """The mixed table itself: columns of ``docs``; a document taken twice comes twice, the cut one with its first words (n_chars set anew).

    Rows lie by shard and in the shard's order: each task has whole parts, of ``RUNS``, of the shards' orders, one after the other.
    """
    took = mixed(docs, **how).filter("shard is not null and words > 0")
    run = F.floor((F.col("place") / F.lit(2.0**64) + 0.5) * RUNS)
    took = took.withColumn("__run", run).repartition("shard", "__run").sortWithinPartitions("shard", "place")
    cut = F.col("words") < F.col("size")
    text = F.when(cut, first_words(F.col("payload.text").cast("string"), F.col("words"))).otherwise(F.col("payload").getField("text"))
    took = took.withColumn("__text", text)
    columns = [F.col("__text").alias(c) if c == "text"
               else F.when(cut, F.length("__text")).otherwise(F.col("payload").getField(c)).cast(docs.schema[c].dataType).alias(c) if c == "n_chars"
               else F.col("payload").getField(c).alias(c) for c in docs.columns]
    return took.select(*columns)
