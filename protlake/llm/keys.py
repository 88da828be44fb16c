"""Keys for tables in which ids repeat: a deal that no frequent key gathers, and an id for every text."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from protlake.operators.ranking import numbered
from protlake.session import scratch_path, staged

COPIES = 4096  # copies of one row that are made together


def spread(rows: DataFrame, key: str, most: int) -> DataFrame:
    """``rows`` with another ``key`` (a long hash) wherever more than ``most`` rows share one.

    Those rows get a key made of the whole row, and equal rows, which stand for each other, are counted and made anew with a
    number in their key. So every key has about ``most`` rows or fewer, however often a row repeats, and reruns agree. Other rows keep their key.
    """
    hot = staged(rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most).select(key), "hot-keys")
    if hot.isEmpty():
        return rows
    cold = rows.join(hot, rows[key].eqNullSafe(hot[key]), "left_anti")
    # of rows with a hot key: each distinct one, by its text form, which takes any column type
    warm = rows.join(hot, rows[key].eqNullSafe(hot[key]), "left_semi").withColumn("__row", F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256))
    same = staged(warm.groupBy("__row").agg(F.count(F.lit(1)).alias("__n"), F.first(F.struct(*rows.columns)).alias("__r")).select("__row", "__n", "__r.*"), "hot-rows")
    parts = same.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / COPIES))))
    # the copies of one row are made in many tasks
    low = F.col("__part") * COPIES
    made = parts.repartition("__row", "__part").withColumn("__copy", F.explode(F.sequence(low, F.least(low + COPIES, F.col("__n")) - 1)))
    return cold.unionByName(made.withColumn(key, F.xxhash64(key, "__row", "__copy")).select(*rows.columns))


def with_text_ids(docs: DataFrame, name: str = "__id") -> tuple[DataFrame, bool]:
    """``docs`` with a long ``name`` that stands for one text only, and whether rows share an id at all.

    It is the doc_id, but where several texts stand under one doc_id all but the one of smallest hash get a number behind the
    largest doc_id, in order of (doc_id, hash). Null texts count as one text, null doc_ids stay null.
    """
    doc_id, text = F.col("doc_id").cast("long"), F.sha2(F.coalesce(F.concat(F.lit("t"), F.col("text").cast("string")), F.lit("")), 256)
    ids = docs.select(doc_id.alias("__d")).filter("__d is not null")
    path = scratch_path(docs.sparkSession, "repeated-ids")
    ids.groupBy("__d").agg(F.count(F.lit(1)).alias("__n")).filter("__n > 1").select("__d").write.parquet(path)
    repeated = docs.sparkSession.read.parquet(path)
    if repeated.isEmpty():
        return docs.withColumn(name, doc_id), False
    texts = staged(docs.select(doc_id.alias("__d"), text.alias("__t")).join(repeated, "__d", "left_semi").distinct(), "texts-of-ids")
    first = texts.groupBy("__d").agg(F.min("__t").alias("__first"))
    further = texts.join(first, "__d").filter("__t <> __first").select("__d", "__t")
    if further.isEmpty():
        return docs.withColumn(name, doc_id), True
    top = ids.agg(F.max("__d")).first()[0]
    extra = numbered(further, [], ["__d", "__t"], "__number").withColumn("__new", F.col("__number") + F.lit(top + 1)).select("__d", "__t", "__new")
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), doc_id.alias("__of"), text.alias("__text"))
    joined = named.join(extra, (F.col("__of") == F.col("__d")) & (F.col("__text") == F.col("__t")), "left")
    return joined.select("__row.*", F.coalesce("__new", "__of").alias(name)), True
