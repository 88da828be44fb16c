"""From raw documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; run() writes each stage's rows as Parquet
into the shared folder and rereads them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from protlake.llm import cotrain, minhash, mixing, packing, suffixes
from protlake.session import staged


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps; labels come from the table ``labels``."""
    return cotrain.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return minhash.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages that an earlier document holds."""
    return suffixes.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources at their target weights; a document taken twice comes twice."""
    return mixing.mixture(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their texts and bins."""
    return packing.packed(docs, with_text=True)


STAGES = [("quality", keep_good), ("near_dedup", one_of_each), ("suffix_dedup", cut_repeats), ("mix", mix_sources), ("pack", pack)]

# classifier, signatures, draws and packing have no SQL form; the stages are tested against brute-force versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
