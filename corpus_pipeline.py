"""A corpus from raw documents, in stages. Each stage takes all that the one before kept.

All but the last return the columns of documents; the last returns each document's place
in a shard.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from attestra.llm.common import materialize, read
from attestra.llm.decontamination import without_benchmark
from attestra.llm.language import in_known_language
from attestra.llm.mixing import mixed_documents
from attestra.llm.near_copies import without_similar
from attestra.llm.sharding import shard_by_splitters
from attestra.session import tuned


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the model knows."""
    tuned(spark)
    return in_known_language(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies: five-word shingles with a Jaccard similarity of 0.8 or more; SimHash links first, then those it can't see."""
    tuned(spark)
    return without_similar(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    tuned(spark)
    return without_benchmark(docs, read(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or what the mix takes of them, once for each time it does."""
    return mixed_documents(docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's shard and slot."""
    return shard_by_splitters(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("sharding", sharding),
]

#: SQL can express neither the trained model nor the drawn samples; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs, name)
    return docs
