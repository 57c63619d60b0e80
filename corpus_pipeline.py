"""The corpus pipeline: quality, near-duplicates, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept and returns a DataFrame,
which is written as Parquet to the shared folder and read again for the next one. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lawfinder.llm import decontamination, mixing, quality, sharding, simhash
from lawfinder.llm.common import left_tables, removed, table, written

#: Share of the tokens that reach the mixture that it delivers; languages, and in them sources, weigh the same,
#: so the largest of them give up what is left out.
MIX_SHARE = 0.9


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word similarity of 0.8 or more), that of the smallest doc_id."""
    return simhash.keep_one(docs)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark passage occurs."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that fill the leaves' budgets, each once at most."""
    return mixing.mix(docs, F.floor(F.col("total") * MIX_SHARE), epochs=1).select(*docs.columns)


def in_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with shard and slot."""
    return sharding.interleaved(docs, ties=("text",))


STAGES = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", one_of_each),
    ("benchmark decontamination", without_benchmark),
    ("mixing to target weights", to_weights),
    ("sharding", in_shards),
]

#: A learnt classifier and SimHash are not to be had in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        out, before = stage(spark, docs, sf_dir), docs
        docs = written(out, name.split()[0].lower())
        removed(*left_tables(out), *([before] if name != STAGES[0][0] else []))
    return STAGES[-1][1](spark, docs, sf_dir)
