"""Corpus pipeline: toxicity, near-duplicates, benchmark passages, mixing by source, sharding.

Each stage takes what its predecessor kept, as written and read again, and returns the columns of
documents; the last adds shard and slot. run() applies them to sf_dir's documents. Extra columns of any
name pass through, and an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shoal.llm import decontaminate, jaccard_join, mixing, shuffle_shards, toxicity
from shoal.llm.shared import free_name, staged

SHARDS = 24


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the Kneser-Ney models, fitted on sf_dir's labels, call toxic.

    Texts without words (null, empty, only punctuation) get the score of figure 0, which is clean in
    fitted models; long ones are scored whole; equal texts go or stay together, whatever their ids.
    """
    name = free_name(docs.columns, "score")
    return toxicity.score(docs, toxicity.fit_from(spark, sf_dir), name=name).where(F.col(name) < 0.5).select(*[F.col(f"`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity of 0.8 or more.

    The smallest doc_id stays; where ids are null or repeat, the first row of a group. Null texts and
    those without words are nobody's duplicates and stay; a text of one to four words is one shingle.
    """
    return jaccard_join.keep_one(docs, width=5, percent=80)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold ten consecutive words of a benchmark item, or all of a shorter one.

    Null texts and those without words are clean. Every row is judged by its text alone.
    """
    return decontaminate.remove_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources in weights of counts to the power 0.7: nothing is dropped, sources that are short for
    their weight come again, and the rows stand in the order of the schedule.

    Null and empty sources are one; rows that repeat are rows of their own.
    """
    prefix = "mix_"
    while any(c.lower().startswith(prefix) for c in docs.columns):
        prefix += "_"
    return mixing.mix_sources(docs, prefix=prefix).orderBy(f"{prefix}position").select(*[F.col(f"`{c}`") for c in docs.columns])


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows in a uniform shuffle over SHARDS shards whose sizes differ by one at most.

    Nulls, repeated rows and texts of any length are rows like all others; columns shard and slot are replaced.
    """
    return shuffle_shards.shuffle_into_shards(docs, SHARDS)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark), ("mixing", mix), ("sharding", shard)]

#: The fitted model and the shuffle are beyond SQL; tests/llm holds each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{name}")
    return docs
