"""A corpus pipeline in five stages, each over all that its predecessor kept.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a
DataFrame, which is written as Parquet and read again as the next one's docs. All
but the last return the columns of `documents`; the last adds `shard`.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lattica.llm import common, decontam, langid, mixing, near_dup, queries, sharding

#: A document goes if its likeliest language has a lower posterior.
LEAST_LANGUAGE_SCORE = 0.5
NEAR = near_dup.Measure(words=5, num=80, den=100)
#: Of all words, so many are taken; no document is repeated.
MIX_SHARE, MIX_EPOCHS = 0.8, 1

#: Training, candidate search and budgets can't be said in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts in no learned language."""
    return langid.in_a_language(docs, langid.train(docs, queries.PIECE_VOCABULARY), LEAST_LANGUAGE_SCORE)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return near_dup.one_of_each(docs, NEAR)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.without_leaks(docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each source's share of the budget, in whole documents."""
    taken = mixing.mix(docs, queries.DOMAINS, queries.MIX_WEIGHTS, MIX_SHARE, MIX_EPOCHS, queries.MIX_SEED)
    return mixing.take_mixture(docs, taken)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards of nearly equal bytes, in `shard`."""
    return sharding.assign_shards(docs, queries.N_SHARDS, f"{common.shared_dir(spark)}/slot-maps/{uuid.uuid4().hex}")


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each stage's rows are kept in the shared folder."""
    folder = f"{common.shared_dir(spark)}/pipeline/{uuid.uuid4().hex}"
    docs = common.table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
