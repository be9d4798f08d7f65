"""The corpus pipeline: language, near copies, benchmark passages, mixture, shards.

``STAGES`` lists (name, function); each function takes (spark, docs, sf_dir) and
returns the documents it keeps. ``run`` writes each stage's result as Parquet and
reads it again as the next one's input. The operators learn, so no SQL twin exists;
``tests/llm`` holds the stages against brute force.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lineagelab.llm import decontaminate, language, mixing, near_dedup, sharding
from lineagelab.llm.common import materialize, read
from lineagelab.session import ensure_importable


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language of the context trees; ``und`` ones, letter noise and other languages go."""
    ensure_importable(spark)
    return language.accepted(docs, language.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    ensure_importable(spark)
    return near_dedup.drop_near_copies(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage of 5 % of their words or more."""
    ensure_importable(spark)
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample with the raked shares of sources, languages and topics."""
    ensure_importable(spark)
    return mixing.sample(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in Hilbert order with shard and slot."""
    ensure_importable(spark)
    return sharding.write_order(docs)


STAGES = [
    ("language", keep_languages),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("mix", mix_sources),
    ("shard", cut_shards),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
