"""A corpus pipeline of five stages over `documents`; each is written as Parquet and read again by the next."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from corpusgraph.llm import decontaminate, jaccard, mixing, quality, token_ids
from corpusgraph.llm.common import shared_dir, ship, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. A null, empty or blank text has no words, so it goes; repeated rows and ties
    are judged alike; no rows give none; other columns, whatever their names, stay as they are."""
    ship(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (5-word shingles, similarity 0.8 or more) stays, the one with the
    smallest id: operator 5's fingerprints find candidates, which are verified, and what few bits can't reach is completed
    exactly. Equal rows count as copies; texts without words are copies of each other; a row without an id can't be told
    apart from others and stays; no rows give none."""
    ship(spark)
    return jaccard.drop_near_duplicates(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go. Null and empty texts hold none and stay, as do rows without an id; rows of
    one id go together; no rows give none."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mixing_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stays as often as the mix takes it, repeated rows each on their own. Texts without words are taken
    like others of their source; null sources are one source; no rows give none."""
    return mixing.mixed(docs)


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as token ids on disk; returned as read back from there. A null text is the empty one, with its end id
    alone; null ids come first; repeated rows follow each other; no rows give none."""
    ship(spark)
    return token_ids.round_trip(docs, "pipeline").withColumnRenamed("id", "doc_id")


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("mixing_sources", mixing_sources),
    ("token_output", token_output),
]

#: The quality model and the alignments aren't SQL; tests/llm holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/corpusgraph/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
