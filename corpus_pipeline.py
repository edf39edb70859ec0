"""The training-data pipeline: five stages over ``documents``, each written as
Parquet and read again as the next one's input.

All but the last stage return the columns of ``documents``; the last adds the
shard.  Stages work on whole tables and whole texts.  Null texts count as empty,
empty tables pass through, and further columns of ``documents`` are kept.  Of
equal texts the smallest doc_id stays; rows of equal doc_id are one document and
stay or go together; without labels no document is rejected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import decontam, mixing, quality, sharding, simhash
from quillstone.llm.common import materialize, read, scratch

SHARDS = 24


def select_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the rule ensemble rejects."""
    kept = quality.keep_good(docs, read(spark, sf_dir, "labels"))
    return kept.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that with the smallest doc_id."""
    return simhash.deduplicate(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontam.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents to the target source mix, in a global shuffle."""
    return mixing.mix(docs).select(*docs.columns)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds the shard."""
    return sharding.shard_documents(docs, SHARDS)


STAGES = [
    ("quality", select_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: The ensemble and the fingerprints cannot be expressed in SQL; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark):  # what a stage wrote on its way goes when its output stands
            docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}", lasting=True)
    return docs
