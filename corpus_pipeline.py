"""From raw documents to training shards: five stages, each one operator over all rows that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lifetrack.llm import decontamination, jaccard, mixing, neighbours, sharding
from lifetrack.session import prepare, settle

SHARDS = 8
#: Documents below this score are rejected.
LEAST_QUALITY = 0.5
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose nearest labelled neighbours vote for good quality; held-out labels are not learned from."""
    labels = _table(spark, sf_dir, "labels").where(~neighbours.held_out(F.col("doc_id")))
    scored = neighbours.score(docs, neighbours.fit(docs, labels))
    return scored.where(F.col("score") >= LEAST_QUALITY).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, the one with the smallest id."""
    return jaccard.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, in whatever order its passages stand."""
    return decontamination.remove(docs, _table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by their source's rate, in a random order."""
    return mixing.replicate(docs).select(*docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows with ``shard`` and ``slot``; every shard holds the sources in the mixture's proportions."""
    return sharding.interleave(docs, shards=SHARDS)


STAGES = [
    ("quality", classify_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", shard),
]

#: SQL has neither the learned scores nor the tiling; tests compare the stages with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again as the next stage's input."""
    prepare(spark)
    docs = _table(spark, sf_dir, "documents").select(*COLUMNS)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = settle(docs)
    return docs
