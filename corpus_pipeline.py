"""The corpus pipeline: quality, near-duplicates, benchmark passages, mixing, shards. Each stage is written and reread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docloom.llm.common import scratch
from docloom.llm.decontam import drop_contaminated
from docloom.llm.mixing import replicate
from docloom.llm.quality import filter_documents
from docloom.llm.sharding import shard_documents
from docloom.llm.simhash import deduplicate
from docloom.session import ship

#: Target weights of sources in the mix; a source without one has weight 1.
WEIGHTS = {"src0": 4.0}
SHARDS = 40


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules reject go."""
    return filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return deduplicate(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark passages go."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated so that sources reach their weights."""
    return replicate(docs, WEIGHTS).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows get a shard and a slot."""
    return shard_documents(docs, SHARDS, keep=[c for c in docs.columns if c != "doc_id"])


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: No SQL can express the near-duplicate stage; tests hold the pipeline against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
