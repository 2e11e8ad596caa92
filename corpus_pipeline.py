"""Corpus pipeline: filter by quality, drop near duplicates, drop contaminated documents, mix sources, assign shards.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and reread as the next
stage's documents.  All but the last return the columns of ``documents``.

A quality model is trained from the labelled documents of the stage's input; classes, contamination and the mix are judged
over all documents that the preceding stages kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm import decontam, minhash, mixing, quality, queries, sharding
from kinlink.llm.scratch import fresh_path, release

#: The first stages hold a model and sampled signatures that SQL cannot express; tests compare every stage with a brute-force version.
ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, _table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.keep_one(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.keep_clean(docs, _table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as rows: a document drawn twice is there twice."""
    mix = mixing.mix(docs, "text", "source", "doc_id").drop("shard")
    # the copy in which a source's quota ends is shorter
    return mix.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sharding.shard(docs, "doc_id", "text", queries.SHARD_BYTES)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontaminated),
    ("mixing", mixed),
    ("sharding", sharded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each is written to the shared folder and reread, and then its working tables go."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = fresh_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        release(path)
    return docs
