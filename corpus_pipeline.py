"""The corpus pipeline: five of the training-data operators over ``documents``, each stage written and read again."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakescan.llm import line_dedup as lines
from lakescan.llm import mixing, packing, quality_rules, similarity
from lakescan.llm.common import shared_dir, table

#: Packing goes through a tokenizer, which SQL cannot express; the pipeline is tested against a brute-force version.
ORACLE_SQL = None


def _measured(docs: DataFrame, columns: list[str]) -> DataFrame:
    """The columns of documents, with n_chars as the text now has it."""
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, without the lines that their host repeats."""
    return _measured(quality_rules.kept_documents(docs), docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines of windows seen before; a document that loses all its lines goes."""
    return _measured(lines.kept_documents(docs), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join."""
    return similarity.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mixed to the sources' target weights, each as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as sequences of power-of-two lengths, without their tokens."""
    return packing.query(docs)


STAGES = [("quality_rules", quality), ("line_dedup", line_dedup), ("ngram_jaccard_join", near_duplicates), ("mixing", mix), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
