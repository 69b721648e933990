"""Helpers shared by the training-data operators: table access, checkpoints, words, components.

Words everywhere are the runs of ``[^\\x20\\x09-\\x0D]``: what ``bytes.split()`` gives in Python, and what
``WORD_GAP`` separates on the JVM side.
"""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_GAP = r"[\x20\x09-\x0D]+"
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, ``spark.checkpoint.dir``; in local mode a temporary one where it is unset."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lakescan-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """An eager reliable checkpoint in the shared folder; it survives lost executors."""
    sc = df.sparkSession.sparkContext
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint(eager=True)


def words(text: Column) -> Column:
    """The words of a text in order; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def text_keys(text: Column) -> list[Column]:
    """Two independent 64-bit hashes that stand for a whole text."""
    return [F.xxhash64(text).alias("text_a"), F.xxhash64(F.lit(7), text).alias("text_b")]
