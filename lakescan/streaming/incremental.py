"""Continuous incremental crawl. New inventory files in a landing folder are a stream; each batch is diffed and stored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.changes import OBJECT, hashed
from ..sources.inventory import SCHEMA


def stream_changes(spark: SparkSession, landing: str, state: str, checkpoint: str, on_changes: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Reads what has landed since the last run, once, and appends new and changed objects to the ``state`` table.

    Each batch is written under its own number, over what an earlier try of the batch left, so a batch that is tried again
    changes nothing. The current inventory is the newest row an object (``current_state``).
    """

    def store(batch: DataFrame, number: int) -> None:
        known = current_state(spark, state, before=number).select(*OBJECT, F.col("hash").alias("_hash"))
        # of several rows of one object in a batch the last modified counts
        rows = hashed(batch).groupBy(*OBJECT).agg(F.max_by(F.struct(*[c for c in hashed(batch).columns if c not in OBJECT]), F.struct("modified", "hash")).alias("r")).select(*OBJECT, "r.*")
        d = rows.join(known, OBJECT, "left").withColumn("change", F.when(F.col("_hash").isNull(), "new").when(F.col("_hash") != F.col("hash"), "changed")).where("change IS NOT NULL").drop("_hash")
        d.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").parquet(f"{state}/batch={number}")
        if on_changes:
            on_changes(spark.read.parquet(f"{state}/batch={number}"), number)

    s = spark.readStream.schema(SCHEMA).parquet(landing)
    return s.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()


def current_state(spark: SparkSession, state: str, before: int | None = None) -> DataFrame:
    """The newest row of each object."""
    try:
        d = spark.read.schema(f"{SCHEMA}, hash string, change string, batch long").parquet(state)
    except Exception as e:  # the folder is made by the first batch
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return hashed(spark.createDataFrame([], SCHEMA)).withColumns({"change": F.lit(""), "batch": F.lit(0).cast("long")})
    d = d.where(F.col("batch") < before) if before is not None else d
    return d.groupBy(*OBJECT).agg(F.max_by(F.struct(*[c for c in d.columns if c not in OBJECT]), "batch").alias("r")).select(*OBJECT, "r.*")
