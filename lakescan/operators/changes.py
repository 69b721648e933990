"""Incremental listings: differences, upserts, schema versions and change events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import metadata_hash

OBJECT = ["bucket", "key"]


def hashed(inventory: DataFrame) -> DataFrame:
    return inventory.withColumn("hash", metadata_hash(F.col("etag"), F.col("size"), F.col("version_id"), F.col("modified")))


def difference(listing: DataFrame, previous: DataFrame) -> DataFrame:
    """(bucket, key, change): new, changed, unchanged or removed, by one full join on the object."""
    now = hashed(listing).select(*OBJECT, F.col("hash").alias("_now"))
    then = hashed(previous).select(*OBJECT, F.col("hash").alias("_then"))
    change = F.when(F.col("_then").isNull(), "new").when(F.col("_now").isNull(), "removed").when(F.col("_now") == F.col("_then"), "unchanged").otherwise("changed")
    return now.join(then, OBJECT, "full").select(*OBJECT, change.alias("change"))


def upsert(previous: DataFrame, listing: DataFrame, now: Column, full: bool = False) -> DataFrame:
    """The stored inventory after a listing, by one full join. Known objects keep id and created_at; a full run rewrites all listed rows, an incremental one only new and changed rows; objects that are gone stay."""
    whole = lambda d, name: hashed(d).select(*OBJECT, F.struct(*d.columns, "hash").alias(name))
    d = whole(previous, "_then").join(whole(listing, "_now"), OBJECT, "full")
    fresh = F.col("_now").isNotNull() if full else F.col("_now").isNotNull() & (F.col("_then").isNull() | (F.col("_now.hash") != F.col("_then.hash")))
    identity = F.substring(F.sha2(F.concat_ws("/", "bucket", "key"), 256), 1, 32)
    made = {"id": F.coalesce("_then.id", identity), "created_at": F.coalesce("_then.created_at", now), "updated_at": now}
    own = lambda c: F.col(c) if c in OBJECT else F.when(F.col("_fresh"), made[c] if c in made else F.col(f"_now.{c}")).otherwise(F.col(f"_then.{c}")).alias(c)
    return d.withColumn("_fresh", fresh).select(*map(own, previous.columns))


def run_metrics(listing: DataFrame, changes: DataFrame, datasets: DataFrame) -> DataFrame:
    """D3: one row of counters of a run."""
    c = changes.agg(*[F.count_if(F.col("change") == k).alias(f"objects_{k}") for k in ("new", "changed", "removed", "unchanged")])
    o = listing.agg(F.count("*").alias("objects_scanned"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    n = datasets.agg(F.count("*").alias("datasets"))
    return o.join(c, F.lit(True)).join(n, F.lit(True)).withColumn("status", F.lit("completed"))  # one row each


def fingerprints(columns: DataFrame, keys: list[str]) -> DataFrame:
    """A schema's fingerprint from its (name, type, nullable) rows; the order of columns does not matter."""
    parts = F.array_sort(F.collect_list(F.concat_ws(":", "name", "type", F.col("nullable").cast("string"))))
    return columns.groupBy(*keys).agg(F.substring(F.sha2(F.array_join(parts, "|"), 256), 1, 32).alias("fingerprint"))


def next_versions(found: DataFrame, stored: DataFrame, key: str = "dataset") -> DataFrame:
    """(dataset, version, fingerprint, previous) to add: those whose fingerprint is not the latest stored one."""
    last = stored.groupBy(key).agg(F.max("version").alias("_v"), F.max_by("fingerprint", "version").alias("previous"))
    d = found.join(last, key, "left").where(F.col("previous").isNull() | (F.col("previous") != F.col("fingerprint")))
    return d.select(key, (F.coalesce("_v", F.lit(0)) + 1).alias("version"), "fingerprint", "previous")


def replace_partitions(stored: DataFrame, found: DataFrame, datasets: DataFrame, key: list[str]) -> DataFrame:
    """The stored partitions with those of ``datasets`` replaced, also by none."""
    return stored.join(datasets.select(*key).distinct(), key, "left_anti").unionByName(found.select(*stored.columns))


def change_events(datasets: DataFrame, stored_datasets: DataFrame, versions: DataFrame, columns: DataFrame, partitions: DataFrame, stored_partitions: DataFrame, metrics: DataFrame, at: Column, mode: str = "auto") -> DataFrame:
    """(type, subject, payload, at): the run's start for each bucket, discovered datasets, changed schemas, truly new partitions, and the run's completion.

    ``versions`` are those of ``next_versions``, ``columns`` the (dataset, name) rows of the schemas they are made from.
    """
    key = ["bucket", "root"]
    made = lambda d, kind, subject, *fields: d.select(F.lit(kind).alias("type"), subject.alias("subject"), F.to_json(F.struct(*fields)).alias("payload"), at.alias("at"))
    place = F.concat_ws("/", "bucket", "root")
    discovered = made(datasets.join(stored_datasets.select(*key), key, "left_anti"), "DatasetDiscovered", place, "bucket", "root", "name", "format", "file_count")
    started = made(datasets.groupBy("bucket").agg(F.lit(mode).alias("mode")), "CrawlStarted", F.col("bucket"), "bucket", "mode")
    wide = versions.join(columns.groupBy("dataset").agg(F.count("*").alias("columns")), "dataset", "left").fillna({"columns": 0})
    schema = made(wide, "SchemaChanged", F.col("dataset"), "version", (F.col("version") - 1).alias("old_version"), "previous", "columns")
    fresh = made(partitions.join(stored_partitions.select(*key, "partition_path"), [*key, "partition_path"], "left_anti"), "NewPartition", place, "partition_path", "file_count")
    updated = made(datasets.join(stored_datasets.select(*key), key, "left_semi"), "CatalogUpdated", place, "bucket", "root")
    done = made(metrics, "CrawlCompleted", F.lit("crawl"), *metrics.columns)
    return started.unionByName(discovered).unionByName(schema).unionByName(fresh).unionByName(updated).unionByName(done)


def delete_datasets(gone: DataFrame, tables: dict[str, DataFrame], key: list[str] = ("bucket", "root")) -> dict[str, DataFrame]:
    """Every table without the rows of ``gone``; in ``objects`` the rows stay and lose their dataset."""
    key, out = list(key), {}
    for name, table in tables.items():
        if name == "objects":
            mark = gone.select(*key).distinct().withColumn("_gone", F.lit(True))
            out[name] = table.join(mark, key, "left").withColumn("dataset_id", F.when(F.col("_gone"), F.lit("")).otherwise(F.col("dataset_id"))).select(*table.columns)
        else:
            out[name] = table.join(gone.select(*key).distinct(), key, "left_anti")
    return out


def latest_versions(schemas: DataFrame, key: str = "dataset") -> DataFrame:
    """The newest version row of each dataset."""
    w = Window.partitionBy(key).orderBy(F.desc("version"))
    return schemas.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
