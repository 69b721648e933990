"""Object inventories: listings of stored objects, and the page-wise browsing of their keys.

An inventory has bucket, key, size, modified and, where the source knows them, etag, storage_class and version_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import compression_of, format_of
from . import listing

SCHEMA = "bucket string, key string, size long, etag string, storage_class string, version_id string, modified timestamp_ntz"


def list_folder(spark: SparkSession, root: str, bucket: str, markers: bool = True) -> DataFrame:
    """A1: a recursive listing without reading contents, by tasks; ``markers=False`` leaves out what stands in ``_delta_log`` folders."""
    try:
        listing.store_of(root)
    except Exception:  # a store that only Spark's readers know
        return _listed_by_spark(spark, root, bucket, markers)
    d = listing.objects(spark, root, bucket)
    return d if markers else d.where(~F.concat(F.lit("/"), "key").contains("/_delta_log/"))


def _listed_by_spark(spark: SparkSession, root: str, bucket: str, markers: bool) -> DataFrame:
    """Spark hides names that start with ``_`` or ``.``; ``_delta_log`` folders are listed by a glob for each depth that has folders."""
    root = root.rstrip("/")
    listed = lambda path: spark.read.format("binaryFile").load(path).select("path", "modificationTime", "length")
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "modificationTime", "length")
    # paths come back as URIs: what follows the root's first occurrence is the key
    tail = root.rsplit("://", 1)[-1] + "/"
    key = F.substring(F.col("path"), F.instr("path", tail) + len(tail), F.length("path"))
    if markers:
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        there = lambda glob: (p := jvm.org.apache.hadoop.fs.Path(glob)).getFileSystem(conf).globStatus(p)
        stem = root
        while there(stem):
            if there(f"{stem}/_delta_log/*.json"):
                found = found.unionByName(listed(f"{stem}/_delta_log/*.json"))
            stem += "/*"
    none = F.lit(None).cast("string")
    return found.select(F.lit(bucket).alias("bucket"), key.alias("key"), F.col("length").alias("size"), none.alias("etag"), none.alias("storage_class"), none.alias("version_id"), F.col("modificationTime").cast("timestamp_ntz").alias("modified"))


def restrict(inventory: DataFrame, prefix: str = "", start_after: str = "") -> DataFrame:
    """A2: keys under a prefix and after a key; both reach a Parquet inventory's scan as pushed filters."""
    d = inventory.where(F.col("key").startswith(prefix)) if prefix else inventory
    return d.where(F.col("key") > start_after) if start_after else d


def children(inventory: DataFrame, prefix: str = "") -> DataFrame:
    """Immediate children of a prefix: folders (distinct next steps) and files with size, modified, format and compression."""
    rest = F.substring(F.col("key"), F.lit(len(prefix) + 1), F.length("key"))
    d = restrict(inventory, prefix).withColumn("_rest", rest).where("_rest <> ''")
    folder = F.instr("_rest", "/") > 0
    d = d.withColumns({"name": F.substring_index("_rest", "/", 1), "is_folder": folder})
    g = d.groupBy("bucket", "name", "is_folder").agg(F.sum("size").alias("_size"), F.max("modified").alias("_modified"), F.count("*").alias("objects"))
    key = F.concat(F.lit(prefix), F.col("name"), F.when(F.col("is_folder"), "/").otherwise(""))
    file = lambda c: F.when(~F.col("is_folder"), c)
    return g.select("bucket", "name", "is_folder", key.alias("key"), file(F.col("_size")).alias("size"), file(F.col("_modified")).alias("modified"), file(format_of(F.col("name"))).alias("format"), file(compression_of(F.col("name"))).alias("compression"), "objects")


def sort_listing(found: DataFrame, by: str = "name", descending: bool = False) -> DataFrame:
    """Folders first, always by name; files by name, size or modified, ties by name."""
    key = F.when(~F.col("is_folder"), F.col(by)) if by != "name" else F.col("name")
    order = key.desc() if descending else key.asc()
    by_name = F.when(F.col("is_folder"), F.col("name"))
    return found.orderBy(F.col("is_folder").desc(), by_name.asc(), order, F.col("name").asc())


def page(found: DataFrame, cursor: str = "", limit: int = 100, search: str = "", name: str = "name") -> tuple[DataFrame, str, bool]:
    """The next ``limit`` rows by name after ``cursor`` whose name starts with ``search``; the new cursor, and whether more follow."""
    d = found.where(F.col(name) > cursor) if cursor else found
    d = d.where(F.lower(name).startswith(search.lower())) if search else d
    top = d.orderBy(name).limit(limit + 1)
    names = [r[0] for r in top.select(name).collect()]  # one page
    more = len(names) > limit
    return top.orderBy(name).limit(limit), names[limit - 1] if more else "", more


def _ancestors(key: Column) -> Column:
    """Every folder above a key, "" among them."""
    parts = F.split(key, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))))


def folder_summaries(inventory: DataFrame, cost: str | None = None) -> DataFrame:
    """I4 for every folder at once: files, bytes, last modified, known formats and, where the inventory has it, cost."""
    d = inventory.where(~F.col("key").endswith("/")).withColumn("folder", F.explode(_ancestors(F.col("key")))).withColumn("_format", format_of(F.col("key")))
    aggs = [F.count("*").alias("files"), F.sum("size").alias("bytes"), F.max("modified").alias("last_modified"), F.array_join(F.sort_array(F.collect_set(F.when(F.col("_format") != "unknown", F.col("_format")))), ",").alias("formats")]
    if cost:
        aggs.append(F.sum(cost).alias("cost"))
    return d.groupBy("bucket", "folder").agg(*aggs)


def folder_summary(inventory: DataFrame, prefix: str = "") -> DataFrame:
    """I4 for one prefix, over all its files."""
    known = F.when(format_of(F.col("key")) != "unknown", format_of(F.col("key")))
    return restrict(inventory, prefix).where(~F.col("key").endswith("/")).agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.max("modified").alias("last_modified"), F.array_join(F.sort_array(F.collect_set(known)), ",").alias("formats"))


def price_regions(buckets: DataFrame, rates: DataFrame, default: str = "us-east-1") -> DataFrame:
    """Each bucket's region if rates exist for it, else the default."""
    known = rates.select(F.col("region").alias("_known")).distinct()
    return buckets.join(known, F.col("region") == F.col("_known"), "left").select(*buckets.columns, F.coalesce("_known", F.lit(default)).alias("price_region"))


def objects_of(inventory: DataFrame, bucket: str, root: str | None = None, limit: int = 50) -> DataFrame:
    """The first objects by key of a bucket, or of a dataset in it."""
    d = inventory.where(F.col("bucket") == bucket)
    d = d.where(F.col("root") == root) if root is not None else d
    return d.orderBy("key").limit(limit)
