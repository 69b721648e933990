"""From classified objects to datasets, partitions and buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys as K

#: Objects of one root that may meet in a task.
ROOT_OBJECTS = 100_000


def classified(inventory: DataFrame, mode: str = "auto", crawl_root: str = "") -> DataFrame:
    """The data objects of an inventory with format, compression, root, strategy, partitions and partition_path; one narrow projection.

    The same results as ``keys.classify``, but each step is a column of its own, so that none is evaluated twice.
    """
    key = F.col("key")
    d = inventory.where(K.table_marker(key).isNull() & ~K.ignored(key))
    root = crawl_root.strip("/")
    below = F.when(key.startswith(root + "/"), F.substring(key, F.lit(len(root) + 2), F.length(key))).otherwise(key) if root else key
    d = d.withColumn("_dirs", K.directories(key)).withColumn("_pairs", F.filter("_dirs", K.is_pair)).withColumn("_first", F.array_position(F.transform("_dirs", K.is_pair), F.lit(True)).cast("int"))
    hive = F.col("_first") > 0
    if mode == "hive":
        other_root, other, none = F.array_join("_dirs", "/"), "legacy", F.array().cast(K.PARTITIONS)
    else:
        dirs = K.directories(below) if root else F.col("_dirs")
        other_root, other, none = F.lit(root), "positional", F.transform(dirs, lambda x, i: F.struct(F.concat(F.lit("pt"), i.cast("string")).alias("name"), x.alias("value"))).cast(K.PARTITIONS)
    parts = F.when(hive, F.transform("_pairs", K.pair).cast(K.PARTITIONS)).otherwise(none)
    d = d.withColumns({"root": F.when(hive, F.array_join(F.slice("_dirs", F.lit(1), F.greatest(F.col("_first") - 1, F.lit(0))), "/")).otherwise(other_root), "strategy": F.when(hive, "hive").otherwise(other), "partitions": parts, "format": K.format_of(key), "compression": K.compression_of(key)})
    return d.withColumn("partition_path", K.partition_path(F.col("partitions"))).drop("_dirs", "_pairs", "_first")


def table_roots(inventory: DataFrame) -> DataFrame:
    """(bucket, table_root, table_format) of the Delta and Iceberg tables whose metadata the inventory lists."""
    m = inventory.withColumn("_m", K.table_marker(F.col("key"))).where("_m IS NOT NULL")
    return m.groupBy("bucket", F.col("_m.root").alias("table_root")).agg(F.min("_m.format").alias("table_format"))


def fold_tables(objects: DataFrame, tables: DataFrame) -> DataFrame:
    """Objects whose root lies at or under a table root move to that table (the longest such root).

    Roots are cut into their ancestors, so the join is by equality; it runs over distinct roots, not objects. Objects get
    their table by two joins: roots of more than ``ROOT_OBJECTS`` objects are broadcast (of n objects n / ROOT_OBJECTS roots at
    most), so that no task gets a whole one; of the other roots those in a table are shuffled.
    """
    roots = objects.groupBy("bucket", "root").agg(F.count("*").alias("_n"))
    parts = F.split("root", "/")
    up = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    near = roots.withColumn("table_root", F.explode(F.array_distinct(up))).join(tables.withColumn("_l", F.length("table_root")), ["bucket", "table_root"], "left")
    best = near.groupBy("bucket", "root").agg(F.max_by(F.struct("table_root", "table_format"), "_l").alias("_t"), F.max("_n").alias("_n"))
    many = best.where(F.col("_n") > ROOT_OBJECTS).select("bucket", "root", F.col("_t").alias("_many"), F.lit(True).alias("_found"))
    few = best.where((F.col("_n") <= ROOT_OBJECTS) & F.col("_t").isNotNull()).select("bucket", "root", (F.col("_n") > ROOT_OBJECTS).cast("int").alias("_spread"), "_t")  # 0, but as a literal it would be no key of the join
    d = objects.join(F.broadcast(many), ["bucket", "root"], "left")
    d = d.withColumn("_spread", F.when(F.col("_found"), F.pmod(F.hash("key"), F.lit(1 << 20)) + 1).otherwise(0)).join(few, ["bucket", "root", "_spread"], "left").withColumn("_t", F.coalesce("_many", "_t"))
    return d.withColumns({"root": F.coalesce("_t.table_root", "root"), "strategy": F.coalesce("_t.table_format", "strategy"), "table_format": F.col("_t.table_format")}).drop("_t", "_many", "_found", "_spread")


def dominant_formats(objects: DataFrame) -> DataFrame:
    """The format with most objects a root; ties go to the earlier of ``FORMAT_ORDER``; a table's own format overrides."""
    order = F.array_position(F.array(*[F.lit(f) for f in K.FORMAT_ORDER]), F.col("format"))
    votes = objects.groupBy("bucket", "root", "format").agg(F.count("*").alias("n"))
    return votes.groupBy("bucket", "root").agg(F.max_by("format", F.struct("n", -order)).alias("format"))


def representatives(objects: DataFrame) -> DataFrame:
    """C4: the largest object a root and format, ties to the later key."""
    return objects.groupBy("bucket", "root", "format").agg(F.max(F.struct("size", "key")).alias("r")).select("bucket", "root", "format", F.col("r.key").alias("key"), F.col("r.size").alias("size"))


def dataset_name(bucket: Column, root: Column) -> Column:
    """C6."""
    return F.when(root == "", bucket).otherwise(F.substring_index(root, "/", -1))


def roll_up(objects: DataFrame) -> DataFrame:
    """Datasets with file_count, total_size, strategy, format, name, partition_keys and partition_depth.

    One scan and one shuffle of partial sums to a row for each root, format and list of partition names; the rest works on
    those few rows. The set of table formats, which ``first`` asks for, keeps those sums in a hash map: with texts' minima
    alone Spark would sort all objects of a task (as it does from 128 groups a task on).
    """
    table_format = F.col("table_format") if "table_format" in objects.columns else F.lit(None).cast("string")
    names, formats = F.transform("partitions", lambda p: p["name"]), F.collect_set(table_format)
    s = objects.groupBy("bucket", "root", "format", names.alias("names")).agg(F.count("*").alias("n"), F.sum("size").alias("size"), F.when(F.size(formats) >= 0, F.min(F.struct("key", "strategy"))).alias("first"), F.array_max(formats).alias("_tf"))
    order = F.array_position(F.array(*[F.lit(f) for f in K.FORMAT_ORDER]), F.col("format"))
    votes = s.groupBy("bucket", "root", "format").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max("_tf").alias("_tf"), F.min("first").alias("first"))
    g = votes.groupBy("bucket", "root").agg(F.sum("n").alias("file_count"), F.sum("size").alias("total_size"), F.max("_tf").alias("_tf"), F.max_by("format", F.struct("n", -order)).alias("_format"), F.min("first").alias("first"))
    place = s.select("bucket", "root", "first.key", F.posexplode("names").alias("pos", "name")).groupBy("bucket", "root", "name").agg(F.min(F.struct("pos", "key")).alias("at"))
    keys = place.groupBy("bucket", "root").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "name"))), lambda x: x["name"]).alias("partition_keys"))
    d = g.join(keys, ["bucket", "root"], "left")
    found = F.coalesce("partition_keys", F.array().cast("array<string>"))
    return d.select("bucket", "root", dataset_name(F.col("bucket"), F.col("root")).alias("name"), F.coalesce("_tf", "_format").alias("format"), "first.strategy", "file_count", "total_size", found.alias("partition_keys"), F.size(found).alias("partition_depth"))


def partition_summary(objects: DataFrame) -> DataFrame:
    """Files and bytes of each partition."""
    d = objects.where(F.size("partitions") > 0)
    return d.groupBy("bucket", "root", "partition_path").agg(F.count("*").alias("file_count"), F.sum("size").alias("total_size"))


def partition_values(partition_path: Column) -> Column:
    """The map of a partition path's names and values."""
    return F.str_to_map(F.trim(partition_path, F.lit("/")), F.lit("/"), F.lit("="))


def bucket_stats(inventory: DataFrame, datasets: DataFrame) -> DataFrame:
    """Objects, bytes and datasets of each bucket."""
    o = inventory.groupBy("bucket").agg(F.count("*").alias("objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))
    return o.join(datasets.groupBy("bucket").agg(F.count("*").alias("datasets")), "bucket", "left").fillna({"datasets": 0})


def estimated_rows(per_file: Column, files: Column) -> Column:
    """The representative's rows times the files; 0 where unknown."""
    return F.when(per_file.isNull() | (per_file <= 0), F.lit(0)).otherwise(per_file * F.greatest(files, F.lit(1)))


def united(a: Column, b: Column) -> Column:
    """The names of both lists in order, once, without blanks."""
    return F.filter(F.array_distinct(F.concat(a, b)), lambda x: F.trim(x) != "")
