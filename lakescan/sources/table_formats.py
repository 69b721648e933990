"""Delta and Iceberg table schemas from their metadata files, many tables in one job and without their libraries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DELTA_FIELD = "fields array<struct<name:string,type:string,nullable:boolean>>"


def delta_tables(spark: SparkSession, logs: str | list[str]) -> DataFrame:
    """(table, pos, name, type, nullable, is_partition) from the newest log file that carries ``metaData``; ``logs`` are globs of ``_delta_log/*.json``."""
    schema = "metaData struct<schemaString:string,partitionColumns:array<string>>"
    d = spark.read.schema(schema).json(logs).where("metaData IS NOT NULL").withColumn("file", F.col("_metadata.file_path"))
    d = d.where(~F.col("file").contains(".checkpoint"))
    last = d.groupBy(F.substring_index("file", "/_delta_log/", 1).alias("table")).agg(F.max_by("metaData", "file").alias("m"))
    # a nested type is an object in the log; read as text it keeps its JSON
    fields = F.from_json("m.schemaString", DELTA_FIELD)["fields"]
    return last.select("table", "m.partitionColumns", F.posexplode(fields).alias("pos", "f")).select("table", "pos", "f.name", "f.type", F.coalesce("f.nullable", F.lit(True)).alias("nullable"), F.coalesce(F.array_contains("partitionColumns", F.col("f.name")), F.lit(False)).alias("is_partition"))


def iceberg_tables(spark: SparkSession, metadata: str | list[str]) -> DataFrame:
    """(table, pos, name, type, nullable, is_partition, num_rows) from the lexically last ``*.metadata.json`` of each table."""
    field = "array<struct<id:int,name:string,type:string,required:boolean>>"
    schema = f"`current-schema-id` int, schemas array<struct<`schema-id`:int,fields:{field}>>, schema struct<fields:{field}>, `partition-specs` array<struct<fields:array<struct<name:string>>>>, `current-snapshot-id` long, snapshots array<struct<`snapshot-id`:long,`timestamp-ms`:long,summary:map<string,string>>>"
    d = spark.read.schema(schema).option("multiLine", True).json(metadata).withColumn("file", F.col("_metadata.file_path"))
    whole = F.struct(*[F.col(f"`{c}`") for c in d.columns if c != "file"])
    last = d.groupBy(F.substring_index("file", "/metadata/", 1).alias("table")).agg(F.max_by(whole, "file").alias("m"))
    m = lambda name: F.col(f"m.`{name}`")
    current = F.filter(m("schemas"), lambda s: s["schema-id"] == m("current-schema-id"))
    fields = F.coalesce(F.get(current, F.lit(0))["fields"], F.get(m("schemas"), F.lit(0))["fields"], m("schema")["fields"])
    parts = F.array_distinct(F.flatten(F.transform(m("partition-specs"), lambda s: F.transform(s["fields"], lambda f: f["name"]))))
    newest = F.element_at(F.array_sort(F.transform(m("snapshots"), lambda s: F.struct(s["timestamp-ms"].alias("at"), F.try_element_at(s["summary"], F.lit("total-records")).alias("n")))), -1)
    out = last.select("table", parts.alias("_parts"), newest["n"].try_cast("long").alias("num_rows"), F.posexplode(fields).alias("pos", "f"))
    return out.select("table", "pos", "f.name", "f.type", (~F.coalesce("f.required", F.lit(False))).alias("nullable"), F.coalesce(F.array_contains("_parts", F.col("f.name")), F.lit(False)).alias("is_partition"), "num_rows")
