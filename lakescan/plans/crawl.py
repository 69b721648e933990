"""The crawl as one plan: inventory to datasets, partitions, schemas and events (E20 and the whole of C and D)."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import datasets as D
from ..operators.infer import infer_json, infer_text, json_cells, sample_rows, sample_stats, text_cells
from ..sources.files import avro_headers, first_rows, footers, heads, orc_footers
from ..sources.json_values import json_values
from ..sources.scratch import checkpoint
from ..sources.table_formats import delta_tables, iceberg_tables


SAMPLE_ROWS = 1000


class Crawl(NamedTuple):
    objects: DataFrame
    datasets: DataFrame
    partitions: DataFrame
    representatives: DataFrame
    buckets: DataFrame


def crawl(inventory: DataFrame, mode: str = "auto", crawl_root: str = "") -> Crawl:
    """Nothing runs here: the frames share their inputs, and one write of each makes a crawl."""
    objects = D.fold_tables(D.classified(inventory, mode, crawl_root), D.table_roots(inventory))
    datasets = D.roll_up(objects)
    return Crawl(objects, datasets, D.partition_summary(objects), D.representatives(objects), D.bucket_stats(inventory, datasets))


def infer_schemas(spark: SparkSession, representatives: DataFrame) -> DataFrame:
    """(file, pos, name, type, nullable, error) of the representatives (file, format): each reader runs once on all its files.

    Delta and Iceberg representatives name their table's folder or a file in it. A file that cannot be read, or shows no columns, gives one
    row with the error and without a name; it does not touch the others.
    """
    of = lambda *kinds: representatives.where(F.col("format").isin(*kinds)).select("file")
    plain = ["file", F.col("pos").cast("int").alias("pos"), "name", "type", "nullable"]
    found = [
        infer_text(heads(of("csv"), quoted=True)), infer_text(heads(of("tsv"), quoted=True), delimiter="\t"), infer_json(heads(of("jsonl"))), infer_json(json_values(of("json"), SAMPLE_ROWS).where("error IS NULL")),
        footers(of("parquet")), orc_footers(of("orc")), avro_headers(of("avro")), *(f for kind in ("delta", "iceberg") if (f := _table_schemas(spark, of(kind), kind)) is not None),
    ]
    error = lambda d: F.col("error") if "error" in d.columns else F.lit(None).cast("string")
    d = reduce(DataFrame.unionByName, [d.select(*plain, error(d).alias("error")) for d in found])
    known = ["csv", "tsv", "jsonl", "json", "parquet", "orc", "avro", "delta", "iceberg"]
    asked = representatives.select(F.col("file").alias("_file"), F.when(F.col("format").isin(*known), "no columns found").otherwise(F.concat(F.lit("no reader for "), "format")).alias("_error"))
    d = asked.join(d, F.col("_file") == F.col("file"), "left")
    return d.select(F.col("_file").alias("file"), "pos", "name", "type", "nullable", F.when(F.col("name").isNull(), F.coalesce("error", "_error")).alias("error"))


class Samples(NamedTuple):
    stats: DataFrame
    rows: DataFrame


def samples(representatives: DataFrame, rows_most: int = SAMPLE_ROWS, shown: int = 200) -> Samples:
    """E18, E19 for every format by one read of the representatives' (file, format) first rows: statistics of each column over ``rows_most`` rows, and ``shown`` rows as JSON.

    The cells are written once; Avro's blocks are not read. Files that cannot be read have neither.
    """
    of = lambda *kinds: representatives.where(F.col("format").isin(*kinds)).select("file")
    found = [
        text_cells(heads(of("csv"), quoted=True), rows_most), text_cells(heads(of("tsv"), quoted=True), rows_most, "\t"), json_cells(heads(of("jsonl")), rows_most),
        json_cells(json_values(of("json"), rows_most).where("error IS NULL"), rows_most), first_rows(of("parquet"), "parquet", rows_most), first_rows(of("orc"), "orc", rows_most),
    ]
    cells = checkpoint(reduce(DataFrame.unionByName, found))
    names = cells.select("file", "pos", "name").distinct()
    return Samples(sample_stats(cells, ["file", "pos", "name"]), sample_rows(cells.drop("name"), names, ["file"], shown))


def _table_schemas(spark: SparkSession, paths: DataFrame, kind: str) -> DataFrame | None:
    """The schemas of Delta or Iceberg tables under the names that ``paths`` gives them."""
    marker, read, names = ("/_delta_log/", delta_tables, "_delta_log/*.json") if kind == "delta" else ("/metadata/", iceberg_tables, "metadata/*.metadata.json")
    root = F.rtrim(F.substring_index("file", marker, 1), F.lit("/"))
    roots = paths.select("file", root.alias("root"))
    tables = [r.root for r in roots.select("root").distinct().collect()]  # a row a table, whose logs the reader lists
    if not tables:
        return None
    plain = lambda c: F.regexp_replace(c, "^file:/*", "/")
    d = read(spark, [f"{t}/{names}" for t in tables])
    return d.withColumn("_table", plain(F.url_decode(F.replace("table", F.lit("+"), F.lit("%2B"))))).join(roots.withColumn("_root", plain(F.col("root"))), F.col("_table") == F.col("_root"))
