"""The catalog: registered tables as a relation, views over files without a copy, and its reads."""

from __future__ import annotations

import json
import re
from dataclasses import asdict, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.files import footers
from ..sources.versions import Versions
from ..sources.readers import ReadOptions, folder_files, read_files, read_folder, read_pruned, with_path_partitions
from .compat import group_files, read_members

ENTRY = "name string, bucket string, root string, format string, paths array<string>, partition_columns array<string>, options string, strategy string, schema_ddl string"
VALID = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")


class Catalog:
    """Entries, registered one by one, are a versioned list: a writer puts the next version if nobody was first, and else starts anew."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")
        self.versions = Versions(spark, self.folder)

    def entries(self) -> DataFrame:
        names = [c.split()[0] for c in ENTRY.split(", ")]
        rows = [tuple(e[n] for n in names) for e in self.versions.current()[1].get("entries", [])]
        return self.spark.createDataFrame(rows, ENTRY)

    def taken(self, name: str) -> bool:
        """Registered, or some other table or view of the session."""
        return bool(self.entries().where(F.lower("name") == name.lower()).limit(1).count()) or self.spark.catalog.tableExists(name)

    def suggest(self, name: str, most: int = 999) -> str:
        """The name, or with the first free number from 2 on."""
        used = self.entries().select(F.lower("name").alias("n")).unionByName(self.spark.createDataFrame([(t.name.lower(),) for t in self.spark.catalog.listTables()], "n string"))
        names = self.spark.range(1, most + 1).select("id", F.when(F.col("id") == 1, F.lit(name)).otherwise(F.concat_ws("_", F.lit(name), "id")).alias("candidate"))
        free = names.join(used, F.lower("candidate") == F.col("n"), "left_anti").agg(F.min_by("candidate", "id")).first()[0]
        if free is None:
            raise ValueError(f"no free name for {name}")
        return free

    def _selected(self, paths: list[str], o: ReadOptions) -> DataFrame:
        """Parquet files picked by hand, as one table of their merged schema; files that do not fit are left out."""
        own = footers(self.spark.createDataFrame([(p,) for p in paths], "file string")).where("error IS NULL").select("file", "pos", "name", "type")
        place = self.spark.createDataFrame(list(enumerate(paths)), "file_idx long, file string")
        columns = own.join(place, "file").withColumn("format", F.lit("parquet"))
        verdicts, merged = group_files(columns)
        good = {r.file_idx for r in verdicts.where("verdict <> 'incompatible'").collect()}  # named one by one
        shapes: dict[str, list[str]] = {}
        for r in columns.where(F.col("file_idx").isin(sorted(good))).groupBy("file_idx", "file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "type"))), lambda c: F.concat(F.lit("`"), c["name"], F.lit("` "), c["type"])), ", ").alias("ddl")).orderBy("file_idx").collect():
            shapes.setdefault(r.ddl, []).append(r.file)
        return read_members(self.spark, [(T._parse_datatype_string(ddl), own) for ddl, own in shapes.items()], merged["parquet"], filename=o.filename)

    def _by_strategy(self, e) -> str | None:
        """The columns that a folder of Parquet files is read with under ``latest`` or ``strict``."""
        paths = list(e.paths) or folder_files(self.spark, e.root, e.format)
        own = footers(self.spark.createDataFrame([(p,) for p in paths], "file string")).where("error IS NULL")
        ddl = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name", "type"))), lambda c: F.concat(F.lit("`"), c["name"], F.lit("` "), c["type"])), ", ")
        times = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths).select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"))
        schemas = own.groupBy("file").agg(ddl.alias("schema")).withColumn("name", F.substring_index("file", ":", -1)).join(times.withColumn("name", F.substring_index("file", ":", -1)).drop("file"), "name")
        return schema_by_strategy(schemas, e.strategy, "") or None

    def _frame(self, e) -> DataFrame:
        asked = ReadOptions(**json.loads(e.options))
        parts = list(e.partition_columns)
        o = replace(asked, filename=True) if parts else asked
        if e.format == "parquet" and e.strategy in ("latest", "strict"):
            df = self.spark.read.schema(self._by_strategy(e)).option("recursiveFileLookup", True).parquet(*(list(e.paths) or [e.root]))
            df = df.withColumn("filename", F.col("_metadata.file_path")) if o.filename else df
        elif e.paths and e.format == "parquet" and o.union_by_name:
            df = self._selected(list(e.paths), o)
        elif e.paths:
            df = read_files(self.spark, list(e.paths), e.format, o)
        else:
            df = read_folder(self.spark, e.root, e.format, options=o)
        if parts and "filename" in df.columns and not set(parts) <= set(df.columns):  # a Hive folder has them already
            df = with_path_partitions(df, e.root, parts, True)
        return df if asked.filename else df.drop("filename")

    def register(self, name: str, root: str, fmt: str, bucket: str = "", partition_columns: list[str] = (), options: ReadOptions | None = None, paths: list[str] = (), strategy: str = "union") -> DataFrame:
        """A row and a view. The view is made first, so a source that cannot be read leaves no row."""
        if not VALID.fullmatch(name):
            raise ValueError(f"not a table name: {name!r}")
        if self.taken(name):
            raise ValueError(f"the name is taken: {name}")
        row = self.spark.createDataFrame([(name, bucket, root, fmt, list(paths), list(partition_columns), json.dumps(asdict(options or ReadOptions())), strategy, "")], ENTRY)
        df = self._frame(row.first())
        entry = row.first().asDict() | {"schema_ddl": df.schema.simpleString()}

        def added(content: dict) -> dict:
            own = content.get("entries", [])
            if any(e["name"].lower() == name.lower() for e in own):
                raise ValueError(f"the name is taken: {name}")
            return {"entries": [*own, entry]}

        self.versions.change(added)
        df.createOrReplaceTempView(name)
        return df

    def refresh(self) -> list[str]:
        """Every entry's view, made anew; what a session does at its start."""
        found = self.entries().collect()  # registered by hand, one by one
        for e in found:
            self._frame(e).createOrReplaceTempView(e.name)
        return [e.name for e in found]

    def scan(self, name: str, where: str) -> DataFrame:
        """The rows of a registered positional folder where a predicate on its partition columns holds; other files are not read."""
        e = self.entries().where(F.lower("name") == name.lower()).first()
        if e is None:
            raise ValueError(f"no such entry: {name}")
        own = list(e.partition_columns)
        df = read_pruned(self.spark, e.root, e.format, own, where, ReadOptions(**json.loads(e.options))) if own and not e.paths else None
        return self._frame(e).where(where) if df is None else df

    def drop(self, name: str) -> None:
        self.versions.change(lambda content: {"entries": [e for e in content.get("entries", []) if e["name"].lower() != name.lower()]})
        self.spark.catalog.dropTempView(name)

    def others(self) -> DataFrame:
        """Tables and views made elsewhere."""
        t = self.spark.createDataFrame([(t.name, t.tableType) for t in self.spark.catalog.listTables()], "name string, kind string")
        return t.join(self.entries().select(F.lower("name").alias("_n")), F.lower("name") == F.col("_n"), "left_anti")


def schema_by_strategy(schemas: DataFrame, strategy: str, merged: str) -> str:
    """The schema of a table over files (file, modified, schema): ``union`` the merged one, ``latest`` the newest file's, ``strict`` the only one."""
    if strategy == "union":
        return merged
    r = schemas.agg(F.max_by("schema", "modified").alias("latest"), F.count_distinct("schema").alias("n")).first()
    if strategy == "strict" and r.n != 1:
        raise ValueError(f"{r.n} different schemas under strict")
    return r.latest


def search_datasets(datasets: DataFrame, text: str = "", bucket: str = "", fmt: str = "", limit: int = 50, offset: int = 0) -> DataFrame:
    """By bucket, format and part of name or root in any case, newest first."""
    d = datasets.where(F.col("bucket") == bucket) if bucket else datasets
    d = d.where(F.col("format") == fmt) if fmt else d
    if text:
        d = d.where(F.lower("name").contains(text.lower()) | F.lower("root").contains(text.lower()))
    return d.orderBy(F.desc("updated_at"), "bucket", "root").offset(offset).limit(limit)


def latest_schema(schemas: DataFrame, columns: DataFrame, stats: DataFrame) -> DataFrame:
    """I8: the columns of each dataset's newest schema version, with their statistics."""
    last = schemas.groupBy("dataset").agg(F.max("version").alias("version"))
    return columns.join(last, ["dataset", "version"]).join(stats, ["dataset", "name"], "left").orderBy("dataset", "pos")


def dataset_detail(bucket: str, root: str, datasets: DataFrame, columns: DataFrame, partitions: DataFrame, samples: DataFrame, objects: DataFrame) -> dict[str, DataFrame]:
    """What is known of one dataset, each part a frame."""
    own = lambda d: d.where((F.col("bucket") == bucket) & (F.col("root") == root))
    return {"dataset": own(datasets), "columns": own(columns).orderBy("pos"), "partitions": own(partitions).orderBy("partition_path"), "samples": own(samples), "objects": own(objects).orderBy("key").limit(50)}


def registrations(entries: DataFrame, datasets: DataFrame) -> DataFrame:
    """How many tables are registered on each dataset, and whether any is."""
    n = entries.groupBy("bucket", "root").agg(F.count("*").alias("tables"))
    return datasets.join(n, ["bucket", "root"], "left").select("bucket", "root", F.coalesce("tables", F.lit(0)).alias("tables"), (F.col("tables") > 0).alias("registered")).fillna({"registered": False})


def find_by_location(datasets: DataFrame, bucket: str, path: str) -> DataFrame:
    """The dataset at a path, else the newest whose name or root holds it."""
    path = path.strip("/")
    d = datasets.where(F.col("bucket") == bucket).withColumn("_exact", F.col("root") == path)
    return d.where(F.col("_exact") | F.col("root").contains(path) | F.col("name").contains(path)).orderBy(F.desc("_exact"), F.desc("updated_at"), "root").limit(1).drop("_exact")
