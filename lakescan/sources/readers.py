"""Readers over files and folders (G1-G13, G23), with the reader options as one value."""

from __future__ import annotations

import csv
import json
import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.keys import format_of

DELIMITERS = {",": ",", ";": ";", "|": "|", ":": ":", "tab": "\t", "space": " "}
TEXT = ("csv", "tsv")


@dataclass(frozen=True)
class ReadOptions:
    """Header and delimiter apply to text only, ignore_errors to text and JSON, union_by_name not to table formats."""

    filename: bool = True
    union_by_name: bool = True
    header: str = "auto"  # auto, present or none
    sample_size: int = 1000
    ignore_errors: bool = False
    delimiter: str = ""

    def applicable(self, fmt: str) -> ReadOptions:
        plain = ReadOptions()
        out = self
        if fmt not in TEXT:
            out = replace(out, header=plain.header, delimiter=plain.delimiter, sample_size=plain.sample_size)
        if fmt not in (*TEXT, "json", "jsonl"):
            out = replace(out, ignore_errors=False)
        return replace(out, union_by_name=False) if fmt in ("delta", "iceberg") else out


def _reader(spark: SparkSession, base: str | None):
    """Explicit files have no partition columns unless there is a base folder to take them from."""
    return spark.read.option("basePath", base) if base else spark.read.option("recursiveFileLookup", True)


def _read_text(spark: SparkSession, paths: list[str], fmt: str, o: ReadOptions, base: str | None = None) -> DataFrame:
    """Files of one delimiter and header line are one read; columns of several reads get the type that serves all, and keep their text where none does.

    Files whose quotes hold line ends are cut into records by byte ranges (``sources.records``), which costs a scan of all
    files to find them; all others go to Spark's reader, which splits them at line ends.
    """
    from ..operators.infer import detect_headers, sniff_delimiters, split_cells
    from .files import heads
    from .records import quoted_line_ends, ranges

    files = spark.createDataFrame([(p,) for p in paths], "file string")
    lines = heads(files, 65_536, quoted=True).where(F.col("line_no") <= o.sample_size + 1)
    sep = "\t" if fmt == "tsv" else DELIMITERS.get(o.delimiter, "")
    delimiters = files.select("file", F.lit(sep).alias("delimiter")) if sep else sniff_delimiters(lines)
    told = files.join(delimiters, "file", "left").join(lines.groupBy("file").agg(F.min_by("line", "line_no").alias("top")), "file", "left")
    if o.header == "auto":
        told = told.join(detect_headers(split_cells(lines, delimiters)), "file", "left")
    else:
        told = told.withColumn("has_header", F.lit(o.header == "present"))
    found = {r.file: (r.delimiter or ",", bool(r.has_header), r.top) for r in told.collect()}  # a row a file that is named
    spans = ranges(spark.createDataFrame([(p, d) for p, (d, _, _) in found.items()], "file string, sep string"))
    many = {r.file for r in quoted_line_ends(spans).collect()}
    groups: dict[tuple, list[str]] = {}
    for p in paths:
        d, header, top = found[p]
        # One header is applied to all files of a read by position, so files are read by header line and united by name.
        groups.setdefault((d, header, top if header and (o.union_by_name or p in many) else None, p in many), []).append(p)
    options = lambda d: {"sep": d, "escape": '"', "mode": "DROPMALFORMED" if o.ignore_errors else "PERMISSIVE"}
    parts = []
    for (d, header, top, by_record), own in groups.items():
        if by_record:
            parts.append(_Records(spark, own, d, header, top, options(d), base))
        else:
            parts.append(_Lines(spark, own, header, options(d), base))
    schemas = [p.schema() for p in parts]
    types = _common_types(schemas)
    named = [p.read(T.StructType([T.StructField(f.name, types[f.name]) for f in s]), o.filename) for p, s in zip(parts, schemas, strict=True)]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), named)


def _common_types(schemas: list[T.StructType]) -> dict[str, T.DataType]:
    """F2 for each column of several reads; text where no type serves all."""
    from ..operators.compat import compatible

    types: dict[str, T.DataType] = {}
    for f in (f for s in schemas for f in s):
        if f.name in types:
            ok, _, merged = compatible(types[f.name], f.dataType)
            types[f.name] = merged if ok else T.StringType()
        else:
            types[f.name] = f.dataType
    return types


class _Lines:
    """Text files for Spark's reader."""

    def __init__(self, spark: SparkSession, paths: list[str], header: bool, options: dict, base: str | None) -> None:
        self.paths, self.header = paths, header
        self.reader = lambda: _reader(spark, base).options(header=header, **options)
        self.hive = _folder_names(paths, base)

    def _own(self, df: DataFrame) -> DataFrame:
        return df if self.header else df.withColumnsRenamed({f"_c{i}": f"col_{i + 1}" for i in range(len(df.columns))})

    def schema(self) -> T.StructType:
        self.inferred = self.reader().option("inferSchema", True).csv(self.paths)
        found = self._own(self.inferred).schema
        return T.StructType([*found[: len(found) - len(self.hive)], *(T.StructField(f.name, T.StringType()) for f in found[len(found) - len(self.hive) :])])

    def read(self, schema: T.StructType, filename: bool) -> DataFrame:
        given = T.StructType([T.StructField(f.name, g.dataType) for f, g in zip(self.inferred.schema, schema, strict=True)])
        df = self._own(self.inferred if given == T.StructType([T.StructField(f.name, f.dataType) for f in self.inferred.schema]) else self.reader().schema(given).csv(self.paths))
        return _named(df) if filename else df


class _Records:
    """Text files of one delimiter and header whose quotes hold line ends."""

    def __init__(self, spark: SparkSession, paths: list[str], sep: str, header: bool, top: str | None, options: dict, base: str | None) -> None:
        from .records import ranges, records

        found = records(ranges(spark.createDataFrame([(p, sep) for p in paths], "file string, sep string")))
        self.rows = found.where("NOT first").select("file", "record") if header else found.select("file", "record")
        self.spark, self.options, self.hive = spark, options, _folder_names(paths, base)
        self.names = header_names(next(csv.reader([top], delimiter=sep))) if header and top is not None else None

    def schema(self) -> T.StructType:
        texts = getattr(self.rows.select("record")._jdf, "as")(self.spark._jvm.org.apache.spark.sql.Encoders.STRING())
        read = self.spark._jsparkSession.read().options({k: str(v) for k, v in self.options.items()}).option("inferSchema", True)
        found = T.StructType.fromJson(json.loads(read.csv(texts).schema().json()))
        names = self.names or [f"col_{i + 1}" for i in range(len(found))]
        kinds = [f.dataType for f in found] + [T.StringType()] * len(names)
        return T.StructType([T.StructField(n, t) for n, t in [*zip(names, kinds, strict=False), *((n, T.StringType()) for n in self.hive)]])

    def read(self, schema: T.StructType, filename: bool) -> DataFrame:
        own = T.StructType(list(schema)[: len(schema) - len(self.hive)])
        bad = "_bad_record"
        drop = self.options["mode"] == "DROPMALFORMED"
        kinds = T.StructType([*own, T.StructField(bad, T.StringType())])
        d = self.rows.select("file", F.from_csv("record", _ddl(kinds), {**self.options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": bad}).alias("r"))
        d = d.where(f"r.{bad} IS NULL") if drop else d
        d = d.select("file", *[F.col("r").getField(f.name).alias(f.name) for f in own])
        return _with_path(d, self.hive, filename)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


def header_names(cells: list[str]) -> list[str]:
    """Names as Spark's reader makes them: blanks by place, repeated ones with their place added."""
    names = [c if c else f"_c{i}" for i, c in enumerate(cells)]
    lower = [n.lower() for n in names]
    return [f"{n}{i}" if lower.count(n.lower()) > 1 else n for i, n in enumerate(names)]


def _folders_as_text(df: DataFrame, paths: list[str], base: str | None) -> T.StructType | None:
    """The frame's schema with its Hive partitions as text, so that ``01`` stays ``01``; None if it has that already."""
    names = set(_folder_names(paths, base))
    fixed = T.StructType([T.StructField(f.name, T.StringType() if f.name in names else f.dataType) for f in df.schema])
    return fixed if [f.dataType for f in fixed] != [f.dataType for f in df.schema] else None


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("filename", F.col("_metadata.file_path"))


def _read_json(spark: SparkSession, paths: list[str], o: ReadOptions, base: str | None = None) -> DataFrame:
    """Files of a value a line are read by lines, whatever their suffix; arrays and values over many lines as a stream of values (``sources.json_values``)."""
    from .files import heads

    files = spark.createDataFrame([(p,) for p in paths], "file string")
    top = heads(files, 65_536).where(F.trim("line") != "")
    kind = F.schema_of_variant(F.try_parse_json("line"))
    top = top.groupBy("file").agg(F.min_by(kind, "line_no").alias("first"))
    by_line = {r.file for r in top.where("first LIKE 'OBJECT%'").collect()}  # a row a file that is named
    parts = []
    mode = "DROPMALFORMED" if o.ignore_errors else "PERMISSIVE"
    if own := [p for p in paths if p in by_line]:
        reader = lambda: _reader(spark, base).option("mode", mode)
        df = reader().json(own)
        text = _folders_as_text(df, own, base)
        df = reader().schema(text).json(own) if text else df
        parts.append(_named(df) if o.filename else df)
    if own := [p for p in paths if p not in by_line]:
        parts.append(_json_stream(spark, own, o, base))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _json_stream(spark: SparkSession, paths: list[str], o: ReadOptions, base: str | None) -> DataFrame:
    from .json_values import json_values

    d = json_values(spark.createDataFrame([(p,) for p in paths], "file string"))
    if not o.ignore_errors:  # a value too long to be read is no row that may be missed
        d = d.withColumn("line", F.when(F.col("error").isNull(), F.col("line")).otherwise(F.raise_error(F.concat("file", F.lit(": "), "error")).cast("string")))
    d = d.where("line IS NOT NULL")
    texts = getattr(d.where("error IS NULL").select("line")._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
    bad = "_corrupt_record"
    found = T.StructType.fromJson(json.loads(spark._jsparkSession.read().json(texts).schema().json()))
    schema = T.StructType([*(f for f in found if f.name != bad), T.StructField(bad, T.StringType())])
    d = d.select("file", F.from_json("line", schema, {"columnNameOfCorruptRecord": bad}).alias("r"))
    if o.ignore_errors:
        d = d.where(f"r.{bad} IS NULL")
    kept = [f.name for f in schema if f.name != bad or bad in found.names and not o.ignore_errors]
    d = d.select("file", *[F.col("r").getField(n).alias(n) for n in kept])
    return _with_path(d, _folder_names(paths, base), o.filename)


def _folder_names(paths: list[str], base: str | None) -> list[str]:
    """The Hive partitions of files below a base folder."""
    return [x.split("=", 1)[0] for x in paths[0].split("/")[:-1] if "=" in x] if base and paths else []


def _with_path(d: DataFrame, folders: list[str], filename: bool) -> DataFrame:
    """Partition columns, as text, and the file name in place of ``file``."""
    for n in folders:
        d = d.withColumn(n, F.url_decode(F.replace(F.regexp_extract("file", rf"/{re.escape(n)}=([^/]*)/", 1), F.lit("+"), F.lit("%2B"))))
    path = F.when(F.col("file").contains("://"), F.col("file")).otherwise(F.concat(F.lit("file:///"), F.regexp_replace("file", "^(file:)?/*", "")))
    return d.withColumn("filename", path).drop("file") if filename else d.drop("file")


def read_files(spark: SparkSession, paths: list[str], fmt: str, options: ReadOptions | None = None, base: str | None = None) -> DataFrame:
    """An explicit list of files; partition columns only of the folders below ``base``."""
    o = (options or ReadOptions()).applicable(fmt)
    if fmt in TEXT:
        return _read_text(spark, paths, fmt, o, base)
    if fmt in ("json", "jsonl"):
        return _read_json(spark, paths, o, base)
    reader = lambda: _reader(spark, base).option("mergeSchema", o.union_by_name) if fmt == "parquet" else _reader(spark, base)
    df = reader().format(fmt).load(paths)
    text = _folders_as_text(df, paths, base)
    df = reader().schema(text).format(fmt).load(paths) if text else df
    return _named(df) if o.filename else df


def folder_files(spark: SparkSession, root: str, fmt: str, extension: str | None = None) -> list[str]:
    """The files of a format below a folder at any depth, by one extension or by all that the format has, compressed or not."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    d = d.where(F.col("path").endswith(extension) if extension else format_of(F.substring_index("path", "/", -1)) == fmt)
    return [r.path for r in d.select("path").orderBy("path").collect()]  # the reader's own file index holds them as well


def read_folder(spark: SparkSession, root: str, fmt: str, extension: str | None = None, options: ReadOptions | None = None) -> DataFrame:
    """A folder's files at any depth, with every option of ``read_files``; Hive partitions as text columns and with pruning; table formats by their packages."""
    o = (options or ReadOptions()).applicable(fmt)
    if fmt in ("delta", "iceberg"):
        return spark.read.format(fmt).load(root)
    paths = folder_files(spark, root, fmt, extension)
    if not paths:
        raise ValueError(f"no {fmt} files under {root}")
    tail = root.rsplit("://", 1)[-1].rstrip("/") + "/"
    hive = all("=" in part for p in paths for part in p[p.index(tail) + len(tail) :].split("/")[:-1]) and any("/" in p[p.index(tail) + len(tail) :] for p in paths)
    return read_files(spark, paths, fmt, o, root if hive else None)


def with_path_partitions(df: DataFrame, root: str, names: list[str], keep_filename: bool = False) -> DataFrame:
    """Positional partition columns cut from ``filename`` below ``root``. They are computed; ``read_pruned`` reads only the files that a predicate on them leaves."""
    tail = root.rsplit("://", 1)[-1].strip("/") + "/"
    path = F.url_decode(F.replace("filename", F.lit("+"), F.lit("%2B")))  # file names come escaped
    rest = F.substring(path, F.instr(path, tail) + len(tail), F.length(path))
    out = df.withColumns({n: F.split_part(rest, F.lit("/"), F.lit(i + 1)) for i, n in enumerate(names)})
    return out if keep_filename else out.drop("filename")


def pruned_files(spark: SparkSession, root: str, fmt: str, names: list[str], where: str | Column, extension: str | None = None) -> list[str]:
    """The files below ``root`` whose positional folders, as columns ``names``, satisfy a predicate; answered from the listing, by tasks."""
    from .listing import objects

    key = F.col("key")
    base = F.substring_index(key, "/", -1)
    d = objects(spark, root).where(~base.startswith(".") & ~base.startswith("_"))
    d = d.where(base.endswith(extension) if extension else format_of(base) == fmt)
    folders = F.split(key, "/")
    # a file's own name is no partition; a missing folder is null here and "" in ``with_path_partitions``
    d = d.withColumns({n: F.when(F.size(folders) > i + 1, F.get(folders, F.lit(i))).otherwise("") for i, n in enumerate(names)})
    stem = root.rstrip("/")
    return [f"{stem}/{r.key}" for r in d.where(where).select("key").orderBy("key").collect()]  # the files that are to be read


def read_pruned(spark: SparkSession, root: str, fmt: str, names: list[str], where: str | Column, options: ReadOptions | None = None, extension: str | None = None) -> DataFrame | None:
    """A positional folder's rows where a predicate on its partition columns holds, reading no other files; None if there are no such files."""
    asked = options or ReadOptions()
    paths = pruned_files(spark, root, fmt, names, where, extension)
    if not paths:
        return None
    d = with_path_partitions(read_files(spark, paths, fmt, replace(asked, filename=True)), root, names, True)
    return d if asked.filename else d.drop("filename")


def preview(df: DataFrame, limit: int = 100) -> tuple[list[str], list[str], list[list[str]], bool]:
    """Columns, types, the first rows as text (null is "", times to the second), and whether there are more."""
    def cell(f):
        c = F.col(f"`{f.name}`")
        kind = f.dataType.typeName()
        text = F.date_format(c, "yyyy-MM-dd HH:mm:ss") if kind in ("timestamp", "timestamp_ntz") else F.to_json(F.struct(c)) if kind in ("variant",) else c.cast("string")
        return F.coalesce(text, F.lit("")).alias(f.name)

    rows = df.limit(limit + 1).select(*[cell(f) for f in df.schema.fields]).collect()  # one page
    return df.columns, [f.dataType.simpleString() for f in df.schema.fields], [list(r) for r in rows[:limit]], len(rows) > limit
