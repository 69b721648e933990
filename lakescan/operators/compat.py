"""Which files can be read together as one table, and as what.

The order-dependent fold of a format runs over its distinct schemas in one grouped task; verdicts go back to the files by
a join.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
FLOATS = {T.FloatType: 32, T.DoubleType: 64}
VERDICT = "format string, schema string, verdict string, reason string, merged string"


def compatible(a: T.DataType, b: T.DataType, bool_as_int: bool = False) -> tuple[bool, bool, T.DataType]:
    """(ok, widened, merged type) of two column types."""
    if isinstance(a, T.NullType) or isinstance(b, T.NullType):
        return True, False, b if isinstance(a, T.NullType) else a
    if a == b:
        return True, False, a
    ka, kb = type(a), type(b)
    if ka in INTS and kb in INTS:
        return True, False, a if INTS[ka] >= INTS[kb] else b
    if ka in FLOATS and kb in FLOATS:
        return True, False, T.DoubleType()
    if (ka in INTS and kb in FLOATS) or (ka in FLOATS and kb in INTS):
        return True, True, T.DoubleType()
    if ka is kb is T.DecimalType:
        scale = max(a.scale, b.scale)
        return True, True, T.DecimalType(min(38, max(a.precision - a.scale, b.precision - b.scale) + scale), scale)
    for x, y in ((a, b), (b, a)):
        if isinstance(x, T.DecimalType) and (type(y) in INTS or type(y) in FLOATS):
            return True, True, T.DecimalType(max(x.precision, 18), x.scale)
        if isinstance(x, T.DateType) and isinstance(y, (T.TimestampType, T.TimestampNTZType)):
            return True, True, y
        if isinstance(x, T.TimestampType) and isinstance(y, T.TimestampNTZType):
            return True, True, x
        if bool_as_int and isinstance(x, T.BooleanType) and isinstance(y, T.ByteType):
            return True, True, T.IntegerType()
        if isinstance(x, T.VariantType) and isinstance(y, T.StringType):
            return True, True, y
    if ka is kb is T.ArrayType:
        ok, wide, inner = compatible(a.elementType, b.elementType, bool_as_int)
        return ok, wide, T.ArrayType(inner)
    if ka is kb is T.MapType:
        ok1, w1, key = compatible(a.keyType, b.keyType, bool_as_int)
        ok2, w2, value = compatible(a.valueType, b.valueType, bool_as_int)
        return ok1 and ok2, w1 or w2, T.MapType(key, value)
    if ka is kb is T.StructType and [f.name.lower() for f in a] == [f.name.lower() for f in b]:
        got = [compatible(x.dataType, y.dataType, bool_as_int) for x, y in zip(a, b, strict=True)]
        return all(g[0] for g in got), any(g[1] for g in got), T.StructType([T.StructField(f.name, g[2]) for f, g in zip(a, got, strict=True)])
    return False, False, a


def schema_shapes(columns: DataFrame) -> DataFrame:
    """(file_idx, format, shape, schema): each file's columns in order, from (file_idx, format, pos, name, type)."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "name", "type")))
    d = columns.groupBy("file_idx", "format").agg(ordered.alias("c"))
    return d.select("file_idx", "format", F.array_join(F.transform("c", lambda x: F.lower(x["name"])), "\x1f").alias("shape"), F.array_join(F.transform("c", lambda x: F.concat(x["name"], F.lit("\x1f"), x["type"])), "\x1e").alias("schema"))


def _folded(types: dict[str, T.DataType], bool_as_int: bool):
    """The verdict on each distinct schema (shape, schema, first, n) of a format; merged is the format's schema as JSON."""

    def run(key: tuple, schemas: pa.Table) -> pa.Table:
        own = sorted(schemas.to_pylist(), key=lambda r: r["first"])
        size: dict[str, int] = {}
        seen: dict[str, int] = {}
        for r in own:
            size[r["shape"]] = size.get(r["shape"], 0) + r["n"]
            seen.setdefault(r["shape"], r["first"])
        anchor = max(size, key=lambda s: (size[s], -seen[s]))
        now: list[tuple[str, T.DataType]] | None = None
        verdicts = []
        for r in own:
            if r["shape"] != anchor:
                verdicts.append((r["schema"], "incompatible", "shape"))
                continue
            cols = [(c.split("\x1f")[0], types[c.split("\x1f")[1]]) for c in r["schema"].split("\x1e")] if r["schema"] else []
            got = [compatible(a, b, bool_as_int) for (_, a), (_, b) in zip(now or cols, cols, strict=True)]
            if not all(g[0] for g in got):
                verdicts.append((r["schema"], "incompatible", "type:" + ",".join(c for (c, _), g in zip(cols, got, strict=True) if not g[0])))
                continue
            wide = ",".join(c for (c, _), g in zip(cols, got, strict=True) if g[1])
            now = [(c, g[2]) for (c, _), g in zip(now or cols, got, strict=True)]
            verdicts.append((r["schema"], "widened" if wide else "compatible", f"widen:{wide}" if wide else ""))
        merged = T.StructType([T.StructField(c, t) for c, t in now or []]).json()
        n = len(verdicts)
        columns = [[key[0].as_py()] * n, *map(list, zip(*verdicts, strict=True)), [merged] * n]
        return pa.table([pa.array(c, pa.string()) for c in columns], names=["format", "schema", "verdict", "reason", "merged"])

    return run


def group_files(columns: DataFrame, bool_as_int: bool = False) -> tuple[DataFrame, dict[str, T.StructType]]:
    """(file_idx, format, verdict, reason) of every file, and each format's merged schema.

    The modal shape (ties to the first seen) anchors a format; other shapes are rejected for ``shape``. Schemas then fold
    in order of their first file; one with a column that does not fit is rejected for ``type`` and adds nothing.
    """
    files = schema_shapes(columns)
    distinct = files.groupBy("format", "shape", "schema").agg(F.min("file_idx").cast("long").alias("first"), F.count("*").alias("n"))
    types = {r.type: T._parse_datatype_string(r.type) for r in columns.select("type").distinct().collect()}  # a row a type of column
    v = distinct.groupBy("format").applyInArrow(_folded(types, bool_as_int), VERDICT)
    merged = {r.format: T.StructType.fromJson(json.loads(r.merged)) for r in v.select("format", "merged").distinct().collect()}  # a row a format
    own = v.select(F.col("format").alias("_format"), F.col("schema").alias("_schema"), "verdict", "reason")
    return files.join(own, (F.col("format") == F.col("_format")) & (F.col("schema") == F.col("_schema"))).select("file_idx", "format", "verdict", "reason"), merged


def summarize(verdicts: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """one row a format: members, rejected, widened, and whether it is the primary table (most members, first on a tie); with ``files`` (file_idx, size) also the members' bytes."""
    more = []
    if files is not None:
        verdicts = verdicts.join(files.select(F.col("file_idx").alias("_file"), "size"), F.col("file_idx") == F.col("_file"), "left").drop("_file")
        more = [F.coalesce(F.sum(F.when(F.col("verdict") != "incompatible", F.col("size"))), F.lit(0)).cast("long").alias("bytes")]
    g = verdicts.groupBy("format").agg(*more, F.count_if(F.col("verdict") != "incompatible").alias("members"), F.count_if(F.col("verdict") == "incompatible").alias("rejected"), F.count_if(F.col("verdict") == "widened").alias("widened"), F.min("file_idx").alias("first"))
    best = g.agg(F.max_by("format", F.struct("members", -F.col("first"))).alias("_best"), (F.count("*") > 1).alias("mixed_format"))
    return g.join(best, F.lit(True)).select("format", "members", "rejected", "widened", *["bytes"] * bool(more), (F.col("format") == F.col("_best")).alias("is_primary"), "mixed_format")


def total_rows(files: DataFrame, *keys: str) -> DataFrame:
    """the sum of footers' rows if every file is Parquet, else -1; for each value of ``keys``."""
    return files.groupBy(*keys).agg(F.when(F.bool_and(F.col("format") == "parquet"), F.sum("num_rows")).otherwise(F.lit(-1)).cast("long").alias("rows"))


def read_as(columns: DataFrame, fmt: str) -> DataFrame:
    """F8: every file treated as of one format."""
    return columns.withColumn("format", F.lit(fmt))


_READS = {("tinyint", "smallint"), ("tinyint", "int"), ("smallint", "int"), ("int", "bigint"), ("int", "double"), ("float", "double"), ("date", "timestamp_ntz")}


def read_members(spark: SparkSession, groups: list[tuple[T.StructType, list[str]]], merged: T.StructType, fmt: str = "parquet", filename: bool = False) -> DataFrame:
    """the members as one table. Where the reader can widen every column itself one scan reads all; else each schema's files are read and cast."""

    def reads(a: T.DataType, b: T.DataType) -> bool:
        return a == b or (a.simpleString(), b.simpleString()) in _READS

    if all(reads(f.dataType, merged[f.name].dataType) for s, _ in groups for f in s if f.name in merged.names):
        df = spark.read.schema(merged).format(fmt).load([p for _, paths in groups for p in paths])
        return df.withColumn("filename", F.col("_metadata.file_path")) if filename else df
    out = None
    for schema, paths in groups:
        by = {f.name.lower(): f.name for f in schema}
        d = spark.read.schema(schema).format(fmt).load(paths).select(*[F.col(f"`{by[f.name.lower()]}`").cast(f.dataType).alias(f.name) for f in merged], *[F.col("_metadata.file_path").alias("filename")] * filename)
        out = d if out is None else out.unionByName(d)
    return out


def common_table_name(keys: DataFrame, fmt: str) -> DataFrame:
    """one row ``name``: the members' common directory, else the first file's stem, else the format, as an identifier."""
    from ..functions.keys import base_name, identifier

    folder = F.when(F.instr("key", "/") > 0, F.regexp_replace("key", "/[^/]*$", "")).otherwise("")
    g = keys.agg(F.min(folder).alias("a"), F.max(folder).alias("b"), F.min(base_name(F.col("key"))).alias("stem"))
    # the common prefix of the least and the greatest is the prefix of all
    a, b = F.split("a", "/"), F.split("b", "/")
    same = F.array_max(F.filter(F.sequence(F.lit(0), F.least(F.size(a), F.size(b))), lambda k: F.slice(a, F.lit(1), k) == F.slice(b, F.lit(1), k)))
    last = F.get(F.slice(a, F.lit(1), same), same - 1)
    name = F.coalesce(F.nullif(identifier(last), F.lit("")), F.nullif(identifier(F.regexp_replace("stem", r"\..*$", "")), F.lit("")), F.lit(fmt))
    return g.select(name.alias("name"))
