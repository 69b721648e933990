"""Column expressions over object keys: format, compression, markers, classification, names.

Every function takes and returns columns, so filters on the results are evaluated in the scan's stage and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Compression suffixes and their codecs.
CODECS = {"gz": "gzip", "gzip": "gzip", "snappy": "snappy", "zst": "zstd", "zstd": "zstd", "br": "brotli", "lz4": "lz4", "bz2": "bzip2", "bzip2": "bzip2"}
#: File extensions and their formats.
FORMATS = {"parquet": "parquet", "pq": "parquet", "orc": "orc", "avro": "avro", "csv": "csv", "tsv": "tsv", "tab": "tsv", "jsonl": "jsonl", "ndjson": "jsonl", "json": "json"}
#: Ties between formats go to the earlier one.
FORMAT_ORDER = ["parquet", "avro", "orc", "jsonl", "json", "csv", "tsv", "unknown"]
#: Marker files.
MARKERS = ["_SUCCESS", "_metadata", "_common_metadata", "_started", "_committed"]
PARTITIONS = "array<struct<name:string,value:string>>"


def _suffix(c: Column, names) -> Column:
    return F.regexp_extract(F.lower(c), r"\.(" + "|".join(names) + r")$", 1)


def _lookup(c: Column, table: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default))


def base_name(key: Column) -> Column:
    return F.substring_index(key, "/", -1)


def compression_of(key: Column) -> Column:
    """The codec a suffix names, in any case; "none" else."""
    return _lookup(_suffix(key, CODECS), CODECS, "none")


def format_of(key: Column) -> Column:
    """B1: the format of the extension under one compression suffix; "unknown" else."""
    bare = F.regexp_replace(F.lower(key), r"\.(" + "|".join(CODECS) + r")$", "")
    return _lookup(F.regexp_extract(base_name(bare), r"\.([^.]*)$", 1), FORMATS, "unknown")


def format_with_header(key: Column, header: Column) -> Column:
    """B2: magic bytes win over the extension; JSON is told from JSON lines by the header's first four lines."""
    by_key = format_of(key)
    lines = F.filter(F.transform(F.slice(F.split(F.decode(header, "ISO-8859-1"), "\n", 4), 1, 4), lambda x: F.regexp_replace(x, r"^[ \t\r\n\f\x0b]+", "")), lambda x: x != "")
    jsonl = (F.size(lines) >= 2) & F.forall(lines, lambda x: x.startswith("{"))
    first = F.substring(F.get(lines, F.lit(0)), 1, 1)
    magic = F.hex(F.substring(header, 1, 4))
    by_magic = F.when(magic == "50415231", "parquet").when(magic == "4F626A01", "avro").when(magic.startswith("4F5243"), "orc")
    return F.coalesce(
        F.when(F.length(header) >= 4, by_magic),
        F.when(by_key.isin("json", "unknown") & F.coalesce(jsonl, F.lit(False)), F.lit("jsonl")),
        F.when((by_key == "unknown") & (F.size(lines) > 0) & first.isin("{", "["), F.lit("json")),
        by_key,
    )


def ignored(key: Column) -> Column:
    """Dot files, folders, marker files and what lies under ``_temporary``."""
    base = base_name(key)
    return key.endswith("/") | (base == "") | base.startswith(".") | base.isin(MARKERS) | base.startswith("_temporary") | key.contains("/_temporary/")


def table_marker(key: Column) -> Column:
    """struct(root, format) where the key is a Delta or Iceberg table's metadata, else null."""
    base = base_name(key)
    in_iceberg = base.endswith(".metadata.json") | base.endswith(".avro") | base.startswith("snap-") | (base == "version-hint.text")
    made = lambda root, kind: F.struct(root.alias("root"), F.lit(kind).alias("format"))
    return (
        F.when(key.contains("/_delta_log/"), made(F.substring_index(key, "/_delta_log/", 1), "delta"))
        .when(key.startswith("_delta_log/"), made(F.lit(""), "delta"))
        .when(key.contains("/metadata/") & in_iceberg, made(F.substring_index(key, "/metadata/", 1), "iceberg"))
        .when(key.startswith("metadata/") & key.endswith(".metadata.json"), made(F.lit(""), "iceberg"))
    )


def normal_key(key: Column) -> Column:
    """Back slashes become slashes and leading slashes go."""
    return F.regexp_replace(F.translate(key, "\\", "/"), "^/+", "")


def directories(key: Column) -> Column:
    """The directories of a key, empty ones left out."""
    parts = F.split(normal_key(key), "/")
    return F.filter(F.slice(parts, 1, F.size(parts) - 1), lambda x: x != "")


def is_pair(x: Column) -> Column:
    return x.rlike(r"(?s)^[^=]+=.+$")


def pair(x: Column) -> Column:
    at = F.instr(x, "=")
    return F.struct(F.substring(x, F.lit(1), at - 1).alias("name"), F.substring(x, at + 1, F.length(x)).alias("value"))


def _classified(root: Column, strategy: str, partitions: Column) -> Column:
    return F.struct(root.alias("root"), F.lit(strategy).alias("strategy"), partitions.cast(PARTITIONS).alias("partitions"))


def classify_hive(key: Column) -> Column:
    """Root before the first ``name=value`` directory, and every pair from there on."""
    dirs = directories(key)
    seen = F.transform(dirs, lambda x, i: F.when(is_pair(x), i))
    first = F.coalesce(F.array_min(F.filter(seen, lambda i: i.isNotNull())), F.size(dirs))
    pairs = F.transform(F.filter(dirs, is_pair), pair)
    return _classified(F.array_join(F.slice(dirs, F.lit(1), first), "/"), "hive", pairs)


def classify_positional(key: Column, crawl_root: str = "", prefix: str = "pt", separator: str = "") -> Column:
    """Every directory below the crawl root is a partition; a root ends at a slash, so ``feed`` does not hold ``feeds/``."""
    root = crawl_root.strip("/")
    rest = F.when(key.startswith(root + "/"), F.substring(key, F.lit(len(root) + 2), F.length(key))).otherwise(key) if root else key
    parts = F.transform(directories(rest), lambda x, i: F.struct(F.concat(F.lit(prefix + separator), i.cast("string")).alias("name"), x.alias("value")))
    return _classified(F.lit(root), "positional", parts)


def classify_legacy(key: Column) -> Column:
    """The file's own directory, without partitions."""
    return _classified(F.array_join(directories(key), "/"), "legacy", F.array())


def classify(key: Column, mode: str = "auto", crawl_root: str = "", prefix: str = "pt", separator: str = "") -> Column:
    """Hive where a directory is a pair; else legacy in mode ``hive`` and positional in any other."""
    fallback = classify_legacy(key) if mode == "hive" else classify_positional(key, crawl_root, prefix, separator)
    return F.when(F.exists(directories(key), is_pair), classify_hive(key)).otherwise(fallback)


def partition_path(partitions: Column) -> Column:
    """C2's path of a partition: pairs in order of their names, each followed by a slash."""
    parts = F.transform(F.array_sort(partitions), lambda p: F.concat(p["name"], F.lit("="), p["value"], F.lit("/")))
    return F.array_join(parts, "")


def virtual_path(key: Column, depth: int = 1 << 30, prefix: str = "pt", separator: str = "") -> Column:
    """The first ``depth`` directories as ``pt0=dir``, the rest as they are."""
    dirs = F.transform(directories(key), lambda x, i: F.when(i < max(depth, 0), F.concat(F.lit(prefix + separator), i.cast("string"), F.lit("="), x)).otherwise(x))
    return F.array_join(F.concat(dirs, F.array(base_name(normal_key(key)))), "/")


def real_path(virtual: Column, prefix: str = "pt") -> Column:
    """The inverse of ``virtual_path``."""
    strip = lambda x: F.when(x.startswith(prefix) & (F.instr(x, "=") > 1), F.substring(x, F.instr(x, "=") + 1, F.length(x))).otherwise(x)
    return F.array_join(F.transform(F.split(virtual, "/"), strip), "/")


def metadata_hash(etag: Column, size: Column, version: Column, modified: Column) -> Column:
    """The first 32 hex digits of SHA-256 over etag, size, version and the time of change to microseconds."""
    at = F.date_format(modified, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    text = [F.coalesce(c.cast("string"), F.lit("")) for c in (etag, size, version, at)]
    return F.substring(F.sha2(F.concat_ws("|", *text), 256), 1, 32)


def table_name(name: Column) -> Column:
    """Lower case; runs of anything but letters and digits become one ``_``; never empty, never a digit first."""
    clean = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "_"), F.lit("_"))
    return F.when(clean == "", F.lit("table")).when(clean.rlike("^[0-9]"), F.concat(F.lit("t_"), clean)).otherwise(clean)


def identifier(name: Column) -> Column:
    """Each bad character becomes ``_``, ends are trimmed of ``_``; empty stays empty, a leading digit gets ``t_``."""
    clean = F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9_]", "_"), F.lit("_"))
    return F.when(clean.rlike("^[0-9]"), F.concat(F.lit("t_"), clean)).otherwise(clean)


def valid_identifier(name: Column) -> Column:
    """B16."""
    return name.rlike("^[A-Za-z_][A-Za-z0-9_]*$")


def data_extension(key: Column, kind: str) -> Column:
    """The sample key's extension with its compression suffix; the format's plain one where it has none."""
    found = F.regexp_extract(F.lower(base_name(key)), r"(\.[a-z0-9]+(\.(" + "|".join(CODECS) + r"))?)$", 1)
    known = F.regexp_extract(found, r"^\.([a-z0-9]+)", 1).isin(list(FORMATS))
    return F.when(known, found).otherwise(F.lit("." + kind))
