"""A1, A2 as a data source of Spark: ``spark.read.format("object_listing")`` lists stored objects, ``readStream`` those that come.

The planner lists folders only, level by level, until there are ``partitions`` of them or no more, and never files below;
tasks list their folders to any depth. A prefix and a start-after key, as options or as pushed filters on ``key``, leave out
folders before they are listed. Every object counts, whatever its name: what stands in ``_delta_log`` too, also where a table
has no data files. The schema is that of an inventory table. A stream's offset is a time: a batch has the objects modified since
the last one, up to ``settle`` seconds ago.

Options: ``path``, ``bucket``, ``prefix``, ``start_after``, ``partitions``, ``settle``, ``pushdown``. Objects that vanish while being listed
are left out. The store is opened by ``pyarrow.fs``; ``inventory.list_folder`` has another way for stores that it does not know.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, StringStartsWith

SCHEMA = "bucket string, key string, size bigint, etag string, storage_class string, version_id string, modified timestamp_ntz"
BATCH_ROWS = 10_000
ARROW = pa.schema([("bucket", pa.string()), ("key", pa.string()), ("size", pa.int64()), ("etag", pa.string()), ("storage_class", pa.string()), ("version_id", pa.string()), ("modified", pa.timestamp("us"))])


def store_of(path: str):
    """The store of a path, and the folder's name in it."""
    from pyarrow import fs

    if path.startswith("file:") or "://" not in path:
        return fs.LocalFileSystem(), "/" + path.removeprefix("file:").strip("/")
    scheme, rest = path.split("://", 1)
    store, name = fs.FileSystem.from_uri(quote(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}", safe="/:@%?=&+,;!$'()*~"))
    return store, name.rstrip("/")


@dataclass
class Folder(InputPartition):
    """A folder below the root ("" or ending in a slash), to be listed whole or without its folders; for a stream the times between which objects count."""

    folder: str
    deep: bool
    low: float | None = None
    high: float | None = None


@dataclass(frozen=True)
class Wanted:
    """Keys with a prefix and after a key."""

    prefix: str = ""
    after: str = ""

    def has(self, key: str) -> bool:
        return key.startswith(self.prefix) and key > self.after

    def may_have(self, folder: str) -> bool:
        """Whether a wanted key can lie below a folder: all such keys start with its name, and none is above the last of them."""
        return (folder.startswith(self.prefix) or self.prefix.startswith(folder)) and (folder > self.after or self.after.startswith(folder))


def entries(store, root: str, folder: str, deep: bool, wanted: Wanted) -> Iterator:
    """(key, info) of a folder's files, and with ``deep`` of all folders below that may have wanted keys, depth first."""
    from pyarrow import fs

    waiting = [folder]
    while waiting:
        at = waiting.pop()
        try:
            found = store.get_file_info(fs.FileSelector(f"{root}/{at}".rstrip("/") or "/", allow_not_found=True))
        except FileNotFoundError:
            continue
        for info in found:
            key = at + info.base_name
            if info.type == fs.FileType.Directory:
                if deep and wanted.may_have(key + "/"):
                    waiting.append(key + "/")
            elif info.type == fs.FileType.File and wanted.has(key):
                yield key, info


def planned(store, root: str, wanted: Wanted, least: int) -> list[Folder]:
    """Folders to list, at least so many if there are: each level that is opened is listed flat, the last one to any depth."""
    from pyarrow import fs

    flat: list[str] = []
    level = [""]
    while level and len(level) < least:
        below = []
        for at in level:
            infos = store.get_file_info(fs.FileSelector(f"{root}/{at}".rstrip("/") or "/", allow_not_found=True))
            below += [f"{at}{i.base_name}/" for i in infos if i.type == fs.FileType.Directory and wanted.may_have(f"{at}{i.base_name}/")]
        flat += level
        level = below
    return [Folder(f, False) for f in flat] + [Folder(f, True) for f in level]


def _rows(bucket: str, found: Iterator, low: float | None = None, high: float | None = None) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []

    def batch() -> pa.RecordBatch:
        none = pa.nulls(len(held), pa.string())
        keys, sizes, times = (list(c) for c in zip(*held, strict=True)) if held else ([], [], [])
        return pa.RecordBatch.from_arrays([pa.array([bucket] * len(held), pa.string()), pa.array(keys, pa.string()), pa.array(sizes, pa.int64()), none, none, none, pa.array(times, pa.timestamp("us"))], schema=ARROW)

    for key, info in found:
        if low is not None and not low < info.mtime_ns / 1e9 <= high:
            continue
        held.append((key, info.size, dt.datetime.fromtimestamp(info.mtime_ns / 1e9, dt.timezone.utc).replace(tzinfo=None)))
        if len(held) >= BATCH_ROWS:
            yield batch()
            held = []
    yield batch()


class _Options:
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.bucket = options["path"], options.get("bucket", "")
        self.wanted = Wanted(options.get("prefix", ""), options.get("start_after", ""))
        self.least, self.settle = int(options.get("partitions", 64)), float(options.get("settle", 1))


class ListingReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.o = _Options(options)
        self.wanted = self.o.wanted

    def partitions(self) -> list[Folder]:
        return planned(*store_of(self.o.path), self.wanted, self.o.least)

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        store, root = store_of(self.o.path)
        yield from _rows(self.o.bucket, entries(store, root, partition.folder, partition.deep, self.wanted))


class PushingReader(ListingReader):
    """With ``spark.sql.python.filterPushdown.enabled``, without which Spark refuses readers that take filters."""

    def pushFilters(self, filters):
        """Prefixes and lower bounds of the key restrict the listing; all filters are left to Spark as well where they are not met exactly."""
        for f in filters:
            key = getattr(f, "attribute", None) == ("key",)
            prefix, after = self.wanted.prefix, self.wanted.after
            if key and isinstance(f, StringStartsWith) and (f.value.startswith(prefix) or prefix.startswith(f.value)):
                self.wanted = Wanted(max(prefix, f.value, key=len), after)
            elif key and isinstance(f, GreaterThan):
                self.wanted = Wanted(prefix, max(after, f.value))
            else:
                if key and isinstance(f, EqualTo) and f.value.startswith(prefix):
                    self.wanted = Wanted(f.value, after)
                elif key and isinstance(f, GreaterThanOrEqual) and f.value:
                    self.wanted = Wanted(prefix, max(after, f.value[:-1]))  # what is greater than all but its last character
                yield f


class ListingStream(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.o = _Options(options)

    def initialOffset(self) -> dict:
        return {"time": 0.0}

    def latestOffset(self) -> dict:
        return {"time": time.time() - self.o.settle}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        if start == end:
            return []
        return [Folder(f.folder, f.deep, start["time"], end["time"]) for f in planned(*store_of(self.o.path), self.o.wanted, self.o.least)]

    def read(self, partition: Folder) -> Iterator[pa.RecordBatch]:
        store, root = store_of(self.o.path)
        yield from _rows(self.o.bucket, entries(store, root, partition.folder, partition.deep, self.o.wanted), partition.low, partition.high)

    def commit(self, end: dict) -> None:
        pass


class ObjectListing(DataSource):
    @classmethod
    def name(cls) -> str:
        return "object_listing"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ListingReader:
        return (PushingReader if self.options.get("pushdown") == "true" else ListingReader)(self.options)

    def streamReader(self, schema) -> ListingStream:
        return ListingStream(self.options)


def objects(spark: SparkSession, root: str, bucket: str = "", prefix: str = "", start_after: str = "", partitions: int = 64) -> DataFrame:
    """The listing of a folder as an inventory."""
    spark.dataSource.register(ObjectListing)
    return spark.read.format("object_listing").options(path=root, bucket=bucket, prefix=prefix, start_after=start_after, partitions=str(partitions), pushdown=spark.conf.get("spark.sql.python.filterPushdown.enabled")).load()


def object_stream(spark: SparkSession, root: str, bucket: str = "", prefix: str = "", settle: float = 1) -> DataFrame:
    """Objects as they come or change, for ``streaming.crawl.apply_batch`` in ``foreachBatch``."""
    spark.dataSource.register(ObjectListing)
    return spark.readStream.format("object_listing").options(path=root, bucket=bucket, prefix=prefix, settle=str(settle)).load()
