"""Versioned tables in key ranges: a log of small parts over compacted ranges, switched by files that only one writer can put.

A table's rows are found by a text ``place`` and lie in ranges of places. A range has parts: files of its last compaction
and what batches have added since. Merging is by ``newest`` (the row of the latest batch counts, ``removed`` rows vanish at
compaction) or by ``sum`` (rows of one place are added up, rows that sum to nothing vanish). A batch reads and writes only
the ranges that it touches; a range is compacted when it has too many parts or rows, and cut in pieces then, so ranges
stay of one size however large the table gets.

A version is a small JSON file with the ranges of every table. It becomes current by ``put_if_absent``, so of two writers
one wins and the other starts anew from the winner's version; readers always see whole versions.
"""

from __future__ import annotations

import bisect
import json
import os
import uuid
from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PARTS_MOST = 8
RANGE_ROWS = 1_000_000
KEPT_VERSIONS = 10


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Writes a file whole unless there is one; False if there is. Local files by a hard link, all else by a rename without overwriting."""
    temporary = f"{path}.{uuid.uuid4().hex}"
    if path.startswith(("file:", "/")):
        name, temporary = ("/" + p.removeprefix("file:").lstrip("/") for p in (path, temporary))
        os.makedirs(os.path.dirname(name), exist_ok=True)
        with open(temporary, "w", encoding="utf-8") as f:
            f.write(text)
        try:
            os.link(temporary, name)
        except FileExistsError:
            return False
        finally:
            os.unlink(temporary)
        return True
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    from_, to = jvm.org.apache.hadoop.fs.Path(temporary), jvm.org.apache.hadoop.fs.Path(path)
    with_ = jvm.org.apache.hadoop.fs.FileContext.getFileContext(to.toUri(), conf)
    out = to.getFileSystem(conf).create(from_, True)
    out.write(bytearray(text.encode()))
    out.close()
    try:
        with_.rename(from_, to, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Exception as e:
        to.getFileSystem(conf).delete(from_, False)
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True


def listed(spark: SparkSession, folder: str) -> list[str]:
    """The names in a folder; none if it does not exist."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(folder)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    stream = p.getFileSystem(spark._jsc.hadoopConfiguration()).open(p)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


class Versions:
    """A folder of numbered JSON files, of which the last one counts."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _name(self, n: int) -> str:
        return f"{self.folder}/{n:012d}.json"

    def current(self) -> tuple[int, dict]:
        """(number, content); (0, {}) before the first."""
        numbers = [int(n[:12]) for n in listed(self.spark, self.folder) if n.endswith(".json") and n[:12].isdigit()]
        return (max(numbers), json.loads(read_text(self.spark, self._name(max(numbers))))) if numbers else (0, {})

    def put(self, number: int, content: dict) -> bool:
        return put_if_absent(self.spark, self._name(number), json.dumps(content))

    def change(self, how: Callable[[dict], dict], tries: int = 100) -> dict:
        """Applies ``how`` to the current content and puts the result; where another writer was first, to that one's content again."""
        for _ in range(tries):
            number, content = self.current()
            content = how(json.loads(json.dumps(content)))
            if self.put(number + 1, content):
                return content
        raise RuntimeError(f"{self.folder}: others were first {tries} times")


def place(*parts: Column | str) -> Column:
    """One text for several keys, in their order."""
    return F.concat_ws("\x00", *parts)


class RangedTable:
    """One table of a version. ``keys`` and ``values`` are its columns besides place; with ``sum``, values are added up."""

    def __init__(self, spark: SparkSession, root: str, ranges: list[dict], schema: str, merge: str, values: list[str]) -> None:
        self.spark, self.root, self.schema, self.merge, self.values = spark, root, f"place string, {schema}, removed boolean, batch long", merge, values
        self.ranges = ranges or [{"low": "", "parts": [], "rows": 0}]

    def range_of(self, at: Column) -> Column:
        """The number of the range that a place lies in, by halving; the ranges' first places are a bounded list."""
        lows = [r["low"] for r in self.ranges]

        def found(first: int, end: int) -> Column:
            half = (first + end) // 2
            return F.when(at < F.lit(lows[half]), found(first, half)).otherwise(found(half, end)) if end - first > 1 else F.lit(first)

        return found(0, len(lows))

    def touched(self, places: DataFrame) -> set[int]:
        """The ranges of some places (place); a number a range comes to the driver."""
        return {r[0] for r in places.select(self.range_of(F.col("place")).alias("r")).distinct().collect()}

    def under(self, prefix: str) -> set[int]:
        """The ranges that may have places with a prefix."""
        lows = [r["low"] for r in self.ranges]
        first = max(bisect.bisect_right(lows, prefix) - 1, 0)
        return {first, *(i for i in range(first + 1, len(lows)) if lows[i].startswith(prefix))}

    def rows(self, ranges: Iterable[int] | None = None) -> DataFrame:
        """The merged rows of some ranges, or of all."""
        own = self.ranges if ranges is None else [self.ranges[i] for i in sorted(ranges)]
        found = []
        for alone in (True, False):  # a part has a place once, so where a range has one part nothing is merged
            paths = [f"{self.root}/{p}" for r in own if (len(r["parts"]) == 1) == alone for p in r["parts"]]
            if paths:
                d = self.spark.read.schema(self.schema).parquet(*paths)
                found.append((d if alone else self.merged(d)).where("NOT removed"))
        return reduce(DataFrame.unionByName, found) if found else self.spark.createDataFrame([], self.schema)

    def merged(self, d: DataFrame) -> DataFrame:
        if self.merge == "sum":
            rest = [c for c in d.columns if c not in ("place", "removed", "batch", *self.values)]
            d = d.groupBy("place").agg(*[F.first(c).alias(c) for c in rest], *[F.sum(c).alias(c) for c in self.values], F.max("batch").alias("batch"))
            nothing = reduce(lambda a, b: a & b, [F.col(c) == 0 for c in self.values])
            return d.withColumn("removed", nothing).select("place", *rest, *self.values, "removed", "batch")
        own = [c for c in d.columns if c != "place"]
        return d.repartition("place").groupBy("place").agg(F.max_by(F.struct(*own), "batch").alias("r")).select("place", "r.*")

    def add(self, rows: DataFrame, batch: int) -> RangedTable:
        """The table with the rows of a batch (the schema's columns, removed optional) in the ranges that they touch."""
        if "removed" not in rows.columns:
            rows = rows.withColumn("removed", F.lit(False))
        folder = f"add-{batch}-{uuid.uuid4().hex}"
        d = rows.withColumn("batch", F.lit(batch).cast("long")).withColumn("range", self.range_of(F.col("place")))
        columns = [c for c in d.columns if c != "range"]
        d.select(*columns, "range").hint("rebalance", "range").write.partitionBy("range").parquet(f"{self.root}/{folder}")
        counts = {int(r[0]): r[1] for r in self.spark.read.parquet(f"{self.root}/{folder}").groupBy("range").count().collect()} if listed(self.spark, f"{self.root}/{folder}") != ["_SUCCESS"] else {}
        ranges = [r | {"parts": [*r["parts"], f"{folder}/range={i}"], "rows": r["rows"] + counts[i]} if i in counts else r for i, r in enumerate(self.ranges)]
        return self._with(ranges).compacted(batch)

    def _with(self, ranges: list[dict]) -> RangedTable:
        out = RangedTable.__new__(RangedTable)
        out.__dict__ = self.__dict__ | {"ranges": ranges}
        return out

    def compacted(self, batch: int) -> RangedTable:
        """Ranges of too many parts or rows are merged and cut into ranges of RANGE_ROWS, all in one job."""
        full = {i for i, r in enumerate(self.ranges) if len(r["parts"]) > PARTS_MOST or len(r["parts"]) > 1 and r["rows"] > 2 * RANGE_ROWS or r["rows"] > 4 * RANGE_ROWS}
        if not full:
            return self
        folder = f"base-{batch}-{uuid.uuid4().hex}"
        n = sum(self.ranges[i]["rows"] for i in full)
        d = self.rows(full).withColumn("range", self.range_of(F.col("place")))
        d.repartitionByRange(max(-(-n // RANGE_ROWS), 1), "range", "place").sortWithinPartitions("range", "place").write.partitionBy("range").parquet(f"{self.root}/{folder}")
        pieces: dict[int, list[tuple]] = {}
        if listed(self.spark, f"{self.root}/{folder}") != ["_SUCCESS"]:
            found = self.spark.read.parquet(f"{self.root}/{folder}").groupBy("range", F.col("_metadata.file_name").alias("file")).agg(F.min("place").alias("low"), F.count("*").alias("rows"))
            for r in found.collect():  # a row a range
                pieces.setdefault(int(r.range), []).append((r.low, f"{folder}/range={r.range}/{r.file}", r.rows))
        ranges = []
        for i, r in enumerate(self.ranges):
            if i not in full:
                ranges.append(r)
                continue
            own = sorted(pieces.get(i, []))
            ranges += [{"low": r["low"] if k == 0 else low, "parts": [file], "rows": rows} for k, (low, file, rows) in enumerate(own)] or [{"low": r["low"], "parts": [], "rows": 0}]
        return self._with(ranges)


def drop_unused(spark: SparkSession, versions: Versions, roots: dict[str, str], keep: int = KEPT_VERSIONS) -> int:
    """Deletes version files before the last ``keep`` and the tables' folders that no kept version names; how many folders. Run it while no batch is running."""
    number, _ = versions.current()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    kept = [json.loads(read_text(spark, versions._name(n))) for n in range(max(number - keep + 1, 1), number + 1)]
    delete = lambda path: jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf).delete(jvm.org.apache.hadoop.fs.Path(path), True)
    for n in range(max(number - keep, 0), 0, -1):
        if f"{n:012d}.json" not in listed(spark, versions.folder):
            break
        delete(versions._name(n))
    gone = 0
    for table, root in roots.items():
        used = {p.split("/")[0] for content in kept for r in content.get("tables", {}).get(table, []) for p in r["parts"]}
        for name in listed(spark, root):
            if name.startswith(("add-", "base-")) and name not in used:
                delete(f"{root}/{name}")
                gone += 1
    return gone
