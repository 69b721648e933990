"""The whole crawl as a stream. Listings and notices that land are a stream; each batch updates objects, partitions,
datasets, table roots, representatives and schema versions, and leaves changes, metrics and events.

The state is a set of versioned tables in key ranges (``sources.versions``). Objects are kept by key, counts as signed
sums: a batch adds what its new, changed and removed objects add to or take from each partition and dataset. So it reads the
ranges of the keys it has, and what it reads does not grow with history. Only where a table root (Delta, Iceberg) appears or
vanishes, or a dataset loses its representative, are the objects below that prefix read again.

Landing rows have the inventory's columns and may have ``removed`` (a notice that the object is gone) and ``scope`` (the
folder that this listing covers completely, "" for the bucket: known objects below it that the batch lacks are gone).
Of several rows of one object in a batch the last modified counts, then a notice of removal.
Rows without bucket or key are left out. A batch that is tried again finds its number in the current version and does nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import keys as K
from ..operators import changes as CH
from ..operators import datasets as D
from ..sources.inventory import SCHEMA
from ..sources.versions import RangedTable, Versions, drop_unused, place

LANDING = f"{SCHEMA}, removed boolean, scope string"
OBJECT = ["bucket", "key"]
GROUP = "bucket string, root string, format string, strategy string, table_format string, names array<string>, n long, size long"
TABLES: dict[str, tuple[str, str, list[str]]] = {
    "objects": (f"{SCHEMA}, hash string", "newest", []),
    "partitions": ("bucket string, root string, partition_path string, n long, size long", "sum", ["n", "size"]),
    "datasets": (GROUP, "sum", ["n", "size"]),
    "tables": ("bucket string, table_root string, table_format string, n long", "sum", ["n"]),
    "representatives": ("bucket string, root string, format string, key string, size long", "newest", []),
    "schemas": ("bucket string, root string, version int, fingerprint string", "newest", []),
}
Infer = Callable[[DataFrame], DataFrame]


class State(NamedTuple):
    """The tables of one version."""

    number: int
    batches: int  # the number of the last batch, -1 before the first
    tables: dict[str, RangedTable]

    def rows(self, name: str) -> DataFrame:
        return self.tables[name].rows().drop("place", "removed", "batch")


def load(spark: SparkSession, root: str) -> State:
    number, content = Versions(spark, f"{root}/versions").current()
    tables = {name: RangedTable(spark, f"{root}/{name}", content.get("tables", {}).get(name, []), *how) for name, how in TABLES.items()}
    return State(number, content.get("batch", -1), tables)


def current_datasets(state: State) -> DataFrame:
    """Datasets from the sums: as ``roll_up`` gives them, but the strategy is that of most objects and names of one depth are in order."""
    s = state.rows("datasets").where("n > 0")
    order = F.array_position(F.array(*[F.lit(f) for f in K.FORMAT_ORDER]), F.col("format"))
    votes = s.groupBy("bucket", "root", "format").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max("table_format").alias("_tf"))
    g = votes.groupBy("bucket", "root").agg(F.sum("n").alias("file_count"), F.sum("size").alias("total_size"), F.max("_tf").alias("_tf"), F.max_by("format", F.struct("n", -order)).alias("_format"))
    most = s.groupBy("bucket", "root", "strategy").agg(F.sum("n").alias("n")).groupBy("bucket", "root").agg(F.max(F.struct("n", "strategy"))["strategy"].alias("strategy"))
    at = s.select("bucket", "root", F.posexplode("names").alias("pos", "name")).groupBy("bucket", "root", "name").agg(F.min("pos").alias("pos"))
    keys = at.groupBy("bucket", "root").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "name"))), lambda x: x["name"]).alias("partition_keys"))
    d = g.join(most, ["bucket", "root"]).join(keys, ["bucket", "root"], "left")
    found = F.coalesce("partition_keys", F.array().cast("array<string>"))
    return d.select("bucket", "root", D.dataset_name(F.col("bucket"), F.col("root")).alias("name"), F.coalesce("_tf", "_format").alias("format"), "strategy", "file_count", "total_size", found.alias("partition_keys"), F.size(found).alias("partition_depth"))


def current_partitions(state: State) -> DataFrame:
    return state.rows("partitions").where("n > 0").select("bucket", "root", "partition_path", F.col("n").alias("file_count"), F.col("size").alias("total_size"))


def _latest(batch: DataFrame) -> DataFrame:
    """One row an object, with its hash."""
    for name, kind in (("removed", "boolean"), ("scope", "string")):
        if name not in batch.columns:
            batch = batch.withColumn(name, F.lit(None).cast(kind))
    d = CH.hashed(batch.where("bucket IS NOT NULL AND key IS NOT NULL")).withColumn("removed", F.coalesce("removed", F.lit(False)))
    rest = [c for c in d.columns if c != "scope"]
    d = d.withColumn("place", place(*OBJECT)).repartition("place")  # few objects come twice, so rows are sorted once, where they meet
    return d.groupBy("place").agg(F.max_by(F.struct(*rest), F.struct("modified", "removed", "hash")).alias("r")).select("place", "r.*")


def _scoped(known: DataFrame, scopes: list) -> DataFrame:
    """Known objects with ``_scoped``: whether they lie below a listed folder. A key is cut at the depths that the folders have, and each cut is looked up among them, so objects stay where they are."""
    spark, found = known.sparkSession, F.lit(False)
    for depth in sorted({s.scope.count("/") for s in scopes}):
        own = spark.createDataFrame([(s.bucket, s.scope, True) for s in scopes if s.scope.count("/") == depth], f"bucket string, _above{depth} string, _in{depth} boolean")
        above = F.concat(F.substring_index("key", "/", depth), F.lit("/")) if depth else F.lit("")
        known = known.withColumn(f"_above{depth}", F.when(F.col("key").startswith(above), above)).join(F.broadcast(own), ["bucket", f"_above{depth}"], "left").drop(f"_above{depth}")  # a row a listing
        found = found | F.coalesce(f"_in{depth}", F.lit(False))
    return known.withColumn("_scoped", found)


def object_changes(objects: RangedTable, batch: DataFrame) -> DataFrame:
    """(bucket, key, change, now, then) of a batch against the ranges that it touches; unchanged objects among them."""
    rows, scopes = _latest(batch), []
    if "scope" in batch.columns:
        listed = F.when(F.col("scope").endswith("/") | (F.col("scope") == ""), F.col("scope")).otherwise(F.concat("scope", F.lit("/")))
        scopes = batch.where("scope IS NOT NULL AND bucket IS NOT NULL").select("bucket", listed.alias("scope")).distinct().collect()  # a row a listing
    ranges = objects.touched(batch.where("bucket IS NOT NULL AND key IS NOT NULL").select(place(*OBJECT).alias("place")))
    for s in scopes:
        ranges |= objects.under(f"{s.bucket}\x00{s.scope}")
    known = objects.rows(ranges)
    own = [c.split()[0] for c in f"{SCHEMA}, hash string".split(", ")]
    rest = [c for c in own if c not in OBJECT]
    then = _scoped(known.select("place", *OBJECT, F.struct(*rest).alias("then")), scopes).select("place", *[F.col(c).alias(f"_{c}") for c in OBJECT], "then", "_scoped")
    now = rows.select("place", *OBJECT, F.struct(*rest).alias("now"), F.col("removed").alias("_notice"))
    d = now.join(then, "place", "full").withColumns({c: F.coalesce(c, f"_{c}") for c in OBJECT})
    there, fresh = F.col("then").isNotNull(), F.col("now").isNotNull() & ~F.coalesce("_notice", F.lit(False))
    change = F.when(fresh & ~there, "new").when(fresh & (F.col("now.hash") != F.col("then.hash")), "changed").when(fresh, "unchanged").when(there & (F.col("now").isNotNull() | F.col("_scoped")), "removed")
    return d.withColumn("change", change).where("change IS NOT NULL").select(*OBJECT, "change", F.when(fresh, F.col("now")).alias("now"), "then")


def _objects(changes: DataFrame, side: str, *which: str) -> DataFrame:
    return changes.where(F.col("change").isin(*which)).select(*OBJECT, f"{side}.*")


def _markers(d: DataFrame, sign: int) -> DataFrame:
    m = d.withColumn("_m", K.table_marker(F.col("key"))).where("_m IS NOT NULL")
    return m.groupBy("bucket", F.col("_m.root").alias("table_root"), F.col("_m.format").alias("table_format")).agg((F.count("*") * sign).cast("long").alias("n"))


def _known_tables(sums: DataFrame) -> DataFrame:
    return sums.where("n > 0").groupBy("bucket", "table_root").agg(F.min("table_format").alias("table_format"))


def _signed(objects: DataFrame, tables: DataFrame, sign: int, mode: str) -> DataFrame:
    d = D.fold_tables(D.classified(objects, mode), tables)
    names = F.transform("partitions", lambda p: p["name"])
    return d.select("bucket", "root", "format", "strategy", "table_format", names.alias("names"), "partition_path", "key", "size", F.lit(sign).alias("sign"))


class Batch(NamedTuple):
    """What a batch did, as written."""

    changes: DataFrame
    events: DataFrame
    metrics: DataFrame


def apply_batch(spark: SparkSession, root: str, batch: DataFrame, number: int, mode: str = "auto", infer: Infer | None = None) -> Batch | None:
    """Brings a batch into the state and makes the new version current; None if that has been done. ``infer`` gives (bucket, root, name, type, nullable) for representatives (bucket, root, format, key, size)."""
    state = load(spark, root)
    if state.batches >= number:
        return None
    t = state.tables
    out = f"{root}/batches/{number}"

    def written(d: DataFrame, name: str) -> DataFrame:
        d.write.mode("overwrite").parquet(f"{out}/{name}")
        return spark.read.schema(d.schema).parquet(f"{out}/{name}")

    changes = written(object_changes(t["objects"], batch), "changes")
    minus, plus = _objects(changes, "then", "changed", "removed"), _objects(changes, "now", "new", "changed")
    # Table roots before and after; objects below those that appear or vanish are counted anew.
    sums = t["tables"].rows().select("bucket", "table_root", "table_format", "n")
    marks = written(_markers(minus, -1).unionByName(_markers(plus, 1)).groupBy("bucket", "table_root", "table_format").agg(F.sum("n").alias("n")).where("n <> 0"), "tables")
    before, after = _known_tables(sums), _known_tables(sums.unionByName(marks).groupBy("bucket", "table_root", "table_format").agg(F.sum("n").alias("n")))
    moved = before.exceptAll(after).unionByName(after.exceptAll(before)).select("bucket", "table_root").distinct().collect()  # a row a table that appears or vanishes
    again = None
    if moved and state.batches >= 0:
        ranges = set().union(*(t["objects"].under(f"{m.bucket}\x00{m.table_root}") for m in moved))
        below = reduce(lambda a, b: a | b, [(F.col("bucket") == m.bucket) & F.col("key").startswith(m.table_root + "/" if m.table_root else "") for m in moved[:500]]) if len(moved) <= 500 else F.lit(True)
        again = t["objects"].rows(ranges).where(below).select(*[c.split()[0] for c in SCHEMA.split(", ")]).join(changes.where("change <> 'unchanged'").select(*OBJECT), OBJECT, "left_anti")
    parts = [_signed(minus, before, -1, mode), _signed(plus, after, 1, mode)]
    if again is not None:
        parts += [_signed(again, before, -1, mode), _signed(again, after, 1, mode)]
    signed = written(reduce(DataFrame.unionByName, parts), "signed")
    amounts = [F.sum("sign").cast("long").alias("n"), F.sum(F.col("sign") * F.col("size")).cast("long").alias("size")]
    groups = signed.groupBy("bucket", "root", "format", "strategy", "table_format", "names").agg(*amounts).where("n <> 0 OR size <> 0").withColumn("place", place("bucket", "root", "format", "strategy", F.coalesce("table_format", F.lit("")), F.array_join("names", "/")))
    partitions = signed.where(F.size("names") > 0).groupBy("bucket", "root", "partition_path").agg(*amounts).where("n <> 0 OR size <> 0").withColumn("place", place("bucket", "root", "partition_path"))
    groups, partitions = written(groups, "dataset_sums"), written(partitions, "partition_sums")
    # What touched datasets and partitions had before.
    roots = groups.select("bucket", "root").distinct()
    near = set().union(*(t["datasets"].under(f"{r.bucket}\x00{r.root}\x00") for r in roots.collect()), set())  # a row a touched dataset
    had = t["datasets"].rows(near).groupBy("bucket", "root").agg(F.sum("n").alias("had"))
    has = roots.join(had, ["bucket", "root"], "left").join(groups.groupBy("bucket", "root").agg(F.sum("n").alias("more")), ["bucket", "root"]).select("bucket", "root", F.coalesce("had", F.lit(0)).alias("had"), (F.coalesce("had", F.lit(0)) + F.col("more")).alias("has"))
    old = t["partitions"].rows(t["partitions"].touched(partitions.select("place"))).select("place", F.col("n").alias("had"))
    fresh = partitions.join(old, "place", "left").where("coalesce(had, 0) <= 0 AND coalesce(had, 0) + n > 0")
    new = dict(t)
    new["objects"] = t["objects"].add(_object_rows(changes), number)
    new["tables"] = t["tables"].add(marks.withColumn("place", place("bucket", "table_root", "table_format")).select("place", "bucket", "table_root", "table_format", "n"), number)
    new["datasets"] = t["datasets"].add(groups.select("place", *[c.split()[0] for c in GROUP.split(", ")]), number)
    new["partitions"] = t["partitions"].add(partitions.select("place", "bucket", "root", "partition_path", "n", "size"), number)
    best = written(_best(new["objects"], t["representatives"], signed, after, mode), "representatives")
    new["representatives"] = t["representatives"].add(best, number)
    versions = spark.createDataFrame([], "dataset string, bucket string, root string, version int, fingerprint string, previous string")
    if infer:
        columns = infer(best.where("NOT removed").select("bucket", "root", "format", "key", "size"))
        found = CH.fingerprints(columns, ["bucket", "root"]).withColumn("dataset", place("bucket", "root"))
        stored = t["schemas"].rows(t["schemas"].touched(found.select(F.col("dataset").alias("place")))).select(F.col("place").alias("dataset"), "version", "fingerprint")
        split = F.split("dataset", "\x00")
        versions = CH.next_versions(found.select("dataset", "fingerprint"), stored).select("dataset", split[0].alias("bucket"), split[1].alias("root"), "version", "fingerprint", "previous")
    versions = written(versions, "schemas")
    new["schemas"] = t["schemas"].add(versions.select(F.col("dataset").alias("place"), "bucket", "root", F.col("version").cast("int").alias("version"), "fingerprint"), number)
    metrics = written(_metrics(changes, has), "metrics")
    events = written(_events(has, fresh, versions, metrics), "events")
    content = {"batch": number, "tables": {name: table.ranges for name, table in new.items()}}
    if not Versions(spark, f"{root}/versions").put(state.number + 1, content):
        if load(spark, root).batches >= number:
            return None
        raise RuntimeError(f"{root}: another writer has changed the state")
    return Batch(changes, events, metrics)


def _object_rows(changes: DataFrame) -> DataFrame:
    d = changes.where("change <> 'unchanged'").withColumn("_r", F.coalesce("now", "then"))
    return d.select(place("bucket", "key").alias("place"), *OBJECT, "_r.*", (F.col("change") == "removed").alias("removed"))


def _best(objects: RangedTable, stored: RangedTable, signed: DataFrame, tables: DataFrame, mode: str) -> DataFrame:
    """C4 for the roots and formats that the batch touched: (place, bucket, root, format, key, size, removed)."""
    at = place("bucket", "root", "format")
    rank = F.max(F.struct("size", "key")).alias("r")
    come = signed.where("sign > 0").groupBy("bucket", "root", "format").agg(rank).select(at.alias("place"), "bucket", "root", "format", F.col("r.size").alias("size"), F.col("r.key").alias("key"))
    gone = signed.where("sign < 0").select(at.alias("place"), "bucket", "root", "key").distinct()
    known = stored.rows(stored.touched(signed.select(at.alias("place")))).select("place", "bucket", "root", "format", "size", "key")
    # one that is gone is missed only if nothing that came is as good: nothing that stayed is better
    better = come.select("place", F.struct("size", "key").alias("_come"))
    lost = known.join(gone.select("place", "key"), ["place", "key"], "left_semi").join(better, "place", "left").where(F.col("_come").isNull() | (F.col("_come") < F.struct("size", "key"))).drop("_come")
    kept = known.join(lost.select("place"), "place", "left_anti").join(signed.select(at.alias("place")).distinct(), "place", "left_semi")
    out = come.select("place", "bucket", "root", "format", "size", "key").unionByName(kept)
    where = lost.select("bucket", "root").distinct().collect()  # a row a dataset that lost its representative
    if where:
        ranges = set().union(*(objects.under(f"{r.bucket}\x00{r.root}") for r in where))
        d = D.fold_tables(D.classified(objects.rows(ranges).select(*[c.split()[0] for c in SCHEMA.split(", ")]), mode), tables)
        found = D.representatives(d).select(at.alias("place"), "bucket", "root", "format", "size", "key").join(lost.select("place"), "place", "left_semi")
        out = out.unionByName(found)
    out = out.groupBy("place", "bucket", "root", "format").agg(rank).select("place", "bucket", "root", "format", F.col("r.key").alias("key"), F.col("r.size").alias("size"), F.lit(False).alias("removed"))
    dead = lost.join(out.select("place"), "place", "left_anti").select("place", "bucket", "root", "format", "key", "size", F.lit(True).alias("removed"))
    return out.unionByName(dead)


def _metrics(changes: DataFrame, has: DataFrame) -> DataFrame:
    """D3."""
    c = changes.agg(*[F.count_if(F.col("change") == k).alias(f"objects_{k}") for k in ("new", "changed", "removed", "unchanged")], F.count_if(F.col("now").isNotNull()).alias("objects_scanned"), F.coalesce(F.sum("now.size"), F.lit(0)).alias("bytes"))
    return c.join(has.agg(F.count("*").alias("datasets")), F.lit(True)).withColumn("status", F.lit("completed"))


def _events(has: DataFrame, fresh: DataFrame, versions: DataFrame, metrics: DataFrame) -> DataFrame:
    """(type, subject, payload), the start of the batch among them."""
    made = lambda d, kind, subject, *fields: d.select(F.lit(kind).alias("type"), subject.alias("subject"), F.to_json(F.struct(*fields)).alias("payload"))
    at = F.concat_ws("/", "bucket", "root")
    return reduce(DataFrame.unionByName, [
        made(metrics, "CrawlStarted", F.lit("crawl"), "objects_scanned"), made(has.where("had <= 0 AND has > 0"), "DatasetDiscovered", at, "bucket", "root", F.col("has").alias("file_count")),
        made(has.where("had > 0"), "CatalogUpdated", at, "bucket", "root", F.col("has").alias("file_count")), made(fresh, "NewPartition", at, "partition_path", F.col("n").alias("file_count")),
        made(versions, "SchemaChanged", at, "version", "fingerprint", "previous"), made(metrics, "CrawlCompleted", F.lit("crawl"), *metrics.columns),
    ])


def stream_crawl(spark: SparkSession, landing: str, root: str, checkpoint: str, mode: str = "auto", infer: Infer | None = None, on_batch: Callable[[Batch, int], None] | None = None, files_most: int | None = None) -> StreamingQuery:
    """Crawls what has landed since the last run, in batches of ``files_most`` files at most, and ends."""

    def store(batch: DataFrame, number: int) -> None:
        done = apply_batch(spark, root, batch, number, mode, infer)
        if done and on_batch:
            on_batch(done, number)

    r = spark.readStream.schema(LANDING)
    r = r.option("maxFilesPerTrigger", files_most) if files_most else r
    return r.parquet(landing).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(store).start()


def clean(spark: SparkSession, root: str, keep: int = 10) -> int:
    """Deletes what no kept version needs."""
    return drop_unused(spark, Versions(spark, f"{root}/versions"), {name: f"{root}/{name}" for name in TABLES}, keep)
