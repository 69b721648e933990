"""Registered queries over folders, listings, streams and catalogs that are made of the given tables; their SQL reads the tables alone."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .operators.catalog import Catalog
from .plans import crawl
from .registry_queries import DIFF, _scratch, inventory, previous, read, registered
from .sources import json_values, listing, table_formats
from .sources import readers as R
from .streaming import crawl as STREAM

#: Rows of one written file where a query cuts a table into files that follow each other.
FILE_ROWS = 200_000

# ---- the crawl as a stream (D1-D8) ----


def _crawled(spark: SparkSession, sf_dir: str) -> tuple[STREAM.State, list[DataFrame]]:
    """Two runs of a stream: what was listed before, as notices, then a complete listing of every bucket."""
    root, changes = _scratch(spark, "stream"), []
    none = F.lit(None)
    run = lambda: STREAM.stream_crawl(spark, f"{root}/landing", f"{root}/state", f"{root}/progress", on_batch=lambda b, n: changes.append(b.changes)).awaitTermination()
    for listed, scope in ((previous(spark, sf_dir), none), (inventory(spark, sf_dir), F.lit(""))):
        own = listed.select("bucket", "key", F.col("size").cast("long").alias("size"), "etag", "storage_class", "version_id", F.col("modified").cast("timestamp_ntz").alias("modified"))
        own.withColumns({"removed": none.cast("boolean"), "scope": scope.cast("string")}).write.mode("append").parquet(f"{root}/landing")  # a run takes all that has landed as one batch
        run()
    return STREAM.load(spark, f"{root}/state"), changes


@registered(f"WITH {DIFF} SELECT bucket, key, change FROM diff", "inv prev")
def stream_crawl_changes(spark, sf_dir):
    return _crawled(spark, sf_dir)[1][-1].select("bucket", "key", "change")


@registered("""WITH v AS (SELECT bucket, root, format, count(*) AS n, max(table_format) AS tf FROM folded GROUP BY ALL),
d AS (SELECT bucket, root, coalesce(max(tf), arg_max(format, n * 100 - list_position(['parquet', 'avro', 'orc', 'jsonl', 'json', 'csv', 'tsv', 'unknown'], format))) AS format FROM v GROUP BY 1, 2),
p AS (SELECT bucket, root, count(DISTINCT array_to_string(list_sort(parts), '/')) AS partitions FROM folded WHERE len(parts) > 0 GROUP BY 1, 2)
SELECT bucket, root, d.format, count(*) AS file_count, sum(size)::BIGINT AS total_size, any_value(coalesce(p.partitions, 0)) AS partitions FROM folded f JOIN d USING (bucket, root) LEFT JOIN p USING (bucket, root) GROUP BY 1, 2, 3""", "inv cls folded")
def stream_crawl_datasets(spark, sf_dir):
    state = _crawled(spark, sf_dir)[0]
    parts = STREAM.current_partitions(state).groupBy("bucket", "root").agg(F.count("*").alias("partitions"))
    return STREAM.current_datasets(state).join(parts, ["bucket", "root"], "left").select("bucket", "root", "format", "file_count", "total_size", F.coalesce("partitions", F.lit(0)).cast("long").alias("partitions"))


# ---- listings (A1, A2) ----


def _lake(spark: SparkSession, sf_dir: str) -> str:
    root, o = _scratch(spark, "lake"), read(spark, sf_dir, "orders")
    o.select("o_orderkey", "o_orderstatus", F.date_format("o_orderdate", "yyyy-MM").alias("month")).repartition("o_orderstatus", "month").write.partitionBy("o_orderstatus", "month").parquet(f"{root}/orders")
    o.select(F.col("o_orderstatus").alias("s")).distinct().select(F.lit("{}").alias("line"), F.concat(F.lit("t="), F.col("s"), F.lit("/deep")).alias("s")).repartition("s").write.partitionBy("s").text(f"{root}/only/logs/_delta_log")
    return root


LISTED = """WITH m AS (SELECT DISTINCT o_orderstatus AS s, strftime(o_orderdate, '%Y-%m') AS month FROM orders),
a AS (SELECT 'orders/o_orderstatus=' || s || '/month=' || month AS folder FROM m UNION ALL SELECT DISTINCT 'only/logs/_delta_log/s=t%3D' || s || '%2Fdeep' FROM m) SELECT folder, 1::BIGINT AS files FROM a"""


@registered(LISTED, "")
def list_objects(spark, sf_dir):
    """Every folder's files, those of a log without data files among them."""
    d = listing.objects(spark, _lake(spark, sf_dir), "b").where(F.regexp_extract("key", "[^/]*$", 0).startswith("part-"))
    return d.groupBy(F.regexp_extract("key", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"))


@registered(LISTED + " WHERE folder >= 'orders/o_orderstatus=O/month=1995-06' AND folder LIKE 'orders/o_orderstatus=O/%'", "")
def list_objects_after(spark, sf_dir):
    d = listing.objects(spark, _lake(spark, sf_dir), "b", "orders/o_orderstatus=O/", "orders/o_orderstatus=O/month=1995-05/~").where(F.regexp_extract("key", "[^/]*$", 0).startswith("part-"))
    return d.groupBy(F.regexp_extract("key", "^(.*)/[^/]*$", 1).alias("folder")).agg(F.count("*").alias("files"))


# ---- text and JSON as they come (G2, E8, E10, E20) ----


@registered("SELECT c_custkey, 'Mr \"' || c_name || '\"' || chr(10) || c_mktsegment || ', ' || chr(10) AS note, c_acctbal FROM customer", "")
def folder_of_quoted_text(spark, sf_dir):
    """Cells with quotes, delimiters and line ends, cut into records by byte ranges."""
    root = _scratch(spark, "quoted")
    row = F.concat_ws(",", "c_custkey", F.concat(F.lit('"Mr ""'), "c_name", F.lit('""\n'), "c_mktsegment", F.lit(', \n"')), F.format_string("%.2f", "c_acctbal"))
    read(spark, sf_dir, "customer").select(row.alias("value")).repartition(4).write.text(root)
    d = R.read_folder(spark, root, "csv", ".txt", R.ReadOptions(filename=False, header="none"))
    return d.select(F.col("col_1").cast("long").alias("c_custkey"), F.col("col_2").alias("note"), F.col("col_3").cast("double").alias("c_acctbal"))


@registered("SELECT CAST(o_orderkey AS DOUBLE) + CASE WHEN o_orderstatus = 'F' THEN 0.5 ELSE 0 END AS k, CASE WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE '00' || o_custkey END AS v FROM orders", "")
def folder_of_mixed_types(spark, sf_dir):
    """Files of whole numbers, of fractions and of words under the same names, in other orders."""
    root, o = _scratch(spark, "mixed"), read(spark, sf_dir, "orders")
    for status, columns in (("F", ["k", "v"]), ("O", ["v", "k"]), ("P", ["k", "v"])):
        k = F.col("o_orderkey") + (0.5 if status == "F" else F.lit(0))
        v = F.col("o_orderpriority") if status == "O" else F.concat(F.lit("00"), "o_custkey")
        o.where(F.col("o_orderstatus") == status).select(k.alias("k"), v.alias("v")).select(*columns).write.option("header", True).csv(f"{root}/{status}")
    d = R.read_folder(spark, root, "csv", options=R.ReadOptions(filename=False, header="present"))
    return d.select(F.col("k").cast("double").alias("k"), "v")


def _arrays(spark: SparkSession, sf_dir: str) -> str:
    """Eight files of one JSON array each."""
    from pyspark.sql import Window

    root = _scratch(spark, "arrays")
    w = Window.partitionBy("part")
    row = F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.struct(F.col("o_orderpriority").alias("p"), F.lit('a "[{,').alias("q")).alias("v")))
    d = read(spark, sf_dir, "orders").select(row.alias("row"), "o_orderkey", (F.col("o_orderkey") % 8).alias("part"))
    d = d.withColumns({"n": F.row_number().over(w.orderBy("o_orderkey")), "of": F.count("*").over(w)})
    line = F.concat(F.when(F.col("n") == 1, "[").otherwise(""), "row", F.when(F.col("n") == F.col("of"), "]").otherwise(","))
    d.select(line.alias("value"), "part", "n").repartition(8, "part").sortWithinPartitions("part", "n").drop("n").write.partitionBy("part").text(root)
    return root


@registered("SELECT o_orderkey AS k, o_orderpriority AS p, 'a \"[{,' AS q FROM orders", "")
def folder_of_json_arrays(spark, sf_dir):
    d = R.read_folder(spark, _arrays(spark, sf_dir), "json", ".txt", R.ReadOptions(filename=False))
    return d.select(F.col("k").cast("long").alias("k"), "v.p", "v.q")


@registered("SELECT o_orderkey % 8 AS part, count(*) AS elements, sum(length(o_orderpriority))::BIGINT AS letters FROM orders GROUP BY 1", "")
def json_array_elements(spark, sf_dir):
    """Elements as they are streamed out of arrays, without a schema."""
    root = _arrays(spark, sf_dir)
    files = spark.createDataFrame([(p,) for p in R.folder_files(spark, root, "json", ".txt")], "file string")
    d = json_values.json_values(files).where("error IS NULL")
    return d.groupBy(F.regexp_extract("file", r"part=(\d+)/", 1).cast("long").alias("part")).agg(F.count("*").alias("elements"), F.sum(F.length(F.get_json_object("line", "$.v.p"))).cast("long").alias("letters"))


@registered("SELECT s AS kind, CASE WHEN s = 'good' THEN c ELSE 0 END::INTEGER AS columns, s <> 'good' AS failed FROM (SELECT unnest(['good', 'bad', 'gone']) AS s), (SELECT count(*) AS c FROM information_schema.columns WHERE table_name = 'orders')", "")
def schema_errors(spark, sf_dir):
    """Files that are no Parquet, or are not there, beside good ones: one error row each."""
    root, o = _scratch(spark, "errors"), read(spark, sf_dir, "orders")
    o.repartition(3).write.parquet(f"{root}/good")
    o.repartition(2).select(F.to_json(F.struct("*")).alias("value")).write.text(f"{root}/bad")
    files = [p for kind in ("good", "bad") for p in R.folder_files(spark, f"{root}/{kind}", "", ".parquet" if kind == "good" else ".txt")]
    d = crawl.infer_schemas(spark, spark.createDataFrame([(p, "parquet") for p in [*files, f"{root}/gone/x.parquet"]], "file string, format string"))
    return d.groupBy(F.regexp_extract("file", "/(good|bad|gone)/[^/]*$", 1).alias("kind")).agg(F.count_distinct("name").cast("int").alias("columns"), F.max(F.col("error").isNotNull()).alias("failed"))


@registered("SELECT o_orderkey, o_custkey, o_orderstatus AS status, strftime(o_orderdate, '%Y') AS year FROM orders WHERE o_orderstatus <> 'P' AND year(o_orderdate) >= 1996", "")
def folder_pruned(spark, sf_dir):
    """A predicate on positional folders, answered before the scan."""
    root, o = _scratch(spark, "pruned"), read(spark, sf_dir, "orders")
    for r in o.select("o_orderstatus", F.year("o_orderdate").alias("y")).distinct().collect():  # a folder each
        own = o.where((F.col("o_orderstatus") == r.o_orderstatus) & (F.year("o_orderdate") == r.y))
        own.select("o_orderkey", "o_custkey").coalesce(1).write.parquet(f"{root}/{r.o_orderstatus}/{r.y}")
    d = R.read_pruned(spark, root, "parquet", ["status", "year"], "status <> 'P' AND CAST(year AS int) >= 1996", R.ReadOptions(filename=False))
    return d.select("o_orderkey", "o_custkey", "status", "year")


@registered("""WITH o AS (SELECT o_orderkey || '' AS k, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderpriority END AS p FROM orders ORDER BY o_orderkey LIMIT 1000), f AS (SELECT unnest(['csv', 'json', 'orc', 'parquet']) AS format),
c AS (SELECT 'k' AS name, k AS v FROM o UNION ALL SELECT 'p', p FROM o) SELECT format, name, count(*) AS count, count(*) - count(v) AS null_count, count(DISTINCT v) AS distinct_count, min(v) AS min, max(v) AS max FROM f, c GROUP BY 1, 2""", "")
def crawl_samples(spark, sf_dir):
    """Statistics of the first thousand rows of a dataset of every format, by one crawl of the datasets' first files."""
    root, o = _scratch(spark, "samples"), read(spark, sf_dir, "orders")
    # about FILE_ROWS rows a file, each after those of the file before
    d = o.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderpriority")).alias("p")).repartitionByRange(-(-o.count() // FILE_ROWS) or 1, "k").sortWithinPartitions("k")
    files = []
    for fmt in ("csv", "json", "orc", "parquet"):
        w = d.write.option("header", True) if fmt == "csv" else d.write.option("ignoreNullFields", False)
        w.format(fmt).save(f"{root}/{fmt}")
        files.append((min(R.folder_files(spark, f"{root}/{fmt}", "", f".{fmt}")), fmt if fmt != "json" else "jsonl"))
    found = crawl.samples(spark.createDataFrame(files, "file string, format string")).stats
    return found.select(F.regexp_extract("file", "/(csv|json|orc|parquet)/[^/]*$", 1).alias("format"), "name", "count", "null_count", "distinct_count", "min", "max")


# ---- table formats, previews, the catalog (E16, E17, G11, G12, G14-G18) ----


NAMES = "SELECT column_name AS name, ordinal_position::INTEGER - 1 AS pos FROM information_schema.columns WHERE table_name = 'orders'"


def _metadata(spark: SparkSession, sf_dir: str, folder: str, content: str) -> None:
    spark.createDataFrame([(content,)], "value string").coalesce(1).write.text(folder)


@registered(NAMES, "")
def delta_schema(spark, sf_dir):
    import json

    root = _scratch(spark, "delta")
    schema = read(spark, sf_dir, "orders").schema
    logged = json.dumps({"metaData": {"schemaString": schema.json(), "partitionColumns": []}})
    _metadata(spark, sf_dir, f"{root}/t/_delta_log", logged)
    return table_formats.delta_tables(spark, [f"{root}/t/_delta_log/*.txt"]).select("name", F.col("pos").cast("int").alias("pos"))


@registered(NAMES, "")
def iceberg_schema(spark, sf_dir):
    import json

    root = _scratch(spark, "iceberg")
    kinds = {T.LongType: "long", T.IntegerType: "int", T.DoubleType: "double"}
    fields = [{"id": i, "name": f.name, "required": not f.nullable, "type": kinds.get(type(f.dataType), "string")} for i, f in enumerate(read(spark, sf_dir, "orders").schema, 1)]
    _metadata(spark, sf_dir, f"{root}/t/metadata", json.dumps({"schema": {"fields": fields}}))
    return table_formats.iceberg_tables(spark, [f"{root}/t/metadata/*.txt"]).select("name", F.col("pos").cast("int").alias("pos"))


@registered("SELECT c_custkey || '' AS key, c_name AS name, strftime(TIMESTAMP '2024-01-01 00:00:00' + INTERVAL (c_custkey) SECOND, '%Y-%m-%d %H:%M:%S') AS time, '' AS nothing, true AS more FROM customer ORDER BY c_custkey LIMIT 100", "")
def preview_customer(spark, sf_dir):
    """A page of text cells and whether there are more rows."""
    d = read(spark, sf_dir, "customer").orderBy("c_custkey").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.expr("timestampadd(SECOND, c_custkey, TIMESTAMP_NTZ '2024-01-01 00:00:00')").alias("time"), F.lit(None).cast("int").alias("nothing"))
    names, _, rows, more = R.preview(d, 100)
    return spark.createDataFrame([(*r, more) for r in rows], ", ".join(f"{n} string" for n in names) + ", more boolean")


@registered("SELECT 'region_' || n_regionkey AS name, 'region_' || n_regionkey || '_2' AS suggested, count(*) AS rows, sum(n_nationkey)::BIGINT AS keys FROM nation GROUP BY n_regionkey", "")
def catalog_tables(spark, sf_dir):
    """A table a region, registered, then opened by a session's refresh, and what a second one of its name would be called."""
    root, n = _scratch(spark, "catalog"), read(spark, sf_dir, "nation")
    own = uuid.uuid4().hex[:8]
    n.select("n_nationkey", "n_regionkey").repartition("n_regionkey").write.partitionBy("n_regionkey").parquet(f"{root}/data")
    regions = sorted(r.n_regionkey for r in n.select("n_regionkey").distinct().collect())  # registered one by one
    for k in regions:
        Catalog(spark, f"{root}/list").register(f"region_{k}_{own}", f"{root}/data/n_regionkey={k}", "parquet", options=R.ReadOptions(filename=False))
        spark.catalog.dropTempView(f"region_{k}_{own}")
    c, out = Catalog(spark, f"{root}/list"), None
    for name in c.refresh():
        plain = name.removesuffix(f"_{own}")
        part = spark.table(name).agg(F.count("*").alias("rows"), F.sum("n_nationkey").cast("long").alias("keys")).select(F.lit(plain).alias("name"), F.lit(c.suggest(name).replace(f"_{own}", "")).alias("suggested"), "rows", "keys")
        out = part if out is None else out.unionByName(part)
    return out


# ---- profiles by sketches (H2, H8) ----


@registered("""WITH c AS (SELECT unnest([{'column': 'o_orderkey', 'v': o_orderkey || ''}, {'column': 'o_orderpriority', 'v': o_orderpriority}, {'column': 'o_totalprice', 'v': NULL}]) AS x FROM orders)
SELECT x['column'] AS name, count(*) AS count, CASE WHEN x['column'] = 'o_totalprice' THEN count(*) ELSE count(x['v']) END AS non_null, CASE WHEN x['column'] = 'o_orderpriority' THEN min(length(x['v'])) END::BIGINT AS min_length,
CASE x['column'] WHEN 'o_totalprice' THEN (SELECT round(avg(o_totalprice), 2) FROM orders) WHEN 'o_orderkey' THEN (SELECT round(avg(o_orderkey), 2) FROM orders) END AS mean, true AS distinct_near, true AS median_near FROM c GROUP BY 1""", "")
def profile_sketches_orders(spark, sf_dir):
    """Monthly partitions, a tenth of which change between two refreshes; estimates are held against exact values."""
    from .operators.sketches import SketchTable

    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice", F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    t = SketchTable(spark, _scratch(spark, "sketches"))
    for last in ("0", "1"):
        odd = F.when(F.col("month").endswith(last), F.lit("old")).otherwise(F.lit("now")) if last == "0" else F.lit("now")
        prints = o.select(F.col("month").alias("partition"), odd.alias("fingerprint")).distinct()
        t.refresh(prints, lambda own: o.where(F.col("month").isin(own)), F.col("month"))
    d = t.profile([0.5]).where("column <> 'month'")
    exact = o.agg(F.count_distinct("o_orderkey").alias("a"), F.count_distinct("o_orderpriority").alias("b"), F.count_distinct("o_totalprice").alias("c"), F.count_if(F.lit(True)).alias("n"))
    want = exact.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_c"), F.col(x).alias("_n")) for c, x in (("o_orderkey", "a"), ("o_orderpriority", "b"), ("o_totalprice", "c"))])).alias("x")).select("x.*")
    low = o.crossJoin(d.agg(*[F.max(F.when(F.col("column") == c, F.get("quantiles", F.lit(0)))).alias(f"_{c}") for c in ("o_orderkey", "o_totalprice")]))  # one row
    ranks = low.agg(*[F.avg((F.col(c) <= F.col(f"_{c}")).cast("double")).alias(c) for c in ("o_orderkey", "o_totalprice")])
    rank = ranks.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_k"), F.col(c).alias("_rank")) for c in ("o_orderkey", "o_totalprice")])).alias("x")).select("x.*")
    d = d.join(F.broadcast(want), F.col("column") == F.col("_c")).join(F.broadcast(rank), F.col("column") == F.col("_k"), "left")  # a row a column
    near = lambda a, b, most: F.abs(a - b) <= most
    return d.select(F.col("column").alias("name"), "count", "non_null", "min_length", F.round("mean", 2).alias("mean"), near(F.col("distinct"), F.col("_n"), 0.06 * F.col("_n")).alias("distinct_near"), F.coalesce(near(F.col("_rank"), F.lit(0.5), 0.015), F.lit(True)).alias("median_near"))
