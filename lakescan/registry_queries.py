"""The registered queries of the engine's own operators, with the same results as SQL.

The inventory is cut from ``orders`` by expressions that read the same in both dialects: Hive, positional and flat
layouts, table-format markers, hidden files, five buckets' worth of sizes, classes and times.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import cells as CELLS
from .functions import cost as COST
from .functions import keys as K
from .operators import changes as CH
from .operators import datasets as D
from .operators import infer as I
from .operators import profile as P
from .operators.catalog import Catalog
from .plans import crawl, sqlapi
from .sources import files as FILES
from .sources import inventory as INV
from .sources import readers as R

KEY = """CASE o_orderkey % 6
WHEN 0 THEN 'orders/year=' || year(o_orderdate) || '/month=' || lpad(month(o_orderdate) || '', 2, '0') || '/part-' || o_orderkey || '.parquet'
WHEN 1 THEN 'feed/' || cast(cast(o_orderdate AS date) AS string) || '/' || o_orderpriority || '/part-' || o_orderkey || '.csv.gz'
WHEN 2 THEN 'flat/' || o_orderkey || '.json'
WHEN 3 THEN CASE WHEN o_orderkey % 30 = 3 THEN 'sales/_delta_log/' || o_orderkey || '.json' ELSE 'sales/region=' || (o_custkey % 4) || '/' || o_orderkey || '.parquet' END
WHEN 4 THEN CASE WHEN o_orderkey % 24 = 4 THEN 'tmp/_temporary/' || o_orderkey WHEN o_orderkey % 24 = 10 THEN 'logs/.hidden-' || o_orderkey ELSE 'logs/app/' || o_orderkey || '.JSONL.zst' END
ELSE CASE WHEN o_orderkey % 60 = 5 THEN 'ice/tbl/metadata/v' || o_orderkey || '.metadata.json' ELSE 'ice/tbl/data/' || o_orderkey || '.orc' END END"""
CLASS = "CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'STANDARD' WHEN '2' THEN 'standard_ia' WHEN '3' THEN 'GLACIER' WHEN '4' THEN 'DEEP_ARCHIVE' ELSE '' END"
FIELDS = {"bucket": "'b' || (o_custkey % 3)", "key": KEY, "size": "cast(floor(o_totalprice * 100) AS bigint)", "etag": "md5(cast(o_orderkey AS string))", "storage_class": CLASS, "version_id": "''", "modified": "o_orderdate"}
INVENTORY = "inv AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in FIELDS.items()) + " FROM orders)"
PREVIOUS = "prev AS (SELECT " + ", ".join(f"{e} AS {c}" for c, e in (FIELDS | {"etag": "CASE WHEN o_orderkey % 11 = 0 THEN 'old' ELSE md5(cast(o_orderkey AS string)) END"}).items()) + " FROM orders WHERE o_orderkey % 7 <> 0 UNION ALL SELECT 'b0', 'gone/' || c_custkey || '.csv', c_custkey, 'x', '', '', TIMESTAMP '2020-01-01 00:00:00' FROM customer WHERE c_custkey % 50 = 0)"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _objects(read(spark, sf_dir, "orders"), FIELDS)


def _objects(orders: DataFrame, fields: dict[str, str]) -> DataFrame:
    """The key goes through an explode, so that it is made once and then read, as an inventory's stored column is."""
    return orders.selectExpr(*[f"explode_outer(array({e})) AS {c}" if c == "key" else f"{e} AS {c}" for c, e in fields.items()])


def previous(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = FIELDS | {"etag": "CASE WHEN o_orderkey % 11 = 0 THEN 'old' ELSE md5(cast(o_orderkey AS string)) END"}
    old = _objects(read(spark, sf_dir, "orders").where("o_orderkey % 7 <> 0"), fields)
    gone = read(spark, sf_dir, "customer").where("c_custkey % 50 = 0").selectExpr("'b0' AS bucket", "'gone/' || c_custkey || '.csv' AS key", "c_custkey AS size", "'x' AS etag", "'' AS storage_class", "'' AS version_id", "TIMESTAMP_NTZ '2020-01-01 00:00:00' AS modified")
    return old.unionByName(gone)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def registered(sql: str = "", needs: str = "inv"):
    """Registers a query under its function's name; ``needs`` names the common tables that go before its SQL."""

    def keep(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            own = sql.strip()
            ctes = {"inv": INVENTORY, "prev": PREVIOUS, "cls": CLASSIFIED, "folded": FOLDED}
            heads = [ctes[n] for n in needs.split()]
            if heads and own.startswith("WITH "):
                own = "WITH " + ", ".join(heads) + ", " + own[5:]
            elif heads:
                own = "WITH " + ", ".join(heads) + " " + own
            SQL[f.__name__] = own
        return f

    return keep


BARE = r"regexp_replace(lower(key), '\.(gz|gzip|zst|zstd|snappy|bz2|bzip2|lz4|br)$', '')"
FORMAT = rf"CASE regexp_extract({BARE}, '\.([^./]*)$', 1) WHEN 'parquet' THEN 'parquet' WHEN 'pq' THEN 'parquet' WHEN 'orc' THEN 'orc' WHEN 'avro' THEN 'avro' WHEN 'csv' THEN 'csv' WHEN 'tsv' THEN 'tsv' WHEN 'tab' THEN 'tsv' WHEN 'jsonl' THEN 'jsonl' WHEN 'ndjson' THEN 'jsonl' WHEN 'json' THEN 'json' ELSE 'unknown' END"
COMPRESSION = r"CASE regexp_extract(lower(key), '\.([^./]*)$', 1) WHEN 'gz' THEN 'gzip' WHEN 'gzip' THEN 'gzip' WHEN 'zst' THEN 'zstd' WHEN 'zstd' THEN 'zstd' WHEN 'snappy' THEN 'snappy' WHEN 'bz2' THEN 'bzip2' WHEN 'bzip2' THEN 'bzip2' WHEN 'lz4' THEN 'lz4' WHEN 'br' THEN 'brotli' ELSE 'none' END"
BASE = "regexp_extract(key, '[^/]*$')"
HIDDEN = f"(key LIKE '%/' OR {BASE} = '' OR {BASE} LIKE '.%' OR {BASE} IN ('_SUCCESS', '_metadata', '_common_metadata', '_started', '_committed') OR starts_with({BASE}, '_temporary') OR contains(key, '/_temporary/'))"
ICE = f"({BASE} LIKE '%.metadata.json' OR {BASE} LIKE '%.avro' OR starts_with({BASE}, 'snap-') OR {BASE} = 'version-hint.text')"
MARK_ROOT = f"CASE WHEN contains(key, '/_delta_log/') THEN split_part(key, '/_delta_log/', 1) WHEN contains(key, '/metadata/') AND {ICE} THEN split_part(key, '/metadata/', 1) END"
MARK_FORMAT = f"CASE WHEN contains(key, '/_delta_log/') THEN 'delta' WHEN contains(key, '/metadata/') AND {ICE} THEN 'iceberg' END"
DIRS = "list_filter(string_split(key, '/')[:-2], lambda x: x <> '')"
PAIRS = f"list_filter({DIRS}, lambda x: regexp_matches(x, '^[^=]+=.+$'))"
IS_HIVE = f"len({PAIRS}) > 0"
HIVE_ROOT = "coalesce(nullif(regexp_replace(regexp_extract(key, '^(.*?)[^/=]+=[^/]+/', 1), '/$', ''), ''), '')"
CLASSIFIED = f"""cls AS (SELECT *, {FORMAT} AS format, {COMPRESSION} AS compression, CASE WHEN {IS_HIVE} THEN {HIVE_ROOT} ELSE '' END AS root,
CASE WHEN {IS_HIVE} THEN 'hive' ELSE 'positional' END AS strategy,
CASE WHEN {IS_HIVE} THEN {PAIRS} ELSE list_transform(range(len({DIRS})), lambda i: 'pt' || i || '=' || {DIRS}[i + 1]) END AS parts
FROM inv WHERE {MARK_FORMAT} IS NULL AND NOT {HIDDEN})"""
FOLDED = f"""marks AS (SELECT bucket, {MARK_ROOT} AS table_root, min({MARK_FORMAT}) AS table_format FROM inv WHERE {MARK_FORMAT} IS NOT NULL GROUP BY 1, 2),
folded AS (SELECT cls.* EXCLUDE (root, strategy), coalesce(m.table_root, cls.root) AS root, coalesce(m.table_format, cls.strategy) AS strategy, m.table_format
FROM cls LEFT JOIN marks m ON cls.bucket = m.bucket AND (cls.root = m.table_root OR starts_with(cls.root, m.table_root || '/')))"""


def classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.classified(inventory(spark, sf_dir))


def folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = inventory(spark, sf_dir)
    return D.fold_tables(D.classified(i), D.table_roots(i))


def _pairs(c: Column) -> Column:
    return F.array_join(F.transform(c, lambda p: F.concat(p["name"], F.lit("="), p["value"])), "/")


# ---- keys (B) ----


@registered(f"SELECT bucket, key, {FORMAT} AS format FROM inv")
def detect_format(spark, sf_dir):
    return inventory(spark, sf_dir).select("bucket", "key", K.format_of(F.col("key")).alias("format"))


@registered(f"SELECT bucket, key, {COMPRESSION} AS compression FROM inv")
def detect_compression(spark, sf_dir):
    return inventory(spark, sf_dir).select("bucket", "key", K.compression_of(F.col("key")).alias("compression"))


@registered("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'parquet' WHEN event_id % 4 = 3 THEN 'json' ELSE 'jsonl' END AS format FROM events""", "")
def detect_format_by_header(spark, sf_dir):
    header = F.when(F.col("event_id") % 4 == 0, F.lit("PAR1....")).when(F.col("event_id") % 4 == 3, F.col("props")).otherwise(F.concat_ws("\n", "props", F.lit(""), "props", F.lit("")))
    name = F.when(F.col("event_id") % 4 == 1, F.lit("a/x.json")).otherwise(F.lit("a/x"))
    return read(spark, sf_dir, "events").select("event_id", K.format_with_header(name, F.encode(header, "UTF-8")).alias("format"))


@registered(f"SELECT bucket, key FROM inv WHERE NOT {HIDDEN}")
def ignore_filter(spark, sf_dir):
    return inventory(spark, sf_dir).where(~K.ignored(F.col("key"))).select("bucket", "key")


@registered(f"SELECT bucket, key, {MARK_ROOT} AS root, {MARK_FORMAT} AS format FROM inv WHERE {MARK_FORMAT} IS NOT NULL")
def table_markers(spark, sf_dir):
    m = inventory(spark, sf_dir).withColumn("m", K.table_marker(F.col("key"))).where("m IS NOT NULL")
    return m.select("bucket", "key", "m.root", "m.format")


@registered(f"SELECT key, CASE WHEN {IS_HIVE} THEN {HIVE_ROOT} ELSE array_to_string({DIRS}, '/') END AS root, array_to_string({PAIRS}, '/') AS partitions FROM inv")
def classify_hive(spark, sf_dir):
    return inventory(spark, sf_dir).select("key", K.classify_hive(F.col("key")).alias("c")).select("key", "c.root", _pairs(F.col("c.partitions")).alias("partitions"))


@registered(f"SELECT key, 'feed' AS root, array_to_string(list_transform(range(len({DIRS})), lambda i: 'pt' || i || '=' || {DIRS}[i + 1]), '/') AS partitions FROM (SELECT substr(key, 6) AS key FROM inv WHERE starts_with(key, 'feed/'))")
def classify_positional(spark, sf_dir):
    d = inventory(spark, sf_dir).where(F.col("key").startswith("feed/")).select(F.substring("key", 6, 1000).alias("key"), K.classify_positional(F.col("key"), "feed").alias("c"))
    return d.select("key", "c.root", _pairs(F.col("c.partitions")).alias("partitions"))


@registered(f"SELECT key, array_to_string({DIRS}, '/') AS root FROM inv")
def classify_legacy(spark, sf_dir):
    return inventory(spark, sf_dir).select("key", K.classify_legacy(F.col("key"))["root"].alias("root"))


@registered("SELECT key, format, compression, root, strategy, array_to_string(parts, '/') AS partitions FROM cls", "inv cls")
def classify_auto(spark, sf_dir):
    return classified(spark, sf_dir).select("key", "format", "compression", "root", "strategy", _pairs(F.col("partitions")).alias("partitions"))


@registered(f"SELECT key, array_to_string(list_concat(list_transform(range(len({DIRS})), lambda i: CASE WHEN i < 2 THEN 'pt' || i || '=' ELSE '' END || {DIRS}[i + 1]), [{BASE}]), '/') AS virtual, key AS restored FROM inv")
def virtual_path(spark, sf_dir):
    d = inventory(spark, sf_dir).select("key", K.virtual_path(F.col("key"), 2).alias("virtual"))
    return d.withColumn("restored", K.real_path(F.col("virtual")))


@registered("SELECT key, substr(sha256(etag || '|' || size || '|' || version_id || '|' || strftime(modified, '%Y-%m-%dT%H:%M:%S.%f') || 'Z'), 1, 32) AS hash FROM inv")
def metadata_hash(spark, sf_dir):
    return CH.hashed(inventory(spark, sf_dir)).select("key", "hash")


def _rates(spark, sf_dir):
    """The default region's rates, and for every nation a region with rates of its own that has no rate for one class."""
    own = COST.rates_table(spark)
    n = read(spark, sf_dir, "nation").selectExpr("concat('region-', n_nationkey) AS _region", "1 + n_nationkey / 100D AS _factor")
    other = own.join(n, F.lit(True)).where("class <> 'GLACIER'")  # 7 rates for each of the 25 nations
    return own.unionByName(other.selectExpr("_region AS region", "class", "rate * _factor AS rate"))


RATES = "rates(c, r) AS (VALUES " + ", ".join(f"('{k}', {v}::DOUBLE)" for k, v in COST.DEFAULT_RATES.items()) + ")"


@registered(f"""WITH {RATES}, k AS (SELECT key, size, CASE WHEN storage_class = '' THEN 'STANDARD' ELSE upper(storage_class) END AS c, size % 40 AS n FROM inv),
p AS (SELECT key, size, c, coalesce('region-' || n_nationkey, 'us-east-1') AS price_region, 1 + coalesce(n_nationkey, 0) / 100::DOUBLE AS f, CASE WHEN n_nationkey IS NOT NULL AND c = 'GLACIER' THEN 'STANDARD' ELSE c END AS billed FROM k LEFT JOIN nation ON n = n_nationkey)
SELECT key, price_region, round((CASE WHEN p.c = 'STANDARD_IA' THEN greatest(size, 131072) ELSE size END * r * f + CASE WHEN p.c IN ('GLACIER', 'DEEP_ARCHIVE') THEN 32768 * r * f + 8192 * 0.023::DOUBLE * f ELSE 0 END) / 1073741824, 9) AS cost FROM p JOIN rates ON billed = rates.c""")
def object_cost(spark, sf_dir):
    d = inventory(spark, sf_dir).withColumn("region", F.concat(F.lit("region-"), F.col("size") % 40))
    return COST.with_cost(d, _rates(spark, sf_dir)).select("key", "price_region", F.round("cost", 9).alias("cost"))


@registered(r"""SELECT p_partkey, CASE WHEN n = '' THEN 'table' WHEN n[1:1] BETWEEN '0' AND '9' THEN 't_' || n ELSE n END AS table_name, regexp_matches(p_name, '^[A-Za-z_][A-Za-z0-9_]*$') AS valid
FROM (SELECT p_partkey, p_name, trim(regexp_replace(lower(p_size || ' ' || p_type || '!'), '[^a-z0-9]+', '_', 'g'), '_') AS n FROM part)""", "")
def sanitize_names(spark, sf_dir):
    return read(spark, sf_dir, "part").select("p_partkey", K.table_name(F.concat(F.col("p_size"), F.lit(" "), "p_type", F.lit("!"))).alias("table_name"), K.valid_identifier(F.col("p_name")).alias("valid"))


# ---- datasets (C) ----


@registered("""SELECT bucket, root, CASE WHEN root = '' THEN bucket ELSE regexp_extract(root, '[^/]*$') END AS name, min(strategy) AS strategy, count(*) AS file_count, sum(size)::BIGINT AS total_size,
coalesce((SELECT string_agg(n, ',' ORDER BY pos, n) FROM (SELECT split_part(x, '=', 1) AS n, min(pos) AS pos FROM (SELECT unnest(parts) AS x, generate_subscripts(parts, 1) AS pos FROM folded g WHERE g.bucket = f.bucket AND g.root = f.root) GROUP BY 1)), '') AS partition_keys
FROM folded f GROUP BY bucket, root""", "inv cls folded")
def dataset_rollup(spark, sf_dir):
    return D.roll_up(folded(spark, sf_dir)).select("bucket", "root", "name", "strategy", "file_count", "total_size", F.array_join("partition_keys", ",").alias("partition_keys"))


@registered("""SELECT bucket, root, array_to_string(list_transform(list_sort(parts), lambda x: x || '/'), '') AS partition_path, count(*) AS file_count, sum(size)::BIGINT AS total_size FROM cls WHERE len(parts) > 0 GROUP BY 1, 2, 3""", "inv cls")
def partition_summary(spark, sf_dir):
    return D.partition_summary(classified(spark, sf_dir))


@registered("""WITH v AS (SELECT bucket, root, format, count(*) AS n FROM cls GROUP BY ALL)
SELECT bucket, root, arg_max(format, n * 100 - list_position(['parquet', 'avro', 'orc', 'jsonl', 'json', 'csv', 'tsv', 'unknown'], format)) AS format FROM v GROUP BY 1, 2""", "inv cls")
def dominant_format(spark, sf_dir):
    return D.dominant_formats(classified(spark, sf_dir))


@registered("""SELECT bucket, root, format, key, size FROM (SELECT *, row_number() OVER (PARTITION BY bucket, root, format ORDER BY size DESC, key DESC) AS n FROM cls) WHERE n = 1""", "inv cls")
def representative_object(spark, sf_dir):
    return D.representatives(classified(spark, sf_dir))


@registered("SELECT key, root, strategy, table_format FROM folded", "inv cls folded")
def table_fold(spark, sf_dir):
    return folded(spark, sf_dir).select("key", "root", "strategy", "table_format")


@registered("""SELECT i.bucket, count(*) AS objects, sum(size)::BIGINT AS bytes, (SELECT count(DISTINCT root) FROM folded f WHERE f.bucket = i.bucket) AS datasets FROM inv i GROUP BY i.bucket""", "inv cls folded")
def bucket_stats(spark, sf_dir):
    return D.bucket_stats(inventory(spark, sf_dir), D.roll_up(folded(spark, sf_dir)))


@registered("""SELECT bucket, root, (CASE WHEN max(n) <= 0 THEN 0 ELSE max(n) * count(*) END)::BIGINT AS rows FROM (SELECT bucket, root, size % 1000 - 1 AS s, arg_max(size % 1000 - 1, (size, key)) OVER (PARTITION BY bucket, root) AS n FROM cls) GROUP BY bucket, root""", "inv cls")
def dataset_row_estimate(spark, sf_dir):
    g = classified(spark, sf_dir).groupBy("bucket", "root").agg(F.count("*").alias("n"), F.max_by(F.col("size") % 1000 - 1, F.struct("size", "key")).alias("rep"))
    return g.select("bucket", "root", D.estimated_rows(F.col("rep"), F.col("n")).cast("long").alias("rows"))


@registered("""SELECT bucket, root, array_to_string(list_distinct_keys, ',') AS keys FROM (SELECT bucket, root, list_sort(list_distinct(list_concat(list_transform(max(parts), lambda x: split_part(x, '=', 1)), ['region']))) AS list_distinct_keys FROM cls GROUP BY 1, 2)""", "inv cls")
def united_partition_keys(spark, sf_dir):
    names = F.transform(F.col("p"), lambda x: F.split_part(x, F.lit("="), F.lit(1)))
    texts = F.transform("partitions", lambda p: F.concat(p["name"], F.lit("="), p["value"]))
    g = classified(spark, sf_dir).groupBy("bucket", "root").agg(F.max(texts).alias("p"))
    return g.select("bucket", "root", F.array_join(F.array_sort(D.united(names, F.array(F.lit("region"), F.lit(" ")))), ",").alias("keys"))


# ---- changes (D) ----

DIFF = """diff AS (SELECT coalesce(i.bucket, p.bucket) AS bucket, coalesce(i.key, p.key) AS key,
CASE WHEN p.key IS NULL THEN 'new' WHEN i.key IS NULL THEN 'removed' WHEN i.etag = p.etag AND i.size = p.size AND i.modified = p.modified THEN 'unchanged' ELSE 'changed' END AS change
FROM inv i FULL JOIN prev p ON i.bucket = p.bucket AND i.key = p.key)"""


@registered(f"WITH {DIFF} SELECT bucket, key, change FROM diff", "inv prev")
def inventory_diff(spark, sf_dir):
    return CH.difference(inventory(spark, sf_dir), previous(spark, sf_dir))


def _stored(spark, sf_dir):
    old = "TIMESTAMP_NTZ '2020-01-01 00:00:00'"
    return previous(spark, sf_dir).selectExpr("*", "md5(key) AS id", f"{old} AS created_at", f"{old} AS updated_at")


@registered(f"""WITH {DIFF} SELECT i.bucket, i.key, i.etag, coalesce(CASE WHEN p.key IS NOT NULL THEN md5(p.key) END, substr(sha256(i.bucket || '/' || i.key), 1, 32)) AS id, CASE WHEN d.change = 'unchanged' THEN '2020' ELSE '2021' END AS updated
FROM inv i JOIN diff d USING (bucket, key) LEFT JOIN prev p ON p.bucket = i.bucket AND p.key = i.key
UNION ALL SELECT bucket, key, 'x', md5(key), '2020' FROM diff WHERE change = 'removed' AND starts_with(key, 'gone/')""", "inv prev")
def inventory_upsert(spark, sf_dir):
    now = F.expr("TIMESTAMP_NTZ '2021-01-01 00:00:00'")
    d = CH.upsert(_stored(spark, sf_dir), inventory(spark, sf_dir), now)
    return d.select("bucket", "key", "etag", "id", F.year("updated_at").cast("string").alias("updated"))


@registered(f"""WITH {DIFF} SELECT (SELECT count(*) FROM inv) AS objects_scanned, (SELECT sum(size)::BIGINT FROM inv) AS bytes, count(*) FILTER (change = 'new') AS objects_new, count(*) FILTER (change = 'changed') AS objects_changed,
count(*) FILTER (change = 'removed') AS objects_removed, count(*) FILTER (change = 'unchanged') AS objects_unchanged, (SELECT count(*) FROM (SELECT DISTINCT bucket, root FROM folded)) AS datasets, 'completed' AS status FROM diff""", "inv prev cls folded")
def run_metrics(spark, sf_dir):
    i = inventory(spark, sf_dir)
    return CH.run_metrics(i, CH.difference(i, previous(spark, sf_dir)), D.roll_up(folded(spark, sf_dir)))


COLS = "cols AS (SELECT p_brand AS dataset, p_type AS name, CASE WHEN max(p_size) > 40 THEN 'string' ELSE 'integer' END AS type, min(p_size) < 5 AS nullable FROM part GROUP BY p_brand, p_type)"
PRINTS = f"{COLS}, prints AS (SELECT dataset, substr(sha256(string_agg(name || ':' || type || ':' || nullable, '|' ORDER BY name || ':' || type || ':' || nullable)), 1, 32) AS fingerprint FROM cols GROUP BY dataset)"


def _columns(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    return p.groupBy(F.col("p_brand").alias("dataset"), F.col("p_type").alias("name")).agg(F.when(F.max("p_size") > 40, "string").otherwise("integer").alias("type"), (F.min("p_size") < 5).alias("nullable"))


@registered(f"WITH {PRINTS} SELECT dataset, fingerprint FROM prints", "")
def schema_fingerprint(spark, sf_dir):
    return CH.fingerprints(_columns(spark, sf_dir), ["dataset"])


@registered(f"""WITH {PRINTS} SELECT dataset, CASE WHEN dataset LIKE '%1' THEN 1 ELSE 3 END AS version, fingerprint, CASE WHEN dataset LIKE '%1' THEN NULL ELSE 'other' END AS previous FROM prints WHERE NOT dataset LIKE '%2'""", "")
def schema_version(spark, sf_dir):
    found = CH.fingerprints(_columns(spark, sf_dir), ["dataset"])
    known = found.where("NOT dataset LIKE '%1'")
    old = known.selectExpr("dataset", "1 AS version", "'first' AS fingerprint").unionByName(known.selectExpr("dataset", "2 AS version", "CASE WHEN dataset LIKE '%2' THEN fingerprint ELSE 'other' END AS fingerprint"))
    return CH.next_versions(found, old)


@registered(f"""WITH {COLS}, o AS (SELECT bucket, root, array_to_string(list_transform(list_sort(parts), lambda x: x || '/'), '') AS pp FROM cls), now AS (SELECT DISTINCT bucket, root FROM o), p AS (SELECT DISTINCT bucket, root, pp FROM o WHERE pp <> '')
SELECT CASE WHEN bucket = 'b2' THEN 'DatasetDiscovered' ELSE 'CatalogUpdated' END AS type, bucket || '/' || root AS subject, count(*) AS n, '' AS schema FROM now GROUP BY 1, 2
UNION ALL SELECT DISTINCT 'CrawlStarted', bucket, 1, '' FROM now
UNION ALL SELECT 'SchemaChanged', dataset, 1, CASE WHEN dataset LIKE '%3' THEN '5,4,' ELSE '1,0,' END || count(*) FROM cols WHERE NOT dataset LIKE '%2' GROUP BY dataset
UNION ALL SELECT 'NewPartition', bucket || '/' || root, count(*), '' FROM p WHERE pp LIKE '%1%' GROUP BY 1, 2 UNION ALL SELECT 'CrawlCompleted', 'crawl', 1, ''""", "inv cls")
def change_events(spark, sf_dir):
    o = classified(spark, sf_dir)
    datasets, partitions = D.roll_up(o), D.partition_summary(o)
    columns = _columns(spark, sf_dir)
    found = CH.fingerprints(columns, ["dataset"])
    stored = found.where("dataset LIKE '%2'").withColumn("version", F.lit(4)).unionByName(found.where("dataset LIKE '%3'").selectExpr("dataset", "'other' AS fingerprint", "4 AS version"))
    metrics = datasets.agg(F.count("*").alias("datasets"))
    e = CH.change_events(datasets, datasets.where("bucket <> 'b2'"), CH.next_versions(found, stored), columns, partitions, partitions.where("NOT partition_path LIKE '%1%'"), metrics, F.lit("2021"))
    p = F.from_json("payload", "version int, old_version int, columns long")
    return e.groupBy("type", "subject").agg(F.count("*").alias("n"), F.max(F.concat_ws(",", p["version"], p["old_version"], p["columns"])).alias("schema"))


@registered("""SELECT bucket, root, array_to_string(list_transform(list_sort(parts), lambda x: x || '/'), '') AS partition_path, count(*) AS file_count, sum(size)::BIGINT AS total_size FROM cls WHERE len(parts) > 0 AND NOT (bucket = 'b1' AND strategy = 'positional') GROUP BY 1, 2, 3""", "inv cls")
def replaced_partitions(spark, sf_dir):
    now = D.partition_summary(classified(spark, sf_dir))
    gone = (F.col("bucket") == "b1") & (F.col("root") == "")
    stale = now.withColumn("file_count", F.col("file_count") + 5)
    return CH.replace_partitions(stale, now.where(~gone), now, ["bucket", "root"])


@registered("""SELECT bucket, key, CASE WHEN root = 'orders' AND bucket = 'b0' THEN '' ELSE root END AS dataset_id FROM cls""", "inv cls")
def dataset_delete(spark, sf_dir):
    o = classified(spark, sf_dir).withColumn("dataset_id", F.col("root"))
    gone = o.where("root = 'orders' AND bucket = 'b0'").select("bucket", "root").distinct()
    return CH.delete_datasets(gone, {"objects": o})["objects"].select("bucket", "key", "dataset_id")


# ---- inference (E) ----

CELL = """CASE WHEN v IS NULL OR trim(v) IN ('', 'null', 'NULL', 'Null', 'na', 'NA', 'n/a', 'N/A', 'nil', 'none', 'None', '\\N') THEN 'null' WHEN lower(trim(v)) IN ('true', 'false', 't', 'f', 'yes', 'no', 'y', 'n') THEN 'boolean'
WHEN regexp_matches(trim(v), '^[+-]?[0-9]+$') AND try_cast(trim(v) AS BIGINT) IS NOT NULL THEN 'integer'
WHEN regexp_matches(trim(v), '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN CASE WHEN NOT regexp_matches(v, '[eE]') AND contains(v, '.') AND length(trim(v)) - instr(trim(v), '.') > 6 THEN 'decimal' ELSE 'float' END
WHEN regexp_matches(v, '^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$') THEN 'uuid'
WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}') THEN 'timestamp' WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN 'date' WHEN (v LIKE '{%}') OR (v LIKE '[%]') THEN 'json' ELSE 'string' END"""
CELLS_EXPR = "CASE event_id % 9 WHEN 0 THEN props WHEN 1 THEN event_type WHEN 2 THEN cast(user_id AS string) WHEN 3 THEN user_id || '.25' WHEN 4 THEN user_id || '.12345678' WHEN 5 THEN cast(cast(ts AS date) AS string) WHEN 6 THEN CASE WHEN user_id % 2 = 0 THEN 'n/a' ELSE 'YES' END WHEN 7 THEN user_id || 'e3' ELSE cast(cast(ts AS date) AS string) || 'T10:20:30Z' END"


def _cells(spark, sf_dir):
    return read(spark, sf_dir, "events").selectExpr("event_id", "event_type", "event_id % 9 AS k", f"{CELLS_EXPR} AS v")


EVENT_CELLS = f"c AS (SELECT event_id, event_type, event_id % 9 AS k, {CELLS_EXPR} AS v FROM events)"


@registered(f"WITH {EVENT_CELLS} SELECT event_id, {CELL} AS type FROM c", "")
def cell_type(spark, sf_dir):
    return _cells(spark, sf_dir).select("event_id", CELLS.cell_type(F.col("v")).alias("type"))


@registered(f"""WITH {EVENT_CELLS}, t AS (SELECT event_type, k // 2 AS g, {CELL} AS t FROM c), a AS (SELECT event_type, g, list_sort(list_distinct(list(t) FILTER (t <> 'null'))) AS ts, count(*) FILTER (t = 'null') > 0 AS n FROM t GROUP BY 1, 2)
SELECT event_type, g, CASE WHEN len(ts) = 1 THEN ts[1] WHEN len(ts) = 0 THEN 'string' WHEN list_has_all(['decimal', 'integer'], ts) THEN 'decimal' WHEN list_has_all(['decimal', 'float', 'integer'], ts) THEN 'float' WHEN list_has_all(['date', 'timestamp'], ts) THEN 'timestamp' ELSE 'string' END AS type, n AS nullable FROM a""", "")
def column_type(spark, sf_dir):
    c = _cells(spark, sf_dir).selectExpr("event_type", "k div 2 AS g", "v AS value")
    return CELLS.column_types(c, ["event_type", "g"])


@registered(f"""WITH {EVENT_CELLS}, d AS (SELECT *, {CELL} = 'null' AS z FROM c) SELECT event_type, k, count(*) AS count, count(*) FILTER (z) AS null_count, count(DISTINCT v) FILTER (NOT z) AS distinct_count, min(v) FILTER (NOT z) AS min, max(v) FILTER (NOT z) AS max,
round(count(*) FILTER (NOT z) / count(*), 9) AS completeness, (SELECT string_agg(v, ',' ORDER BY a, v) FROM (SELECT v, min(event_id) AS a FROM d e WHERE e.event_type = d.event_type AND e.k = d.k AND NOT z GROUP BY v ORDER BY a, v LIMIT 10)) AS samples FROM d GROUP BY event_type, k""", "")
def sample_stats(spark, sf_dir):
    c = _cells(spark, sf_dir).selectExpr("event_type", "k", "event_id AS line_no", "v AS value")
    return I.sample_stats(c, ["event_type", "k"]).select("event_type", "k", "count", "null_count", "distinct_count", "min", "max", F.round("completeness", 9).alias("completeness"), F.array_join("samples", ",").alias("samples"))


def _lines(spark, sf_dir):
    sep = "CASE o_custkey % 4 WHEN 0 THEN '|' WHEN 1 THEN ';' WHEN 2 THEN ',' ELSE '\\t' END"
    return read(spark, sf_dir, "orders").selectExpr("'f' || o_custkey AS file", "o_orderkey AS line_no", f"o_orderkey || {sep} || o_orderpriority || {sep} || o_orderstatus AS line")


@registered("""SELECT 'f' || o_custkey AS file, CASE WHEN count(*) < 2 THEN ',' ELSE CASE o_custkey % 4 WHEN 0 THEN '|' WHEN 1 THEN ';' WHEN 2 THEN ',' ELSE chr(9) END END AS delimiter FROM orders GROUP BY o_custkey""", "")
def delimiter_sniff(spark, sf_dir):
    return I.sniff_delimiters(_lines(spark, sf_dir))


@registered("""WITH f AS (SELECT o_custkey AS c, count(*) AS n, CASE o_custkey % 4 WHEN 0 THEN '|' WHEN 1 THEN ';' WHEN 2 THEN ',' ELSE chr(9) END AS sep, min(o_orderkey) AS k, min(o_orderpriority) AS p, min(o_orderstatus) AS s, bool_and(o_orderstatus = 'F') AS all_f FROM orders GROUP BY o_custkey)
SELECT 'f' || c AS file, i AS pos, 'col_' || (i + 1) AS name, CASE WHEN i = 0 THEN 'integer' WHEN i = 2 AND all_f THEN 'boolean' ELSE 'string' END AS type, false AS nullable FROM f, (SELECT unnest([0, 1, 2]) AS i) WHERE n > 1 OR sep = ','
UNION ALL SELECT 'f' || c, 0, k || sep || p || sep || s, 'string', true FROM f WHERE n = 1 AND sep <> ','""", "")
def text_schema(spark, sf_dir):
    return I.infer_text(_lines(spark, sf_dir), 1 << 40).select("file", "pos", "name", "type", "nullable")


@registered("""SELECT event_type AS file, 0 AS pos, 'k' AS name, 'integer' AS type, false AS nullable FROM events WHERE props LIKE '{"k": %}' GROUP BY 1""", "")
def json_schema(spark, sf_dir):
    return I.infer_json(read(spark, sf_dir, "events").selectExpr("event_type AS file", "event_id AS line_no", "props AS line"))


@registered("""SELECT event_id, CASE event_id % 7 WHEN 0 THEN 'integer' WHEN 1 THEN 'float' WHEN 2 THEN 'boolean' WHEN 3 THEN 'date' WHEN 4 THEN 'array' WHEN 5 THEN 'struct' ELSE 'null' END AS kind FROM events""", "")
def json_kinds(spark, sf_dir):
    value = "CASE event_id % 7 WHEN 0 THEN cast(user_id AS string) WHEN 1 THEN user_id || '.5' WHEN 2 THEN 'true' WHEN 3 THEN '\"' || cast(cast(ts AS date) AS string) || '\"' WHEN 4 THEN '[1]' WHEN 5 THEN props ELSE 'null' END"
    v = read(spark, sf_dir, "events").selectExpr("event_id", f"parse_json({value}) AS v")
    return v.select("event_id", I.json_kind(F.col("v"), F.col("v").cast("string")).alias("kind"))


@registered("""SELECT event_type, event_id AS line_no, '{"id":"' || event_id || '","user":"' || user_id || '"}' AS row FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events) WHERE n <= 200""", "")
def sample_rows(spark, sf_dir):
    e = read(spark, sf_dir, "events")
    cells = e.selectExpr("event_type", "event_id AS line_no", "explode(array(struct(0 AS pos, cast(event_id AS string) AS value), struct(1 AS pos, cast(user_id AS string) AS value))) AS c").select("event_type", "line_no", "c.*")
    names = e.select("event_type").distinct().selectExpr("event_type", "explode(array(struct(0 AS pos, 'id' AS name), struct(1 AS pos, 'user' AS name))) AS c").select("event_type", "c.*")
    return I.sample_rows(cells, names, ["event_type"])


# ---- profiles (H) ----


def _scalar_sql(table: str, numeric: list[str], text: list[str], times: list[str]) -> str:
    rows = []
    for c in numeric:
        rows.append(f"SELECT '{c}' AS \"column\", 'numeric' AS kind, count(*) AS count, count({c}) AS non_null, count(DISTINCT {c}) AS \"distinct\", round(avg({c}), 5) AS mean, round(stddev_pop({c}), 6) AS stddev, round(quantile_cont({c}, 0.5), 6) AS median, NULL::BIGINT AS min_length, NULL::BIGINT AS max_length, round(count(DISTINCT {c}) / count({c}), 9) AS distinct_pct FROM {table}")
    for c in text:
        rows.append(f"SELECT '{c}', 'string', count(*), count({c}), count(DISTINCT {c}), NULL, NULL, NULL, min(length({c})), max(length({c})), round(count(DISTINCT {c}) / count({c}), 9) FROM {table}")
    for c in times:
        rows.append(f"SELECT '{c}', 'temporal', count(*), count({c}), count(DISTINCT {c}), NULL, NULL, NULL, NULL, NULL, round(count(DISTINCT {c}) / count({c}), 9) FROM {table}")
    return " UNION ALL ".join(rows)


def _scalar(df: DataFrame) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return P.scalars(df, exact=True).select("column", "kind", "count", "non_null", "distinct", F.round("mean", 5).alias("mean"), r("stddev"), r("median"), "min_length", "max_length", F.round("distinct_pct", 9).alias("distinct_pct"))


LINEITEM = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@registered(_scalar_sql("lineitem", LINEITEM, ["l_returnflag", "l_linestatus"], ["l_shipdate"]), "")
def profile_scalar_lineitem(spark, sf_dir):
    return _scalar(read(spark, sf_dir, "lineitem"))


def profile_approx_lineitem(spark, sf_dir):
    return P.scalars(read(spark, sf_dir, "lineitem"))


TOP = " UNION ALL ".join(f"SELECT '{c}' AS col, {c}::VARCHAR AS value, count(*) AS n FROM orders WHERE {c} IS NOT NULL GROUP BY 2" for c in ("o_orderstatus", "o_orderpriority", "o_orderdate"))


@registered(f"""SELECT col AS "column", place::INT AS place, value, n FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY n DESC, value) AS place FROM ({TOP})) WHERE place <= 8""", "")
def profile_topn_orders(spark, sf_dir):
    return P.top_values(read(spark, sf_dir, "orders"))


HIST = " UNION ALL ".join(f"SELECT '{c}' AS c, {c}::DOUBLE AS v FROM lineitem" for c in LINEITEM)


@registered(f"""WITH v AS ({HIST}), e AS (SELECT c, min(v) AS lo, max(v) AS hi FROM v GROUP BY c HAVING max(v) > min(v)), b AS (SELECT c, least(floor((v - lo) / ((hi - lo) / 12)), 11)::INT AS bin, count(*) AS n FROM v JOIN e USING (c) GROUP BY 1, 2)
SELECT e.c AS "column", i::INT AS bin, round(lo + i * ((hi - lo) / 12), 6) AS low, round(lo + (i + 1) * ((hi - lo) / 12), 6) AS high, coalesce(n, 0) AS n FROM e CROSS JOIN (SELECT unnest(range(12)) AS i) LEFT JOIN b ON b.c = e.c AND b.bin = i""", "")
def profile_hist_lineitem(spark, sf_dir):
    return P.histograms(read(spark, sf_dir, "lineitem")).select("column", "bin", F.round("low", 6).alias("low"), F.round("high", 6).alias("high"), "n")


@registered("""SELECT 'c_custkey' AS "column", 'Candidate Key' AS badges UNION ALL SELECT 'c_name', CASE WHEN count(DISTINCT c_name) >= 0.99 * count(*) THEN 'Candidate Key' WHEN count(DISTINCT c_name) >= 0.9 * count(*) THEN 'High Cardinality' ELSE '' END FROM customer
UNION ALL SELECT 'c_nationkey', '' UNION ALL SELECT 'c_acctbal', CASE WHEN count(DISTINCT c_acctbal) >= 0.99 * count(*) THEN 'Candidate Key' WHEN count(DISTINCT c_acctbal) >= 0.9 * count(*) THEN 'High Cardinality' ELSE '' END FROM customer
UNION ALL SELECT 'c_mktsegment', '' UNION ALL SELECT 'mail', 'Email' UNION ALL SELECT 'same', 'Constant' UNION ALL SELECT 'rare', 'Mostly Null'""", "")
def profile_badges_customer(spark, sf_dir):
    d = read(spark, sf_dir, "customer").selectExpr("*", "'m' || (c_custkey % 30) || '@x.org' AS mail", "1 AS same", "CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS rare")
    return P.badged(d, exact=True).select("column", F.array_join("badges", ",").alias("badges"))


EXT = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {'round(var_pop(' + c + '), 4)' if n else 'NULL'} AS variance, {'round(quantile_cont(' + c + ', 0.25), 6)' if n else 'NULL'} AS q25, {'round(quantile_cont(' + c + ', 0.75), 6)' if n else 'NULL'} AS q75, (SELECT round(-sum(n / t * log2(n / t)), 6) FROM (SELECT count(*) AS n, sum(count(*)) OVER () AS t FROM part GROUP BY {c})) AS entropy, 0.0::DOUBLE AS duplicate_ratio FROM {'part' if n else '(SELECT 1)'}" for c, n in (("p_partkey", 1), ("p_name", 0), ("p_brand", 0), ("p_type", 0), ("p_size", 1), ("p_retailprice", 1)))


@registered(EXT, "")
def profile_extended_part(spark, sf_dir):
    return P.extended(read(spark, sf_dir, "part")).select("column", F.round("variance", 4).alias("variance"), F.round("q25", 6).alias("q25"), F.round("q75", 6).alias("q75"), F.round("entropy", 6).alias("entropy"), "duplicate_ratio")


@registered("""SELECT 'embeddings' AS t, 'vec_id' AS "column", 'numeric' AS kind, count(*) AS non_null FROM embeddings UNION ALL SELECT 'embeddings', 'embedding', 'other', count(*) FROM embeddings UNION ALL SELECT 'embeddings', 'label', 'numeric', count(*) FROM embeddings""", "")
def profile_kinds_embeddings(spark, sf_dir):
    return P.scalars(read(spark, sf_dir, "embeddings")).select(F.lit("embeddings").alias("t"), "column", "kind", "non_null")


# ---- reading together (F) ----


def _file_columns(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    cols = "explode(CASE WHEN c_custkey % 10 = 9 THEN array(struct(0 AS pos, 'id' AS name, 'int' AS type)) ELSE array(struct(0 AS pos, 'id' AS name, CASE WHEN c_custkey % 3 = 0 THEN 'bigint' ELSE 'int' END AS type), struct(1 AS pos, CASE WHEN c_custkey % 2 = 0 THEN 'Name' ELSE 'name' END AS name, CASE WHEN c_custkey % 10 = 7 THEN 'int' ELSE 'string' END AS type)) END) AS c"
    return c.selectExpr("c_custkey AS file_idx", "CASE WHEN c_custkey % 4 = 3 THEN 'orc' ELSE 'parquet' END AS format", cols).select("file_idx", "format", "c.*")


VERDICTS = "v AS (SELECT c_custkey AS file_idx, CASE WHEN c_custkey % 4 = 3 THEN 'orc' ELSE 'parquet' END AS format, CASE WHEN c_custkey % 10 IN (7, 9) THEN 'incompatible' ELSE 'compatible' END AS verdict, CASE c_custkey % 10 WHEN 9 THEN 'shape' WHEN 7 THEN 'type:name' ELSE '' END AS reason FROM customer)"


@registered(f"WITH {VERDICTS} SELECT * FROM v", "")
def compat_groups(spark, sf_dir):
    from .operators.compat import group_files

    return group_files(_file_columns(spark, sf_dir))[0]


@registered(f"""WITH {VERDICTS} SELECT format, count(*) FILTER (verdict <> 'incompatible') AS members, count(*) FILTER (verdict = 'incompatible') AS rejected, 0::BIGINT AS widened, format = 'parquet' AS is_primary, true AS mixed_format FROM v GROUP BY format""", "")
def compat_summary(spark, sf_dir):
    from .operators.compat import group_files, summarize

    return summarize(group_files(_file_columns(spark, sf_dir))[0])


@registered("""SELECT c_mktsegment, CASE WHEN c_mktsegment = 'BUILDING' THEN sum(c_custkey)::BIGINT ELSE -1 END AS rows FROM customer GROUP BY 1""", "")
def footer_rows(spark, sf_dir):
    from .operators.compat import total_rows

    f = read(spark, sf_dir, "customer").selectExpr("c_mktsegment", "CASE WHEN c_mktsegment = 'BUILDING' OR c_custkey % 2 = 0 THEN 'parquet' ELSE 'csv' END AS format", "c_custkey AS num_rows")
    return total_rows(f, "c_mktsegment")


# ---- browsing (A, I) ----


@registered("""SELECT bucket, key, size FROM inv WHERE bucket = 'b1' AND starts_with(key, 'orders/') ORDER BY key LIMIT 50""")
def bucket_objects(spark, sf_dir):
    return INV.objects_of(D.classified(inventory(spark, sf_dir)), "b1", "orders").select("bucket", "key", "size")


@registered("""SELECT n_name AS name, CASE WHEN n_regionkey = 1 THEN 'eu-west-1' ELSE 'us-east-1' END AS price_region FROM nation""", "")
def price_regions(spark, sf_dir):
    buckets = read(spark, sf_dir, "nation").selectExpr("n_name AS name", "CASE n_regionkey WHEN 1 THEN 'eu-west-1' WHEN 2 THEN 'mars-1' END AS region")
    return INV.price_regions(buckets, spark.createDataFrame([("eu-west-1",), ("us-east-1",)], "region string")).select("name", "price_region")


@registered(f"""WITH {COLS}, v AS (SELECT dataset, CASE WHEN dataset LIKE '%1' THEN 1 ELSE 2 END AS version FROM (SELECT DISTINCT dataset FROM cols)), k AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY name) - 1 AS pos FROM cols)
SELECT k.dataset, v.version, k.pos, k.name, k.type, s.n FROM k JOIN v USING (dataset) LEFT JOIN (SELECT p_brand AS dataset, p_type AS name, count(*) AS n FROM part WHERE p_size > 10 GROUP BY 1, 2) s USING (dataset, name)""", "")
def latest_schema(spark, sf_dir):
    from pyspark.sql import Window

    from .operators.catalog import latest_schema as latest

    pos = (F.row_number().over(Window.partitionBy("dataset").orderBy("name")) - 1).cast("long").alias("pos")
    cols = _columns(spark, sf_dir).select("dataset", pos, "name", "type")
    both = cols.withColumn("version", F.lit(1)).unionByName(cols.where("NOT dataset LIKE '%1'").withColumn("version", F.lit(2)))
    stats = read(spark, sf_dir, "part").where("p_size > 10").groupBy(F.col("p_brand").alias("dataset"), F.col("p_type").alias("name")).agg(F.count("*").alias("n"))
    return latest(both.select("dataset", "version").distinct(), both, stats).select("dataset", "version", "pos", "name", "type", "n")


@registered("""SELECT bucket, root FROM (SELECT DISTINCT bucket, root FROM folded) WHERE bucket = 'b2' AND root = 'sales'""", "inv cls folded")
def dataset_by_location(spark, sf_dir):
    from .operators.catalog import find_by_location

    d = D.roll_up(folded(spark, sf_dir)).withColumn("updated_at", F.lit(0))
    return find_by_location(d, "b2", "/sales/").select("bucket", "root")


@registered("""SELECT bucket, split_part(substr(key, 6), '/', 1) AS name, contains(substr(key, 6), '/') AS is_folder, count(*) AS objects FROM inv WHERE starts_with(key, 'feed/') GROUP BY ALL""")
def list_dir(spark, sf_dir):
    return INV.children(inventory(spark, sf_dir), "feed/").select("bucket", "name", "is_folder", "objects")


@registered("""SELECT bucket, key, size, modified FROM inv WHERE starts_with(key, 'flat/') AND key > 'flat/5'""")
def listing_restrict(spark, sf_dir):
    return INV.restrict(inventory(spark, sf_dir), "flat/", "flat/5").select("bucket", "key", "size", "modified")


@registered("""WITH f AS (SELECT bucket, key, size, modified, string_split(key, '/') AS p FROM inv WHERE NOT key LIKE '%/'), x AS (SELECT bucket, key, size, modified, unnest(range(len(p))) AS i, p FROM f)
SELECT bucket, CASE WHEN i = 0 THEN '' ELSE array_to_string(p[1:i], '/') || '/' END AS folder, count(*) AS files, sum(size)::BIGINT AS bytes, max(modified) AS last_modified FROM x GROUP BY 1, 2""")
def folder_summary(spark, sf_dir):
    return INV.folder_summaries(inventory(spark, sf_dir)).select("bucket", "folder", "files", "bytes", "last_modified")


@registered("""SELECT name, is_folder FROM (SELECT DISTINCT split_part(key, '/', 1) AS name, true AS is_folder FROM inv WHERE bucket = 'b0') WHERE name > 'feed' ORDER BY name LIMIT 3""")
def keyset_page(spark, sf_dir):
    listing = INV.children(inventory(spark, sf_dir).where("bucket = 'b0'")).select("name", "is_folder")
    return INV.page(listing, cursor="feed", limit=3)[0]


@registered("""SELECT bucket, root, name FROM (SELECT DISTINCT bucket, root, CASE WHEN root = '' THEN bucket ELSE regexp_extract(root, '[^/]*$') END AS name FROM folded) WHERE contains(lower(name), 's') OR contains(lower(root), 's') ORDER BY bucket, root LIMIT 50""", "inv cls folded")
def dataset_search(spark, sf_dir):
    from .operators.catalog import search_datasets

    d = D.roll_up(folded(spark, sf_dir)).withColumn("updated_at", F.lit(0))
    return search_datasets(d, "S").select("bucket", "root", "name")


@registered("""SELECT bucket, root, (CASE WHEN root = 'orders' THEN 2 ELSE 0 END)::BIGINT AS tables, root = 'orders' AS registered FROM (SELECT DISTINCT bucket, root FROM folded)""", "inv cls folded")
def registration_counts(spark, sf_dir):
    from .operators.catalog import registrations

    d = D.roll_up(folded(spark, sf_dir))
    entries = d.where("root = 'orders'").select("bucket", "root", F.explode(F.array(F.lit("x"), F.lit("y"))).alias("name"))
    return registrations(entries, d)


# ---- files written from the tables and read back (E, F, G) ----


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lakescan-")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _files(spark: SparkSession, root: str, fmt: str) -> DataFrame:
    return spark.createDataFrame([(p,) for p in R.folder_files(spark, root, fmt)], "file string")


@registered("SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderstatus AS status FROM orders", "")
def folder_of_text(spark, sf_dir):
    """A positional folder of compressed files with ``;`` between the cells."""
    root, o = _scratch(spark, "text"), read(spark, sf_dir, "orders")
    for status in ("F", "O", "P"):
        o.where(F.col("o_orderstatus") == status).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority").write.option("sep", ";").option("header", True).option("compression", "gzip").csv(f"{root}/{status}")
    d = R.with_path_partitions(R.read_folder(spark, root, "csv"), root, ["status"])
    return d.select(F.col("o_orderkey").cast("long"), F.col("o_custkey").cast("long"), F.col("o_totalprice").cast("double"), "o_orderpriority", "status")


@registered("SELECT o_orderkey, o_totalprice, o_orderstatus, strftime(o_orderdate, '%m') AS month FROM orders", "")
def folder_of_hive_parquet(spark, sf_dir):
    root = _scratch(spark, "hive")
    read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus", F.date_format("o_orderdate", "MM").alias("month")).write.partitionBy("o_orderstatus", "month").parquet(root)
    return R.read_folder(spark, root, "parquet").select("o_orderkey", "o_totalprice", "o_orderstatus", "month")


@registered("SELECT event_id, event_type, user_id FROM events", "")
def folder_of_json(spark, sf_dir):
    root = _scratch(spark, "json")
    read(spark, sf_dir, "events").select("event_id", "event_type", "user_id").write.json(root)
    d = R.read_folder(spark, root, "json", options=R.ReadOptions(filename=False))
    return d.select(F.col("event_id").cast("long"), "event_type", F.col("user_id").cast("long"))


FOOTERS = "SELECT name, type, n AS rows FROM (SELECT unnest(['k', 'p', 't']) AS name, unnest(['bigint', 'string', 'double']) AS type), (SELECT count(*) AS n FROM orders)"


def _narrow(spark, sf_dir) -> DataFrame:
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"), F.col("o_orderpriority").alias("p"), F.col("o_totalprice").cast("double").alias("t")).repartition(5, "k")


def _footer_query(fmt: str, read_footers):
    def run(spark, sf_dir):
        root = _scratch(spark, fmt)
        _narrow(spark, sf_dir).write.format(fmt).save(root)
        return read_footers(_files(spark, root, fmt)).groupBy("name", "type").agg(F.sum("num_rows").alias("rows"))

    return run


QUERIES["parquet_footers"], SQL["parquet_footers"] = _footer_query("parquet", FILES.footers), FOOTERS
QUERIES["orc_footers"], SQL["orc_footers"] = _footer_query("orc", FILES.orc_footers), FOOTERS


@registered("SELECT f AS format, pos, name, CASE WHEN f IN ('csv', 'json') AND type = 'bigint' THEN 'integer' WHEN f IN ('csv', 'json') AND type = 'double' THEN 'float' ELSE type END AS type, n AS files_rows FROM (SELECT unnest(['csv', 'json', 'orc', 'parquet']) AS f), (SELECT unnest([0, 1, 2]) AS pos, unnest(['k', 'p', 't']) AS name, unnest(['bigint', 'string', 'double']) AS type), (SELECT count(*) AS n FROM orders)", "")
def schema_dispatch(spark, sf_dir):
    """Every format's schema by one crawl, with the rows that the files hold."""
    root, d = _scratch(spark, "dispatch"), _narrow(spark, sf_dir)
    reps = None
    for fmt in ("csv", "json", "orc", "parquet"):
        (d.write.option("header", True) if fmt == "csv" else d.write).format(fmt).save(f"{root}/{fmt}")
        own = _files(spark, f"{root}/{fmt}", fmt).withColumn("format", F.lit(fmt))
        reps = own if reps is None else reps.unionByName(own)
    found = crawl.infer_schemas(spark, reps).join(reps, "file").groupBy("format", "pos", "name").agg(F.max("type").alias("type"))
    return found.crossJoin(d.agg(F.count("*").alias("files_rows")))  # one row


@registered("SELECT o_orderkey AS k, o_custkey AS c FROM orders", "")
def read_selection(spark, sf_dir):
    """Files of int and of bigint members picked by hand, read as their merged schema."""
    root, o = _scratch(spark, "selection"), read(spark, sf_dir, "orders")
    for name, kind in (("a", "int"), ("b", "long")):
        o.where(F.col("o_orderkey") % 2 == (1 if name == "b" else 0)).select(F.col("o_orderkey").alias("k"), F.col("o_custkey").cast(kind).alias("c")).write.parquet(f"{root}/{name}")
    own = Catalog(spark, f"{root}/catalog")
    name = "selection_" + uuid.uuid4().hex
    return own.register(name, "", "parquet", paths=R.folder_files(spark, f"{root}/a", "parquet") + R.folder_files(spark, f"{root}/b", "parquet"), options=R.ReadOptions(filename=False)).select("k", "c")


@registered("""SELECT 'f' || c AS file, i AS pos, CASE WHEN c % 2 = 0 THEN ['id', 'prio', 'col_3', 'id_2'][i + 1] ELSE 'col_' || (i + 1) END AS name, c % 2 = 0 AS has_header FROM (SELECT DISTINCT o_custkey AS c FROM orders), (SELECT unnest([0, 1, 2, 3]) AS i)""", "")
def text_headers(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    body = o.selectExpr("'f' || o_custkey AS file", "o_orderkey AS line_no", "o_orderkey || ',' || o_orderpriority || ',' || o_orderstatus || ',x' AS line")
    top = o.where("o_custkey % 2 = 0").selectExpr("'f' || o_custkey AS file", "-1L AS line_no", "' id ,prio,,id' AS line").distinct()
    lines = body.unionByName(top)
    cells = I.split_cells(lines, lines.select("file").distinct().withColumn("delimiter", F.lit(",")))
    headers = I.detect_headers(cells)
    return I.header_names(cells, headers).join(headers, "file")


@registered("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN NULL WHEN floor(o_totalprice) <= 100000 THEN o_custkey ELSE floor(floor(o_totalprice) / (100000 / greatest(o_custkey, 1)))::BIGINT END AS rows FROM orders""", "")
def row_estimates(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    size, rows = F.floor("o_totalprice"), F.col("o_custkey").cast("long")
    return o.select("o_orderkey", I.estimated_rows(F.lit(100_000), rows, size, F.col("o_orderkey") % 3 == 0).cast("long").alias("rows"))


@registered(f"WITH {VERDICTS} SELECT file_idx, 'csv' AS format, verdict, reason FROM v", "")
def compat_one_format(spark, sf_dir):
    from .operators.compat import group_files, read_as

    return group_files(read_as(_file_columns(spark, sf_dir), "csv"))[0]


@registered("""SELECT 'parquet' AS format, count(*) AS members, 0::BIGINT AS rejected, count(*) FILTER (s_suppkey % 2 = 0) AS widened, sum(10 * s_suppkey)::BIGINT AS bytes, true AS is_primary, false AS mixed_format, 'struct<v:double>' AS merged FROM supplier""", "")
def compat_widened(spark, sf_dir):
    from .operators.compat import group_files, summarize

    s = read(spark, sf_dir, "supplier")
    columns = s.selectExpr("s_suppkey AS file_idx", "'parquet' AS format", "0 AS pos", "'v' AS name", "CASE WHEN s_suppkey % 2 = 0 THEN 'double' ELSE 'int' END AS type")
    verdicts, merged = group_files(columns)
    return summarize(verdicts, s.selectExpr("s_suppkey AS file_idx", "10 * s_suppkey AS size")).withColumn("merged", F.lit(merged["parquet"].simpleString()))


@registered("SELECT CASE WHEN count(DISTINCT o_custkey % 3) > 1 THEN 'web_sales' ELSE 'x' END AS name FROM orders", "")
def common_table_name(spark, sf_dir):
    from .operators.compat import common_table_name as common

    return common(read(spark, sf_dir, "orders").selectExpr("'lake/Web Sales/' || (o_custkey % 3) || '/' || o_orderkey || '.csv' AS key"), "csv")


@registered("""SELECT name, is_folder, size FROM (SELECT substr(key, 6) AS name, false AS is_folder, size FROM inv WHERE bucket = 'b1' AND starts_with(key, 'flat/')) ORDER BY size DESC, name LIMIT 30""")
def listing_by_size(spark, sf_dir):
    listing = INV.children(inventory(spark, sf_dir).where("bucket = 'b1'"), "flat/")
    return INV.sort_listing(listing, "size", True).select("name", "is_folder", "size").limit(30)


@registered("""SELECT bucket, key, size FROM folded WHERE bucket = 'b1' AND root = 'orders' ORDER BY key LIMIT 50""", "inv cls folded")
def dataset_objects(spark, sf_dir):
    from .operators.catalog import dataset_detail

    objects = folded(spark, sf_dir)
    none = D.partition_summary(objects)
    parts = dataset_detail("b1", "orders", D.roll_up(objects), none.withColumn("pos", F.lit(0)), none, none, objects)
    return parts["objects"].select("bucket", "key", "size")


@registered("""SELECT 'c_custkey' AS "column", 'numeric' AS kind, count(*) AS count, count(c_custkey) AS non_null FROM customer UNION ALL SELECT 'c_name', 'string', count(*), count(c_name) FROM customer UNION ALL SELECT 'c_nationkey', 'numeric', count(*), count(c_nationkey) FROM customer UNION ALL SELECT 'c_acctbal', 'numeric', count(*), count(c_acctbal) FROM customer UNION ALL SELECT 'c_mktsegment', 'string', count(*), count(c_mktsegment) FROM customer""", "")
def sql_summarize(spark, sf_dir):
    read(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    return sqlapi.query(spark, "SUMMARIZE customer", None)[0].select("column", "kind", "count", "non_null")


# ---- SQL over views (G19-G21) ----


def _sql(text: str, *tables: str):
    def run(spark, sf_dir):
        for t in tables:
            read(spark, sf_dir, t).createOrReplaceTempView(t)
        return sqlapi.query(spark, text, None)[0]

    return run


SMOKE = {
    "sql_join": ("SELECT n_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name", ("customer", "nation")),
    "sql_window": ("SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS n, sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS running FROM orders", ("orders",)),
    "sql_rollup": ("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)", ("lineitem",)),
    "sql_set_operations": ("SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000 UNION ALL SELECT n_nationkey FROM nation", ("customer", "supplier", "nation")),
    "sql_semi_anti": ("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 100000) AND c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')", ("customer", "orders")),
}
for _name, (_text, _tables) in SMOKE.items():
    QUERIES[_name] = _sql(_text, *_tables)
    SQL[_name] = _text
QUERIES["profile_approx_lineitem"] = profile_approx_lineitem
