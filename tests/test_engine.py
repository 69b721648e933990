from __future__ import annotations

import gzip
import json
import os
import random
import shutil
import subprocess
import sys

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.errors import ParseException
from pyspark.sql import functions as F

from lakescan.operators import catalog as C
from lakescan.operators import changes as CH
from lakescan.operators import datasets as D
from lakescan.operators import profile as P
from lakescan.plans import crawl, sqlapi
from lakescan.sources import files
from lakescan.sources import inventory as INV
from lakescan.sources import readers as R
from lakescan.streaming import incremental


def objects(spark, keys, bucket="b"):
    rows = [(bucket, k, n, "e", "STANDARD", "") for k, n in keys.items()]
    return spark.createDataFrame(rows, "bucket string, key string, size long, etag string, storage_class string, version_id string").withColumn("modified", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"))


KEYS = {"orders/year=2023/month=01/a.parquet": 10, "orders/year=2023/month=02/b.parquet": 20, "orders/year=2024/month=01/c.csv": 30, "sales/_delta_log/0.json": 1, "sales/region=x/p.parquet": 5, "sales/region=y/q.parquet": 6, "docs/a.json": 7, "_SUCCESS": 0}


def test_crawl_folds_tables_once_q2(spark):
    c = crawl.crawl(objects(spark, KEYS))
    got = {r.root: (r.format, r.strategy, r.file_count, r.total_size, r.partition_keys) for r in c.datasets.collect()}
    assert got == {"orders": ("parquet", "hive", 3, 60, ["year", "month"]), "sales": ("delta", "delta", 2, 11, ["region"]), "": ("json", "positional", 1, 7, ["pt0"])}
    assert {(r.root, r.partition_path, r.file_count) for r in c.partitions.collect()} == {("orders", "month=01/year=2023/", 1), ("orders", "month=02/year=2023/", 1), ("orders", "month=01/year=2024/", 1), ("sales", "region=x/", 1), ("sales", "region=y/", 1), ("", "pt0=docs/", 1)}
    assert [(r.bucket, r.objects, r.bytes, r.datasets) for r in c.buckets.collect()] == [("b", 8, 79, 3)]
    assert {r.key for r in c.representatives.where("root = 'orders'").collect()} == {"orders/year=2023/month=02/b.parquet", "orders/year=2024/month=01/c.csv"}


def test_empty_inventory(spark):
    c = crawl.crawl(objects(spark, KEYS).where("false"))
    assert all(d.count() == 0 for d in c)


def test_q4_q7_changes(spark):
    old, new = objects(spark, {"a/x=1/f": 1, "a/x=2/g": 2, "b/h": 3}), objects(spark, {"a/x=1/f": 1, "a/x=2/g": 9, "c/i": 4})
    assert {r.key: r.change for r in CH.difference(new, old).collect()} == {"a/x=1/f": "unchanged", "a/x=2/g": "changed", "b/h": "removed", "c/i": "new"}
    parts = lambda d: D.partition_summary(D.classified(d))
    stored, now = parts(old), parts(new)
    assert now.join(stored.select("root", "partition_path"), ["root", "partition_path"], "left_anti").where("root = 'a'").count() == 0
    emptied = CH.replace_partitions(stored, now.where("root <> 'a'"), stored, ["bucket", "root"])
    assert emptied.where("root = 'a'").count() == 0
    gone = spark.createDataFrame([("b", "a")], "bucket string, root string")
    assert CH.delete_datasets(gone, {"partitions": stored})["partitions"].where("root = 'a'").count() == 0


def test_schema_versions_and_fingerprints(spark):
    cols = spark.createDataFrame([("d", "b", "int", True), ("d", "a", "int", False)], "dataset string, name string, type string, nullable boolean")
    fp = CH.fingerprints(cols, ["dataset"])
    assert fp.first().fingerprint == CH.fingerprints(cols.orderBy("name"), ["dataset"]).first().fingerprint
    none = spark.createDataFrame([], "dataset string, version int, fingerprint string")
    first = CH.next_versions(fp, none)
    assert [(r.version, r.previous) for r in first.collect()] == [(1, None)]
    assert CH.next_versions(fp, first.select("dataset", "version", "fingerprint")).count() == 0


def test_listing_pages_and_sorts(spark):
    names = [f"n{i:02d}" for i in range(11)]
    d = spark.createDataFrame([(n,) for n in reversed(names)], "name string")
    for size in (1, 4, 11, 12):
        seen, cursor, more = [], "", True
        while more:
            rows, cursor, more = INV.page(d, cursor, size)
            seen += [r.name for r in rows.collect()]
        assert seen == names
    assert INV.page(d, "n10", 2)[0].count() == 0
    sizes = {"u": 7, "v": 7, "w": 1, "x": 90}
    kids = INV.children(objects(spark, {f"d/{k}": n for k, n in sizes.items()} | {"d/zz/q": 1, "d/aa/q": 1}), "d/")
    for down in (False, True):
        by_size = sorted(sorted(sizes), key=lambda k: sizes[k] * (-1 if down else 1))
        assert [r.name for r in INV.sort_listing(kids, "size", down).collect()] == ["aa", "zz", *by_size]
        assert [r.name for r in INV.sort_listing(kids, "name", down).collect()] == ["aa", "zz", *sorted(sizes, reverse=down)]
    s = INV.folder_summary(objects(spark, KEYS), "orders/").first()
    assert (s.files, s.bytes, s.formats) == (3, 60, "csv,parquet")
    every = {r.folder: r.files for r in INV.folder_summaries(objects(spark, KEYS)).collect()}
    assert every["orders/"] == 3 and every["orders/year=2023/"] == 2 and every[""] == 8
    b = spark.createDataFrame([("x", "eu-west-1"), ("y", None)], "name string, region string")
    assert {r.price_region for r in INV.price_regions(b, spark.createDataFrame([("eu-west-1",)], "region string")).collect()} == {"eu-west-1", "us-east-1"}


def test_listing_a_folder_with_markers(spark, tmp_path):
    keys = ["t/_delta_log/0.json", "t/p.parquet", "x.csv", "a/b/c/deep/_delta_log/0.json", "a/b/c/deep/p.parquet", f"again{tmp_path}/y.csv", "with blank/z.csv"]
    for k in keys:
        (tmp_path / k).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / k).write_text("a")
    assert {(r.key, r.size) for r in INV.list_folder(spark, f"file://{tmp_path}", "b").collect()} == {(k, 1) for k in keys}


def test_profile_goldens(spark):
    d = spark.createDataFrame([(1, "a@b.co", "x"), (2, "c@d.co", "y"), (3, "e@f.co", None), (4, "g@h.co", None)], "id int, email string, note string")
    got = {r.column: r for r in P.scalars(d, exact=True).collect()}
    assert (got["id"]["count"], got["id"].non_null, got["id"].distinct) == (4, 4, 4) and got["note"].non_null == 2 and got["email"].max_length == 6 and got["note"].null_pct == 0.5
    assert P.top_values(d).where("column = 'id'").count() == 0
    h = P.histograms(spark.range(10).selectExpr("CAST(id AS double) AS v", "1 AS c"), 5).collect()
    assert [(r.column, r.bin, r.n) for r in sorted(h, key=lambda r: r.bin)] == [("v", i, 2) for i in range(5)]
    assert P.histograms(spark.range(1)).count() == 0
    b = lambda df: {r.column: r.badges for r in P.badged(df, exact=True).collect()}
    many = spark.range(100).selectExpr("id", "1 AS one", "CASE WHEN id % 10 < 3 THEN id END AS few", "CASE WHEN id < 60 THEN CASE WHEN id < 58 THEN id ELSE 0 END END AS high", "uuid() AS u")
    assert b(many) == {"id": ["Candidate Key"], "one": ["Constant"], "few": ["Mostly Null", "High Cardinality"], "high": ["High Cardinality"], "u": ["Candidate Key", "UUID"]}
    assert b(d)["email"] == ["Email"]
    nested = spark.sql("SELECT array(1) AS a, map('k', 1) AS m, named_struct('x', 1) AS s, INTERVAL 1 DAY AS i, DATE '2020-01-01' AS d, true AS b, X'00' AS y")
    assert {c: k for c, k in P.kinds(nested).items()} == {"a": "other", "m": "other", "s": "other", "i": "temporal", "d": "temporal", "b": "bool", "y": "other"}
    assert P.scalars(nested).count() == 7
    wide = spark.range(1).select(*[F.lit("x").alias(f"c{i}") for i in range(41)])
    assert P.top_values(wide).count() == 0 and P.scalars(wide).count() == 41
    assert P.scalars(d.where("false")).where("count = 0").count() == 3
    e = {r.column: r for r in P.extended(spark.createDataFrame([(1, "a"), (1, "a"), (3, "b"), (5, "c")], "n int, s string")).collect()}
    assert e["s"].entropy == pytest.approx(1.5) and e["n"].duplicate_ratio == pytest.approx(0.25) and e["n"].variance == pytest.approx(2.75)


def test_exact_quantiles(spark):
    r = random.Random(3)
    values = {"a": [r.choice([0.0, 0.0, 0.0, 1.0, 7.5, None, -3.0]) for _ in range(200)], "b": [r.gauss(0, 1) for _ in range(200)], "c": [5.0] * 200, "d": [None] * 199 + [2.0]}
    d = spark.createDataFrame(list(zip(*values.values(), strict=True)), "a double, b double, c double, d double")
    at = [0.0, 0.1, 0.5, 0.75, 1.0]
    got = {x.column: x.q for x in P.exact_quantiles(d, list(values), at, 7).collect()}
    for c, v in values.items():
        v = sorted(x for x in v if x is not None)
        places = [q * (len(v) - 1) for q in at]
        assert got[c] == pytest.approx([v[int(p)] + (p - int(p)) * (v[min(int(p) + 1, len(v) - 1)] - v[int(p)]) for p in places])


def test_readers(spark, tmp_path):
    d = tmp_path / "feed" / "2023-10-11"
    d.mkdir(parents=True)
    with gzip.open(d / "part-0.csv.gz", "wt") as f:
        f.write("a,1\nb,2\n")
    got = R.read_files(spark, [f"file://{d}/part-0.csv.gz"], "csv", R.ReadOptions(header="none"))
    assert got.columns == ["col_1", "col_2", "filename"] and got.count() == 2
    (tmp_path / "x.csv").write_text("a,b\n1,2\n")
    (tmp_path / "y.csv").write_text("b,a\n3,4\n")
    got = R.read_files(spark, [f"{tmp_path}/x.csv", f"{tmp_path}/y.csv"], "csv", R.ReadOptions(filename=False))
    assert sorted((r.a, r.b) for r in got.collect()) == [(1, 2), (4, 3)]
    with_dirs = R.with_path_partitions(R.read_files(spark, [f"file://{d}/part-0.csv.gz"], "csv", R.ReadOptions(header="none")), f"file://{tmp_path}/feed", ["pt0"])
    assert {r.pt0 for r in with_dirs.collect()} == {"2023-10-11"}
    spark.range(3).selectExpr("id", "'01' AS month").write.partitionBy("month").parquet(f"{tmp_path}/p")
    assert {r.month for r in R.read_folder(spark, f"{tmp_path}/p", "parquet").collect()} == {"01"}
    names, types, rows, more = R.preview(spark.sql("SELECT explode(array(1, 2, NULL)) AS v, TIMESTAMP_NTZ '2020-01-01 10:00:00.5' AS t"), 2)
    assert (names, types, rows, more) == (["v", "t"], ["int", "timestamp_ntz"], [["1", "2020-01-01 10:00:00"], ["2", "2020-01-01 10:00:00"]], True)
    assert R.ReadOptions(delimiter="|", ignore_errors=True).applicable("parquet") == R.ReadOptions()


def test_catalog(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/t")
    c = C.Catalog(spark, f"file://{tmp_path}/catalog")
    c.register("events_1", f"{tmp_path}/t", "parquet")
    assert spark.table("events_1").count() == 5 and c.suggest("events_1") == "events_1_2" and c.suggest("free") == "free" and c.taken("EVENTS_1")
    for bad in ("2x", "events_1"):
        with pytest.raises(ValueError):
            c.register(bad, f"{tmp_path}/t", "parquet")
    with pytest.raises(Exception):
        c.register("broken", f"{tmp_path}/nothing", "parquet")
    assert [r.name for r in c.entries().collect()] == ["events_1"]
    spark.catalog.dropTempView("events_1")
    assert c.refresh() == ["events_1"] and spark.table("events_1").count() == 5
    spark.range(1).createOrReplaceTempView("elsewhere")
    assert "elsewhere" in {r.name for r in c.others().collect()} and "events_1" not in {r.name for r in c.others().collect()}
    c.drop("events_1")
    assert c.entries().count() == 0 and not spark.catalog.tableExists("events_1")
    s = spark.createDataFrame([("f", 1, "a int"), ("g", 2, "a long")], "file string, modified int, schema string")
    assert C.schema_by_strategy(s, "latest", "m") == "a long" and C.schema_by_strategy(s, "union", "m") == "m"
    with pytest.raises(ValueError):
        C.schema_by_strategy(s, "strict", "m")
    d = spark.createDataFrame([("b", "x/orders", "orders", "csv", 2), ("b", "x", "x", "csv", 1)], "bucket string, root string, name string, format string, updated_at int")
    assert C.find_by_location(d, "b", "/x/").first().root == "x" and C.find_by_location(d, "b", "order").first().root == "x/orders"
    assert [r.root for r in C.search_datasets(d, "ORD").collect()] == ["x/orders"]


@pytest.mark.parametrize("sql", ["SELECT 1", "  with x as (select 1) select * from x", "DESCRIBE v", "SUMMARIZE v", "summarize SELECT id FROM v", "SUMMARIZE (WITH q AS (SELECT 1 AS x) SELECT * FROM q)", "(SELECT 1)", "-- c\nSELECT ';'", "SHOW TABLES", "EXPLAIN SELECT 1", "VALUES (1)", "FROM v SELECT *", "SELECT 1;"])
def test_reading_statements(spark, sql):
    spark.range(3).createOrReplaceTempView("v")
    assert sqlapi.query(spark, sql)[0].collect()


@pytest.mark.parametrize("sql", ["CACHE TABLE v", "TRUNCATE TABLE v", "CREATE VIEW w AS SELECT 1", "MERGE INTO v USING w ON v.id = w.id WHEN MATCHED THEN DELETE", "WITH q AS (SELECT 1) INSERT INTO v SELECT * FROM q", "FROM v INSERT INTO u SELECT *", "", "SET a = 1", "REFRESH TABLE v", "SELECT java_method('java.lang.System', 'getProperty', 'user.home')", "SELECT `reflect` ('java.lang.Math', 'random')", "SELECT 'a' || reflect/* x */('b', 'c')", "SELECT IDENTIFIER('reflect')('java.lang.System','getProperty','user.name')", "SELECT IDENTIFIER('java_' || 'method')('java.lang.Math','random')", "SELECT r'\\', java_method('java.lang.Math','random'), ' '", "SELECT 1 WHERE EXISTS (SELECT try_reflect('java.lang.Math','random'))", "WITH q AS (SELECT reflect('java.lang.Math','random') AS x) SELECT * FROM q", "EXPLAIN SELECT reflect('java.lang.Math','random')", "VALUES (reflect('java.lang.Math','random'))", "SUMMARIZE SELECT reflect('java.lang.Math','random')", "SUMMARIZE INSERT INTO v SELECT 1", "SELECT transform(array(1), x -> reflect('java.lang.Math','random'))"])
def test_q14_writing_statements_are_refused(spark, sql):
    with pytest.raises(ValueError):
        sqlapi.check_read_only(spark, sql)


def test_q14_a_second_statement_is_refused_by_the_parser(spark):
    with pytest.raises(ParseException):
        sqlapi.check_read_only(spark, "SELECT 1; SELECT 2")
    spark.range(3).createOrReplaceTempView("v")
    for fine in ("SELECT 'reflect(' AS x, id AS reflect FROM v -- java_method(", "SELECT to_json(named_struct('a', 1)), url_decode('a'), parse_json('1'), from_json('{}', 'a int'), is_valid_utf8('a'), luhn_check('1'), upper('a'), uuid(), aes_encrypt('a', '0000111122223333')", "SELECT x FROM (SELECT max(id) AS x FROM v GROUP BY id % 2) JOIN v ON x = id"):
        sqlapi.check_read_only(spark, fine)


def test_functions_of_the_session_need_leave(spark):
    spark.udf.register("twice", lambda x: 2 * x, "int")
    with pytest.raises(ValueError):
        sqlapi.check_read_only(spark, "SELECT twice(1)")
    sqlapi.check_read_only(spark, "SELECT twice(1)", functions=True)


def test_the_profile_of_a_query_is_that_of_its_rows(spark):
    spark.range(10).createOrReplaceTempView("v")
    rows = sqlapi.query(spark, "-- odd ones\nSUMMARIZE SELECT id, CASE WHEN id > 4 THEN id END AS big FROM v WHERE id % 2 = 1;")[0].collect()
    assert sorted((r.column, r["count"], r.non_null) for r in rows) == [("big", 5, 3), ("id", 5, 5)]


def test_events_of_a_run_tell_its_start_and_the_schemas_columns(spark):
    inventory = objects(spark, {"a/x=1/p.csv": 1, "a/x=2/q.csv": 2, "c/x=1/r.csv": 3})
    o = D.classified(inventory)
    datasets, parts = D.roll_up(o), D.partition_summary(o)
    cols = spark.createDataFrame([("b/a", "k", "int", True), ("b/a", "l", "int", False)], "dataset string, name string, type string, nullable boolean")
    versions = CH.next_versions(CH.fingerprints(cols, ["dataset"]), spark.createDataFrame([("b/a", 2, "f")], "dataset string, version int, fingerprint string"))
    e = CH.change_events(datasets, datasets.where("root = 'a'"), versions, cols, parts, parts.where("root = 'a'"), datasets.agg(F.count("*").alias("datasets")), F.lit("t"), "hive")
    found = {(r.type, r.subject): json.loads(r.payload) for r in e.collect()}
    bucket = inventory.first().bucket
    assert found["CrawlStarted", bucket] == {"bucket": bucket, "mode": "hive"}
    assert found["SchemaChanged", "b/a"] == {"version": 3, "old_version": 2, "previous": "f", "columns": 2}
    assert found["DatasetDiscovered", f"{bucket}/c"]["file_count"] == 1 and found["CrawlCompleted", "crawl"] == {"datasets": 2}
    assert {k for k in found if k[0] == "NewPartition"} == {("NewPartition", f"{bucket}/c")}
    nothing = CH.change_events(datasets.limit(0), datasets, versions.limit(0), cols.limit(0), parts.limit(0), parts, datasets.agg(F.count("*").alias("datasets")), F.lit("t"))
    assert [r.type for r in nothing.collect()] == ["CrawlCompleted"]


def test_limits(spark):
    spark.range(10).createOrReplaceTempView("v")
    df, limit = sqlapi.query(spark, "SELECT * FROM v", 4)
    assert df.count() == 5 and limit == 4


def test_stream(spark, tmp_path):
    land, state, point = (f"{tmp_path}/{x}" for x in ("land", "state", "point"))
    seen = []
    run = lambda: incremental.stream_changes(spark, land, state, point, lambda d, n: seen.append(sorted((r.key, r.change) for r in d.collect()))).awaitTermination()
    objects(spark, {"a": 1, "b": 2}).write.mode("append").parquet(land)
    run()
    objects(spark, {"a": 1, "b": 5, "c": 3}).write.mode("append").parquet(land)
    run()
    run()
    assert seen == [[("a", "new"), ("b", "new")], [("b", "changed"), ("c", "new")]]
    assert {(r.key, r.size) for r in incremental.current_state(spark, state).collect()} == {("a", 1), ("b", 5), ("c", 3)}


@pytest.mark.parametrize("pipeline", [False, True])
def test_the_engine_does_without_the_training_data_part(tmp_path, pipeline):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    shutil.copytree(f"{root}/lakescan", tmp_path / "lakescan", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *["corpus_pipeline.py"] * (pipeline and os.path.exists(f"{root}/corpus_pipeline.py"))]:
        shutil.copy(f"{root}/{name}", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'profile_scalar_lineitem' in q and not any(k.startswith('op') for k in q) and 'pipeline' not in q; assert set(e.oracle_sql()) <= set(q)"
    assert subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=False).returncode == 0


def test_folders_of_text(spark, tmp_path):
    def put(key, text):
        (tmp_path / key).parent.mkdir(parents=True, exist_ok=True)
        with (gzip.open if key.endswith(".gz") else open)(tmp_path / key, "wt") as f:
            f.write(text)

    put("plain/2023/US/part-0.csv.gz", "1;x\n2;y\n")
    put("plain/2024/FR/part 1.csv", "3;z\n4;u\n")
    got = R.read_folder(spark, f"file://{tmp_path}/plain", "csv")
    assert sorted((r.col_1, r.col_2) for r in got.collect()) == [(1, "x"), (2, "y"), (3, "z"), (4, "u")] and got.columns == ["col_1", "col_2", "filename"]
    put("swapped/a.csv", "a,b\n1,2\n")
    put("swapped/b.csv", "b,a\n3,4\n")
    put("swapped/c.txt", "no")
    assert sorted((r.a, r.b) for r in R.read_folder(spark, f"{tmp_path}/swapped", "csv", options=R.ReadOptions(filename=False)).collect()) == [(1, 2), (4, 3)]
    put("hive/month=01/a.tsv", "n\tv\n1\ta|b\n")
    put("hive/month=02/b.tsv.gz", "n\tv\n2\tc\n")
    assert sorted((r.n, r.v, r.month) for r in R.read_folder(spark, f"{tmp_path}/hive", "tsv").collect()) == [(1, "a|b", "01"), (2, "c", "02")]
    put("json/a.json", '{"k": 1}\n{"k": 2}\n')
    put("json/b.json", '[{"k": 3},\n {"k": 4}]')
    put("json/c.json", '{\n "k": 5\n}')
    assert sorted(r.k for r in R.read_folder(spark, f"{tmp_path}/json", "json").collect()) == [1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        R.read_folder(spark, f"{tmp_path}/json", "csv")
    c = C.Catalog(spark, f"file://{tmp_path}/catalog")
    d = c.register("feed_1", f"file://{tmp_path}/plain", "csv", partition_columns=["year", "land"], options=R.ReadOptions(filename=False))
    assert sorted(tuple(r) for r in d.collect()) == [(1, "x", "2023", "US"), (2, "y", "2023", "US"), (3, "z", "2024", "FR"), (4, "u", "2024", "FR")]
    d = c.register("hive_1", f"file://{tmp_path}/hive", "tsv", partition_columns=["month"], options=R.ReadOptions(filename=False))
    assert sorted(r.month for r in d.collect()) == ["01", "02"]


def test_selections_and_strategies(spark, tmp_path):
    spark.range(2).selectExpr("CAST(id AS int) AS n", "'a' AS s").coalesce(1).write.parquet(f"{tmp_path}/x")
    spark.range(2, 4).selectExpr("id AS n", "'b' AS s").coalesce(1).write.parquet(f"{tmp_path}/y")
    spark.range(1).selectExpr("'no' AS n", "1 AS t").coalesce(1).write.parquet(f"{tmp_path}/z")
    files = [r.path for d in "xyz" for r in spark.read.format("binaryFile").load(f"{tmp_path}/{d}/*.parquet").select("path").collect()]
    c = C.Catalog(spark, f"file://{tmp_path}/catalog")
    d = c.register("picked", "", "parquet", paths=files)
    assert dict(d.dtypes)["n"] == "bigint" and sorted((r.n, r.s) for r in d.collect()) == [(0, "a"), (1, "a"), (2, "b"), (3, "b")]
    assert c.register("all_same", f"file://{tmp_path}/x", "parquet", strategy="strict").count() == 2
    with pytest.raises(ValueError):
        c.register("mixed", "", "parquet", paths=files[:2], strategy="strict")
    assert set(c.refresh()) == {"picked", "all_same"}


def test_inference_reaches_every_format(spark, tmp_path):
    texts = {"a b.tsv": "n\tv|w\n1\tx|y\n", "l.json": '{"k": 1}\n{"k": 2.5}\n', "o.json": '{"k": true}', "big.json": "[" + ",".join(['{"k": "v"}'] * 40_000) + "]"}
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    orc = spark.range(3).selectExpr("id", "'x' AS s").coalesce(1)
    orc.write.orc(f"{tmp_path}/o1")
    orc.limit(1).write.option("compression", "zlib").orc(f"{tmp_path}/o2")
    log = {"metaData": {"schemaString": json.dumps({"type": "struct", "fields": [{"name": "d", "type": "long", "nullable": True, "metadata": {}}]}), "partitionColumns": []}}
    (tmp_path / "tbl/_delta_log").mkdir(parents=True)
    (tmp_path / "tbl/_delta_log/00000000000000000000.json").write_text(json.dumps(log))
    orcs = sorted(str(x) for x in tmp_path.glob("o?/*.orc"))
    rows = [(f"file:{tmp_path}/{n}", n.rsplit(".", 1)[1]) for n in texts] + [(f"file:{x}", "orc") for x in orcs] + [(f"file:{tmp_path}/tbl/_delta_log/00000000000000000000.json", "delta")]
    got = {(r.file.rsplit("/", 1)[-1] if ".orc" not in r.file else "orc", r.name, r.type) for r in crawl.infer_schemas(spark, spark.createDataFrame(rows, "file string, format string")).collect()}
    assert got == {("a b.tsv", "n", "integer"), ("a b.tsv", "v|w", "string"), ("l.json", "k", "float"), ("o.json", "k", "boolean"), ("big.json", "k", "string"), ("orc", "id", "bigint"), ("orc", "s", "string"), ("00000000000000000000.json", "d", "long")}
    assert sorted((r.num_rows, r.codec) for r in files.orc_footers(spark.createDataFrame([(x,) for x in orcs], "file string")).where("pos = 0").collect()) == [(1, "zlib"), (3, "zstd")]


def test_registrations_at_once(spark, tmp_path):
    spark.range(2).write.parquet(f"{tmp_path}/d")
    c = C.Catalog(spark, f"file://{tmp_path}/catalog")
    with ThreadPoolExecutor(10) as pool:
        done = list(pool.map(lambda i: c.register(f"at_once_{i}", f"file://{tmp_path}/d", "parquet").count(), range(20)))
        again = list(pool.map(lambda i: _refused(lambda: c.register("same_name", f"file://{tmp_path}/d", "parquet")), range(5)))
    assert done == [2] * 20 and sorted(again) == [False] + [True] * 4
    assert {r.name for r in c.entries().collect()} == {"same_name", *(f"at_once_{i}" for i in range(20))}


def _refused(f):
    try:
        f()
    except ValueError:
        return True
    return False
