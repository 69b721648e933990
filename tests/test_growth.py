"""Steps that must not grow with one root, one file or one task."""

from __future__ import annotations

import glob

from pyspark.sql import functions as F

from lakescan import registry_lake as L
from lakescan.functions import cells
from lakescan.operators import datasets as D
from lakescan.operators import infer
from lakescan.streaming import crawl as S

from .test_stream_crawl import landed

SF = "/root/testdata/sf0.01"


def plan(d):
    return d._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


def test_a_listing_lands_by_many_tasks_in_one_batch_and_keys_are_not_exploded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "_scratch", lambda spark, name: f"file://{tmp_path}/{name}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        changes = L._crawled(spark, "/root/testdata/sf0.01")[1]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert len(changes) == 2 and changes[1].where("change = 'removed'").count() > 0
    assert len(glob.glob(f"{tmp_path}/stream/landing/part-*")) > 2
    scoped = S.object_changes(S.load(spark, f"file://{tmp_path}/stream/state").tables["objects"], landed(spark, [("s/a.csv", 1, None, "s"), ("t/u/b.csv", 1, None, "t/u")]))
    assert "Generate" not in plan(scoped)


def test_a_representative_that_comes_again_is_not_searched_for(spark, tmp_path, monkeypatch):
    root = f"file://{tmp_path}/state"
    S.apply_batch(spark, root, landed(spark, [("s/d=1/a.csv", 5), ("s/d=1/b.csv", 3)]), 0)
    monkeypatch.setattr(D, "representatives", lambda objects: 1 / 0)  # the search reads a dataset's objects
    S.apply_batch(spark, root, landed(spark, [("s/d=1/a.csv", 5)]).withColumn("etag", F.lit("other")), 1)
    assert [(r.key, r.size) for r in S.load(spark, root).rows("representatives").collect()] == [("s/d=1/a.csv", 5)]


def test_a_root_of_many_objects_meets_in_no_task(spark, monkeypatch):
    keys = [(f"{t}/d={i % 3}/{i}.parquet",) for t in ("lake/t", "plain") for i in range(400)] + [("lake/small/d=1/x.parquet",), ("lake/t/_delta_log/0.json",), ("lake/small/_delta_log/0.json",)]
    inventory = spark.createDataFrame(keys, "key string").selectExpr("'b' AS bucket", "key", "1L AS size")
    monkeypatch.setattr(D, "ROOT_OBJECTS", 50)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        rows = D.fold_tables(D.classified(inventory), D.table_roots(inventory)).select("root", "table_format", F.spark_partition_id().alias("task")).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted({(r.root, r.table_format) for r in rows}, key=str) == [("lake/small", "delta"), ("lake/t", "delta"), ("plain", None)] and len(rows) == 801
    assert max(sum(r.task == t for r in rows) for t in range(4)) < 350


def test_samples_are_of_files_that_tasks_share(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(L, "_scratch", lambda spark, name: f"file://{tmp_path}/{name}")
    monkeypatch.setattr(L, "FILE_ROWS", 5000)
    rows = L.crawl_samples(spark, SF).collect()
    assert len(rows) == 8 and {(r["count"], r.distinct_count) for r in rows if r.name == "k"} == {(1000, 1000)}
    assert all(len(glob.glob(f"{tmp_path}/samples/{f}/part-*")) == 3 for f in ("csv", "json", "orc", "parquet"))


def test_headers_do_not_sort_cells_by_windows(spark):
    lines = spark.createDataFrame([("a", 3, "id,n"), ("a", 7, "1,2"), ("b", 1, "x,y"), ("b", 2, "z,w,v"), ("c", 5, "k")], "file string, line_no long, line string")
    cells = infer.split_cells(lines, lines.select("file").distinct().withColumn("delimiter", F.lit(",")))
    headers = infer.detect_headers(cells)
    assert {r.file: r.has_header for r in headers.collect()} == {"a": True, "b": False, "c": True}
    names = infer.header_names(cells, headers)
    assert sorted(map(tuple, names.collect())) == [("a", 0, "id"), ("a", 1, "n"), ("b", 0, "col_1"), ("b", 1, "col_2"), ("b", 2, "col_3"), ("c", 0, "k")]
    assert plan(headers).count("Window [") == 0 and plan(names).count("Window [") == 1


def test_text_schema_shuffles_lines_alone(spark):
    lines = spark.createDataFrame([("a", 1, "id|n"), ("a", 2, "1|x"), ("a", 3, "2|")], "file string, line_no long, line string")
    d = infer.infer_text(lines)
    assert sorted((r.pos, r.name, r.type, r.nullable) for r in d.collect()) == [(0, "id", "integer", False), (1, "n", "string", True)]
    assert plan(d).count("Exchange hashpartitioning") <= 2


def test_delimiters_come_with_the_sort_of_lines_and_join_nothing(spark):
    blank = [("b", i, " ") for i in range(1, 61)] + [("b", i, "x;z") for i in range(61, 64)]  # blank lines are none of the 40
    late = [("l", i, "p|q" if i <= 40 else "p q") for i in range(1, 400)]  # later lines do not count
    lines = spark.createDataFrame([*blank, *late, ("e", 1, "")], "file string, line_no long, line string").repartition(3)
    sniffed, d = infer.sniff_delimiters(lines), infer.infer_text(lines)
    assert {r.file: r.delimiter for r in sniffed.collect()} == {"b": ";", "l": "|", "e": ","}
    assert sorted((r.file, r.pos, r.type, r.nullable) for r in d.collect()) == [("b", 0, "string", True), ("b", 1, "string", True), ("l", 0, "string", False), ("l", 1, "string", True)]
    for p in (plan(sniffed), plan(d)):
        assert p.count("Join") == 0 and p.count("Exchange hashpartitioning") == 1 and p.count("FileScan") + p.count("Scan ExistingRDD") == 1


def test_a_kind_and_its_bit_agree_on_texts_between_the_tests(spark):
    texts = {
        "1.": "float", ".5": "float", "-": "string", "1e5": "float", "1.12345678e2": "float", "+1.1234567": "decimal", "INF": "float", "+Infinity": "float", "-nan": "float", "infinit": "string", "99999999999999999999": "float", "-9223372036854775808": "integer",
        "12:30:61": "string", "23:59:59,5": "time", "10-12-2020": "date", "2020-12-10 10:00:00,25": "timestamp", "20-12-10": "string", "2020/12/10": "date", "12/10/2020 01:02:03": "timestamp", "13/10/2020": "string", "550e8400-e29b-41d4-a716-44665544000g": "string", "550E8400-E29B-41D4-A716-446655440000": "uuid",
        "1-URGENT": "string", "{a}": "json", "[": "string", "\u2003 5 \u00a0": "integer", " \u3000": "null", "N/A": "null", "Yes": "boolean", "1 2": "string", "2024-01-02T03:04:05+01:00": "timestamp", "2024-01-02T03:04:05+0100": "string", "٣": "string",
    }
    d = spark.createDataFrame(list(texts.items()), "v string, want string").select("v", "want", cells.cell_type(F.col("v")).alias("kind"), cells.cell_bit(F.col("v")).alias("bit"))
    assert [(r.v, r.kind, r.bit) for r in d.collect() if r.kind != r.want or r.bit != cells.BITS.get(r.want, 0)] == []
