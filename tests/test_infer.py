from __future__ import annotations

import gzip
import json

import pytest
from pyspark.sql import functions as F

from lakescan.functions import cells
from lakescan.operators import infer

CELLS = {
    "": "null", "NULL": "null", "\\N": "null", " na ": "null", "t": "boolean", "YES": "boolean", "1": "integer", "-5": "integer", "9223372036854775808": "float", "1.5": "float", "1e9": "float", "1.1234567": "decimal", "nan": "float", "-Infinity": "float",
    "2024-02-30": "string", "2024-01-02": "date", "01/02/2024": "date", "13-01-2024": "date", "2024-01-01T00:00:00Z": "timestamp", "2024-01-01 00:00:00.5": "timestamp", "2024/01/01 10:00:00": "timestamp", "10:00:00": "time", '{"a":1}': "json", "[1]": "json",
    "550e8400-e29b-41d4-a716-446655440000": "uuid", "hello": "string", "2024-01-01T25:00:00": "string",
}


def test_cell_types(spark):
    d = spark.createDataFrame(list(CELLS.items()), "v string, want string")
    bad = d.withColumn("got", cells.cell_type(F.col("v"))).where("got <> want").collect()
    assert bad == []


@pytest.mark.parametrize(("kinds", "want"), [(["integer", "decimal"], "decimal"), (["integer", "float", "decimal"], "float"), (["date", "timestamp"], "timestamp"), (["null"], "null"), (["null", "date"], "date"), (["boolean", "integer"], "string"), (["date", "time"], "string")])
def test_merged_types(spark, kinds, want):
    d = spark.createDataFrame([(k,) for k in kinds], "k string").agg(F.bit_or(cells.type_bit(F.col("k"))).alias("b"))
    assert d.select(cells.merged_type(F.col("b"))).first()[0] == want


def lines(spark, files):
    return spark.createDataFrame([(f, i + 1, x) for f, text in files.items() for i, x in enumerate(text.split("\n"))], "file string, line_no long, line string")


def test_q1_delimiters_are_sniffed(spark):
    files = {"pipe": "a|x,y|1\nb|z,w|2", "comma": "id,name,age\n1,a,3", "tab": "a\tb\n1\t2", "semi": "a;b\n1;2", "stray": "a,b\n1,x|y\n2,z", "one": "a|b"}
    got = {r.file: r.delimiter for r in infer.sniff_delimiters(lines(spark, files)).collect()}
    assert got == {"pipe": "|", "comma": ",", "tab": "\t", "semi": ";", "stray": ",", "one": ","}


def test_text_schema(spark):
    files = {"h": 'id,name,,name\n1,"a, ""b""",x,1.5\n2,c,y,\n3,d', "n": "1,a\n2,b", "only": "id,name"}
    got: dict = {}
    for r in infer.infer_text(lines(spark, files)).orderBy("file", "pos").collect():
        got.setdefault(r.file, []).append((r.name, r.type, r.nullable))
    assert got["h"] == [("id", "integer", False), ("name", "string", False), ("col_3", "string", True), ("name_2", "float", True)]
    assert got["n"] == [("col_1", "integer", False), ("col_2", "string", False)]
    assert got["only"] == [("id", "string", True), ("name", "string", True)]


def test_q9_missing_json_key_is_nullable(spark):
    files = {"j": '{"a": 1, "b": "2024-01-01"}\nbad line\n{"a": 2.5, "b": null}\n{"a": 3, "b": "x", "c": {"d": 1}}\n{"a": 1, "b": "y", "e": [1]}'}
    got = {r.name: (r.type, r.nullable) for r in infer.infer_json(lines(spark, files)).collect()}
    assert got == {"a": ("float", False), "b": ("string", True), "c": ("struct", True), "e": ("array", True)}


def test_json_arrays_become_lines(spark):
    d = spark.createDataFrame([("f", json.dumps([{"a": 1}, {"a": True}]))], "file string, content string")
    assert [r.type for r in infer.infer_json(infer.json_lines(d)).collect()] == ["string"]


def test_q18_estimates(spark):
    d = spark.createDataFrame([(100, 10, 1000, False), (100, 10, 50, False), (100, 10, 1000, True)], "b long, r long, s long, c boolean")
    got = [r[0] for r in d.select(infer.estimated_rows(F.col("b"), F.col("r"), F.col("s"), F.col("c"))).collect()]
    assert got == [100, 10, None]


def test_sample_stats_and_rows(spark):
    d = spark.createDataFrame([("f", i, 0, v) for i, v in enumerate(["b", "a", "", "b", "c"])], "file string, line_no long, pos int, value string")
    r = infer.sample_stats(d, ["file", "pos"]).first()
    assert (r["count"], r.null_count, r.distinct_count, r["min"], r["max"], r.samples) == (5, 1, 3, "a", "c", ["b", "a", "c"]) and abs(r.completeness - 0.8) < 1e-9 and abs(r.uniqueness - 0.75) < 1e-9
    names = spark.createDataFrame([("f", 0, "x")], "file string, pos int, name string")
    assert [json.loads(r.row) for r in infer.sample_rows(d, names, ["file"], 2).orderBy("line_no").collect()] == [{"x": "b"}, {"x": "a"}]


def test_heads_footers_and_the_whole_dispatch(spark, tmp_path):
    from lakescan.plans.crawl import infer_schemas
    from lakescan.sources.files import footers, heads, orc_footers

    (tmp_path / "a.csv").write_text("id,name\n1,x\n2,y\n")
    with gzip.open(tmp_path / "b.csv.gz", "wt") as f:
        f.write("id;v\n1;2.5\n")
    (tmp_path / "c.jsonl").write_text('{"k": 1}\n{"k": "t"}\n')
    (tmp_path / "d.json").write_text('[\n{"z": true},\n{"z": false}\n]')
    spark.range(3).selectExpr("id", "CAST(id AS decimal(10,2)) AS d", "TIMESTAMP_NTZ '2020-01-01 00:00:00' AS t").coalesce(1).write.parquet(f"{tmp_path}/p")
    spark.range(4).coalesce(1).write.orc(f"{tmp_path}/o")
    (pq,) = (tmp_path / "p").glob("*.parquet")
    (orc,) = (tmp_path / "o").glob("*.orc")
    reps = spark.createDataFrame([(str(tmp_path / n), k) for n, k in (("a.csv", "csv"), ("b.csv.gz", "csv"), ("c.jsonl", "jsonl"), ("d.json", "json"))] + [(str(pq), "parquet")], "file string, format string")
    got: dict = {}
    for r in infer_schemas(spark, reps).orderBy("file", "pos").collect():
        got.setdefault(r.file.rsplit("/", 1)[-1], []).append((r.name, r.type))
    assert got["a.csv"] == [("id", "integer"), ("name", "string")] and got["b.csv.gz"] == [("id", "integer"), ("v", "float")] and got["c.jsonl"] == [("k", "string")] and got["d.json"] == [("z", "boolean")]
    assert got[pq.name] == [("id", "bigint"), ("d", "decimal(10,2)"), ("t", "timestamp_ntz")]
    assert {r.num_rows for r in footers(reps.where("format = 'parquet'")).collect()} == {3}
    assert {(r.name, r.type, r.num_rows) for r in orc_footers(spark.createDataFrame([(str(orc),)], "file string")).collect()} == {("id", "bigint", 4)}
    assert heads(reps.where("format = 'csv'"), 9).where("file LIKE '%a.csv'").count() == 1  # a cut line is not a line


def test_table_formats(spark, tmp_path):
    from lakescan.sources.table_formats import delta_tables, iceberg_tables

    log = tmp_path / "sales" / "_delta_log"
    log.mkdir(parents=True)
    schema = {"type": "struct", "fields": [{"name": "sale_id", "type": "long", "nullable": False, "metadata": {}}, {"name": "region", "type": "string", "nullable": True, "metadata": {}}, {"name": "tags", "type": {"type": "array", "elementType": "string"}, "nullable": True}]}
    (log / "00000000000000000000.json").write_text(json.dumps({"metaData": {"schemaString": json.dumps({"type": "struct", "fields": []}), "partitionColumns": []}}) + "\n")
    (log / "00000000000000000001.json").write_text(json.dumps({"commitInfo": {}}) + "\n" + json.dumps({"metaData": {"schemaString": json.dumps(schema), "partitionColumns": ["region"]}}) + "\n")
    got = [(r.name, r.nullable, r.is_partition) for r in delta_tables(spark, f"{tmp_path}/*/_delta_log/*.json").orderBy("pos").collect()]
    assert got == [("sale_id", False, False), ("region", True, True), ("tags", True, False)]
    meta = tmp_path / "ice" / "metadata"
    meta.mkdir(parents=True)
    fields = [{"id": 1, "name": "a", "required": True, "type": "long"}, {"id": 2, "name": "b", "required": False, "type": "string"}]
    (meta / "v1.metadata.json").write_text(json.dumps({"schema": {"fields": fields[:1]}}))
    (meta / "v2.metadata.json").write_text(json.dumps({"current-schema-id": 1, "schemas": [{"schema-id": 0, "fields": fields[:1]}, {"schema-id": 1, "fields": fields}], "partition-specs": [{"fields": [{"name": "b"}]}, {"fields": [{"name": "b"}]}], "snapshots": [{"snapshot-id": 1, "timestamp-ms": 5, "summary": {"total-records": "7"}}, {"snapshot-id": 2, "timestamp-ms": 9, "summary": {"total-records": "12"}}]}))
    got = [(r.name, r.type, r.nullable, r.is_partition, r.num_rows) for r in iceberg_tables(spark, f"{tmp_path}/*/metadata/*.metadata.json").orderBy("pos").collect()]
    assert got == [("a", "long", False, False, 12), ("b", "string", True, True, 12)]


def test_cells_between_any_white_space(spark):
    marks = ["\t", "\r", " ", "\u00a0", "\u2003", "\u3000", "\x0b"]
    kinds = {"12": "integer", "1.5": "float", "NULL": "null", "": "null", "true": "boolean", "2024-02-03": "date", "a b": "string"}
    rows = [(f"{m}{c}{m * 2}", kind) for m in marks for c, kind in kinds.items()]
    d = spark.createDataFrame(rows, "cell string, want string").withColumn("got", cells.cell_type(F.col("cell")))
    assert d.where("got <> want").collect() == []
    assert d.where(cells.is_null_text(F.col("cell")) != (F.col("want") == "null")).collect() == []
