from __future__ import annotations

import pytest
from pyspark.sql import types as T

from lakescan.operators import compat


def t(s):
    return T._parse_datatype_string(s) if s != "null" else T.NullType()


@pytest.mark.parametrize(("a", "b", "want"), [
    ("int", "bigint", (True, False, "bigint")), ("tinyint", "int", (True, False, "int")), ("int", "double", (True, True, "double")), ("date", "timestamp_ntz", (True, True, "timestamp_ntz")), ("timestamp_ntz", "timestamp", (True, True, "timestamp")),
    ("int", "decimal(18,2)", (True, True, "decimal(18,2)")), ("null", "string", (True, False, "string")), ("double", "string", (False, None, None)), ("boolean", "tinyint", (False, None, None)), ("array<int>", "array<string>", (False, None, None)),
    ("array<int>", "array<bigint>", (True, False, "array<bigint>")), ("struct<a:int>", "struct<A:double>", (True, True, "struct<a:double>")), ("decimal(10,0)", "decimal(10,8)", (True, True, "decimal(18,8)")), ("map<string,int>", "map<string,bigint>", (True, False, "map<string,bigint>")),
])
def test_matrix_and_q12(a, b, want):
    ok, wide, merged = compat.compatible(t(a), t(b))
    assert ok == want[0] and (not ok or (wide, merged.simpleString()) == want[1:])


def test_bool_coercion():
    assert compat.compatible(t("boolean"), t("tinyint"), True)[:2] == (True, True)


def columns(spark, files):
    rows = [(i, fmt, pos, n, k) for i, (fmt, cols) in enumerate(files) for pos, (n, k) in enumerate(cols)]
    return spark.createDataFrame(rows, "file_idx long, format string, pos int, name string, type string")


def test_grouping(spark):
    v, merged = compat.group_files(columns(spark, [("parquet", [("id", "int"), ("name", "string")]), ("parquet", [("id", "bigint"), ("Name", "string")]), ("parquet", [("id", "string"), ("name", "string")]), ("parquet", [("id", "int")]), ("csv", [("d", "date")]), ("csv", [("d", "timestamp_ntz")])]))
    got = {r.file_idx: (r.verdict, r.reason) for r in v.collect()}
    assert got == {0: ("compatible", ""), 1: ("compatible", ""), 2: ("incompatible", "type:id"), 3: ("incompatible", "shape"), 4: ("compatible", ""), 5: ("widened", "widen:d")}
    assert merged["parquet"].simpleString() == "struct<id:bigint,name:string>"
    s = {r.format: (r.members, r.rejected, r.is_primary, r.mixed_format) for r in compat.summarize(v).collect()}
    assert s == {"parquet": (2, 2, True, True), "csv": (2, 0, False, True)}
    assert {r.format for r in compat.read_as(columns(spark, [("a", [("x", "int")])]), "csv").collect()} == {"csv"}


def test_rows_of_footers(spark):
    f = lambda rows: compat.total_rows(spark.createDataFrame(rows, "format string, num_rows long")).first().rows
    assert f([("parquet", 100), ("parquet", 100)]) == 200 and f([("parquet", 100), ("csv", None)]) == -1


@pytest.mark.parametrize(("keys", "want"), [(["data/orders/a.parquet", "data/orders/b.parquet"], "orders"), (["a.parquet", "b.parquet"], "a"), (["2023-01/x.parquet", "2023-01/y.parquet"], "t_2023_01"), (["abc/x.csv", "abd/y.csv"], "x")])
def test_q17_names_are_cut_at_a_slash(spark, keys, want):
    assert compat.common_table_name(spark.createDataFrame([(k,) for k in keys], "key string"), "parquet").first().name == want


def test_read_members(spark, tmp_path):
    a, b, c = (f"{tmp_path}/{x}" for x in "abc")
    spark.range(2).selectExpr("CAST(id AS int) AS id", "CAST(1.5 AS float) AS x").write.parquet(a)
    spark.range(2).selectExpr("id", "CAST(2.5 AS double) AS x").write.parquet(b)
    merged = t("struct<id:bigint,x:double>")
    groups = [(t("struct<id:int,x:float>"), [a]), (t("struct<id:bigint,x:double>"), [b])]
    assert sorted(tuple(r) for r in compat.read_members(spark, groups, merged).collect()) == [(0, 1.5), (0, 2.5), (1, 1.5), (1, 2.5)]
    spark.range(2).selectExpr("id", "'t' AS x").write.parquet(c)
    strings = t("struct<id:string,x:string>")
    assert {tuple(r) for r in compat.read_members(spark, [(t("struct<id:bigint,x:string>"), [c]), (t("struct<id:int,x:float>"), [a])], strings).collect()} == {("0", "t"), ("1", "t"), ("0", "1.5"), ("1", "1.5")}
