from __future__ import annotations

import gzip
import json
import random
import struct
import tracemalloc

import pytest

from lakescan.plans import crawl
from lakescan.sources import avro_header, files, json_values, readers


def found(data, size=5, most=1 << 20):
    at = 0

    def read(n):
        nonlocal at
        at += size
        return data[at - size : at]

    return list(json_values.values(read, most))


def texts(data, **how):
    return [json.loads(v) if v is not None else None for v, _ in found(data, **how)]


def value(r, depth=0):
    k = r.randrange(8 if depth < 3 else 5)
    if k < 5:
        return r.choice((None, True, -1.5e3, 12, "", 'a"b\\', "[{,", "é\n", "x" * 30))
    if k < 6:
        return [value(r, depth + 1) for _ in range(r.randrange(4))]
    return {f"k{i}": value(r, depth + 1) for i in range(r.randrange(4))}


@pytest.mark.parametrize("size", [1, 3, 1 << 20])
def test_arrays_lines_and_single_values(size):
    r = random.Random(size)
    for _ in range(150):
        table = [value(r) for _ in range(r.randrange(6))]
        for indent in (None, 1):
            assert texts(json.dumps(table, indent=indent, ensure_ascii=False).encode(), size=size) == table
        rows = [{"k": v} for v in table]
        assert texts("\n".join(map(json.dumps, rows)).encode(), size=size) == rows
        if rows:
            assert texts(b"\xef\xbb\xbf \n" + json.dumps(rows[0], indent=2).encode(), size=size) == rows[:1]


def test_broken_arrays_go_on_as_lines():
    assert [v for v, _ in found(b'[\n{"k": 1}\n{"k": 2}\n')] == [b'{"k": 1}', b'{"k": 2}']
    assert [v for v, _ in found(b'[1, 2')][:1] == [b"1"]
    assert found(b"") == found(b" \n") == found(b"[]") == found(b"[ ] ") == []
    assert [v for v, _ in found(b'{"a": 1\n{"b": 2}\n')] == [b'{"a": 1', b'{"b": 2}']


def test_long_values_are_passed_over():
    long = json.dumps({"s": 'x\\"' * 200, "t": [1, {"u": "}]"}]})
    for size in (3, 50, 1000):
        got = found(f'[{{"a": 1}}, {long}, {{"b": 2}}, [{long}], 3]'.encode(), size=size, most=100)
        assert [v for v, _ in got] == [b'{"a": 1}', None, b'{"b": 2}', None, b"3"]
        assert [bool(e) for _, e in got] == [False, True, False, True, False]
        got = found(f'{{"a": 1}}\n{long}\n{{"b": 2}}'.encode(), size=size, most=100)
        assert [v for v, _ in got] == [b'{"a": 1}', None, b'{"b": 2}']


def test_memory_does_not_grow_with_the_array():
    row, n = b'{"k": "' + b"v" * 500 + b'", "n": [1, 2, 3]}, ', 120_000

    class Long:
        left = n

        def read(self, size):
            k = min(self.left, max(size // len(row), 1))
            first = b"[" if self.left == n else b""
            self.left -= k
            return first + row * k if k else b""

    tracemalloc.start()
    assert sum(1 for _ in json_values.values(Long().read)) >= n
    assert tracemalloc.get_traced_memory()[1] < 20 << 20
    tracemalloc.stop()


def test_reading_arrays(spark, tmp_path):
    with gzip.open(tmp_path / "a.json.gz", "wt") as f:
        json.dump([{"k": i, "v": {"x": str(i)}} for i in range(3000)], f, indent=1)
    (tmp_path / "b.json").write_text('{\n "k": -1\n}')
    (tmp_path / "c.json").write_text('{"k": -2}\n{"k": -3}\n')
    d = readers.read_folder(spark, f"file://{tmp_path}", "json")
    assert sorted(r.k for r in d.collect()) == [-3, -2, -1, *range(3000)]
    assert {r.v.x for r in d.where("k >= 0").collect()} == {str(i) for i in range(3000)}
    assert {r.filename.rsplit("/", 1)[-1] for r in d.select("filename").distinct().collect()} == {"a.json.gz", "b.json", "c.json"}


def zigzag(n):
    n = (n << 1) ^ (n >> 63)
    out = b""
    while n > 0x7F:
        out += bytes([n & 0x7F | 0x80])
        n >>= 7
    return out + bytes([n])


def avro(schema, codec=b"null", sized=False, more=()):
    pairs = [(b"avro.schema", json.dumps(schema).encode()), (b"avro.codec", codec), *more]
    body = b"".join(zigzag(len(x)) + x for pair in pairs for x in pair)
    count = zigzag(-len(pairs)) + zigzag(len(body)) if sized else zigzag(len(pairs))
    return avro_header.MAGIC + count + body + zigzag(0) + bytes(16)


SCHEMA = {"type": "record", "name": "row", "namespace": "n", "fields": [
    {"name": "i", "type": "int"}, {"name": "l", "type": ["null", "long"]}, {"name": "d", "type": {"type": "int", "logicalType": "date"}},
    {"name": "t", "type": {"type": "long", "logicalType": "timestamp-micros"}}, {"name": "m", "type": {"type": "bytes", "logicalType": "decimal", "precision": 9, "scale": 2}},
    {"name": "e", "type": {"type": "enum", "name": "kind", "symbols": ["A"]}}, {"name": "e2", "type": ["kind", "null"]}, {"name": "a", "type": {"type": "array", "items": ["null", "string"]}},
    {"name": "s", "type": {"type": "record", "name": "inner", "fields": [{"name": "x", "type": {"type": "map", "values": "double"}}]}}, {"name": "u", "type": ["int", "long"]}, {"name": "w", "type": ["int", "string"]}]}
COLUMNS = [("i", "int", False), ("l", "bigint", True), ("d", "date", False), ("t", "timestamp", False), ("m", "decimal(9,2)", False), ("e", "string", False), ("e2", "string", True), ("a", "array<string>", False), ("s", "struct<x:map<string,double>>", False), ("u", "bigint", False), ("w", "struct<member0:int,member1:string>", False)]


def test_avro_headers(spark, tmp_path):
    (tmp_path / "a.avro").write_bytes(avro(SCHEMA, b"deflate"))
    (tmp_path / "b.avro").write_bytes(avro(SCHEMA, sized=True, more=[(b"long", bytes(200_000))]) + struct.pack("q", 1))
    (tmp_path / "c.avro").write_bytes(avro("string"))
    (tmp_path / "cut.avro").write_bytes(avro(SCHEMA)[:60])
    (tmp_path / "no.avro").write_bytes(b"PAR1")
    (tmp_path / "self.avro").write_bytes(avro({"type": "record", "name": "r", "fields": [{"name": "next", "type": ["null", "r"]}]}))
    names = [f"{n}.avro" for n in ("a", "b", "c", "cut", "no", "self", "gone")]
    d = files.avro_headers(spark.createDataFrame([(f"{tmp_path}/{n}",) for n in names], "file string"))
    rows = sorted(d.collect(), key=lambda r: (r.file, r.pos or 0))
    own = lambda n: [r for r in rows if r.file.endswith(f"/{n}.avro")]
    assert [(r.name, r.type, r.nullable) for r in own("a")] == [(r.name, r.type, r.nullable) for r in own("b")] == COLUMNS
    assert {r.codec for r in own("a")} == {"deflate"} and {r.codec for r in own("b")} == {"none"}
    assert [(r.name, r.type) for r in own("c")] == [("value", "string")]
    assert ["cut off" in own("cut")[0].error, "not an Avro" in own("no")[0].error, "holds itself" in own("self")[0].error, bool(own("gone")[0].error)] == [True] * 4


def test_one_bad_file_does_not_fail_the_others(spark, tmp_path):
    spark.range(3).coalesce(1).write.parquet(f"{tmp_path}/good")
    (good,) = [str(p) for p in (tmp_path / "good").glob("*.parquet")]
    bad = {"bad.parquet": b"PAR1 no PAR1", "bad.orc": b"x", "bad.avro": b"y", "bad.json": b"no", "empty.csv": b"", "bad.csv.gz": b"\x1f\x8b broken", "o.json": b'[{"k": 1}, {"k": "a"}]', "x.bin": b"1"}
    for n, data in bad.items():
        (tmp_path / n).write_bytes(data)
    rows = [(good, "parquet"), *((f"{tmp_path}/{n}", {"gz": "csv", "bin": "unknown"}.get(n.rsplit(".", 1)[1], n.rsplit(".", 1)[1])) for n in bad), (f"{tmp_path}/gone.parquet", "parquet")]
    got = crawl.infer_schemas(spark, spark.createDataFrame(rows, "file string, format string")).collect()
    assert {(r.name, r.type) for r in got if not r.error} == {("id", "bigint"), ("k", "string")}
    failed = {r.file.rsplit("/", 1)[-1]: r.error for r in got if r.error}
    assert set(failed) == {*bad, "gone.parquet"} - {"o.json"}
    assert all(r.name is None for r in got if r.error)
    assert failed["x.bin"] == "no reader for unknown" and failed["empty.csv"] == "no columns found" and "FileNotFoundError" in failed["gone.parquet"]


def test_samples_of_every_format_by_one_crawl(spark, tmp_path):
    d = spark.range(5).selectExpr("id", "if(id = 3, null, concat('s', id % 2)) AS s", "array(id) AS a").coalesce(1)
    d.write.parquet(f"{tmp_path}/p")
    d.write.orc(f"{tmp_path}/o")
    (tmp_path / "t.csv").write_text('id,s\n' + "".join(f'{i},"s{i % 2}\n"\n' if i != 3 else "3,\n" for i in range(5)))
    (tmp_path / "l.jsonl").write_text("".join(json.dumps({"id": i, "s": None if i == 3 else f"s{i % 2}", "a": [i]}) + "\n" for i in range(5)))
    (tmp_path / "j.json").write_text(json.dumps([{"id": i, "s": None if i == 3 else f"s{i % 2}", "a": [i]} for i in range(5)]))
    (tmp_path / "bad.parquet").write_text("no")
    names = [*(str(p) for k in "po" for p in (tmp_path / k).glob("part-*")), *(f"{tmp_path}/{n}" for n in ("t.csv", "l.jsonl", "j.json", "bad.parquet"))]
    got = crawl.samples(spark.createDataFrame([(n, n.rsplit(".", 1)[1]) for n in names], "file string, format string"))
    stats = {(r.file.rsplit(".", 1)[1], r.name): r for r in got.stats.collect()}
    for kind in ("parquet", "orc", "csv", "jsonl", "json"):
        r, n = stats[kind, "s"], stats[kind, "id"]
        assert (r["count"], r.null_count, r.distinct_count, n.null_count, n.distinct_count, n.min, n.max) == (5, 1, 2, 0, 5, "0", "4")
        assert [x.strip() for x in r.samples] == ["s0", "s1"]
    rows = [(r.file.rsplit(".", 1)[1], r.line_no, json.loads(r.row)) for r in got.rows.collect()]
    assert sorted(k for k, *_ in rows) == sorted(["parquet", "orc", "csv", "jsonl", "json"] * 5)
    assert {k: row["a"].replace(" ", "") for k, n, row in rows if row["id"] == "2" and k != "csv"} == {k: "[2]" for k in ("parquet", "orc", "jsonl", "json")}
