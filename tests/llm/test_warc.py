from __future__ import annotations

import base64
import gzip
import hashlib

from lakescan.llm import warc


def brute(rows):
    order = lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or "")
    whole = {}
    for row in sorted(rows, key=order):
        whole.setdefault((row[2] or "").encode(), row)
    out = []
    for row in rows:
        data = (row[2] or "").encode()
        first = whole[data]
        revisits = first[:2] != row[:2] and first[0] is not None
        out.append((row[0], len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisits else "response", first[0] if revisits else None))
    return sorted(out, key=str)


def found(spark, rows):
    return sorted((tuple(r) for r in warc.query(frame(spark, rows)).collect()), key=str)


ROWS = [(5, "http://b.example.com/x?q=1", "<p>é</p>"), (2, "https://a.example.com/", "<p>é</p>"), (3, None, None), (4, "http://a.example.com:80/#f", ""), (9, "http://c.org/y", "x" * 300_000), (7, "http://a.example.com/", "<p>é</p>"), (8, "bad\r\nurl", "\r\n\r\n")]


def frame(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_round_trip_equals_brute_force(spark):
    assert found(spark, ROWS) == brute(ROWS)


def test_many_blocks_and_shards(spark):
    rows = [(i, f"http://h{i % 7}.org/{i % 50}", f"body {i % 90}") for i in range(3000)]
    assert found(spark, rows) == brute(rows)


def test_empty_table_and_extra_columns(spark):
    assert warc.query(frame(spark, [])).count() == 0
    d = frame(spark, ROWS).selectExpr("*", "1 AS digest", "2 AS payload")
    assert sorted((tuple(r) for r in warc.query(d).collect()), key=str) == brute(ROWS)


def test_every_row_is_a_capture(spark):
    same_id = [(1, "http://a/", "x"), (1, "http://a/", "y"), (1, "http://b/", "x"), (2, "http://c/", "x"), (2, "http://c/", None)]
    repeated = [(1, "http://a/", "t"), (1, "http://a/", "t"), (3, "http://a/", "t"), (3, "http://a/", "t")]
    no_id = [(None, "http://a/", "t"), (None, None, "t"), (4, None, "t"), (None, None, "u"), (None, None, "u")]
    for rows in (same_id, repeated, no_id, [*same_id, *repeated, *no_id]):
        assert found(spark, rows) == brute(rows)


def test_many_captures_of_one_page(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 4)
    rows = [(1, "http://a/", f"v{i % 30}") for i in range(60)] + [(2, "http://a/", "v1"), (0, "http://a/", "v2")]
    assert found(spark, rows) == brute(rows)
    archive = warc.write(warc.captures(frame(spark, rows)), warc.shared_dir(spark) + "/warc-many")
    wanted = spark.createDataFrame([("http://a/", 1)], "url string, page_id long")
    assert warc.lookup(spark, archive, wanted).count() == 60


def test_a_lookup_that_hits_nothing_is_left_out(spark, tmp_path):
    archive = warc.write(warc.captures(frame(spark, ROWS)), f"file://{tmp_path}/w")
    wanted = spark.createDataFrame([("http://c.org/y", 9), ("http://c.org/z", 9), ("http://zz/", 1)], "url string, page_id long")
    got = warc.lookup(spark, archive, wanted).collect()
    assert [(r.page_id, bytes(r.payload)) for r in got] == [(9, b"x" * 300_000)]


def test_archives_are_gzip_members_of_warc_records(spark, tmp_path):
    archive = warc.write(warc.captures(frame(spark, ROWS)), f"file://{tmp_path}/w", shards=1)
    names = {r.archive for r in spark.read.parquet(f"{archive.folder}/lines").collect()}
    data = b"".join(gzip.open(name).read() for name in names)
    assert data.count(b"WARC/1.1\r\n") == 7 and data.count(b"WARC-Type: revisit") == 3


def test_url_key(spark):
    d = spark.createDataFrame([("HTTPS://www.Example.com:443/A?b#c",), (None,), ("ftp://u@x.y/",)], "u string")
    assert [r[0] for r in d.select(warc.url_key(d.u)).collect()] == ["com,example,www)/a?b", "", "y,x)/"]
