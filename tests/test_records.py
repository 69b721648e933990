from __future__ import annotations

import csv
import gzip
import io
import random

import pytest

from lakescan.plans import crawl
from lakescan.sources import readers, records


def sequential(data, seps):
    """Records and the last state, a byte at a time."""
    state, out, begin = records.START, [], 0
    for i, c in enumerate(data):
        if state == records.ENDED:
            state = records.QUOTED if c == records.QUOTE else records.PLAIN
            if state == records.QUOTED:
                continue
        if state == records.QUOTED:
            state = records.ENDED if c == records.QUOTE else state
        elif c == records.LINE_END:
            out.append((begin, i))
            begin, state = i + 1, records.START
        elif c in seps:
            state = records.START
        else:
            state = records.QUOTED if c == records.QUOTE and state == records.START else records.PLAIN
    return state, out, begin


def test_the_automaton_and_its_maps():
    r = random.Random(1)
    for _ in range(3000):
        data = bytes(r.choice(b'""\n\n,,;ab') for _ in range(r.randrange(40)))
        last, spans, rest = sequential(data, b",")
        assert records.advance(data, records.START, b",")[0] == last
        assert records.cut(data, 0, b",") == (spans, rest)
        size, state = r.randrange(1, 7), records.START
        for at in range(0, len(data), size):
            state = records.range_map(data[at : at + size], b",")[state][0]
        assert state == last


def text(seed, rows, sep=",", end="\n"):
    r = random.Random(seed)
    cell = lambda: r.choice(("", "x", "a b", "é", 'say "hi"', f"one{end}two", f"{sep}{end}{end}", '"', "5' 3\""))
    table = [[str(i), cell(), cell()] for i in range(rows)]
    out = io.StringIO(newline="")
    csv.writer(out, delimiter=sep, lineterminator=end).writerows(table)
    return table, out.getvalue()


@pytest.mark.parametrize(("size", "sep", "end", "packed"), [(1, ",", "\n", False), (7, ";", "\n", False), (64, ",", "\r\n", False), (1 << 20, ",", "\n", False), (50, ",", "\n", True)])
def test_ranges_equal_a_sequential_parser(spark, tmp_path, size, sep, end, packed):
    want = {}
    for k in range(4):
        table, body = text(k, 40 * k, sep, end)
        if k == 3:
            body = body.removesuffix(end)
        name = f"{tmp_path}/f{k}.csv" + ".gz" * packed
        with (gzip.open if packed else open)(name, "wb") as f:
            f.write((b"\xef\xbb\xbf" if k == 2 else b"") + body.encode())
        want[name] = table
    found = records.ranges(spark.createDataFrame([(n, sep) for n in want], "file string, sep string"), size)
    got: dict = {n: [] for n in want}
    for r in records.records(found).orderBy("file", "at").collect():
        got[r.file] += csv.reader(io.StringIO(r.record, newline=""), delimiter=sep)
        assert r.first == (len(got[r.file]) == 1)
    assert got == want
    assert {r.file for r in records.quoted_line_ends(found).collect()} == {n for n, t in want.items() if t}


def test_a_quote_that_is_never_closed_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,"open\n' + "x\n" * 5000)
    found = records.ranges(spark.createDataFrame([(f"{tmp_path}/a.csv", ",")], "file string, sep string"), 100)
    with pytest.raises(Exception, match="a quote may not be closed"):
        records.records(found, 1000).collect()


def test_files_with_quoted_line_ends_are_read_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n1,"a\nb"\n2,"c"\n3,\n')
    (tmp_path / "b.csv").write_text("id,note\n7,plain\n")
    d = readers.read_folder(spark, f"file://{tmp_path}", "csv")
    assert sorted((r.id, r.note) for r in d.collect()) == [(1, "a\nb"), (2, "c"), (3, None), (7, "plain")]
    assert dict(d.dtypes)["id"] == "int" and {r.filename.rsplit("/", 1)[-1] for r in d.collect()} == {"a.csv", "b.csv"}
    names = readers.read_files(spark, [f"{tmp_path}/a.csv"], "csv", readers.ReadOptions(filename=False, header="none"))
    assert names.columns == ["col_1", "col_2"] and names.count() == 4


def test_partition_folders_and_bad_rows(spark, tmp_path):
    (tmp_path / "day=1 x").mkdir()
    (tmp_path / "day=1 x/a.csv").write_text('id,note\n1,"a\nb"\n2,x,y,z\n')
    d = readers.read_folder(spark, f"file://{tmp_path}", "csv", options=readers.ReadOptions(filename=False, ignore_errors=True, header="present"))
    assert [tuple(r) for r in d.collect()] == [(1, "a\nb", "1 x")]


def test_columns_whose_types_differ(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n007,2\n1,3\n")
    (tmp_path / "b.csv").write_text("b,a\nx,2.5\ny,3\n")
    (tmp_path / "c.csv").write_text('c,a\n"1\n2",4\n')
    d = readers.read_folder(spark, f"file://{tmp_path}", "csv", options=readers.ReadOptions(filename=False))
    assert dict(d.dtypes) == {"a": "double", "b": "string", "c": "string"}
    assert sorted(tuple(r) for r in d.select("a", "b").collect() if r.b) == [(1.0, "3"), (2.5, "x"), (3.0, "y"), (7.0, "2")]
    (tmp_path / "d.csv").write_text("a,b\nz,1\n")
    d = readers.read_folder(spark, f"file://{tmp_path}", "csv", options=readers.ReadOptions(filename=False))
    assert dict(d.dtypes)["a"] == "string" and "007" in {r.a for r in d.collect()}


def test_inferred_types_see_records(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note,n\n1,"a\nb",5\n2,"c",6\n')
    d = crawl.infer_schemas(spark, spark.createDataFrame([(f"{tmp_path}/a.csv", "csv")], "file string, format string"))
    assert {(r.name, r.type) for r in d.collect()} == {("id", "integer"), ("note", "string"), ("n", "integer")}
