from __future__ import annotations

import random

from pyspark.sql import functions as F

from lakescan.operators import profile as P
from lakescan.operators.sketches import SketchTable, merged, partition_sketches

SCHEMA = "day string, n long, x double, s string, t timestamp_ntz, a array<int>"


def data(spark, days, seed=1, rows=3000):
    r = random.Random(seed)
    out = []
    for d in days:
        for i in range(rows):
            out.append((d, r.randrange(2000), None if i % 10 == 0 else float("nan") if i % 501 == 0 else 1e9 + r.gauss(0, 5), None if i % 7 == 0 else f"s{r.randrange(300)}", None, [i % 3]))
    return spark.createDataFrame(out, SCHEMA)


def close(a, b, share):
    return abs(a - b) <= share * max(abs(b), 1)


def compare(spark, got, d):
    """Everything exact but distinct values and quantiles, and those within their bounds."""
    want = {r.column: r for r in P.scalars(d, exact=True).collect()}
    for r in got.collect():
        w = want[r.column]
        assert (r.kind, r["count"], r.non_null, r.min_length, r.max_length, r.avg_length) == (w.kind, w["count"], w.non_null, w.min_length, w.max_length, w.avg_length)
        assert close(r.distinct, w.distinct, 0.06)
        if r.kind == "numeric":
            v = sorted(x[0] for x in d.select(F.col(r.column).cast("double")).where(f"{r.column} IS NOT NULL AND NOT isnan({r.column})").collect())
            mean = sum(v) / len(v)
            assert float(r.min) == v[0] and float(r.max) == v[-1] and close(r.mean, mean, 1e-9)
            assert close(r.stddev, (sum((x - mean) ** 2 for x in v) / len(v)) ** 0.5, 1e-6)
            for q, share in zip(r.quantiles, (0.25, 0.5, 0.75), strict=True):
                low, high = sum(x < q for x in v) / len(v), sum(x <= q for x in v) / len(v)
                assert low - 0.015 <= share <= high + 0.015
        else:
            assert (r.min, r.max) == (w.min, w.max)
    assert {r.column for r in got.collect()} == set(want)


def test_merged_sketches_keep_their_bounds(spark):
    d = data(spark, "abc")
    compare(spark, merged(partition_sketches(d, F.col("day"))), d)
    assert merged(partition_sketches(d.where("false"), F.col("day"))).count() == 0


def test_only_changed_partitions_are_read(spark, tmp_path):
    t = SketchTable(spark, f"file://{tmp_path}/sketches")
    tables = {k: data(spark, k, i, 400) for i, k in enumerate("abcd")}
    read = lambda own: tables[own[0]] if len(own) == 1 else tables[own[0]].unionByName(read(own[1:]))
    parts = lambda **prints: spark.createDataFrame(list(prints.items()), "partition string, fingerprint string")
    assert t.refresh(parts(a="1", b="1", c="1"), read, F.col("day")) == ["a", "b", "c"]
    assert t.refresh(parts(a="1", b="1", c="1"), read, F.col("day")) == []
    tables["b"] = data(spark, "b", 9, 500)
    assert t.refresh(parts(a="1", b="2", d="1"), read, F.col("day")) == ["b", "d"]
    assert {r.partition for r in t.rows().select("partition").distinct().collect()} == {"a", "b", "d"}
    compare(spark, t.profile(), read(["a", "b", "d"]))
    tables["a"] = tables["a"].drop("s")
    assert t.refresh(parts(a="3", b="2", d="1"), read, F.col("day")) == ["a"]
    assert t.rows().where("partition = 'a' AND column = 's'").count() == 0 and t.rows().where("column = 's'").count() == 2
