from __future__ import annotations

import os
import time

import pytest
from pyspark.sql import functions as F

from lakescan.operators import catalog
from lakescan.operators import datasets as D
from lakescan.sources import inventory, listing, readers
from lakescan.streaming import crawl

KEYS = ["x.csv", "a/b/t/_delta_log/0.json", "a/b/t/_delta_log/1.json", "a/.hidden", "a/_SUCCESS", "year=2024/month=1/p 1.parquet", "year=2024/month=2/p%2.parquet", "year=2023/month=12/ü+.parquet", "deep/1/2/3/4/5/6/7.json", "x.csv.d/y.csv"]


def put(root, *keys):
    for k in keys:
        os.makedirs(os.path.dirname(f"{root}/{k}") or root, exist_ok=True)
        with open(f"{root}/{k}", "w") as f:
            f.write(k)


@pytest.mark.parametrize("partitions", [1, 3, 1000])
def test_lists_every_object_at_any_depth(spark, tmp_path, partitions):
    put(tmp_path, *KEYS)
    (tmp_path / "empty/er").mkdir(parents=True)
    d = listing.objects(spark, f"file://{tmp_path}", "b", partitions=partitions)
    assert d.schema == spark.createDataFrame([], inventory.SCHEMA).schema
    assert sorted((r.key, r.size) for r in d.collect()) == sorted((k, len(k.encode())) for k in KEYS)
    assert d.where("modified > timestamp_ntz '2020-01-01'").count() == len(KEYS)
    assert listing.objects(spark, f"{tmp_path}/nothing").count() == 0


def test_delta_tables_without_data_files(spark, tmp_path):
    put(tmp_path, "x.csv", "a/b/t/_delta_log/0.json")
    for d in (inventory.list_folder(spark, f"file://{tmp_path}", "b"), inventory._listed_by_spark(spark, f"file://{tmp_path}", "b", True)):
        assert {r.key for r in d.collect()} == {"x.csv", "a/b/t/_delta_log/0.json"}
        assert [tuple(r) for r in D.table_roots(d).collect()] == [("b", "a/b/t", "delta")]
    assert [r.key for r in inventory.list_folder(spark, str(tmp_path), "b", markers=False).collect()] == ["x.csv"]


@pytest.mark.parametrize(("prefix", "after"), [("", ""), ("year=2024/", ""), ("year=2024/month=1/p", ""), ("a/b", ""), ("", "deep/1"), ("", "x.csv"), ("year", "year=2024/month=1/p 1.parquet"), ("nothing", ""), ("", "zzz")])
def test_prefix_and_start_after(spark, tmp_path, prefix, after):
    put(tmp_path, *KEYS)
    want = sorted(k for k in KEYS if k.startswith(prefix) and k > after)
    assert sorted(r.key for r in listing.objects(spark, str(tmp_path), "b", prefix, after).collect()) == want
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    try:
        assert sorted(r.key for r in inventory.restrict(listing.objects(spark, str(tmp_path), "b"), prefix, after).collect()) == want
        assert [r.key for r in listing.objects(spark, str(tmp_path), "b").where("key = 'x.csv'").collect()] == ["x.csv"]
        assert listing.objects(spark, str(tmp_path), "b").where(F.col("key") >= "x.csv").count() == len([k for k in KEYS if k >= "x.csv"])
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", False)


def test_folders_out_of_reach_are_not_listed(tmp_path):
    put(tmp_path, *KEYS)
    store, root = listing.store_of(str(tmp_path))
    opened = []

    class Noted:
        def get_file_info(self, selector):
            opened.append(selector.base_dir.removeprefix(root).strip("/"))
            return store.get_file_info(selector)

    wanted = listing.Wanted("year=2024/", "year=2024/month=1~")
    found = [k for f in listing.planned(Noted(), root, wanted, 3) for k, _ in listing.entries(Noted(), root, f.folder, f.deep, wanted)]
    assert found == ["year=2024/month=2/p%2.parquet"]
    assert not any(f.startswith(("a", "deep", "year=2023")) for f in opened) and "year=2024/month=1" not in opened
    reader = listing.PushingReader({"path": str(tmp_path)})
    rest = list(reader.pushFilters([listing.StringStartsWith(("key",), "a"), listing.GreaterThan(("key",), "ab"), listing.GreaterThan(("size",), 1), listing.EqualTo(("key",), "a/x")]))
    assert [type(f).__name__ for f in rest] == ["GreaterThan", "EqualTo"] and reader.wanted == listing.Wanted("a/x", "ab")


def test_a_stream_of_objects_feeds_the_crawl(spark, tmp_path):
    land, state, seen = tmp_path / "land", f"file://{tmp_path}/state", []

    def store(batch, number):
        done = crawl.apply_batch(spark, state, batch, number)
        seen.extend((r.key, r.change) for r in done.changes.collect())

    put(land, "s/d=1/a.csv", "s/d=2/b.csv")
    q = listing.object_stream(spark, f"file://{land}", "b", settle=0.2).writeStream.option("checkpointLocation", f"{tmp_path}/point").foreachBatch(store).trigger(processingTime="1 second").start()
    try:
        for more in ([], ["s/d=3/c.csv"]):
            put(land, *more)
            end = time.time() + 90
            while len(seen) < 2 + len(more) and time.time() < end and q.isActive:
                time.sleep(0.5)
    finally:
        q.stop()
    assert sorted(seen) == [("s/d=1/a.csv", "new"), ("s/d=2/b.csv", "new"), ("s/d=3/c.csv", "new")]


def test_predicates_on_folders_choose_the_files(spark, tmp_path):
    for year, land, n in (("2023", "US", 1), ("2023", "F R", 2), ("2024", "US", 3), ("2024", "ü+%", 4)):
        spark.createDataFrame([(n,)], "n int").coalesce(1).write.csv(f"{tmp_path}/feed/{year}/{land}")
    put(tmp_path, "feed/2024/top.csv")
    where = "year = '2024' AND land <> 'US'"
    files = readers.pruned_files(spark, f"file://{tmp_path}/feed", "csv", ["year", "land"], where)
    assert len(files) == 2 and all("/2024/" in f for f in files)
    only = "year = '2024' AND land LIKE 'ü%'"
    assert len(readers.pruned_files(spark, f"file://{tmp_path}/feed", "csv", ["year", "land"], only)) == 1
    c = catalog.Catalog(spark, f"file://{tmp_path}/list")
    c.register("feed_pruned", f"file://{tmp_path}/feed", "csv", partition_columns=["year", "land"], options=readers.ReadOptions(header="none"))
    for predicate, want in (("year = '2023'", {1, 2}), ("land = 'F R'", {2}), (only, {4})):
        d = c.scan("feed_pruned", predicate)
        assert {int(r.col_1) for r in d.collect()} == want
        assert len(d.inputFiles()) == len(want)
    assert c.scan("feed_pruned", "year = '1999'").count() == 0
