from __future__ import annotations

import random
import threading

from pyspark.sql import functions as F

from lakescan.operators import datasets as D
from lakescan.sources import versions as V
from lakescan.streaming import crawl as S

COLUMNS = "bucket string, key string, size long, etag string, modified string, removed boolean, scope string"


def landed(spark, rows):
    """Rows (key, size[, removed[, scope]]) as a landing batch."""
    full = [("b", r[0], r[1], f"e{r[1]}", "2024-01-01", *(r[2:] + (None, None))[:2]) for r in rows]
    d = spark.createDataFrame(full, COLUMNS)
    return d.selectExpr("bucket", "key", "size", "etag", "'' AS storage_class", "'' AS version_id", "CAST(modified AS timestamp_ntz) AS modified", "removed", "scope")


def whole(spark, objects):
    """What one crawl over all objects finds."""
    d = landed(spark, [(k, s) for k, s in objects.items()]).drop("removed", "scope")
    found = D.fold_tables(D.classified(d), D.table_roots(d))
    datasets = {(r.root, r.format, r.file_count, r.total_size, r.partition_depth) for r in D.roll_up(found).collect()}
    partitions = {(r.root, r.partition_path, r.file_count, r.total_size) for r in D.partition_summary(found).collect()}
    best = {(r.root, r.format, r.key, r.size) for r in D.representatives(found).collect()}
    return datasets, partitions, best


def kept(state):
    datasets = {(r.root, r.format, r.file_count, r.total_size, r.partition_depth) for r in S.current_datasets(state).collect()}
    partitions = {(r.root, r.partition_path, r.file_count, r.total_size) for r in S.current_partitions(state).collect()}
    best = {(r.root, r.format, r.key, r.size) for r in state.rows("representatives").collect()}
    return datasets, partitions, best


def some_key(r):
    return r.choice((f"sales/day={r.randrange(4)}/f{r.randrange(30)}.parquet", f"feed/{r.randrange(3)}/x{r.randrange(20)}.csv", f"lake/t{r.randrange(2)}/part={r.randrange(2)}/f{r.randrange(9)}.parquet", f"lake/t{r.randrange(2)}/_delta_log/{r.randrange(3)}.json", f"top{r.randrange(5)}.json"))


def test_batches_equal_one_crawl(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "PARTS_MOST", 2)
    monkeypatch.setattr(V, "RANGE_ROWS", 15)
    r, objects, root = random.Random(7), {}, f"file://{tmp_path}/state"
    for number in range(4):
        rows = [(some_key(r), r.randrange(1, 50)) for _ in range(40)]
        rows = list(dict(rows).items())
        gone = r.sample(sorted(objects), min(8, len(objects))) if number else []
        if number == 3:
            gone = sorted({*gone, *(k for k in objects if "/_delta_log/" in k)})
        notices = [(k, 0, True) for k in gone if k not in dict(rows)]
        done = S.apply_batch(spark, root, landed(spark, rows + notices), number)
        change = {x.key: x.change for x in done.changes.collect()}
        for k, s in rows:
            assert change[k] == ("new" if k not in objects else "changed" if objects[k] != s else "unchanged")
        assert all(change[k] == "removed" for k, *_ in notices)
        objects.update(rows)
        for k, *_ in notices:
            objects.pop(k)
        assert S.apply_batch(spark, root, landed(spark, rows), number) is None
    state = S.load(spark, root)
    assert {(x.key, x.size) for x in state.rows("objects").collect()} == set(objects.items())
    assert kept(state) == whole(spark, objects)
    lows = [x["low"] for x in state.tables["objects"].ranges]
    assert len(lows) > 2 and lows == sorted(lows) and lows[0] == ""
    assert S.clean(spark, root, 1) > 0
    assert kept(S.load(spark, root)) == whole(spark, objects)


def test_events_scopes_and_schemas(spark, tmp_path):
    root, kinds = f"file://{tmp_path}/state", {"a": "int"}
    infer = lambda best: best.select("bucket", "root", F.lit("c").alias("name"), F.lit(kinds["a"]).alias("type"), F.lit(True).alias("nullable"))
    events = lambda done: sorted((e.type, e.subject) for e in done.events.collect())
    first = S.apply_batch(spark, root, landed(spark, [("s/d=1/a.csv", 1), ("s/d=2/b.csv", 2), ("t/d=1/c.csv", 3)]), 0, infer=infer)
    assert events(first) == [("CrawlCompleted", "crawl"), ("CrawlStarted", "crawl"), ("DatasetDiscovered", "b/s"), ("DatasetDiscovered", "b/t"), *[("NewPartition", "b/s")] * 2, ("NewPartition", "b/t"), ("SchemaChanged", "b/s"), ("SchemaChanged", "b/t")]
    kinds["a"] = "bigint"
    # a complete listing of s/ that lacks one object and has one more
    second = S.apply_batch(spark, root, landed(spark, [("s/d=2/b.csv", 2, None, "s"), ("s/d=3/e.csv", 9, None, "s/")]), 1, infer=infer)
    assert {(c.key, c.change) for c in second.changes.collect()} == {("s/d=1/a.csv", "removed"), ("s/d=2/b.csv", "unchanged"), ("s/d=3/e.csv", "new")}
    assert ("NewPartition", "b/s") in events(second) and ("CatalogUpdated", "b/s") in events(second) and ("SchemaChanged", "b/s") in events(second)
    m = second.metrics.first()
    assert (m.objects_new, m.objects_removed, m.objects_unchanged, m.datasets) == (1, 1, 1, 1)
    assert {(x.root, x.version) for x in S.load(spark, root).rows("schemas").collect()} == {("s", 2), ("t", 1)}


def test_a_batch_reads_what_it_touches_however_long_the_history(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(V, "RANGE_ROWS", 100)
    monkeypatch.setattr(V, "PARTS_MOST", 3)
    root, read = f"file://{tmp_path}/state", []
    rows = V.RangedTable.rows

    def noted(self, ranges=None):
        read.append(sum(self.ranges[i]["rows"] for i in (range(len(self.ranges)) if ranges is None else ranges)))
        return rows(self, ranges)

    monkeypatch.setattr(V.RangedTable, "rows", noted)
    amounts = []
    for number in range(6):
        read.clear()
        S.apply_batch(spark, root, landed(spark, [(f"s/day={number:03d}/f{i}.csv", i) for i in range(120)]), number)
        amounts.append(sum(read))
    assert max(amounts) < 1500 and amounts[5] < 2 * max(amounts[2:4]) + 200
    assert S.load(spark, root).tables["objects"].rows().count() == 720


def test_stream(spark, tmp_path):
    land, root, point = (f"{tmp_path}/{x}" for x in ("land", "state", "point"))
    seen = []
    run = lambda: S.stream_crawl(spark, land, f"file://{root}", point, on_batch=lambda b, n: seen.append(sorted((r.key, r.change) for r in b.changes.collect()))).awaitTermination()
    landed(spark, [("a.csv", 1), ("b.csv", 2)]).write.mode("append").parquet(land)
    run()
    landed(spark, [("a.csv", 0, True), ("b.csv", 5)]).drop("scope").write.mode("append").parquet(land)
    run()
    run()
    assert seen == [[("a.csv", "new"), ("b.csv", "new")], [("a.csv", "removed"), ("b.csv", "changed")]]


def test_twenty_writers_at_once(spark, tmp_path):
    log = V.Versions(spark, f"file://{tmp_path}/log")
    threads = [threading.Thread(target=lambda i=i: log.change(lambda c: c | {str(i): i})) for i in range(20)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert log.current() == (20, {str(i): i for i in range(20)})
