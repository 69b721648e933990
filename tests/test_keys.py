from __future__ import annotations

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from lakescan.functions import cost
from lakescan.functions import keys as K


def values(spark, rows, expr):
    d = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, k string")
    return [r.v for r in d.select("i", expr(F.col("k")).alias("v")).orderBy("i").collect()]


def classified(spark, key, mode, root, prefix="pt", separator=""):
    (c,) = values(spark, [key], lambda k: K.classify(k, mode, root, prefix, separator))
    return c.root, c.strategy, [(p.name, p.value) for p in c.partitions]


def made_keys(seed, n=60):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcxyz019-_ é") for _ in range(r.randint(1, 6))).strip() or "w"
    for _ in range(n):
        folders = [word() for _ in range(r.randint(0, 3))]
        pairs = [(f"k{i}" if r.random() < 0.5 else word(), word() + r.choice(["", "=", "=1"])) for i in range(r.randint(0, 3))]
        yield folders, pairs, word() + ".bin", r.choice(["/", "/", "//", "\\"])


def test_classify_generated_keys(spark):
    keys, want = [], []
    for folders, pairs, name, slash in made_keys(4):
        keys.append(slash.join([*folders, *(f"{k}={v}" for k, v in pairs), name]))
        if pairs:
            want.append(("/".join(folders), "hive", pairs))
        else:
            want.append(("", "positional", [(f"pt{i}", x) for i, x in enumerate(folders)]))
    d = spark.createDataFrame(list(enumerate(keys)), "i int, k string")
    for mode in ("positional", "hive"):
        got = [(r.c.root, r.c.strategy, [(p.name, p.value) for p in r.c.partitions]) for r in d.select("i", K.classify(F.col("k"), mode, "", "pt", "").alias("c")).orderBy("i").collect()]
        for g, w in zip(got, want, strict=True):
            assert g == (w if w[1] == "hive" or mode == "positional" else ("/".join(x for _, x in w[2]), "legacy", []))


def test_a_pair_needs_a_name_and_a_value(spark):
    assert classified(spark, "in/=v/k=/x=y=z/f", "hive", "") == ("in/=v/k=", "hive", [("x", "y=z")])
    assert classified(spark, "zone/b/2020/f", "positional", "zone") == ("zone", "positional", [("pt0", "b"), ("pt1", "2020")])


def test_positional_names_and_q10_root_ends_at_a_slash(spark):
    r = random.Random(11)
    word = lambda: "".join(r.choice("klmno789") for _ in range(r.randint(1, 5)))
    for prefix, joint in (("pt", ""), ("level", "-"), ("c", "__")):
        folders = [word() for _ in range(r.randint(1, 4))]
        key = "/".join([*folders, word()])
        assert classified(spark, key, "positional", "", prefix, joint)[2] == [(f"{prefix}{joint}{i}", x) for i, x in enumerate(folders)]
        # a root counts as a whole folder only, not as the beginning of a longer name
        assert classified(spark, key, "positional", folders[0] + "x")[2] == [(f"pt{i}", x) for i, x in enumerate(folders)]
        longer = f"{folders[0]}x/" + key
        assert classified(spark, longer, "positional", folders[0])[2] == [(f"pt{i}", x) for i, x in enumerate([folders[0] + "x", *folders])]


@pytest.mark.parametrize("depth", [-1, 0, 1, 2, 9])
def test_virtual_path_and_back(spark, depth):
    keys = [slash.join([*folders, name]).replace("//", "/") for folders, _, name, slash in made_keys(5)] + ["p/q=1/r", "é/ü/f", "dir/"]
    want = []
    for key in keys:
        *folders, name = key.replace("\\", "/").split("/")
        want.append("/".join([f"pt{i}={x}" if i < depth else x for i, x in enumerate(folders)] + [name]))
    assert values(spark, keys, lambda k: K.virtual_path(k, depth)) == want
    assert values(spark, keys, lambda k: K.real_path(K.virtual_path(k, depth))) == [k.replace("\\", "/") for k in keys]


def test_ignored_markers_formats(spark):
    r = random.Random(12)
    word = lambda: "".join(r.choice("pqrst") for _ in range(r.randint(1, 6)))
    above = lambda: "".join(f"{word()}/" for _ in range(r.randrange(4)))
    keys, hidden = [], []
    for _ in range(40):
        name = word() + r.choice(["", ".csv", ".parquet", ".tar.gz"])
        for base, is_hidden in ((name, False), ("." + name, True), (name + "/", True), (r.choice(K.MARKERS), True), ("_temporary" + name, True), (f"{word()}/_temporary/{name}", True), (f"{word()}_temporary/{name}", False), ("_" + name, False)):
            keys.append(above() + base)
            hidden.append(is_hidden)
    assert values(spark, keys, K.ignored) == hidden
    keys, want = [], []
    for _ in range(30):
        root = above().strip("/")
        at = lambda rest: f"{root}/{rest}" if root else rest
        meta = r.choice([word() + ".metadata.json", "snap-" + word(), word() + ".avro", "version-hint.text"])
        cases = [(at(f"_delta_log/{word()}.json"), (root, "delta")), (at(f"_delta_log/{word()}/{word()}"), (root, "delta")), (at(f"metadata/{meta}"), (root, "iceberg") if root or meta.endswith(".metadata.json") else None), (at(f"metadata/{word()}.txt"), None), (at(f"{word()}_delta_log/x"), None), (at(word() + ".avro"), None)]
        keys += [k for k, _ in cases]
        want += [w for _, w in cases]
    assert [None if m is None else (m.root, m.format) for m in values(spark, keys, K.table_marker)] == want
    keys = ["a.CSV.GZ", "b.pq", "c.tab.bz2", "d.ndjson", "e", "f.json.br", "g.d/x"]
    assert values(spark, keys, K.format_of) == ["csv", "parquet", "tsv", "jsonl", "unknown", "json", "unknown"]
    assert values(spark, keys, K.compression_of) == ["gzip", "none", "bzip2", "none", "none", "brotli", "none"]


def test_format_by_header(spark):
    rows = [("x.csv", b"PAR1...."), ("x", b"Obj\x01"), ("x", b"ORC\x00"), ("x.json", b'{"a":1}\n{"b":2}\n'), ("x", b' [1]'), ("x", b'{"a":1}\nb\n'), ("x", b""), ("x.json", b'{"a":1}')]
    d = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, k string, h binary")
    got = [r.v for r in d.select("i", K.format_with_header(F.col("k"), F.col("h")).alias("v")).orderBy("i").collect()]
    assert got == ["parquet", "avro", "orc", "jsonl", "json", "json", "unknown", "json"]


def test_names(spark):
    r = random.Random(6)
    raw = ["".join(r.choice("aZ09 _-./!é") for _ in range(r.randint(0, 8))) for _ in range(80)]

    def made(x):
        x = re.sub("_+", "_", re.sub("[^a-z0-9_]", "_", x.lower())).strip("_")
        return "table" if not x else f"t_{x}" if x[0].isdigit() else x

    assert values(spark, raw, K.table_name) == [made(x) for x in raw]
    assert values(spark, raw, K.valid_identifier) == [re.fullmatch("[A-Za-z_][A-Za-z0-9_]*", x) is not None for x in raw]
    suffixes = ["", ".gz", ".bz2", ".zst"]
    assert values(spark, [f"q/r.csv{x}" for x in suffixes], lambda k: K.data_extension(k, "csv")) == [f".csv{x}" for x in suffixes]
    assert values(spark, ["q/r"], lambda k: K.data_extension(k, "orc")) == [".orc"]


def test_costs(spark):
    g = 1 << 30
    rows = [("us-east-1", "STANDARD", g, 0.023), ("us-east-1", "standard", g, 0.023), ("us-east-1", "STANDARD", 1024, 0.023 * 1024 / g), ("us-east-1", "STANDARD_IA", 1024, 0.0125 * 131072 / g),
            ("us-east-1", "GLACIER", g, (g * 0.0036 + 32768 * 0.0036 + 8192 * 0.023) / g), ("us-east-1", "DEEP_ARCHIVE", 0, (32768 * 0.00099 + 8192 * 0.023) / g), ("mars-1", "", g, 0.023), ("us-east-1", "OUTPOSTS", g, 0.023), ("us-east-1", None, g, 0.023)]
    d = spark.createDataFrame(rows, "region string, storage_class string, size long, want double")
    for r in cost.with_cost(d, cost.rates_table(spark)).collect():
        assert abs(r.cost - r.want) < 1e-12


def test_rates_from_published_price_files(spark, tmp_path):
    def offer(region, prefix, more=()):
        products = [("1", "TimedStorage-ByteHrs", "Standard", "AWS Region", [("0", "GB-Mo", "0.03"), ("51200", "GB-Mo", "0.02")]), ("2", "TimedStorage-GlacierByteHrs", "Amazon Glacier", "AWS Region", [("0", "GB-Mo", "0.005")]),
                    ("3", "TimedStorage-ByteHrs", "IntelligentTieringAAObjectOverhead", "AWS Region", [("0", "GB-Mo", "9")]), ("4", "Tables-TimedStorage-ByteHrs", "Standard", "AWS Region", [("0", "GB-Mo", "9")]),
                    ("5", "TimedStorage-SIA-ByteHrs", "Standard - Infrequent Access", "AWS Outposts", [("0", "GB-Mo", "9")]), ("6", "TimedStorage-ZIA-ByteHrs", "One Zone - Infrequent Access", "AWS Region", [("0", "Objects", "9")]), *more]
        attributes = lambda p: {"regionCode": region, "usagetype": prefix + p[1], "volumeType": p[2], "locationType": p[3]}
        prices = lambda p: {f"{p[0]}.t.{i}": {"beginRange": b, "unit": u, "pricePerUnit": {"USD": v}} for i, (b, u, v) in enumerate(p[4])}
        return {"publicationDate": "2020", "products": {p[0]: {"sku": p[0], "attributes": attributes(p)} for p in products}, "terms": {"OnDemand": {p[0]: {f"{p[0]}.t": {"priceDimensions": prices(p)}} for p in products}, "Reserved": {}}}

    for region, prefix in [("moon-1", ""), ("moon-2", "MN2-")]:
        (tmp_path / f"{region}.json").write_text(json.dumps(offer(region, prefix)))
    found = {(r.region, r["class"], r.rate) for r in cost.price_list(spark, f"{tmp_path}/moon-1.json").collect()}
    assert found == {("moon-1", "STANDARD", 0.03), ("moon-1", "GLACIER", 0.005)}
    assert {(r["class"], r.rate) for r in cost.price_list(spark, [f"{tmp_path}/moon-2.json"]).collect()} == {("STANDARD", 0.03), ("GLACIER", 0.005)}
    d = spark.createDataFrame([("moon-1", "GLACIER_IR", 1 << 30)], "region string, storage_class string, size long")
    assert cost.with_cost(d, cost.price_list(spark, f"{tmp_path}/moon-1.json")).first().cost == 0.03
    (tmp_path / "bad.json").write_text(json.dumps(offer("moon-3", "", [("7", "TimedStorage-ByteHrs", "Standard", "AWS Region", [("0", "GB-Mo", "0.04")])])))
    with pytest.raises(Exception, match="rates differ: moon-3 STANDARD"):
        cost.price_list(spark, f"{tmp_path}/bad.json").collect()
