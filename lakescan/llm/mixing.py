"""Operator 2, mixing sources to target weights by weighted fair queueing.

Every source gets a target in words: its weight's share of the budget, at most ``epochs`` times its own size, the excess
shared again by weight among the others. Within a source each epoch's documents stand in a shuffled order fixed by a
hash of the document. A document's virtual finish time is its source's running words, this document included, divided by
the source's target. All copies of all sources are range-sorted by finish time over the cluster, and the mix is the
longest start of that order whose words stay within the budget. ``mixed_documents`` returns it in that order.

At scale: what is sorted is narrow rows of ids and sizes. Running sums take two levels, within a source (sums of hash
buckets, then rows inside a bucket) and over the sorted copies (sums of the sort's partitions, then rows inside one), so
no source and no sort is one task; only tables of one row a source, a bucket or a partition go through a window of their
own. Texts are shuffled twice, to meet their places and into their order.

Defined results: a null text has size 0; null is a source of its own, last in the order; a source without words has
target 0 and nothing is taken from it; documents of size 0 are never taken; repeated rows are separate documents, and
rows equal in doc_id, source and text are interchangeable, also where further columns differ; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint, n_words


def source_targets(sized: DataFrame, source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: int = 2) -> DataFrame:
    """(source, source_size, target) from a table with ``source`` and ``size``: weights repeat over the sources in code point order, null last."""
    s = sized.groupBy(F.col(source).alias("source")).agg(F.sum("size").alias("source_size"), F.count("*").alias("source_rows"))
    everyone = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.get(F.array(*[F.lit(float(w)) for w in weights]), (F.row_number().over(by_name) - 1) % len(weights))
    s = s.withColumn("source_place", F.row_number().over(by_name)).withColumn("weight", weight).withColumn("most", (epochs * F.col("source_size")).cast("double"))
    s = s.withColumns({"ratio": F.col("most") / F.col("weight"), "budget": share * F.sum("source_size").over(everyone)})
    up = Window.orderBy("ratio").rangeBetween(Window.unboundedPreceding, 0)
    s = s.withColumns({"full_words": F.sum("most").over(up), "rest_weight": F.sum("weight").over(everyone) - F.sum("weight").over(up)})
    s = s.withColumn("full", F.col("full_words") + F.col("ratio") * F.col("rest_weight") <= F.col("budget"))
    used, open_weight = F.sum(F.when(F.col("full"), F.col("most")).otherwise(0.0)).over(everyone), F.sum(F.when(F.col("full"), 0.0).otherwise(F.col("weight"))).over(everyone)
    level = (F.col("budget") - used) / open_weight
    target = F.when(F.col("full"), F.col("most")).otherwise(F.least(F.col("most"), level * F.col("weight")))
    return s.select("source", "source_size", "source_rows", "source_place", "budget", target.alias("target"))


def finish_times(sized: DataFrame, targets: DataFrame, seed: str = "mix", bucket_rows: int = 2000) -> DataFrame:
    """``sized`` (doc_id, source, size, tie) with its source's columns and running: the source's words up to and including the row."""
    t = targets.withColumnRenamed("source", "_source")
    name = F.concat_ws("|", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    d = sized.withColumn("turn", F.conv(F.substring(F.md5(name), 1, 12), 16, 10).cast("long"))
    d = d.join(t, d.source.eqNullSafe(t._source)).drop("_source")
    d = d.withColumn("bucket", F.floor(F.col("turn") / F.lit(float(2**48)) * F.ceil(F.col("source_rows") / bucket_rows)).cast("long"))
    sums = d.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    before = F.sum("words").over(Window.partitionBy("source").orderBy("bucket")) - F.col("words")
    sums = sums.select(F.col("source").alias("_source"), F.col("bucket").alias("_bucket"), before.alias("before"))
    d = d.join(sums, d.source.eqNullSafe(sums._source) & (d.bucket == sums._bucket)).drop("_source", "_bucket")
    inside = Window.partitionBy("source", "bucket").orderBy("turn", "doc_id", "tie").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("running", F.col("before") + F.sum("size").over(inside)).drop("bucket", "before")


def queue(docs: DataFrame, text: str = "text", source: str = "source", weights: Sequence[float] = (3, 1, 2), share: float = 1.5, epochs: int = 2, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """The documents (row, doc_id, source, tie, size, source_size, target) and the copies that the mix takes (row, doc_id, source, tie, size, place).

    ``place`` counts from 0 in order of finish; tie is a hash of the text; row tells rows apart.
    """
    sized = checkpoint(docs.select("doc_id", F.col(source).alias("source"), n_words(F.col(text)).alias("size"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("tie")))
    d = finish_times(sized, source_targets(sized, "source", weights, share, epochs), seed).withColumn("row", F.monotonically_increasing_id())
    d = checkpoint(d)
    copies = d.where("size > 0 AND target > 0").withColumn("epoch", F.explode(F.array(*[F.lit(e) for e in range(epochs)])))
    copies = copies.withColumn("finish", (F.col("running") + F.col("epoch") * F.col("source_size")) / F.col("target"))
    order = ["finish", "source_place", "epoch", "turn", "doc_id", "tie", "row"]
    copies = copies.select("row", "source", "size", "budget", *order[:-1]).repartitionByRange(*order).sortWithinPartitions(*order)
    copies = checkpoint(copies.withColumn("part", F.spark_partition_id()))
    sums = copies.groupBy("part").agg(F.sum("size").alias("words"), F.count("*").alias("rows"))
    by_part = Window.orderBy("part")  # a row a partition of the sort
    sums = sums.select(F.col("part").alias("_part"), (F.sum("words").over(by_part) - F.col("words")).alias("words_before"), (F.sum("rows").over(by_part) - F.col("rows")).alias("rows_before"))
    inside = Window.partitionBy("part").orderBy(*order)
    c = copies.withColumns({"upto": F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)), "n": F.row_number().over(inside)})
    c = c.join(F.broadcast(sums), F.col("part") == F.col("_part")).where(F.col("words_before") + F.col("upto") <= F.col("budget"))
    return d, c.select("row", "doc_id", "source", "tie", "size", (F.col("rows_before") + F.col("n") - 1).alias("place"))


def mix(docs: DataFrame, text: str = "text", source: str = "source", **options) -> DataFrame:
    """(doc_id, source, tie, size, source_size, target, times, taken): times says how often the mix holds the document."""
    d, taken = queue(docs, text, source, **options)
    times = taken.groupBy(F.col("row").alias("_row")).agg(F.count("*").alias("times"))
    d = d.join(times, F.col("row") == F.col("_row"), "left").withColumn("times", F.coalesce("times", F.lit(0)))
    return d.select("doc_id", "source", "tie", "size", "source_size", "target", "times", (F.col("times") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: the rows of ``docs``, each as often as the mix takes it, in order of finish."""
    keys = lambda tie: [F.xxhash64(*k, "doc_id", "source", tie).alias(n) for n, k in (("key_a", []), ("key_b", [F.lit(7)]))]
    _, taken = queue(docs, text, source, **options)
    taken = taken.select(*keys("tie"), "place")
    d = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.col(source).alias("source"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("tie"))
    d = d.select("row", *keys("tie")).dropDuplicates(["key_a", "key_b"])
    return d.join(taken, ["key_a", "key_b"]).select("row", "place").repartitionByRange("place").sortWithinPartitions("place").select("row.*")


def query(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH d AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(coalesce(text, ''), '[ 	-
]+'), lambda x: x <> ''))::BIGINT AS size,
                  ('0x' || md5('mix|' || doc_id)[1:12])::BIGINT AS turn FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS ss FROM d GROUP BY source),
r AS (SELECT source, ss, [3.0, 1.0, 2.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w, row_number() OVER (ORDER BY source NULLS LAST) AS place, (2 * ss)::DOUBLE AS most FROM s),
q AS (SELECT a.*, 1.5::DOUBLE * (SELECT sum(ss) FROM r) AS budget, (SELECT sum(b.most) FROM r b WHERE b.most / b.w <= a.most / a.w) AS fw, (SELECT coalesce(sum(b.w), 0) FROM r b WHERE b.most / b.w > a.most / a.w) AS rw FROM r a),
f AS (SELECT *, fw + most / w * rw <= budget AS full_ FROM q),
t AS (SELECT *, CASE WHEN full_ THEN most ELSE least(most, (budget - (SELECT coalesce(sum(most), 0) FROM f WHERE full_)) / (SELECT sum(w) FROM f WHERE NOT full_) * w) END AS target FROM f),
c AS (SELECT d.*, t.ss, t.target, t.budget, t.place, sum(size) OVER (PARTITION BY d.source ORDER BY turn, doc_id) AS run FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (SELECT c.*, epoch, (run + epoch * ss)::DOUBLE / target AS fin FROM c, (SELECT unnest([0, 1]) AS epoch) WHERE size > 0 AND target > 0),
g AS (SELECT doc_id, size, budget, sum(size) OVER (ORDER BY fin, place, epoch, turn, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM e),
k AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM g WHERE upto <= budget GROUP BY doc_id)
SELECT c.doc_id, c.size, c.ss AS source_size, c.target, coalesce(k.taken, 0) AS taken FROM c LEFT JOIN k USING (doc_id)
"""
