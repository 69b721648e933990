"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

EDGE = "a long, b long"


class Forest:
    """Union-find over hashable nodes; the root is the smallest node of its tree."""

    def __init__(self) -> None:
        self.up: dict = {}

    def find(self, x):
        up = self.up
        root = x
        while (y := up.get(root, root)) != root:
            root = y
        while x != root:
            up[x], x = root, up.get(x, x)
        return root

    def join(self, x, y) -> None:
        x, y = self.find(x), self.find(y)
        if x != y:
            if y < x:
                x, y = y, x
            self.up[y] = x
            self.up.setdefault(x, x)


def shrink(batches: Iterator[pa.RecordBatch], limit: int = 500_000) -> Iterator[pa.RecordBatch]:
    """Each run of at most ``limit`` edges becomes a spanning forest of stars (node, smallest node)."""
    forest = Forest()

    def out() -> pa.RecordBatch:
        nodes = list(forest.up)
        roots = np.fromiter((forest.find(x) for x in nodes), np.int64, len(nodes))
        nodes = np.fromiter(nodes, np.int64, len(nodes))
        keep = nodes != roots
        return pa.RecordBatch.from_arrays([pa.array(nodes[keep]), pa.array(roots[keep])], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if a != b:
                forest.join(a, b)
        if len(forest.up) > limit:
            yield out()
            forest = Forest()
    yield out()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b: long); component is the smallest node reachable.

    Rounds grow with the logarithm of the longest path. Each round is two aggregations and two equi-joins; hub nodes
    are aggregated map-side. The aggregates are written before they are joined, so that both sides are shuffled for the
    join and adaptive execution can split a hub. Null ends and loops are left out; an empty table gives an empty table.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL").select("a", "b")
    e = checkpoint(edges.mapInArrow(shrink, EDGE).distinct())

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b"))).first())

    before = None
    while (now := mark(e)) != before and now[0]:
        before = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = checkpoint(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = checkpoint(large)
        low = checkpoint(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("x")).select("x.a", "x.b").where("a <> b").distinct()
        e = checkpoint(small)
    return e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
