from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakescan.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<double>, label int"


def expected(rows):
    """Every anchor against every row."""
    good, seen = [], set()
    for vec_id, e, label in rows:
        if vec_id is None or label is None or not e or any(x is None or not math.isfinite(x) or abs(x) >= (1 << 31) / 256 for x in e):
            continue
        q = tuple(math.floor(256 * x) for x in e)
        if max(map(abs, q)) ** 2 * len(q) >= 1 << 62:
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        if (vec_id, label, q) not in seen:
            seen.add((vec_id, label, q))
            good.append((vec_id, label, q))
    out = []
    for a, label, q in good:
        if a % 100:
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, r, strict=True)), i, b) for i, b, r in good if i != a and len(r) == len(q))
        for p, i, b in [x for x in scored if x[2] == label][:5]:
            negatives = [(-s, j) for s, j, c in scored if c != label and 30 * -p <= 100 * -s <= 90 * -p][:10]
            out += [(a, i, k, j, -p, s) for k, (s, j) in enumerate(negatives, 1)]
    return sorted(out)


def vectors(seed, n=500, dim=7, spread=0.4):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows: list = []
    for i in range(n):
        k = r.random()
        v = [x + r.gauss(0, spread) for x in r.choice(centres)]
        if k < 0.3:
            v = centres[0]
        elif k < 0.4:
            v = [round(x) / 4 for x in v]
        rows.append((i * 4, v, r.randrange(4)))
    odd = [(700001, None, 1), (700, [], 1), (None, [1.0] * dim, 1), (800, [1.0] * dim, None), (900, [math.nan] * dim, 1), (1000, [None] + [1.0] * (dim - 1), 1), (1100, [math.inf] * dim, 2), (300, [1e300] * dim, 2), (100, [5e6] * dim, 2), (500, [1.0, 2.0], 1), (504, [1.0, 2.0], 1), (505, [1.5, 1.0], 3), (200, [0.0] * dim, 1), (99_900, [3.0], 77), rows[50], rows[50]]
    return rows + odd


@pytest.mark.parametrize(("seed", "shard", "cell", "block", "spread"), [(1, 4 << 20, 128, 1 << 16, 0.4), (2, 40 * 28, 5, 3, 0.1), (3, 7 * 28, 2, 1 << 16, 1.0)])
def test_equals_brute_force(spark, monkeypatch, seed, shard, cell, block, spread):
    for name, value in (("SHARD_BYTES", shard), ("CELL_ROWS", cell), ("BLOCK_QUERIES", block), ("SAMPLE_ROWS", 200), ("BATCH_ROWS", 9)):
        monkeypatch.setattr(hard_negatives, name, value)
    rows = vectors(seed, spread=spread)
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS dim", "2 AS q", "3 AS shard", "'x' AS query").repartition(3)
    got = sorted(tuple(r) for r in hard_negatives.query(d).collect())
    assert got == expected(rows)
    assert len({x[0] for x in got}) > 10


def test_large_components_stay_exact(spark):
    r = random.Random(5)
    rows = [(i * 50, [float(r.randrange(-3_000_000, 3_000_000)) + r.random() for _ in range(4)], i % 2) for i in range(60)]
    d = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(x) for x in hard_negatives.query(d).collect()) == expected(rows)


def test_no_anchor_no_partner_no_row(spark):
    d = spark.createDataFrame([(1, [1.0], 1), (3, [1.0], 1)], SCHEMA)
    assert hard_negatives.query(d).count() == 0
    assert hard_negatives.query(d.where("false")).count() == 0
    alone = spark.createDataFrame([(100, [1.0], 1), (3, [1.0], 2)], SCHEMA)
    assert hard_negatives.query(alone).columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert hard_negatives.query(alone).count() == 0


def test_multi_sequence_yields_all_pairs_by_falling_sum():
    r = np.random.default_rng(1)
    u, v = r.normal(size=9).round(1), r.normal(size=6).round(1)
    got = list(hard_negatives.multi_sequence(u, v))
    assert sorted(x[:2] for x in got) == [(i, j) for i in range(9) for j in range(6)]
    assert all(a[2] >= b[2] for a, b in zip(got, got[1:], strict=False))


def test_clustered_search_leaves_most_rows_unvisited(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BATCH_ROWS", 64)
    monkeypatch.setattr(hard_negatives, "CELL_ROWS", 20)
    r = np.random.default_rng(2)
    rows = [(k * 200 + i, [float(x) for x in c + r.normal(size=8) * 0.02], k % 3) for k, c in enumerate(np.eye(8)) for i in range(200)]
    placed, grids = hard_negatives.build_index(hard_negatives.integer_rows(spark.createDataFrame(rows, SCHEMA)))
    shard = hard_negatives.Shard(grids[8], 8, placed.toArrow().to_batches())
    assert len(shard.cells) > 4
    shown = []
    visits = shard.visits

    def noted(*a):
        for found in visits(*a):
            shown.append(len(found[0]))
            yield found

    shard.visits = noted
    q = shard.x[0].astype(np.int64)
    best = hard_negatives.positives(shard, int(shard.ids[0]), int(shard.labels[0]), q, hard_negatives.Rules())
    assert len(best.id) == 5
    assert sum(shown) < 0.5 * len(rows)


def test_own_rules(spark):
    rows = [(i, [math.cos(i / 9), math.sin(i / 9)], i % 2) for i in range(40)]
    d = spark.createDataFrame(rows, SCHEMA)
    got = hard_negatives.mine(d, F.col("vec_id") == 3, hard_negatives.Rules(2, 3, 0, 100)).collect()
    assert len(got) == 6
    assert {x.rank for x in got} == {1, 2, 3}
    assert all(0 <= x.negative_score <= x.positive_score for x in got)
