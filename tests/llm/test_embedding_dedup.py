from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from lakescan.llm import embedding_dedup

from . import brute


def vectors(seed, n=220, dim=6):
    r = random.Random(seed)
    rows: list = []
    for i in range(n):
        k = r.random()
        if k < 0.5 and rows and rows[-1][1]:
            base = r.choice([v for _, v in rows if v and all(x is not None for x in v)])
            v = [x * 2 + r.gauss(0, 0.4) for x in base] if r.random() < 0.8 else list(base)
        else:
            v = [r.gauss(0, 1) for _ in range(dim)]
        rows.append((i * 2, v))
    rows += [(1001, None), (1003, []), (1005, [0.0] * dim), (1007, [float("nan")] + [1.0] * (dim - 1)), (1009, [None] + [1.0] * (dim - 1)), (1011, [float("inf")] * dim), (1013, [1.0, 2.0]), (1015, [2.0, 4.0]), (1017, [1e-200] * dim), (1019, [1e200] * dim)]
    return rows


@pytest.mark.parametrize(("seed", "rows", "cell"), [(1, 16384, 8192), (2, 20, 16), (3, 16384, 10), (4, 7, 60)])
def test_equals_brute_force(spark, monkeypatch, seed, rows, cell):
    monkeypatch.setattr(embedding_dedup, "BLOCK_BYTES", rows * 6 * 8)
    monkeypatch.setattr(embedding_dedup, "CELL_BYTES", cell * 6 * 8)
    data = vectors(seed)
    kind = "float" if seed == 4 else "double"
    if seed == 4:
        data = [(i, v if v is None else [x if x is None else float(np.float32(x)) for x in v]) for i, v in data]
    d = spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 AS cell", "2 AS dim")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.query(d).collect()}
    assert got == brute.cosine_links(data)


def test_many_cells_of_their_own_size(spark, monkeypatch):
    """Clusters of unequal size at the real bytes of a cell; every link crosses or stays, and none is lost."""
    monkeypatch.setattr(embedding_dedup, "MATRIX_BYTES", 1 << 16)
    r = np.random.default_rng(3)
    dim, n = 512, 9000
    centres = r.normal(size=(60, dim))
    which = np.minimum(r.geometric(0.08, n) - 1, 59)
    x = (centres[which] + 0.25 * r.normal(size=(n, dim))).astype(np.float32)
    x[::9] = x[1::9] + (0.02 * r.normal(size=x[::9].shape)).astype(np.float32)
    d = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(n) * 3), "embedding": pa.array(list(x), pa.list_(pa.float32()))}))
    cells = n * 8 * dim // embedding_dedup.CELL_BYTES
    assert cells >= 8
    got = embedding_dedup.query(d).toArrow().sort_by("vec_id")
    unit = embedding_dedup.unit_rows(pa.array(list(x), pa.list_(pa.float32())), dim)
    links = np.array([(unit @ unit[i] >= 0.95).sum() - 1 for i in range(n)])
    assert got["n_links"].to_pylist() == links.tolist() and links.sum() > 5000


def test_work_for_a_vector_does_not_grow_with_clusters_far_away():
    """Where vectors are clustered a vector is in few cells, however many there are; a slice has its bytes whatever the pivots."""
    r = np.random.default_rng(4)
    seen = {}
    for clusters in (50, 400):
        centres = embedding_dedup.unit_rows(pa.array(list(r.normal(size=(clusters, 64))), pa.list_(pa.float64())), 64)
        x = np.repeat(centres, 8, axis=0) + 0.02 * r.normal(size=(8 * clusters, 64))
        x /= np.sqrt((x * x).sum(axis=1, keepdims=True))
        pivots = x[::4]
        d = embedding_dedup._distances(x, pivots)
        home = d.argmin(axis=1)
        low, high = (np.full((len(pivots), embedding_dedup.GUIDES + 1), v) for v in (np.inf, -np.inf))
        at = np.hstack([d[:, : embedding_dedup.GUIDES], d.min(axis=1)[:, None]])
        np.minimum.at(low, home, at)
        np.maximum.at(high, home, at)
        seen[clusters] = embedding_dedup.visited(d, pivots, (low, high), 0.3163)[1].sum() / len(x)
        assert max(part.nbytes for _, part in embedding_dedup._slices(np.repeat(x, 50, axis=0), pivots)) <= embedding_dedup.MATRIX_BYTES
    assert max(seen.values()) < 3


def test_rows_without_id_repeats_and_empty(spark):
    d = spark.createDataFrame([(None, [1.0, 0.0]), (4, [1.0, 0.0]), (4, [1.0, 0.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id or 0), r.n_links, r.component_id, r.kept) for r in embedding_dedup.query(d).collect())
    assert got == [(0, 0, None, False), (2, 2, 2, True), (4, 2, 2, False), (4, 2, 2, False)]
    assert embedding_dedup.query(d.where("false")).count() == 0


def test_pivots_need_no_window_over_a_dimension(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "CELL_BYTES", 20 * 6 * 8)
    d = spark.createDataFrame(vectors(5), "vec_id long, embedding array<double>")
    plans, collect = [], type(d).collect

    def noted(self):
        plans.append(self._jdf.queryExecution().executedPlan().toString())
        return collect(self)

    monkeypatch.setattr(type(d), "collect", noted)
    out = embedding_dedup.query(d)
    assert plans and not any("Window" in p for p in plans)
    monkeypatch.undo()
    assert out.count() == d.count()
