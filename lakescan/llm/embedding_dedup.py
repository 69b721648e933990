"""Operator 9, embedding near-dedup by an exact metric range join.

Vectors of length one lie within distance r = sqrt(2 - 2c) of each other exactly when their cosine is at least c. Equal
vectors are one class. Pivots, a bounded sample of the vectors, partition the classes: each belongs to the cell of its
nearest pivot. The triangle inequality sets what must be seen across a boundary: a vector x of cell a visits cell b > a
if it lies within r of the plane halfway between the two pivots, and if its distances to pivot b and to each of the first
``GUIDES`` pivots are those of some resident of cell b, give or take r: of every cell the least and greatest distance to
these pivots is known. Each pair of near vectors so meets in exactly one cell, and cells are joined independently: inside one,
vectors are sorted by their distance to the pivot, and only slices whose distances differ by at most r are multiplied.
Products are screened in single precision with a margin for its error; pairs that pass are decided in double precision.

Cells have ``CELL_BYTES`` of vectors on average and are ``LEAST_CELLS`` at least, so their number grows with the table as
long as the pivots, which are broadcast, stay within ``PIVOT_BYTES``. Distances to pivots are worked out for as many
vectors at a time as make a matrix of ``MATRIX_BYTES``, whatever the number of pivots. Where vectors lie at random in many
dimensions no metric bound rules cells out, and copies of a vector grow with the cells. Residents and visitors of a cell are cut into blocks of ``BLOCK_BYTES``; a task
has two blocks of residents or one of each kind, so no cell has to fit one task. A task returns each class's number of
links and a spanning forest, never pairs; alternating stars join the forests.

Defined results: vectors that are null, empty or zero, or hold null or non-finite components link with nothing, and
vectors of different dimensions do not link with each other; rows without vec_id link with nothing, have no component
and are not kept; repeated rows are vectors of their own and link with each other; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from .common import checkpoint
from .graph import connected_components

#: Sizes in bytes of double precision, so that they hold for vectors of any dimension.
CELL_BYTES = 4 << 20
BLOCK_BYTES = 8 << 20
PIVOT_BYTES = 32 << 20
MATRIX_BYTES = 8 << 20
GUIDES = 16
LEAST_CELLS = 4
SLACK = 1e-9


def unit_rows(column: pa.Array, dim: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # so that no square leaves the range of doubles
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims).tolist():
        part = batch.filter(pa.array(dims == dim))
        yield dim, part, unit_rows(part.column("embedding"), dim)


def _distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ pivots.T), 0))


def _slices(x: np.ndarray, pivots: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, distances to all pivots) of as many rows as ``MATRIX_BYTES`` hold."""
    rows = max(MATRIX_BYTES // (8 * len(pivots)), 1)
    for k in range(0, len(x), rows):
        yield k, _distances(x[k : k + rows], pivots)


def _homes(pivots):
    """(dim, cell, low, high): of each batch's cells the least and greatest distances to the guides and to the own pivot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, _, x in _by_dim(batch):
                home, at = [], []
                for _, d in _slices(x, pivots.value[dim]):
                    home.append(d.argmin(axis=1))
                    at.append(np.hstack([d[:, :GUIDES], d.min(axis=1)[:, None]]))
                home, at = np.concatenate(home), np.vstack(at)
                order = np.argsort(home, kind="stable")
                cells, first = np.unique(home[order], return_index=True)
                ends = [f.reduceat(at[order], first, axis=0) for f in (np.minimum, np.maximum)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cells), dim, np.int32)), pa.array(cells.astype(np.int32)), *(pa.array(list(e), pa.list_(pa.float64())) for e in ends)], names=["dim", "cell", "low", "high"])

    return run


def _spans(classes: DataFrame, pivots, at: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """For each dimension the least and greatest distances of every cell's residents to the guides and the cell's pivot; a row a pivot, ``GUIDES`` + 1 columns."""
    own = classes.select("dim", "embedding").mapInArrow(_homes(pivots), "dim int, cell int, low array<double>, high array<double>")
    own = own.select("dim", "cell", F.posexplode(F.arrays_zip("low", "high")).alias("guide", "x")).groupBy("dim", "cell", "guide").agg(F.min("x.low").alias("low"), F.max("x.high").alias("high"))
    spans = {dim: (np.full((len(p), GUIDES + 1), np.inf), np.full((len(p), GUIDES + 1), -np.inf)) for dim, p in at.items()}
    for row in own.collect():  # GUIDES + 1 rows a pivot at most, and pivots are bounded
        guide = row.guide if row.guide < min(GUIDES, len(at[row.dim])) else GUIDES
        spans[row.dim][0][row.cell, guide], spans[row.dim][1][row.cell, guide] = row.low, row.high
    return spans


def visited(d: np.ndarray, pivots: np.ndarray, spans: tuple[np.ndarray, np.ndarray], r: float) -> tuple[np.ndarray, np.ndarray]:
    """(home, visits): each row's nearest pivot, and whether it is in each cell, given its distances to all pivots."""
    low, high = spans
    home = d.argmin(axis=1)
    own = d[np.arange(len(d)), home]
    between = _distances(pivots[home], pivots)  # of the same size as d
    with np.errstate(divide="ignore", invalid="ignore"):
        to_plane = (d * d - (own * own)[:, None]) / (2 * between)
    visits = (to_plane <= r + SLACK) | (between == 0)
    visits &= np.arange(len(pivots))[None, :] > home[:, None]
    visits &= (d <= high[:, GUIDES] + r + SLACK) & (d >= low[:, GUIDES] - r - SLACK)
    for g in range(min(GUIDES, len(pivots))):
        visits &= (d[:, g, None] <= high[:, g] + r + SLACK) & (d[:, g, None] >= low[:, g] - r - SLACK)
    visits[np.arange(len(d)), home] = True
    return home, visits


def _dealt(pivots, spans, r: float, with_vectors: bool):
    """Each class in its own cell and, as a visitor, in later cells that may hold a near vector."""
    more = ["far", "vec_id", "copies", "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for dim, part, x in _by_dim(batch):
                p = pivots.value[dim]
                for k, d in _slices(x, p):
                    home, visits = visited(d, p, spans.value[dim], r)
                    row, cell = np.nonzero(visits)
                    step = max(MATRIX_BYTES // (8 * dim), 1) if with_vectors else max(len(row), 1)
                    for s in range(0, len(row), step):  # a vector may go to very many cells
                        i, c = row[s : s + step], cell[s : s + step]
                        where = [pa.array(np.full(len(i), dim, np.int32)), pa.array(c.astype(np.int32)), pa.array(c == home[i])]
                        if with_vectors:
                            out = part.take(pa.array(i + k))
                            where += [pa.array(d[i, c]), *(out.column(name) for name in more[1:])]
                        yield pa.RecordBatch.from_arrays(where, names=["dim", "cell", "native", *more[: len(where) - 3]])

    return run


def near_pairs(x: np.ndarray, left: np.ndarray, right: np.ndarray, far: np.ndarray, cosine: float, rows: int = 512) -> Iterator[tuple[int, np.ndarray]]:
    """(row of ``left``, rows of ``right`` with that cosine or more); ``far`` has the distances to the cell's pivot."""
    r = float(np.sqrt(max(2 - 2 * cosine, 0))) + SLACK
    right = right[np.argsort(far[right], kind="stable")]
    left = left[np.argsort(far[left], kind="stable")]
    small = x.astype(np.float32)
    screen = np.float32(cosine - 1e-5 - 2.4e-7 * x.shape[1])
    there = far[right]
    for k in range(0, len(left), rows):
        own = left[k : k + rows]
        lo, hi = np.searchsorted(there, far[own[0]] - r, "left"), np.searchsorted(there, far[own[-1]] + r, "right")
        q, y = np.nonzero(small[own] @ small[right[lo:hi]].T >= screen)
        for a in range(0, len(q), 1 << 16):
            i, j = own[q[a : a + (1 << 16)]], right[lo:hi][y[a : a + (1 << 16)]]
            good = ((x[i] * x[j]).sum(axis=1) >= cosine) & (i != j)
            i, j = i[good], j[good]
            edge = np.flatnonzero(np.concatenate([[True], i[1:] != i[:-1]])) if len(i) else np.empty(0, np.int64)
            for s, e in zip(edge.tolist(), [*edge[1:].tolist(), len(i)], strict=True) if len(i) else ():
                yield int(i[s]), j[s:e]


def _joined(cosine: float):
    """Rows sorted by (dim, cell, kind, i, j) -> (vec_id, root, links) of each group."""

    def search(key: tuple, batch: pa.Table) -> pa.RecordBatch:
        dim, _, kind, bi, bj = key
        x = unit_rows(batch.column("embedding").combine_chunks(), dim)
        ids, copies = batch.column("vec_id").to_numpy(), batch.column("copies").to_numpy()
        native, far, block = (batch.column(k).to_numpy() for k in ("native", "far", "block"))
        links, up = np.zeros(len(x), np.int64), np.arange(len(x))

        def roots(at: np.ndarray) -> np.ndarray:
            at = up[at]
            while (up[at] != at).any():
                at = up[at]
            return at

        # residents meet each other once and visitors once; visitors do not meet each other here
        left, right = (native, ~native) if kind else (block == bi, block == bj)
        for i, found in near_pairs(x, np.flatnonzero(left), np.flatnonzero(right), far, cosine):
            links[i] += copies[found].sum()
            if kind or bi != bj:
                links[found] += copies[i]
            trees = np.unique(roots(np.append(found, i)))
            up[trees] = trees[0]
            up[found], up[i] = trees[0], trees[0]
        keep = links > 0
        label = roots(np.arange(len(x)))
        first = np.full(len(x), np.iinfo(np.int64).max)
        np.minimum.at(first, label, ids)
        return pa.RecordBatch.from_arrays([pa.array(ids[keep]), pa.array(first[label[keep]]), pa.array(links[keep])], names=["vec_id", "root", "links"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in ("dim", "cell", "kind", "i", "j")], 1)
            edge = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]).any(axis=1)])).tolist()
            for s, e in zip(edge, [*edge[1:], len(keys)], strict=True):
                key = tuple(keys[s].tolist())
                if key != now and parts:
                    yield search(now, pa.Table.from_batches(parts))
                    parts = []
                now = key
                parts.append(batch.slice(s, e - s))
        if parts:
            yield search(now, pa.Table.from_batches(parts))

    return run


def _pivots(classes: DataFrame, most: dict[int, int], rows: dict[int, int]) -> list[Row]:
    """Rows of the first classes of each dimension in hash order, ``most`` of a dimension; each task sends its own first ones only."""
    few = [dim for dim, n in rows.items() if n <= most[dim]]
    order = [F.xxhash64("embedding"), F.col("vec_id")]
    found = classes.where(F.col("dim").isin(few)).orderBy("dim", *order).select("dim", "embedding").collect() if few else []
    for dim in sorted(set(rows) - set(few)):
        found += classes.where(F.col("dim") == dim).orderBy(*order).limit(most[dim]).select("dim", "embedding").collect()
    return found


def near_components(vectors: DataFrame, cosine: float = 0.95) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"  # half the bytes, the same values
    kind = "array<float>" if single else "array<double>"
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"))
    finite = F.coalesce(F.forall("embedding", lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False))) & F.exists("embedding", lambda v: v != 0.0), F.lit(False))
    good = vectors.where(finite & F.col("vec_id").isNotNull())
    classes = checkpoint(good.groupBy("embedding").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("copies")).withColumn("dim", F.size("embedding")))
    rows = {row.dim: row["count"] for row in classes.groupBy("dim").count().collect()}  # a row a dimension
    most = {dim: min(max(n * 8 * dim // CELL_BYTES, LEAST_CELLS), max(PIVOT_BYTES // (8 * dim), 1)) for dim, n in rows.items()}
    pivots: dict[int, list] = {}
    for row in _pivots(classes, most, rows):
        pivots.setdefault(row.dim, []).append(row.embedding)
    at = {dim: unit_rows(pa.array(own, pa.list_(pa.float64())), dim) for dim, own in pivots.items()}
    shared = spark.sparkContext.broadcast(at)
    r = float(np.sqrt(max(2 - 2 * cosine, 0)))
    spans = spark.sparkContext.broadcast(_spans(classes, shared, at))
    # Every class's home is known, but a cell's visitors have to be counted before they are cut into blocks.
    block_rows = F.greatest(F.lit(BLOCK_BYTES // 8) / F.col("dim"), F.lit(1.0))
    count = lambda native: F.ceil(F.count_if(F.col("native") == native) / F.first(block_rows)).cast("int")
    sizes = classes.mapInArrow(_dealt(shared, spans, r, False), "dim int, cell int, native boolean").groupBy("dim", "cell").agg(count(True).alias("residents"), count(False).alias("visitors"))
    sizes = F.broadcast(sizes.withColumnsRenamed({"dim": "_dim", "cell": "_cell"}))  # a row a pivot at most
    dealt = classes.mapInArrow(_dealt(shared, spans, r, True), f"dim int, cell int, native boolean, far double, vec_id long, copies long, embedding {kind}")
    d = dealt.join(sizes, (F.col("dim") == F.col("_dim")) & (F.col("cell") == F.col("_cell"))).where("residents > 0")
    d = d.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.when(F.col("native"), F.col("residents")).otherwise(F.col("visitors"))).cast("int"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    task = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"))
    among = F.transform(upto(F.col("residents")), lambda o: task(0, F.least("block", o), F.greatest("block", o)))
    hosts = F.transform(upto(F.col("visitors")), lambda o: task(1, F.col("block"), o))
    visits = F.transform(upto(F.col("residents")), lambda o: task(1, o, F.col("block")))
    d = d.withColumn("task", F.explode(F.when(F.col("native"), F.concat(among, hosts)).otherwise(visits)))
    keys = ["dim", "cell", "kind", "i", "j"]
    d = d.select("dim", "cell", "task.*", "block", "native", "far", "vec_id", "copies", "embedding")
    found = checkpoint(d.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_joined(cosine), "vec_id long, root long, links long"))
    components = connected_components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("vec_id").agg(F.sum("links").alias("links"))
    classes = classes.join(links.withColumnRenamed("vec_id", "_v"), F.col("vec_id") == F.col("_v"), "left").join(components, F.col("vec_id") == F.col("node"), "left")
    classes = classes.select(F.col("embedding").alias("_embedding"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"), F.coalesce("component", "vec_id").alias("low"))
    out = vectors.withColumn("_good", finite & F.col("vec_id").isNotNull())
    out = out.join(classes, F.col("_good") & (F.col("embedding") == F.col("_embedding")), "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("low", "vec_id"))
    return out.select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))


def query(vectors: DataFrame) -> DataFrame:
    return near_components(vectors)


SQL = r"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
g AS (SELECT vec_id, e FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM g a JOIN g b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.95),
r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT r.a AS vec_id, (SELECT count(*) FROM l WHERE l.a = r.a) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept FROM r GROUP BY r.a
"""
