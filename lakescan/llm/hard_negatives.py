"""Operator 13, hard negatives by an inverted multi-index with certified windows.

Vectors become integers, and equal rows one. Two codebooks, one for each half of the dimensions and fitted on a bounded
sample, form a grid of cells: a row's cell is its nearest codeword of either half. Cells know their number of rows and how
far their rows lie from either codeword at most, so the score of a query q with any row of cell (i, j) is at most the sum of the
half-scores q1 c_i + |q1| r_i and q2 c_j + |q2| r_j, with r the radii of the codewords. A query's cells are visited by
multi-sequence: both halves' codewords sorted by their half-scores, a heap over pairs yields the cells by falling sum. The search
stops when no later cell can change the windows that are wanted: exact scores decide, and ties go to smaller ids.

Cells lie in shards of bounded bytes, in grid order, large cells in several of them; a shard is the memory of one task,
and query vectors stream through it. Each shard answers for its own rows: its first positives of each query, and, with the
exact positives known, its first negatives in each positive's window. Shards' answers merge by a window per query that keeps
ten rows or fewer, so results are exact whatever codebooks were fitted; a shard whose bounds fall below what the
queries' nearest shard has already found gets no copy of the query.

Rows that share vector and label can differ in their ids only, and lists are filled by smaller ids first: of such a group,
its smallest ids, as many as a list can take and the query itself, are all that any list can hold. A vector that a third of all rows have
so costs what one row costs.

Defined results: rows with a null label, vector, id or component, with NaN or infinity, without any dimension, or with
components so large that a score could pass 64 bits take no part; vectors of other dimensions than the query's do not
meet it; rows that repeat id, label and vector are one; rows that share an id alone are rows of their own, but no partners of
each other and one query each; a query without another row of its label has no positives and no rows; an empty table gives an empty
table; further columns do not matter.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

SAMPLE_ROWS = 16_384
CODEWORDS_MOST = 256
CELL_ROWS = 128
SHARD_BYTES = 4 << 20
SHARD_BYTES_MOST = 64 << 20
SHARDS_WANTED = 256
BLOCK_QUERIES = 1 << 16
BATCH_ROWS = 2048
SCALE = 256


class Rules(NamedTuple):
    n_positives: int = 5
    n_negatives: int = 10
    low: int = 30
    high: int = 90  # low * positive <= 100 * score <= high * positive


# ------------------------------------------------------------------ rows


def integer_rows(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, q, dim): rows that take part, with vectors of integers."""
    d = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("e")).where("vec_id IS NOT NULL AND label IS NOT NULL AND size(e) > 0")
    scaled = F.transform("e", lambda x: F.floor(x * F.lit(float(SCALE))).cast("int"))
    fits = F.forall("e", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < (1 << 31) / SCALE), F.lit(False)))
    # Filters may be merged, so the cast has to be guarded on its own.
    d = d.select("vec_id", "label", F.when(fits, scaled).alias("q"), F.size("e").alias("dim"))
    largest = F.array_max(F.transform("q", lambda x: F.abs(x.cast("double"))))
    return d.where(largest * largest * F.col("dim") < float(1 << 62))


def relabelled(vectors: DataFrame, every: int = 7, labels: int = 10) -> DataFrame:
    """Every seventh row under the next label, as the query wants it."""
    return vectors.withColumn("label", F.when(F.col("vec_id") % every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label")))


def kept_rows(rows: DataFrame, rules: Rules) -> DataFrame:
    """Of the rows of equal vector and label those of the smallest ids, as many as lists can hold."""
    w = Window.partitionBy("q", "label").orderBy("vec_id")
    most = max(rules.n_positives, rules.n_negatives) + 1
    return rows.dropDuplicates(["vec_id", "label", "q"]).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= most).drop("_k")


# ------------------------------------------------------------------ index


class Grid(NamedTuple):
    """The codebooks of one dimension, their radii, and where cells lie."""

    half: int
    books: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    shard_of: dict[tuple[int, int], tuple[int, int]]  # cell -> its first shard and its number of shards


def codebook(x: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """k-means over the distinct vectors of a sample; starts are spread over their order along the widest axis."""
    x = np.unique(x.astype(np.float64), axis=0)
    k = min(k, len(x))
    if not x.shape[1]:
        return x[:1]
    order = np.argsort(x[:, x.var(axis=0).argmax()], kind="stable")
    c = x[order[(np.arange(k) * len(x)) // k]].copy()
    for _ in range(rounds):
        own = nearest(x, c)[0]
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, own, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(codeword, distance) of each row."""
    own = ((c * c).sum(axis=1)[None, :] - 2 * (x @ c.T)).argmin(axis=1)
    return own, np.sqrt(((x - c[own]) ** 2).sum(axis=1))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def _placed(books):
    """Rows with their cell and their distances from its codewords."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = matrix(part.column("q"), dim).astype(np.float64)
                half, c1, c2 = books.value[dim]
                (i, di), (j, dj) = nearest(x[:, :half], c1), nearest(x[:, half:], c2)
                more = [pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(di), pa.array(dj)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=[*part.schema.names, "i", "j", "di", "dj"])

    return run


def build_index(rows: DataFrame) -> tuple[DataFrame, dict[int, Grid]]:
    """The rows with their cells, written, and the grid of each dimension, at most CODEWORDS_MOST squared cells each."""
    sc = rows.sparkSession.sparkContext
    books = {}
    sizes = {r.dim: r["count"] for r in rows.groupBy("dim").count().collect()}  # a row a dimension
    for dim, n in sizes.items():
        sample = rows.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id", "q")).limit(SAMPLE_ROWS).select("q").toArrow().column("q").combine_chunks()
        x, half = matrix(sample, dim), (dim + 1) // 2
        k = int(min(max(np.sqrt(n / CELL_ROWS), 1), CODEWORDS_MOST))
        books[dim] = (half, codebook(x[:, :half], k), codebook(x[:, half:], k))
    types = "vec_id long, label long, q array<int>, dim int, i int, j int, di double, dj double"
    placed = checkpoint(rows.select("vec_id", "label", "q", "dim").mapInArrow(_placed(sc.broadcast(books)), types))
    cells = placed.groupBy("dim", "i", "j").agg(F.count("*").alias("n"), F.max("di").alias("di"), F.max("dj").alias("dj")).collect()  # a row a cell, bounded as above
    grids = {}
    for dim, (half, c1, c2) in books.items():
        own = sorted((r for r in cells if r.dim == dim), key=lambda r: (r.i, r.j))
        radii = (np.zeros(len(c1)), np.zeros(len(c2)))
        for r in own:
            radii[0][r.i], radii[1][r.j] = max(radii[0][r.i], r.di), max(radii[1][r.j], r.dj)
        bytes_ = 4 * dim
        rows_most = int(max(min(max(SHARD_BYTES, sizes[dim] * bytes_ // SHARDS_WANTED), SHARD_BYTES_MOST) // bytes_, 1))
        shard_of, shard, filled = {}, 0, 0
        for r in own:
            if filled and filled + r.n > rows_most:
                shard, filled = shard + 1, 0
            parts = -(-r.n // rows_most)
            shard_of[r.i, r.j] = (shard, parts)
            if parts > 1:
                shard, filled = shard + parts, 0
            else:
                filled += r.n
        grids[dim] = Grid(half, (c1, c2), radii, shard_of)
    return placed, grids


# ------------------------------------------------------------------ search


def half_scores(grid: Grid, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Upper bounds of the half-scores of query q (or of each row of q) with the rows of each codeword."""
    parts = (q[..., : grid.half], q[..., grid.half :])
    return tuple(p @ c.T + np.sqrt((p * p).sum(axis=-1))[..., None] * r for p, c, r in zip(parts, grid.books, grid.radii, strict=True))


def multi_sequence(u: np.ndarray, v: np.ndarray) -> Iterator[tuple[int, int, float]]:
    """(a, b, u[a] + v[b]) of all pairs by falling sum; a pair enters the heap when both its predecessors have left it."""
    su, sv = np.argsort(-u, kind="stable"), np.argsort(-v, kind="stable")
    pu, pv = u[su].tolist(), v[sv].tolist()
    heap = [(-(pu[0] + pv[0]), 0, 0)]
    upto = [0] * len(pu)  # how many of its row have left the heap
    while heap:
        bound, a, b = heapq.heappop(heap)
        yield int(su[a]), int(sv[b]), -bound
        upto[a] = b + 1
        if b + 1 < len(pv) and (a == 0 or upto[a - 1] > b + 1):
            heapq.heappush(heap, (-(pu[a] + pv[b + 1]), a, b + 1))
        if a + 1 < len(pu) and upto[a + 1] == b:
            heapq.heappush(heap, (-(pu[a + 1] + pv[b]), a + 1, b))


class Shard:
    """The rows of a shard by cell, and the parts of its dimension's grid that it has."""

    def __init__(self, grid: Grid, dim: int, tables: list[pa.RecordBatch]) -> None:
        t = pa.Table.from_batches(tables).combine_chunks()
        get = lambda name: t.column(name).combine_chunks().to_numpy(zero_copy_only=False)
        order = np.lexsort((get("vec_id"), get("j"), get("i")))
        i, j = get("i")[order], get("j")[order]
        self.ids, self.labels = get("vec_id")[order], get("label")[order]
        x = matrix(t.column("q").combine_chunks(), dim)[order]
        self.largest = float(np.abs(x.astype(np.float64)).max())
        self.dim, self.grid, self.x = dim, grid, x
        edge = np.flatnonzero(np.append(True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])))
        self.cells = {(int(i[a]), int(j[a])): (int(a), int(b)) for a, b in zip(edge, np.append(edge[1:], len(i)), strict=True)}
        self.own = (np.unique(i), np.unique(j))
        self.floats: np.ndarray | None = None

    def scores(self, q: np.ndarray, spans: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
        """(rows, exact scores) of the rows in some spans."""
        rows = np.concatenate([np.arange(a, b) for a, b in spans])
        if self.largest * float(np.abs(q).max()) * self.dim < 1 << 53:  # exact in doubles
            return rows, (self.x[rows].astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
        return rows, (self.x[rows].astype(np.int64) * q).sum(axis=1)

    def visits(self, q: np.ndarray, floor, top: float | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, scores) in portions of cells by falling bound, while the next bound reaches floor(), which may rise meanwhile.

        Cells whose scores all lie over ``top`` are passed over.
        """
        qf = q.astype(np.float64)
        u, v = half_scores(self.grid, qf)
        slack = 1e-9 * (np.abs(u).max() + np.abs(v).max()) + 1e-6
        parts = (qf[: self.grid.half], qf[self.grid.half :])
        width = [2 * np.sqrt((p * p).sum()) * r for p, r in zip(parts, self.grid.radii, strict=True)]
        us, vs = u[self.own[0]], v[self.own[1]]
        spans: list[tuple[int, int]] = []
        held = 0
        for a, b, bound in multi_sequence(us, vs):
            if bound + slack < floor():
                break
            i, j = int(self.own[0][a]), int(self.own[1][b])
            span = self.cells.get((i, j))
            if span is None or top is not None and bound - width[0][i] - width[1][j] - slack > top:
                continue
            spans.append(span)
            held += span[1] - span[0]
            if held >= BATCH_ROWS:
                yield self.scores(q, spans)
                spans, held = [], 0
        if spans:
            yield self.scores(q, spans)


class First:
    """The first k of the rows shown, by falling score and rising id."""

    def __init__(self, k: int) -> None:
        self.k, self.score, self.id = k, np.empty(0, np.int64), np.empty(0, np.int64)

    def show(self, score: np.ndarray, ids: np.ndarray) -> None:
        if len(self.score) == self.k:
            keep = score >= self.score[-1]
            score, ids = score[keep], ids[keep]
        if not len(score):
            return
        score, ids = np.append(self.score, score), np.append(self.id, ids)
        best = np.lexsort((ids, -score))[: self.k]
        self.score, self.id = score[best], ids[best]

    def last(self) -> float:
        """What a row must reach to enter the list."""
        return float(self.score[-1]) if len(self.score) == self.k else -np.inf


def positives(shard: Shard, vec_id: int, label: int, q: np.ndarray, rules: Rules, floor: float = -np.inf) -> First:
    best = First(rules.n_positives)
    for rows, scores in shard.visits(q, lambda: max(best.last(), floor)):
        own = (shard.labels[rows] == label) & (shard.ids[rows] != vec_id)
        best.show(scores[own], shard.ids[rows[own]])
    return best


def _up(a: int, b: int) -> int:
    return -(-a // b)


def negatives(shard: Shard, vec_id: int, label: int, q: np.ndarray, scores_: list[int], rules: Rules, floors: list[int]) -> list[First]:
    """The first negatives of the window of each distinct positive score."""
    lows = [max(_up(rules.low * p, 100), f) for p, f in zip(scores_, floors, strict=True)]
    highs = [rules.high * p // 100 for p in scores_]
    lists = [First(rules.n_negatives) for _ in scores_]
    open_ = [k for k in range(len(scores_)) if lows[k] <= highs[k]]
    if not open_:
        return lists
    for rows, s in shard.visits(q, lambda: min(max(lists[k].last(), lows[k]) for k in open_), max(highs[k] for k in open_)):
        other = (shard.labels[rows] != label) & (shard.ids[rows] != vec_id)
        s, ids = s[other], shard.ids[rows[other]]
        for k in open_:
            inside = (s >= lows[k]) & (s <= highs[k])
            lists[k].show(s[inside], ids[inside])
    return lists


HIT = "query long, vec_id long, label long, kth int, positive_score long, score long, other long"
HIT_TYPES = pa.schema([("query", pa.int64()), ("vec_id", pa.int64()), ("label", pa.int64()), ("kth", pa.int32()), ("positive_score", pa.int64()), ("score", pa.int64()), ("other", pa.int64())])


def _searched(grids, rules: Rules):
    """Rows sorted by (dim, shard, block, kind), a shard's rows before its queries -> hits of each query in each shard."""

    def asked(shard: Shard, batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        q_all = matrix(batch.column("q"), shard.dim).astype(np.int64)
        columns = [batch.column(c).to_pylist() for c in ("query", "vec_id", "label", "wanted", "floors")]
        for q, query_, vec_id, label, wanted, floors in zip(q_all, *columns, strict=True):
            if wanted is None:
                best = positives(shard, vec_id, label, q, rules, -np.inf if not floors else floors[0])
                out += [(query_, vec_id, label, 0, 0, s, o) for s, o in zip(best.score.tolist(), best.id.tolist(), strict=True)]
            else:
                for k, (p, best) in enumerate(zip(wanted, negatives(shard, vec_id, label, q, wanted, rules, floors), strict=True)):
                    out += [(query_, vec_id, label, k, p, s, o) for s, o in zip(best.score.tolist(), best.id.tolist(), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*out, strict=True)) or [[]] * len(HIT_TYPES), HIT_TYPES.types, strict=True)], schema=HIT_TYPES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows, shard = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(k).to_numpy() for k in ("dim", "shard", "block", "kind")], 1)
            edge = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]).any(axis=1))).tolist()
            for a, b in zip(edge, [*edge[1:], len(keys)], strict=True):
                key, part = tuple(keys[a, :3].tolist()), batch.slice(a, b - a)
                if key != now:
                    now, rows, shard = key, [], None
                if keys[a, 3] == 0:
                    rows.append(part)
                elif rows or shard:
                    if shard is None:
                        shard, rows = Shard(grids.value[key[0]], key[0], rows), []
                    yield asked(shard, part)

    return run


def _routed(grids, rules: Rules, home_only: bool):
    """Each query with the shards it has to visit: the one of its best cells, or all whose bounds reach what it wants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables: dict[int, tuple] = {}
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                grid: Grid = grids.value[dim]
                if dim not in tables:
                    cells = list(grid.shard_of)
                    first = np.array([s for s, _ in grid.shard_of.values()])
                    tables[dim] = (np.array([i for i, _ in cells]), np.array([j for _, j in cells]), first, np.array([n for _, n in grid.shard_of.values()]))
                i, j, first, n = tables[dim]
                x = matrix(part.column("q"), dim).astype(np.float64)
                wanted, floors = part.column("wanted").to_pylist(), part.column("floors").to_pylist()
                at, shards = [], []
                for k in range(len(x)):
                    u, v = half_scores(grid, x[k])
                    bound = u[i] + v[j]
                    if home_only:
                        best = int(bound.argmax())
                        found = {int(first[best])}
                    else:
                        slack = 1e-9 * (np.abs(u).max() + np.abs(v).max()) + 1e-6
                        low = -np.inf if not floors[k] else min(floors[k])
                        if wanted[k]:
                            low = max(low, min(_up(rules.low * p, 100) for p in wanted[k]))
                        near = np.flatnonzero(bound + slack >= low)
                        found = {s + m for s, c in zip(first[near].tolist(), n[near].tolist(), strict=True) for m in range(c)}
                    at += [k] * len(found)
                    shards += sorted(found)
                out = part.take(pa.array(at, pa.int32()))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(shards, pa.int32())], names=[*out.schema.names, "shard"])

    return run


ASKED = ["dim", "query", "vec_id", "label", "q", "wanted", "floors"]
ASKED_TYPES = "dim int, query long, vec_id long, label long, q array<int>, wanted array<long>, floors array<long>"


def _search(placed: DataFrame, queries: DataFrame, grids, rules: Rules, n_blocks: int, home_only: bool = False) -> DataFrame:
    """Hits of all queries in their shards, written."""
    cells = {(d, i, j): v for d, g in grids.value.items() for (i, j), v in g.shard_of.items()}
    spark = placed.sparkSession
    where = spark.createDataFrame([(d, i, j, s, n) for (d, i, j), (s, n) in cells.items()], "_d int, _i int, _j int, first int, parts int")
    rows = placed.join(F.broadcast(where), (F.col("dim") == F.col("_d")) & (F.col("i") == F.col("_i")) & (F.col("j") == F.col("_j")))  # a row a cell at most
    none = lambda kind: F.lit(None).cast(kind)
    rows = rows.select("dim", (F.col("first") + F.pmod(F.xxhash64("vec_id", "label"), F.col("parts"))).cast("int").alias("shard"), F.lit(0).alias("kind"), none("long").alias("query"), "vec_id", "label", "q", none("array<long>").alias("wanted"), none("array<long>").alias("floors"), "i", "j")
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))
    asked = queries.select(*ASKED).mapInArrow(_routed(grids, rules, home_only), ASKED_TYPES + ", shard int")
    asked = asked.withColumns({"kind": F.lit(1), "i": F.lit(0), "j": F.lit(0), "block": F.pmod(F.xxhash64("query"), F.lit(n_blocks)).cast("int")})
    keys = ["dim", "shard", "block"]
    both = rows.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "kind")
    return checkpoint(both.mapInArrow(_searched(grids, rules), HIT))


def _firsts(hits: DataFrame, n: int) -> DataFrame:
    w = Window.partitionBy("query", "kth").orderBy(F.desc("score"), F.asc("other"))
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def mine(vectors: DataFrame, is_query: Column, rules: Rules = Rules()) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for each query row and positive. ``vectors`` has vec_id, label and embedding."""
    sc = vectors.sparkSession.sparkContext
    rows = integer_rows(vectors)
    placed, found = build_index(kept_rows(rows, rules))
    grids = sc.broadcast(found)
    none = F.lit(None).cast("array<long>")
    anchors = rows.where(is_query).dropDuplicates(["vec_id", "label", "q"]).select("dim", F.monotonically_increasing_id().alias("query"), "vec_id", "label", "q")
    anchors = checkpoint(anchors)
    n_blocks = max(-(-anchors.count() // BLOCK_QUERIES), 1)
    plain = anchors.select("*", none.alias("wanted"), none.alias("floors"))

    def floors(hits: DataFrame, n: int) -> DataFrame:
        """The score that the n-th of each list has so far, where it has n."""
        return _firsts(hits, n).where(F.col("rank") == n).select(F.col("query").alias("_query"), "kth", F.col("score").alias("floor"))

    # Positives: what the home shard has found bounds what the others can add.
    home = _search(placed, plain, grids, rules, n_blocks, home_only=True)
    known = floors(home, rules.n_positives)
    asked = anchors.join(known, F.col("query") == F.col("_query"), "left").select(*anchors.columns, none.alias("wanted"), F.when(F.col("floor").isNotNull(), F.array("floor")).alias("floors"))
    best = checkpoint(_firsts(_search(placed, asked, grids, rules, n_blocks), rules.n_positives).select("query", F.col("rank").alias("place"), F.col("other").alias("positive_id"), F.col("score").alias("positive_score")))
    # Negatives: one window for each distinct score of a query's positives.
    wanted = best.groupBy(F.col("query").alias("_query")).agg(F.sort_array(F.collect_set("positive_score")).alias("wanted"))  # a list's length at most
    asked = anchors.join(wanted, F.col("query") == F.col("_query")).select(*anchors.columns, "wanted", F.transform("wanted", lambda p: F.lit(-(1 << 63)).cast("long")).alias("floors"))
    asked = checkpoint(asked)
    home = _search(placed, asked, grids, rules, n_blocks, home_only=True)
    known = floors(home, rules.n_negatives).groupBy("_query").agg(F.map_from_entries(F.collect_list(F.struct("kth", "floor"))).alias("known"))
    better = F.transform("wanted", lambda p, k: F.coalesce(F.element_at("known", k), F.lit(-(1 << 63)).cast("long")))
    asked = asked.join(known, F.col("query") == F.col("_query"), "left").select(*anchors.columns, "wanted", better.alias("floors"))
    hits = _firsts(_search(placed, asked, grids, rules, n_blocks), rules.n_negatives)
    hits = hits.select("query", F.col("vec_id").alias("anchor_id"), F.col("positive_score").alias("_p"), "rank", F.col("other").alias("negative_id"), F.col("score").alias("negative_score"))
    best = best.select(F.col("query").alias("_query"), "positive_id", "positive_score")
    out = hits.join(best, (F.col("query") == F.col("_query")) & (F.col("_p") == F.col("positive_score")))
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def query(vectors: DataFrame) -> DataFrame:
    return mine(relabelled(vectors.select("vec_id", "embedding", "label")), F.col("vec_id") % 100 == 0)


SQL = r"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank, other AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * score AND 100 * score <= 90 * positive_score
QUALIFY rank <= 10
"""
