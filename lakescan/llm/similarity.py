"""Operator 6, n-gram Jaccard join by T-occurrence search (DivideSkip).

A document's set is its distinct five-word shingles of lower-cased words, as 64-bit hashes. Two documents link when their
sets' Jaccard similarity is at least 80 %.

1. *Sets.* One pass over the whole texts gives each document its set's size and a 128-bit signature, and the keys of its
   shingles: the upper 40 bits of those hashes that lie in the lower 3/8. Documents of equal signature are one class. Keys
   are dealt by ranges of hashes, in chunks of documents as sorted steps and places (about five bytes a key), and there each
   is counted exactly over all documents. The counts go back to the chunks.
2. *Cells.* Sharing 80 % takes sharing one of the first 20 % of the shingles in any order common to all. The order is: keys
   by count, rarest first, then the other shingles by hash, for sets that have too few keys. So common passages do not bring
   documents together, however large the corpus; keys that two shingles share change the cost but not the result. A shingle
   that one document has alone links nothing and is left out. For the smaller of two sets even the first 11 % will do.
   Classes that share such a shingle and whose sizes allow a link are chained, and components of the chains are cells: no
   link leaves a cell. Shingles lie in sorted ranges, so one that very many classes share is cut, and the
   chain is closed over the seams.
3. *Search.* Inside a cell every class is a query against an inverted index of the others: short lists are merged and
   counted, and the candidates with enough hits are probed in the few long lists by binary search; those that reach the
   overlap that their two sizes ask for are links. Cells above a size are cut into blocks, and each pair of blocks is a
   task of its own. A task returns a spanning forest and a number of links for each class, never pairs.
4. *Components* of the forests, by alternating stars.

Defined results: null texts and texts without words have an empty set, link with nothing and are their own component;
texts of one to four words have one shingle, the whole sequence; rows that share doc_id are one document for the ids of
components, but each counts as a link; rows without doc_id get no component; an empty table gives an empty table.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint
from .graph import connected_components

N = 5
PERCENT = 80
KEYED = np.uint64(96 << 56)  # shingles whose hash is below, 3/8 of them, stand first in the order and have keys, which are counted
KEY_SHIFT = np.uint64(24)
BUCKETS = 1024
BUCKET_KEYS = np.uint64((96 << 32) // BUCKETS)
CHUNK_KEYS = 2_000_000
CHUNK = "chunk long, bucket int, keys binary, docs binary, extra binary"
BLOCK_SHINGLES = 1_000_000
LONG = 64  # lists of more documents are probed rather than merged
_MULTIPLIERS = [np.uint64(x | 1) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(text: str | bytes | None, n: int = N) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's n-word shingles; of the whole sequence where it has fewer words."""
    if not text:
        return np.empty(0, np.uint64)
    words = (text.encode() if isinstance(text, str) else text).lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    if len(words) < n:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), 1)], np.uint64)
    m = len(h) - n + 1
    out = h[:m] * _MULTIPLIERS[0]
    for k in range(1, n):
        out = _mixed(out) + h[k : k + m] * _MULTIPLIERS[k]
    return np.unique(_mixed(out))


def prefix_length(size: int, percent: int = PERCENT) -> int:
    """How many of a set's shingles, in a common order, a set with that share of overlap must meet."""
    return size - -(-size * percent // 100) + 1


def index_length(size: int, percent: int = PERCENT) -> int:
    """As ``prefix_length``, for partners that are not smaller."""
    return size - -(-2 * percent * size // (100 + percent)) + 1


def _texts(column: pa.Array) -> Iterator[bytes | None]:
    return iter(column.cast(pa.binary()).to_pylist())


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n, a, b) of all documents, and rows (bucket, chunk, keys, docs, extra) of chunks of documents.

    A chunk has each class once a task. Row -1 lists its nodes (high halves of signatures), the sizes of their sets and the
    numbers of their keys; row k from 0 on has the keys of bucket k, as steps, and the places of their documents; row -2 has
    the shingles, places and flags of prefixes that are longer than a document's keys.
    """
    seen, number = set(), 0
    chunk: list[tuple] = []  # (node, n, keys, rest)
    names = ["doc_id", "n", "a", "b", "chunk", "bucket", "keys", "docs", "extra"]

    def out() -> pa.RecordBatch:
        nodes, sizes = np.array([x[0] for x in chunk], np.int64), np.array([x[1] for x in chunk], np.int64)
        n_keys = np.array([len(x[2]) for x in chunk], np.int64)
        rows = [(-1, nodes.tobytes(), sizes.tobytes(), n_keys.tobytes())]
        rest = np.array([len(x[3]) for x in chunk], np.int64)
        if rest.any():
            at = np.repeat(np.arange(len(chunk), dtype=np.uint16), rest)
            rank = np.arange(len(at)) + (n_keys - (rest.cumsum() - rest))[at]
            rows.append((-2, np.concatenate([x[3] for x in chunk]).tobytes(), at.tobytes(), (rank < index_length(sizes[at])).tobytes()))
        keys = np.concatenate([x[2] for x in chunk])
        order = np.argsort(keys, kind="stable")
        keys, docs = keys[order], np.repeat(np.arange(len(chunk), dtype=np.uint16), n_keys)[order]
        ends = np.searchsorted(keys, np.arange(BUCKETS + 1, dtype=np.uint64) * BUCKET_KEYS)
        for k in np.flatnonzero(np.diff(ends)).tolist():
            own = slice(ends[k], ends[k + 1])
            rows.append((k, _steps(keys[own] - np.uint64(k) * BUCKET_KEYS), docs[own].tobytes(), None))
        none = pa.nulls(len(rows), pa.int64())
        at = np.full(len(rows), TaskContext.get().partitionId() << 32 | number, np.int64)
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.array(at), pa.array([r[0] for r in rows], pa.int32()), *(pa.array([r[k] for r in rows], pa.binary()) for k in (1, 2, 3))], names=names)

    n_keys = 0
    for batch in batches:
        ids, n, a, b = batch.column("doc_id"), [], [], []
        for text, known in zip(_texts(batch.column("text")), ids.is_valid().to_pylist(), strict=True):
            s = shingles(text)
            n.append(len(s))
            digest = xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0
            a.append((digest >> 64) - (1 << 63))
            b.append((digest & (1 << 64) - 1) - (1 << 63))
            if not known or not len(s) or a[-1] in seen:
                continue
            seen.add(a[-1])
            low = np.searchsorted(s, KEYED)
            keys = s[:low] >> KEY_SHIFT
            keys = keys[np.append(True, keys[1:] != keys[:-1])] if low else keys
            chunk.append((a[-1], len(s), keys, s[low : low + max(0, prefix_length(len(s)) - len(keys))]))
            n_keys += len(keys)
            if n_keys >= CHUNK_KEYS or len(chunk) > np.iinfo(np.uint16).max:
                yield out()
                chunk, n_keys, number = [], 0, number + 1
        none, nothing = pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary())
        yield pa.RecordBatch.from_arrays([ids, *(pa.array(x, pa.int64()) for x in (n, a, b)), none, none.cast(pa.int32()), nothing, nothing, nothing], names=names)
    if chunk:
        yield out()


def _steps(x: np.ndarray) -> bytes:
    """Ascending numbers of 32 bits as their differences, byte planes apart, so that zeros compress."""
    return np.diff(x.astype(np.uint32), prepend=np.uint32(0)).view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_steps(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(4, -1).T.copy().view(np.uint32).ravel().cumsum(dtype=np.uint32)


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[tuple]]]:
    """Rows sorted by their first column, those of one value at a time."""
    group, rows = None, []
    for batch in batches:
        for key, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if key != group:
                if rows:
                    yield group, rows
                group, rows = key, []
            rows.append(row)
    if rows:
        yield group, rows


def _common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, chunk, keys, docs) -> the keys that stand there more than once, for each chunk, and how often."""
    for bucket, rows in _groups(batches):
        keys = [_from_steps(r[1]) for r in rows]
        _, inverse, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        times = np.minimum(times, np.iinfo(np.uint16).max).astype(np.uint16)[inverse]
        end, found = 0, []
        for (chunk, _, docs), own in zip(rows, keys, strict=True):
            end, n = end + len(own), times[end : end + len(own)]
            keep = n > 1
            if keep.any():
                found.append((chunk, _steps(own[keep]), np.frombuffer(docs, np.uint16)[keep].tobytes(), n[keep].tobytes()))
        columns = list(zip(*found, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array([bucket] * len(found), pa.int32()), *(pa.array(x, pa.binary()) for x in columns[1:])], names=["chunk", "bucket", "keys", "docs", "extra"])


def _rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (chunk, bucket, keys, docs, extra) sorted by chunk -> (shingle, size, node), without keys that one document has alone."""
    for _, rows in _groups(batches):
        nodes, sizes, n_keys = (np.frombuffer(x, np.int64) for x in next(r[1:] for r in rows if r[0] == -1))
        for _, shingle, docs, indexed in (r for r in rows if r[0] == -2):
            at = np.frombuffer(docs, np.uint16)
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(shingle, np.int64)), pa.array(2 * sizes[at] + np.frombuffer(indexed, bool)), pa.array(nodes[at])], names=["shingle", "size", "node"])
        common = [r for r in rows if r[0] >= 0]
        if not common:
            continue
        keys = np.concatenate([_from_steps(k) + np.uint64(bucket) * BUCKET_KEYS for bucket, k, _, _ in common])
        docs, times = (np.concatenate([np.frombuffer(r[k], np.uint16) for r in common]) for k in (2, 3))
        order = np.lexsort((keys, times, docs))
        keys, docs = keys[order], docs[order]
        n = np.bincount(docs, minlength=len(nodes))
        # The keys that a document has alone stand first.
        rank = np.arange(len(docs)) + (n_keys - n - (n.cumsum() - n))[docs]
        keep = rank < prefix_length(sizes[docs])
        keys, docs, rank = keys[keep], docs[keep], rank[keep]
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(2 * sizes[docs] + (rank < index_length(sizes[docs]))), pa.array(nodes[docs])], names=["shingle", "size", "node"])


def _prefixes(measured: DataFrame) -> DataFrame:
    """(shingle, size, node) for the rarest shingles of each class; size is twice the set's, and one more in the index prefix.

    Shingles that no other document has are left out, as they link nothing.
    """
    chunks = measured.where("chunk IS NOT NULL").select("chunk", "bucket", "keys", "docs", "extra")
    common = chunks.where("bucket >= 0").select("bucket", "chunk", "keys", "docs").repartition("bucket").sortWithinPartitions("bucket")
    rows = common.mapInArrow(_common, CHUNK).unionByName(chunks.where("bucket < 0"))
    return rows.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_rarest, "shingle long, size long, node long")


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (kind 0: a, b), heads (kind 1) and the tail (kind 2) of a range of rows sorted by shingle, size and node.

    A row links to the last row before it that has the shingle in its index prefix, if the sizes allow a link. Any two
    rows that may link are connected by such steps, because the sizes between theirs allow them too. Where a shingle is
    cut by the range's beginning, its rows without such a row here are heads; the last indexed row is the tail.
    """
    part = TaskContext.get().partitionId()
    names = ["kind", "part", "shingle", "size", "a", "b"]

    def out(kind: int, keys: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        same = [np.full(len(a), x, np.int32) for x in (kind, part)]
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (*same, keys, sizes, a, b)], names=names)

    first, last = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, sizes, nodes = (batch.column(k).to_numpy() for k in ("shingle", "size", "node"))
        first = keys[0] if first is None else first
        new = np.ones(len(keys), bool)
        if last is not None:
            keys, sizes, nodes = (np.append(x, y) for x, y in zip(last, (keys, sizes, nodes), strict=True))
            new = np.append(False, new)
        indexed = np.flatnonzero(sizes & 1)
        before = np.searchsorted(indexed, np.arange(len(keys)), "left") - 1
        y = indexed[np.maximum(before, 0)] if len(indexed) else np.zeros(len(keys), np.int64)
        follows = (before >= 0) & (keys[y] == keys)
        edge = follows & (100 * (sizes[y] >> 1) >= PERCENT * (sizes >> 1)) & (nodes[y] != nodes)
        pairs = np.unique(np.stack([nodes[edge], nodes[y[edge]]], 1), axis=0)
        none = np.zeros(len(pairs), np.int64)
        yield out(0, none, none, pairs[:, 0], pairs[:, 1])
        head = new & (keys == first) & ~follows
        yield out(1, keys[head], sizes[head], nodes[head], nodes[head])
        if len(indexed):
            last = tuple(x[indexed[-1:]] for x in (keys, sizes, nodes))
    if last is not None:
        yield out(2, *last, last[2])


def _edges(prefixes: DataFrame) -> DataFrame:
    """(a, b) of the chains over ``prefixes`` (shingle, size, node), which lie in ranges, so that a hot shingle is cut.

    What the driver sees is a tail and a shingle a range. A range's heads follow the last tail before it of their shingle.
    """
    order = ["shingle", "size", "node"]
    chained = checkpoint(checkpoint(prefixes).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_chained, "kind int, part int, shingle long, size long, a long, b long"))
    tails = sorted((r.shingle, r.part, r.size, r.a) for r in chained.where("kind = 2").collect())
    seams = []
    for r in chained.where("kind = 1").select("part", "shingle").distinct().collect():
        k = bisect_left(tails, (r.shingle, r.part)) - 1
        if k >= 0 and tails[k][0] == r.shingle:
            seams.append((r.part, tails[k][2], tails[k][3]))
    edges = chained.where("kind = 0").select("a", "b")
    if not seams:
        return edges
    seam = F.broadcast(prefixes.sparkSession.createDataFrame(seams, "part int, size_before long, before long"))  # a row a range
    heads = chained.where("kind = 1").join(seam, "part")
    linked = heads.where((F.lit(100) * F.shiftright("size_before", 1) >= PERCENT * F.shiftright("size", 1)) & (F.col("before") != F.col("a")))
    return edges.unionByName(linked.select("a", F.col("before").alias("b")))


def _merged(owner: np.ndarray, begin: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """How often each of ``n`` owners stands in the lists ``owner[begin : begin + length]``."""
    at = np.repeat(begin - (length.cumsum() - length), length) + np.arange(length.sum())
    return np.bincount(owner[at], minlength=n)


def divide_skip(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, percent: int = PERCENT) -> Iterator[tuple[int, np.ndarray]]:
    """For each query in ``left`` the indexed sets in ``right`` that link with it.

    ``sets`` are sorted distinct hashes. Overlap needed by sizes x and y is ceil(p (x + y) / (100 + p)); partners have a
    size from p % of x to x / p %. At least ceil(p x / 100) hits are needed of any partner: that is T of the T-occurrence
    problem. Long lists are set aside, T - 1 at most, and the others are merged; partners with T less that number of hits
    are probed for in the long lists by binary search, or counted there too where that takes fewer steps.
    """
    sizes = np.array([len(s) for s in sets], np.int64)
    right = right[np.argsort(sizes[right], kind="stable")]
    keys = np.concatenate([sets[j] for j in right]) if len(right) else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(right)), sizes[right])
    order = np.argsort(keys, kind="stable")
    keys, owner = keys[order], owner[order]
    own_sizes = sizes[right]
    pairs = np.searchsorted(keys, keys, "left") * len(right) + owner
    for i in left.tolist():
        s = sets[i]
        x = len(s)
        need_least = -(-percent * x // 100)
        lo, hi = np.searchsorted(own_sizes, [need_least, x * 100 // percent + 1])
        if lo >= hi or not x:
            yield i, np.empty(0, np.int64)
            continue
        begin, end = np.searchsorted(keys, s, "left"), np.searchsorted(keys, s, "right")
        length = end - begin
        n_long = min(need_least - 1, int((length > LONG).sum()))
        by_length = np.argsort(length, kind="stable") if n_long else np.arange(x)
        short, long = by_length[: x - n_long], by_length[x - n_long :]
        hits = _merged(owner, begin[short], length[short], len(right))
        found = np.flatnonzero(hits[lo:hi] >= need_least - n_long) + lo
        total = hits[found]
        need = -(-percent * (x + own_sizes[found]) // (100 + percent))
        if n_long and len(found):
            if len(found) * n_long < length[long].sum():
                # owners are sorted within a list, so (list, owner) pairs are sorted as a whole
                probe = (begin[long][:, None] * len(right) + found[None, :]).ravel()
                p = np.searchsorted(pairs, probe)
                total = total + (pairs[np.minimum(p, len(pairs) - 1)] == probe).reshape(n_long, -1).sum(axis=0)
            else:
                total = total + _merged(owner, begin[long], length[long], len(right))[found]
        yield i, right[found[total >= need]]


def _searched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, i, j, block, node, copies, shingles) sorted by (cell, i, j) -> (node, root, links) of each group."""
    group, rows = None, []

    def search(group: tuple, rows: list) -> pa.RecordBatch:
        _, i, j = group
        rows = list({r[1]: r for r in rows}.values())  # rows that share id and text come several times
        node = np.array([r[1] for r in rows], np.int64)
        block = np.array([r[0] for r in rows])
        copies = np.array([r[2] for r in rows], np.int64)
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        left = np.flatnonzero(block == i)
        right = left if i == j else np.flatnonzero(block == j)
        links, up = np.zeros(len(rows), np.int64), np.arange(len(rows))

        def roots(at: np.ndarray) -> np.ndarray:
            at = up[at]
            while (up[at] != at).any():
                at = up[at]
            return at

        for q, found in divide_skip(sets, left, right):
            found = found[found != q]
            links[q] += copies[found].sum()
            if i != j:
                links[found] += copies[q]
            both = np.append(found, q)
            trees = np.unique(roots(both))
            up[trees] = trees[0]
            up[both] = trees[0]
        keep = links > 0
        return pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(node[roots(np.flatnonzero(keep))]), pa.array(links[keep])], names=["node", "root", "links"])

    for batch in batches:
        cells, is_, js = (batch.column(k).to_pylist() for k in ("cell", "i", "j"))
        blocks, nodes, copies, sets = (batch.column(k).to_pylist() for k in ("block", "node", "copies", "shingles"))
        for key in zip(cells, is_, js, blocks, nodes, copies, sets, strict=True):
            if key[:3] != group:
                if len(rows) > 1:
                    yield search(group, rows)
                group, rows = key[:3], []
            rows.append(key[3:])
    if len(rows) > 1:
        yield search(group, rows)


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The shingles of each row's text, where they still have the row's signature."""
    for batch in batches:
        sets = [shingles(t) for t in _texts(batch.column("text"))]
        same = [bool(len(s)) and (xxhash.xxh3_128_intdigest(s.tobytes()) >> 64) - (1 << 63) == n for s, n in zip(sets, batch.column("node").to_pylist(), strict=True)]
        out = pa.RecordBatch.from_arrays([batch.column("cell"), batch.column("blocks"), batch.column("block"), batch.column("node"), batch.column("copies"), pa.array([s.tobytes() for s in sets], pa.binary())], names=["cell", "blocks", "block", "node", "copies", "shingles"])
        yield out.filter(pa.array(same))


def jaccard_components(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, n_links) for each row of ``docs`` (doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    measured = checkpoint(docs.mapInArrow(_measured, f"doc_id long, n long, a long, b long, {CHUNK}"))
    rows = measured.where("n IS NOT NULL").select("doc_id", "n", "a", "b")
    classes = rows.where("n > 0 AND doc_id IS NOT NULL").groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.first("n").alias("n"))
    cells = checkpoint(connected_components(_edges(_prefixes(measured))))
    # A node is half a signature; classes that share it merely come into one cell together.
    member = classes.join(cells, F.col("a") == F.col("node")).select("node", F.col("component").alias("cell"), "rep", "copies", "n")
    sizes = member.groupBy("cell").agg(F.sum("n").alias("total")).select(F.col("cell").alias("_cell"), F.ceil(F.col("total") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    member = member.join(sizes, F.col("cell") == F.col("_cell")).drop("_cell").withColumn("block", F.pmod(F.xxhash64("node"), "blocks").cast("int"))
    sets = docs.join(member, F.col("doc_id") == F.col("rep")).select("text", "cell", "blocks", "block", "node", "copies").mapInArrow(_sets, "cell long, blocks int, block int, node long, copies long, shingles binary")
    # Block k meets every block: as i of the pairs (k, j) with j >= k, as j of the pairs (i, k) with i < k.
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = sets.withColumn("o", other).select("cell", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"), "block", "node", "copies", "shingles")
    found = checkpoint(dealt.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j").mapInArrow(_searched, "node long, root long, links long"))
    components = connected_components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    linked = classes.join(links, F.col("a") == F.col("node")).drop("node").join(components, F.col("a") == F.col("node"))
    lowest = linked.groupBy("component").agg(F.min("rep").alias("low"))
    linked = linked.join(lowest, "component").select(F.col("a").alias("_a"), F.col("b").alias("_b"), "low", "links")
    classes = classes.join(linked, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")), "left").select(F.col("a").alias("_a"), F.col("b").alias("_b"), F.coalesce("low", "rep").alias("low"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    # Written first, so that both sides are shuffled for the join and a class of very many copies can be split.
    classes = checkpoint(classes)
    out = rows.join(classes, (F.col("a") == F.col("_a")) & (F.col("b") == F.col("_b")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("low", "doc_id")).alias("component_id"), F.coalesce("links", F.lit(0)).alias("n_links"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that are their component's smallest id; rows without doc_id stay."""
    found = jaccard_components(docs).where("component_id = doc_id").select(F.col("doc_id").alias("_id")).distinct()
    kept = docs.join(found, docs["doc_id"] == found["_id"], "left_semi")
    return kept.unionByName(docs.where("doc_id IS NULL"))


def query(docs: DataFrame) -> DataFrame:
    return jaccard_components(docs)


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS g FROM d),
e AS (SELECT doc_id, unnest(g) AS x FROM s),
n AS (SELECT doc_id, len(g) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT n.doc_id, n.n::BIGINT AS n_shingles, min(r.b) AS component_id, (SELECT count(*) FROM l WHERE l.a = n.doc_id) AS n_links
FROM n JOIN r ON r.a = n.doc_id GROUP BY n.doc_id, n.n
"""
