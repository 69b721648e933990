"""Operator 12, phrase collocations from depth-truncated suffix trees, by vertical partitioning.

A piece is what stands between two of ``[.,;:!?\\x0A-\\x0D]``; at each of its words begins a suffix, truncated to
``depth`` words. All counts are totals of leaves of the trees of these suffixes, one tree a language:

1. Prefixes are counted, all words first; a prefix that more suffixes share than ``BUDGET`` is extended by a word and
   counted again, until none is above it or it has ``depth`` words. Prefixes are known by 64-bit hashes here, which decide
   only where a suffix goes.
2. In the order of their hashes, prefixes are grouped so that a group has ``BUDGET`` suffixes at most, unless one whole
   phrase has more, which its tasks count before they send it. A group is named by the hash at which it begins.
3. Tasks cut texts into suffixes, leave out what begins with a word seen less than ``least`` times, cut suffixes before
   such a word (a bit table of bounded size tells them; it errs only towards keeping), count equal ones and send them to their
   groups in blocks with the words they use. Each group's subtree is built on its own by sorting its suffixes; the
   totals of inner nodes are sums of leaves. Nodes above an extension get their total from several groups, by a sum.

What is broadcast is bounded: the bit table has ``TABLE_BITS`` bits at most, and extended prefixes and groups are at most
``GROUPS`` each, as the budget grows where a corpus would need more. Blocks have ``BLOCK_SUFFIXES`` suffixes at most.
The first ``most`` of a language are taken in rounds over shares of its candidates, so that no task has them all.

Defined results: a null text counts as empty, a null language as ``und``; repeated rows count each; empty texts and pieces
have no words; ties are broken by score, count and phrase in the order of UTF-8 bytes; an empty table gives an empty table;
columns other than text and lang do not matter. Scores are integers and exact while n stays below 10^15.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint

BREAK = re.compile(rb"[.,;:!?\n-\r]")
BUDGET = 1 << 21
GROUPS = 1 << 21
TABLE_BITS = 1 << 27
BATCH_WORDS = 1 << 20
BATCH_BYTES = 16 << 20
BLOCK_SUFFIXES = 1 << 14
SHARE = 20_000
UNKNOWN = "und"
NONE = np.uint64(0)


def pieces(text: bytes | None, upto: int = 1 << 20) -> Iterator[list[list[bytes]]]:
    """The pieces of a text as lists of words, in portions cut between pieces."""
    text, at = text or b"", 0
    while at < len(text):
        cut = BREAK.search(text, at + upto)
        end = cut.end() if cut else len(text)
        # split() parts at white space; all of it but blank and tab has been taken as breaks
        yield [w for w in map(bytes.split, BREAK.split(text[at:end].lower())) if w]
        at = end


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _extended(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The hashes of prefixes with one word more."""
    return _mixed(prefix * np.uint64(0xD6E8FEB86659FD93) + word)


class Suffixes:
    """The suffixes of a batch of pieces of one language: ``ids`` (n, depth) into ``words``, -1 past their end."""

    def __init__(self, lang: str, found: list[list[bytes]], depth: int) -> None:
        table: dict[bytes, int] = {}
        flat = [table.setdefault(w, len(table)) for piece in found for w in piece]
        ends = np.cumsum([len(piece) for piece in found])
        n = len(flat)
        left = np.repeat(ends, [len(piece) for piece in found]) - np.arange(n)  # words up to the end of the piece
        line = np.concatenate([np.array(flat, np.int64), np.full(depth, -1)])
        self.lang, self.words = lang, list(table)
        self.ids = np.stack([np.where(left > k, line[k : k + n], -1) for k in range(depth)], 1)
        self.hashes = np.array([xxhash.xxh3_64_intdigest(w, seed=xxhash.xxh32_intdigest(lang)) | 1 for w in self.words], np.uint64)

    def prefixes(self, extended: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """(hash, level) of the prefix that places each suffix: extended as often as the tables say. Level counts from 0."""
        h = _mixed(self.hashes[self.ids[:, 0]])
        level = np.zeros(len(h), np.int8)
        for k, known in enumerate(extended):
            more = np.flatnonzero((level == k) & _among(h, known))
            nxt = self.ids[more, k + 1]
            # A suffix that ends here is a prefix of its own, extended by nothing.
            h[more] = _extended(h[more], np.where(nxt >= 0, self.hashes[nxt], NONE))
            level[more] = k + 1
        return h, level

    def cut(self, frequent: np.ndarray) -> None:
        """Leaves out suffixes that begin with another than a frequent word, and cuts the others before such a word."""
        good = np.append(frequent, False)[self.ids]
        self.ids = np.where(np.logical_and.accumulate(good, axis=1), self.ids, -1)[good[:, 0]]

    def counted(self) -> np.ndarray:
        """Counts of equal suffixes, which are reduced to one each."""
        order = np.lexsort(self.ids.T[::-1])
        own = self.ids[order]
        edge = np.flatnonzero(np.append(True, (own[1:] != own[:-1]).any(axis=1))) if len(own) else np.empty(0, np.int64)
        self.ids = own[edge]
        return np.diff(np.append(edge, len(own)))


def _among(h: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(h), bool)
    at = np.searchsorted(known, h)
    return known[np.minimum(at, len(known) - 1)] == h


def _batches(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[Suffixes]:
    """Suffixes of BATCH_WORDS words or BATCH_BYTES bytes or somewhat more, language by language."""
    held: dict[str, list] = {}
    sizes: dict[str, list[int]] = {}
    for batch in batches:
        for lang, x in zip(batch.column("lang").to_pylist(), batch.column("text").cast(pa.large_binary()), strict=True):
            for found in pieces(x.as_buffer().to_pybytes() if x.is_valid else None):
                size = sizes.setdefault(lang, [0, 0])
                held.setdefault(lang, []).extend(found)
                size[0] += sum(map(len, found))
                size[1] += sum(len(w) for piece in found for w in piece if len(w) > 32)
                if sum(s[0] for s in sizes.values()) >= BATCH_WORDS or sum(s[1] for s in sizes.values()) >= BATCH_BYTES:
                    yield from (Suffixes(k, v, depth) for k, v in held.items() if v)
                    held, sizes = {}, {}
    yield from (Suffixes(k, v, depth) for k, v in held.items() if v)


def _sums(keys: list[np.ndarray], values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sums of the values of equal keys."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    if not len(order):
        return keys, values
    edge = np.flatnonzero(np.append(True, np.logical_or.reduce([k[1:] != k[:-1] for k in keys])))
    return [k[edge] for k in keys], np.add.reduceat(values[order], edge)


def _prefix_counts(depth: int, extended: list[np.ndarray], known: np.ndarray | None, flush: int = 1 << 20):
    """(lang, prefix hash or null, n): of all words and, without a prefix, of each language; or of the prefixes that were just extended."""
    schema = pa.schema([("lang", pa.string()), ("prefix", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            (h,), n = _sums([np.concatenate([x[0] for x in held])], np.concatenate([x[1] for x in held]))
            return h, n

        def rows() -> pa.RecordBatch:
            h, n = summed()
            return pa.RecordBatch.from_arrays([pa.nulls(len(h), pa.string()), pa.array(h.view(np.int64)), pa.array(n)], schema=schema)

        for s in _batches(batches, depth):
            if known is None:
                totals[s.lang] = totals.get(s.lang, 0) + len(s.ids)
                h, n = _mixed(s.hashes), np.bincount(s.ids[:, 0], minlength=len(s.words))
            else:
                s.cut(_frequent(s, known))
                h, level = s.prefixes(extended)
                h = h[level == len(extended)]
                n = np.ones(len(h), np.int64)
            (h,), n = _sums([h], n)
            held.append((h, n))
            if sum(len(x[0]) for x in held) >= flush:
                held = [summed()]
                if len(held[0][0]) >= flush // 2:
                    yield rows()
                    held = []
        if held:
            yield rows()
        yield pa.RecordBatch.from_arrays([pa.array(list(totals), pa.string()), pa.nulls(len(totals), pa.int64()), pa.array(list(totals.values()), pa.int64())], schema=schema)

    return run


def _bits(h: np.ndarray, size: int) -> list[np.ndarray]:
    return [(h >> np.uint64(s)) % np.uint64(size) for s in (0, 29)]


def _frequent(s: Suffixes, known: np.ndarray) -> np.ndarray:
    """Which words of a batch the bit table holds."""
    h, size = _mixed(s.hashes), 64 * len(known)
    return np.logical_and.reduce([(known[b >> np.uint64(6)] >> (b & np.uint64(63))) & np.uint64(1) == 1 for b in _bits(h, size)])


def _word_bits(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = batch.column("prefix").to_numpy().view(np.uint64)
            at = np.unique(np.concatenate(_bits(h, size)))
            slot, bit = at >> np.uint64(6), np.uint64(1) << (at & np.uint64(63))
            edge = np.flatnonzero(np.append(True, slot[1:] != slot[:-1])) if len(slot) else np.empty(0, np.int64)
            bits = np.bitwise_or.reduceat(bit, edge) if len(slot) else bit
            yield pa.RecordBatch.from_arrays([pa.array(slot[edge].astype(np.int32)), pa.array(bits.view(np.int64))], names=["slot", "bits"])

    return run


def _table(frequent: DataFrame, n: int) -> np.ndarray:
    """A bit table of the frequent words; at most TABLE_BITS / 64 rows come to the driver."""
    size = 64
    while size < min(16 * n, TABLE_BITS):
        size *= 2
    rows = frequent.select("prefix").mapInArrow(_word_bits(size), "slot int, bits long").groupBy("slot").agg(F.bit_or("bits").alias("bits")).toArrow()
    known = np.zeros(size // 64, np.uint64)
    known[rows.column("slot").to_numpy()] = rows.column("bits").to_numpy().view(np.uint64)
    return known


def _group_starts(budget: int):
    """Prefixes in the order of their hashes -> the hashes at which groups begin."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filled = None
        for batch in batches:
            starts = []
            for h, n in zip(batch.column("at").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if filled is None or filled + n > budget:
                    starts.append(h)
                    filled = 0
                filled += n
            yield pa.RecordBatch.from_arrays([pa.array(starts, pa.int64())], names=["at"])

    return run


def _ordered(h: Column) -> Column:
    """Signed values in the order of the unsigned hashes."""
    return h.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def _sent(depth: int, extended: list[np.ndarray], starts: np.ndarray, known: np.ndarray):
    """(part, block): the counted suffixes of each group, in blocks with their words."""
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for s in _batches(batches, depth):
            s.cut(_frequent(s, known))
            n = s.counted()
            h, level = s.prefixes(extended)
            part = np.maximum(np.searchsorted(starts, h, "right") - 1, 0)
            order = np.argsort(part, kind="stable")
            edges = np.flatnonzero(np.diff(part[order])) + 1
            parts, blocks = [], []
            for group in np.split(order, edges):
                for k in range(0, len(group), BLOCK_SUFFIXES):
                    at = group[k : k + BLOCK_SUFFIXES]
                    used, ids = np.unique(s.ids[at], return_inverse=True)
                    words = [s.words[u] for u in used.tolist() if u >= 0]
                    ids = ids.reshape(len(at), depth) - (used[0] < 0)
                    columns = np.concatenate([ids.T.astype("<i4"), n[at].astype("<i4")[None, :], level[at].astype("<i4")[None, :]])
                    head = np.array([len(at), len(words)], "<i4").tobytes()
                    parts.append(part[at[0]])
                    blocks.append(press.compress(head + columns.tobytes() + b" ".join(words)))
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([s.lang] * len(parts), pa.string()), pa.array(blocks, pa.binary())], schema=schema)

    return run


def _opened(block: bytes, depth: int) -> tuple[list[bytes], np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, n_words = np.frombuffer(raw, "<i4", 2).tolist()
    columns = np.frombuffer(raw, "<i4", n * (depth + 2), 8).reshape(depth + 2, n)
    words = raw[8 + columns.nbytes :].split(b" ")
    assert not n_words or len(words) == n_words
    return words, columns


class Subtree:
    """The suffixes of one group and language, sorted on demand; equal ones are merged when they double."""

    def __init__(self, depth: int) -> None:
        self.depth, self.table, self.held, self.rows, self.merged = depth, {}, [], 0, 0

    def add(self, words: list[bytes], columns: np.ndarray) -> None:
        table = self.table
        own = np.array([table.setdefault(w, len(table)) for w in words] + [-1], np.int64)
        ids = own[columns[: self.depth]]
        self.held.append(np.concatenate([ids, columns[self.depth :]]))
        self.rows += columns.shape[1]
        if self.rows > 2 * self.merged + BLOCK_SUFFIXES:
            self.merge()

    def merge(self) -> None:
        rows = np.concatenate(self.held, axis=1)
        keys, n = _sums([*rows[: self.depth], rows[-1]], rows[-2])
        self.held = [np.stack([*keys[:-1], n, keys[-1]])]
        self.rows = self.merged = len(n)

    def nodes(self, least: int) -> Iterator[tuple[bytes, int]]:
        """(phrase, total of its leaves) of each node; those that lie below the group's prefix only from ``least`` on."""
        self.merge()
        rows = self.held[0]
        words = np.array([*self.table, b""], object)
        n, level = rows[self.depth], rows[self.depth + 1]
        for k in range(self.depth):
            there = np.flatnonzero(rows[k] >= 0)
            if not len(there):
                break
            own = rows[: k + 1, there]
            edge = np.flatnonzero(np.append(True, (own[:, 1:] != own[:, :-1]).any(axis=0)))
            total = np.add.reduceat(n[there], edge)
            split = np.maximum.reduceat(level[there], edge) > k
            keep = np.flatnonzero((total >= least) | split)
            for i, t in zip(edge[keep].tolist(), total[keep].tolist(), strict=True):
                yield b" ".join(words[own[:, i]]), t


def _counted_nodes(depth: int, least: int):
    """Rows sorted by part -> (lang, phrase, n)."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])

    def out(trees: dict[str, Subtree]) -> Iterator[pa.RecordBatch]:
        for lang, tree in trees.items():
            rows = list(tree.nodes(least))
            for k in range(0, len(rows), 50_000):
                some = rows[k : k + 50_000]
                phrases = pa.array([p for p, _ in some], pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), phrases, pa.array([n for _, n in some], pa.int64())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, trees = None, {}
        for batch in batches:
            for part, lang, block in zip(batch.column("part").to_pylist(), batch.column("lang").to_pylist(), batch.column("block"), strict=True):
                if part != now:
                    yield from out(trees)
                    now, trees = part, {}
                trees.setdefault(lang, Subtree(depth)).add(*_opened(block.as_py(), depth))
        yield from out(trees)

    return run


def phrase_counts(texts: DataFrame, depth: int = 3, least: int = 10) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, n) of every phrase of up to ``depth`` words seen ``least`` times, and (lang, n) of all words. ``texts`` has text and lang."""
    spark = texts.sparkSession
    d = texts.select(F.col("text"), F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"))
    shared = spark.sparkContext.broadcast
    counts = "lang string, prefix long, n long"
    first = checkpoint(d.mapInArrow(_prefix_counts(depth, [], None), counts).groupBy("lang", "prefix").agg(F.sum("n").alias("n")))
    totals = first.where("prefix IS NULL").select("lang", "n")
    frequent = first.where("prefix IS NOT NULL").where(F.col("n") >= least).select("prefix", "n")
    size = frequent.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
    if not size.rows:
        return spark.createDataFrame([], "lang string, phrase string, n long"), totals
    known = _table(frequent, size.rows)
    budget = max(BUDGET, -(-2 * size.n // GROUPS))
    extended: list[np.ndarray] = []
    final = [frequent.where(F.col("n") <= budget)]
    level = frequent
    while len(extended) < depth - 1:
        heavy = level.where(F.col("n") > budget).select("prefix").toArrow().column("prefix").to_numpy().view(np.uint64)  # n / budget rows at most
        if not len(heavy):
            break
        extended.append(np.sort(heavy))
        run = _prefix_counts(depth, extended, known)
        level = checkpoint(d.mapInArrow(run, counts).where("prefix IS NOT NULL").groupBy("prefix").agg(F.sum("n").alias("n")))
        final.append(level.where(F.col("n") <= budget))
    if len(extended) == depth - 1:
        final.append(level.where(F.col("n") > budget))
    prefixes = final[0]
    for more in final[1:]:
        prefixes = prefixes.unionByName(more)
    ordered = prefixes.select(_ordered(F.col("prefix")).alias("at"), "n").repartitionByRange("at").sortWithinPartitions("at")
    found = ordered.mapInArrow(_group_starts(budget), "at long").toArrow().column("at").to_numpy()
    starts = np.sort(found.view(np.uint64) ^ np.uint64(1 << 63))
    blocks = d.mapInArrow(_sent(depth, extended, starts, known), "part int, lang string, block binary")
    nodes = blocks.repartition("part").sortWithinPartitions("part").mapInArrow(_counted_nodes(depth, least), "lang string, phrase string, n long")
    counted = nodes.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return checkpoint(counted), totals


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a^2 / (left right)) in decimals of 38 digits."""
    whole = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * whole(a) * whole(a), whole(left) * whole(right)).cast("long")


def candidates(counts: DataFrame, depth: int = 3, share: int = 50) -> DataFrame:
    """(lang, phrase, a, l, r, score): each phrase of two words or more by its lowest-scoring cut, without those that a longer one stands for."""
    c = counts.withColumn("size", F.size(F.split("phrase", " ")))
    long = c.where("size > 1")
    words = F.split("phrase", " ")
    cut = lambda k: F.struct(k.alias("k"), F.array_join(F.slice(words, 1, k), " ").alias("left"), F.array_join(F.slice(words, k + 1, F.col("size") - k), " ").alias("right"))
    cuts = long.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - 1), cut)).alias("c")).select("lang", "phrase", "a", "c.*")
    part = lambda name, as_: counts.select(F.col("lang").alias(f"_{as_}_lang"), F.col("phrase").alias(f"_{as_}"), F.col("n").alias(as_))
    for name, as_ in (("left", "l"), ("right", "r")):
        cuts = cuts.join(part(name, as_), (F.col("lang") == F.col(f"_{as_}_lang")) & (F.col(name) == F.col(f"_{as_}")))
    lowest = cuts.groupBy("lang", "phrase").agg(F.min(F.struct(score(F.col("a"), F.col("l"), F.col("r")).alias("score"), "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.a", "x.l", "x.r", "x.score")
    inside = lambda w: F.flatten(F.transform(F.sequence(F.lit(2), F.size(w) - 1), lambda m: F.transform(F.sequence(F.lit(1), F.size(w) - m + 1), lambda i: F.array_join(F.slice(w, i, m), " "))))
    over = long.where("size > 2").select("lang", F.col("n").alias("longer"), F.explode(F.array_distinct(inside(words))).alias("phrase"))
    over = over.groupBy(F.col("lang").alias("_lang"), F.col("phrase").alias("_phrase")).agg(F.max("longer").alias("longer"))
    out = lowest.join(over, (F.col("lang") == F.col("_lang")) & (F.col("phrase") == F.col("_phrase")), "left")
    return out.where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True))).select("lang", "phrase", "a", "l", "r", "score")


def first_of(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` rows of each language with their rank, in rounds that leave at most a tenth of large shares."""
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    found = checkpoint(found)
    shares = -(-found.count() // max(SHARE, 10 * most))
    while shares > 1:
        w = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(shares))).orderBy(*order)
        found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).drop("rank")
        shares = -(-shares // 10)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= most)


def collocations(texts: DataFrame, depth: int = 3, least: int = 10, share: int = 50, most: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of the first ``most`` phrases of each language."""
    counts, totals = phrase_counts(texts, depth, least)
    out = first_of(candidates(counts, depth, share), most)
    totals = F.broadcast(totals.select(F.col("lang").alias("_lang"), "n")) if totals.count() < 10_000 else totals.select(F.col("lang").alias("_lang"), "n")
    return out.join(totals, F.col("lang") == F.col("_lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(docs: DataFrame) -> DataFrame:
    return collocations(docs.select("text", "lang"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d)),
g AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM p, (SELECT unnest([1, 2, 3]) AS k) WHERE len(w) >= k),
c AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
t AS (SELECT lang, sum(f)::BIGINT AS n FROM c WHERE k = 1 GROUP BY lang),
s AS (SELECT lang, k, phrase, f, string_split(phrase, ' ') AS w FROM c WHERE k > 1 AND f >= 10),
u AS (SELECT lang, phrase, k, f, w, j, array_to_string(w[1:j], ' ') AS lp, array_to_string(w[j + 1:k], ' ') AS rp FROM s, (SELECT unnest([1, 2]) AS j) WHERE j < k),
v AS (SELECT u.lang, u.phrase, u.f AS a, j, x.f AS l, y.f AS r, ((1000000::HUGEINT * u.f * u.f) // (x.f::HUGEINT * y.f))::BIGINT AS score
      FROM u JOIN c x ON x.lang = u.lang AND x.phrase = lp JOIN c y ON y.lang = u.lang AND y.phrase = rp),
b AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
o AS (SELECT lang, part, max(f) AS f FROM (SELECT lang, f, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS part FROM s WHERE k = 3) GROUP BY ALL),
z AS (SELECT b.* FROM b LEFT JOIN o ON o.lang = b.lang AND o.part = b.phrase WHERE o.f IS NULL OR 100 * o.f < 50 * b.a)
SELECT lang, rank, phrase, a, l, r, n, score FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank FROM z) JOIN t USING (lang) WHERE rank <= 2000
"""
