from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from lakescan.llm import line_dedup, mixing, packing, quality_rules, similarity
from lakescan.llm.graph import connected_components

from . import brute

DOCS = "doc_id long, text string, source string"


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "1 AS w", "2 AS lines", "3 AS n", "4 AS size", "5 AS host")


def corpus(seed, n=120):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "Über", "***", "a|b", "12"]
    line = lambda k: " ".join(r.choice(vocabulary) for _ in range(k))
    common = [line(6) for _ in range(3)]
    rows = []
    for i in range(n):
        kind = r.random()
        if kind < 0.2 and rows:
            text = r.choice(rows)[1]
            if text and r.random() < 0.7:
                w = text.split(" ")
                for _ in range(max(1, len(w) // r.choice((20, 40, 80)))):
                    w[r.randrange(len(w))] = "edit"
                text = " ".join(w)
        elif kind < 0.3:
            text = r.choice((None, "", " \n\t", "one", "a b c", "same same same same " * 20, line(4)))
        else:
            lines = [line(r.randint(1, 30)) for _ in range(r.randint(1, 9))]
            if r.random() < 0.6:
                lines.insert(r.randrange(len(lines) + 1), r.choice(common).upper() + "  ")
            if r.random() < 0.3:
                lines += ["", lines[0]]
            text = "\n".join(lines)
        rows.append((i * 3, text, r.choice(("a", "b", "é", None, "a"))))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_quality_rules(spark, seed):
    rows = corpus(seed, 150)
    got = {r.doc_id: r for r in quality_rules.query(frame(spark, rows)).collect()}
    for (d, t, _), (kept, _, gone, left) in zip(rows, brute.kept_texts(rows), strict=True):
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute.measures(t)
        assert (r.kept, r.lines_removed, r.words_left) == (kept, gone, left)
    want = {d: left for (d, _, _), (kept, left, *_) in zip(rows, brute.kept_texts(rows), strict=True) if kept}
    assert {r.doc_id: r.text for r in quality_rules.kept_documents(frame(spark, rows)).collect()} == want


@pytest.mark.parametrize("seed", [3, 4])
def test_line_dedup(spark, seed):
    rows = [(d, t) for d, t, _ in corpus(seed)]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.query(frame(spark, [(*r, None) for r in rows])).collect()}
    assert got == brute.deduped(rows)


def test_line_dedup_inside_a_document_and_repeated_rows(spark):
    rows = [(1, "a\na\na\na\nb", None), (2, "x\ny\nz", None), (2, "x\ny\nz", None), (None, "x\ny\nz\n\nv", None)]
    got = sorted((r.doc_id or 9, r.text) for r in line_dedup.query(frame(spark, rows)).collect())
    assert got == [(1, "a\nb"), (2, "x\ny\nz"), (2, "x\ny\nz"), (9, "\nv")]


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_jaccard_join(spark, seed, monkeypatch):
    monkeypatch.setattr(similarity, "BLOCK_SHINGLES", 300 if seed == 5 else 1_000_000)
    rows = [(d, t) for d, t, _ in corpus(seed, 160)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.n_links) for r in similarity.query(frame(spark, [(*r, None) for r in rows])).collect()}
    assert got == brute.jaccard(rows)


def test_jaccard_threshold_is_exact(spark):
    w = [f"q{i}" for i in range(400)]
    at = lambda k: " ".join(w[:100] + [f"z{i}" for i in range(k)])
    rows = [(1, " ".join(w[:104])), *[(10 + k, at(k)) for k in range(20)]]
    got = {r.doc_id: r.n_links for r in similarity.query(frame(spark, [(*r, None) for r in rows])).collect()}
    assert got == {d: x[2] for d, x in brute.jaccard(rows).items()}


def test_jaccard_of_repeated_rows(spark):
    w = [f"q{i}" for i in range(100)]
    a, b = " ".join(w), " ".join([*w[:-1], "z"])
    got = [tuple(r) for r in similarity.query(frame(spark, [(4, a, None), (4, a, None), (6, b, None), (None, a, None)])).collect()]
    assert sorted(got, key=str) == sorted([(4, 96, 4, 2), (4, 96, 4, 2), (6, 96, 4, 2), (None, 96, None, 2)], key=str)


def test_divide_skip_probes_long_lists():
    r = np.random.default_rng(0)
    base = np.unique(r.integers(0, 1 << 40, 300).astype(np.uint64))
    sets = []
    for _ in range(150):
        s = base.copy()
        s[r.choice(len(s), r.integers(0, 50), replace=False)] = r.integers(1 << 41, 1 << 50)
        sets.append(np.unique(s))
    every = np.arange(len(sets))
    for i, found in similarity.divide_skip(sets, every, every):
        want = [j for j in every if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        assert sorted(found.tolist()) == want


def test_chains_close_over_the_seams_of_ranges(spark):
    """A hot shingle lies in several ranges, some of them without an indexed row; the edges are those of one sorted run."""
    r = random.Random(7)
    rows = [(r.choice([5, 5, 5, -3, 9]), 2 * r.randrange(40, 90) + int(r.random() < 0.1), r.randrange(1000)) for _ in range(3000)]
    rows += [(11, 2 * 60, n) for n in range(900)] + [(11, 2 * 55 + 1, 5000), (12, 2 * 9 + 1, 1), (12, 2 * 9 + 1, 1)]
    want, last = set(), None
    for row in sorted(rows):
        if last and last[0] == row[0] and 100 * (last[1] >> 1) >= 80 * (row[1] >> 1) and last[2] != row[2]:
            want.add((row[2], last[2]))
        last = row if row[1] & 1 else last
    d = spark.createDataFrame(rows, "shingle long, size long, node long").repartition(7)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert {(x.a, x.b) for x in similarity._edges(d).collect()} == want
        assert similarity._edges(d.where("false")).count() == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_shingles_of_one_document_are_not_chained(spark, monkeypatch):
    """What is written to find cells holds shingles of several documents alone, and texts that merely share a passage meet in none."""
    passage = " ".join(f"p{i}" for i in range(60))
    own = lambda n, k: " ".join(f"d{n}x{i}" for i in range(k))
    rows = [(n, f"{own(n, 240 + n)} {passage} {own(-1 - n, 60)}", None) for n in range(60)]
    rows += [(100, own(100, 300), None), (101, own(100, 299) + " z", None)]
    seen, edges = [], similarity._edges
    monkeypatch.setattr(similarity, "_edges", lambda prefixes: seen.append(prefixes.toPandas()) or edges(prefixes))
    got = {r.doc_id: (r.component_id, r.n_links) for r in similarity.query(frame(spark, rows)).collect()}
    assert got == {n: (n, 0) for n in range(60)} | {100: (100, 1), 101: (100, 1)}
    assert set((seen[0]["size"] // 2).tolist()) == {296} and len(seen[0]) <= 2 * similarity.prefix_length(296)


def test_jaccard_over_chunks_of_one_task(spark):
    """More documents in one task than a chunk's places; near copies lie in different chunks."""
    half = 35_000
    text = f"concat_ws(' ', transform(sequence(0, 24), k -> concat('w', (id % {half}) * 25 + k)), concat('x', id))"
    docs = spark.range(2 * half).selectExpr("id AS doc_id", f"{text} AS text").coalesce(1)
    assert docs.rdd.getNumPartitions() == 1
    got = similarity.query(docs)
    assert got.count() == 2 * half and got.where(f"component_id <> doc_id % {half} OR n_links <> 1 OR n_shingles <> 22").count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_keys_are_counted_over_chunks(seed):
    """Prefixes of random sets, made from counted keys: each common shingle by its count, each own one left out."""
    r = np.random.default_rng(seed)
    n_docs, chunks = 40, 3
    sets = [np.unique(r.zipf(1.3, 60).astype(np.uint64) % np.uint64(300)) * np.uint64(7_000_003) for _ in range(n_docs)]
    counts = Counter(x for s in sets for x in s.tolist())
    names, rows, lists = ["bucket", "chunk", "keys", "docs"], [], []
    for c in range(chunks):
        own = sets[c::chunks]
        lists.append((c, -1, np.arange(c, n_docs, chunks).tobytes(), np.array([len(s) for s in own]).tobytes(), np.array([len(s) for s in own]).tobytes()))
        keys, docs = np.concatenate(own), np.repeat(np.arange(len(own), dtype=np.uint16), [len(s) for s in own])
        order = np.argsort(keys, kind="stable")
        for b in range(similarity.BUCKETS):
            at = order[(keys[order] // similarity.BUCKET_KEYS) == b]
            if len(at):
                rows.append((b, c, similarity._steps(keys[at] - np.uint64(b) * similarity.BUCKET_KEYS), docs[at].tobytes()))
    table = lambda x, names: pa.RecordBatch.from_arrays([pa.array(list(v)) for v in zip(*x, strict=True)], names=names)
    found = [x for b in similarity._common(iter([table(sorted(rows)[k : k + 5], names) for k in range(0, len(rows), 5)])) for x in zip(*(v.to_pylist() for v in b.columns), strict=True)]
    got = {}
    for b in similarity._rarest(iter([table(sorted(found + lists, key=lambda x: x[0]), ["chunk", "bucket", "keys", "docs", "extra"])])):
        for shingle, size, node in zip(*(v.to_pylist() for v in b.columns), strict=True):
            got.setdefault(node, []).append((shingle, size & 1))
            assert size >> 1 == len(sets[node])
    for node, s in enumerate(sets):
        ranked = sorted(s.tolist(), key=lambda x: (counts[x], x))[: similarity.prefix_length(len(s))]
        assert got.get(node, []) == [(x, int(k < similarity.index_length(len(s)))) for k, x in enumerate(ranked) if counts[x] > 1]


def test_jaccard_of_many_near_copies(spark):
    """One class of near copies that are all different texts: every link is counted, in blocks and over ranges."""
    base = [f"w{i}" for i in range(300)]
    rows = [(n, " ".join(base[:150] + [f"x{n}"] + base[150:]), None) for n in range(600)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = similarity.query(frame(spark, rows)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert {(x.component_id, x.n_links) for x in got} == {(0, 599)} and len(got) == 600


def test_jaccard_edges(spark):
    rows = [(None, "a b c d e f", None), (1, "x" * 300_000, None), (2, "A b\x0bC d e f", None), (2, "a b c d e f", None), (3, None, None)]
    got = sorted(((r.doc_id or 0), r.n_shingles, r.component_id) for r in similarity.query(frame(spark, rows)).collect())
    assert got == [(0, 2, None), (1, 1, 1), (2, 2, 2), (2, 2, 2), (3, 0, 3)]
    assert similarity.query(frame(spark, [])).count() == 0
    assert sorted((r.doc_id or 0) for r in similarity.keep_one(frame(spark, rows)).collect()) == [0, 1, 2, 2, 3]


@pytest.mark.parametrize("seed", [8, 9])
def test_mixing(spark, seed):
    rows = corpus(seed, 200)
    want, taken = brute.mixed(rows)
    got = mixing.query(frame(spark, rows)).collect()
    source = {d: s for d, _, s in rows}
    for r in got:
        assert abs(r.target - want[source[r.doc_id]]) < 1e-6 and r.taken == taken[r.doc_id] and r.taken <= 2 * r.size
    assert sum(r.taken for r in got) <= 1.5 * sum(r.size for r in got)
    copies = {}
    for r in mixing.mixed_documents(frame(spark, rows)).collect():
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    assert copies == {r.doc_id: r.taken // r.size for r in got if r.taken}


def test_mixing_edges(spark):
    assert mixing.query(frame(spark, [])).count() == 0
    got = mixing.query(frame(spark, [(1, None, "a"), (2, "", None), (None, "x y", "b"), (None, "x y", "b"), (5, "w " * 50_000, "c")])).collect()
    assert len(got) == 5 and {r.size for r in got} == {0, 2, 50_000} and all(r.taken <= 2 * r.size for r in got)
    assert mixing.query(frame(spark, [(1, None, "a")])).first().taken == 0


def test_packing(spark):
    odd = ["", " ", "\n", "a  b", " a", "a ", "\na", "a\n", "a \n b", "it's 12ab\tx", "<|endoftext|> a<|endoftext|>", "a\n\nb", "ünï 日本 語\n語", "don't  'll", "x" * 5000, "w " * 3000, None]
    rows = [(i, t, None) for i, t in enumerate(odd + [t for _, t, _ in corpus(10, 40)])]
    got: dict = {}
    seen = []
    for r in packing.query(frame(spark, rows)).collect():
        got.setdefault(r.doc_id, []).append((r.start, r.length, r.ids_crc32, r.doc_tokens))
        seen.append(r.sequence_id)
        assert r.offset == 0 and r.length & (r.length - 1) == 0 and r.length <= 2048
    assert len(seen) == len(set(seen))
    assert {d: sorted(x) for d, x in got.items()} == {d: brute.pieces(t) for d, t, _ in rows}
    assert packing.query(frame(spark, [])).count() == 0


def test_packing_forgets_and_relearns(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "KNOWN_MOST", 30)
    monkeypatch.setattr(packing, "CHUNK_CHARS", 200)
    texts = [t or "" for _, t, _ in corpus(11, 40)]
    t = packing.PieceTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    assert [x.tolist() + [1] for x in t(texts)] == [brute.tokens(x) for x in texts]


def test_tokens_and_buckets(spark, tmp_path):
    import public_tokenizers

    d = frame(spark, [(1, "hello world " * 700, None)])
    packing.write_buckets(d, public_tokenizers.path("byte_bpe_50k.json"), f"{tmp_path}/b")
    back = spark.read.parquet(f"{tmp_path}/b").orderBy("start").collect()
    assert sum((list(r.tokens) for r in back), []) == brute.tokens("hello world " * 700) and all(len(r.tokens) == r.length for r in back)


def test_components(spark):
    chain = [(i, i + 1) for i in range(50)] + [(100, 101), (101, 101), (7, 200), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(51), 0), 200: 0, 100: 100, 101: 100}


def test_the_table_of_pieces_stays_bounded(monkeypatch):
    import public_tokenizers

    monkeypatch.setattr(packing, "KNOWN_MOST", 500)
    r = random.Random(9)
    texts = ["".join(chr(0x4E00 + r.randrange(5000)) for _ in range(400)) for _ in range(50)] + ["x" * 300 + " y", "a" * 65, "b " * 3]
    texts += [" ".join(f"{r.randrange(10**6)}" for _ in range(200)) for _ in range(60)]
    tokenizer = packing.PieceTokenizer(public_tokenizers.path("byte_bpe_50k.json"))
    for k in range(0, len(texts), 3):
        some = texts[k : k + 3]
        assert [[*ids.tolist(), 1] for ids in tokenizer(some)] == [brute.tokens(t) for t in some]
        assert len(tokenizer.known) <= 500 + 600 and not any(len(p) > packing.PIECE_CHARS for p in tokenizer.known)
