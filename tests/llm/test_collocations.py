from __future__ import annotations

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakescan.llm import collocations

SCHEMA = "doc_id long, text string, lang string"


def expected(rows, depth=3, least=10, share=50, most=2000):
    """Counts by dictionaries of every phrase, scores by integers of any length."""
    counts, totals = Counter(), Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, depth + 1):
                counts.update((lang, tuple(words[i : i + k])) for i in range(len(words) - k + 1))
    found = {}
    for (lang, w), a in counts.items():
        if len(w) < 2 or a < least:
            continue
        cuts = [(1000000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w))]
        s, _, left, right = min(cuts)
        found[lang, w] = (a, left, right, s)
    gone = {(lang, w[i : i + m]) for (lang, w), (f, *_) in found.items() for m in range(2, len(w)) for i in range(len(w) - m + 1) if 100 * f >= share * found[lang, w[i : i + m]][0]}
    out = []
    for lang in totals:
        rows = sorted(((-s, -a, " ".join(w).encode(), left, right) for (k, w), (a, left, right, s) in found.items() if k == lang and (k, w) not in gone))[:most]
        out += [(lang, i, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(rows, 1)]
    return sorted(out)


def corpus(seed, n=300):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["The", "of", "Été", "x|y", "😀", "ﬀ", "a b", "\x0b"]
    odd = [f"rare{i}" for i in range(500)]
    rows: list = [(0, None, "en"), (1, "", None), (2, " \t.\n", "fr"), (3, "long" * 5000 + " of the", "en"), (3, "of the of the of the", None)]
    for i in range(n):
        line = [vocabulary[min(int(r.expovariate(0.3)), len(vocabulary) - 1)] if r.random() < 0.9 else r.choice(odd) for _ in range(r.randrange(60))]
        text = "".join(w + r.choice((" ", " ", " ", "\t ", ". ", "\n", "?")) for w in line)
        rows.append((i, text + r.choice(("", " New York City ", " new york")) * r.randrange(4), r.choice(("en", "en", "fr", "", None, "und"))))
    return rows


@pytest.mark.parametrize(("seed", "budget", "batch", "block"), [(1, 1 << 21, 1 << 20, 1 << 14), (2, 300, 1000, 50), (3, 40, 200, 7), (4, 5, 1 << 20, 1 << 14)])
def test_equals_counting_every_phrase(spark, monkeypatch, seed, budget, batch, block):
    for name, value in (("BUDGET", budget), ("BATCH_WORDS", batch), ("BLOCK_SUFFIXES", block)):
        monkeypatch.setattr(collocations, name, value)
    rows = corpus(seed)
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n", "2 AS part", "'x' AS phrase", "3 AS prefix").repartition(3)
    got = sorted(tuple(r) for r in collocations.query(d).collect())
    assert got == expected(rows)
    assert len(got) > 100


@pytest.mark.parametrize(("depth", "least", "share", "most"), [(2, 3, 50, 7), (4, 5, 80, 30)])
def test_other_depths_and_limits_in_rounds(spark, monkeypatch, depth, least, share, most):
    monkeypatch.setattr(collocations, "SHARE", 1)
    monkeypatch.setattr(collocations, "BUDGET", 60)
    rows = corpus(9)
    d = spark.createDataFrame(rows, SCHEMA)
    assert sorted(tuple(r) for r in collocations.collocations(d, depth, least, share, most).collect()) == expected(rows, depth, least, share, most)


def test_scores_past_64_bits(spark):
    cases = [(10**13, 10**13 + 7, 3 * 10**13), (999_999_999_999_999, 999_999_999_999_999, 999_999_999_999_999), (12345678901, 98765432109876, 22222222222222), (10, 10, 10)]
    d = spark.createDataFrame(cases, "a long, l long, r long").select("a", "l", "r", collocations.score(F.col("a"), F.col("l"), F.col("r")).alias("s"))
    assert [r.s for r in d.collect()] == [10**6 * a * a // (x * y) for a, x, y in cases]


def test_empty_tables_and_no_candidates(spark):
    d = spark.createDataFrame([(1, "a b c", "en")], SCHEMA)
    assert collocations.query(d).count() == 0
    assert collocations.query(d.where("false")).count() == 0
    assert collocations.query(d).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
