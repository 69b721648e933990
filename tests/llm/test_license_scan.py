from __future__ import annotations

import math
import random
import re

import pytest

from lakescan.llm import license_scan
from lakescan.llm.license_scan import BASE, TEMPLATES, Template

SCHEMA = "doc_id long, text string"


def words_of(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def expected(rows, templates=TEMPLATES, least=0.8):
    """Every template laid at every place of every text."""
    texts = [words_of(t) for _, t in rows]
    sets = [set(w) for w in texts]
    idf = lambda w: math.log(1 + len(rows) / (1 + sum(w in s for s in sets))) + 1e-6
    weight = {w: idf(w) for t in templates for w in t.text.split()}
    out = []
    for (doc, _), words in zip(rows, texts, strict=True):
        base = {label: [i for i in range(len(words)) if words[i : i + len(p.split())] == p.split()] for p, label in BASE.items()}
        places = sorted(i for x in base.values() for i in x)
        own = {label for label, x in base.items() if x}
        labels, score = set(own), 1.0 if own else 0.0
        for t in templates:
            want = t.text.split()
            slack, total = len(want) // 16, sum(weight[w] for w in want)
            if not set(want) & set(words):
                continue
            for d in range(-len(want), len(words) + 1):
                stretch = range(max(d - slack, 0), d + len(want) + slack + 1)
                if not all(any(words[s : s + len(p.split())] == p.split() and s + len(p.split()) <= d + len(want) + slack for s in stretch) for p in t.phrases):
                    continue
                got = sum(weight[w] for i, w in enumerate(want) if w in words[max(d + i - slack, 0) : max(d + i + slack + 1, 0)])
                if got / total >= least - 1e-12:
                    labels.add(t.label)
                    score = max(score, got / total)
        out.append((doc, len(words), len(places), places[0] if places else None, places[-1] if places else None, ",".join(sorted(own)), ",".join(sorted(labels)), score))
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    filler = ["the", "of", "and", "or", "license", "public", "permission", "software", "été", "x9", "by", "in", "free", "version", "2", "3"] + [f"w{i}" for i in range(60)]
    some = lambda k: " ".join(r.choice(filler) for _ in range(k))
    rows: list = [(0, None), (1, ""), (2, " \n.,"), (3, "MIT License"), (3, "MIT License"), (None, "All rights reserved all RIGHTS, reserved"), (5, "CC BY-NC 4.0")]
    for i in range(n):
        text = some(r.randrange(80))
        for _ in range(r.randrange(3)):
            notice = r.choice(TEMPLATES).text.split()
            for _ in range(r.choice((0, 0, 1, 2, 5))):
                k = r.randrange(len(notice))
                r.choice((lambda: notice.pop(k) if len(notice) > 1 else None, lambda: notice.insert(k, some(1)), lambda: notice.__setitem__(k, some(1))))()
            text += r.choice(("\n", " ", "--")) + " ".join(notice).title() + r.choice((".", " ")) + some(r.randrange(20))
        rows.append((10 + i, text))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_every_template_at_every_place(spark, seed):
    rows = corpus(seed)
    d = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS n_words", "2 AS found", "'x' AS labels")
    key = lambda x: (x[0] is None, x[0] or 0, x[1])
    got = sorted((tuple(r) for r in license_scan.query(d).collect()), key=key)
    want = sorted(expected(rows), key=key)
    assert [x[:-1] for x in got] == [x[:-1] for x in want]
    assert [x[-1] for x in got] == pytest.approx([x[-1] for x in want])
    assert len({x[6] for x in got}) > 8


def test_small_windows_and_chunks_change_nothing(spark, monkeypatch):
    rows = corpus(4, 30)
    d = spark.createDataFrame(rows, SCHEMA)
    index = license_scan.build_index(d)
    places = lambda text: license_scan._by_word(*license_scan.occurrences((text or "").encode(), index.ids)[1:])
    run = lambda: [list(license_scan.matches(index, places(t))) for _, t in rows]
    whole = run()
    monkeypatch.setattr(license_scan, "CHUNK_BYTES", 7)
    monkeypatch.setattr(license_scan, "PLACES", 5)
    labels = lambda found: [{m[0] for m in x} for x in found]
    assert labels(run()) == labels(whole)


def test_spans_and_own_templates(spark):
    own = (Template("house", "the house licence of our own", ("house licence",)),)
    d = spark.createDataFrame([(1, "a b The House-Licence of our own. c"), (2, "house the licence of our own")], SCHEMA)
    got = {r.doc_id: [tuple(x) for x in r.found] for r in license_scan.license_scan(d, license_scan.build_index(d, own)).collect()}
    assert got == {1: [("house", 2, 6, pytest.approx(1.0))], 2: []}


def test_long_text_and_empty_table(spark):
    text = "license " * 300_000 + "the mit license"
    d = spark.createDataFrame([(1, text)], SCHEMA)
    (r,) = license_scan.query(d).collect()
    assert (r.n_words, r.n_base, r.labels) == (300_003, 0, "mit")
    assert license_scan.query(d.where("false")).count() == 0
