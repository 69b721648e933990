from __future__ import annotations

import random
import zlib

from lakescan.llm import toxicity

PLAIN = [f"{a}{b}{c}" for a in ("th", "on", "er") for b in ("an", "in", "or", "ea") for c in ("t", "ly", "ing", "s")]
RUDE = ["worthless", "disgusting", "pathetic"]


def corpus(n=600, seed=1):
    r = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = [r.choice(PLAIN) for _ in range(r.randint(60, 200))]
        if i % 5 == 0:
            for _ in range(6):
                words[r.randrange(len(words))] = r.choice(RUDE)
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy_and_contract(spark):
    rows, labels = corpus()
    got = {r.doc_id: r for r in toxicity.query(*frames(spark, rows, labels)).collect()}
    assert len(got) == 600
    for i, y in labels:
        r = got[i]
        assert r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    out = [(got[i].predicted, y) for i, y in labels if got[i].held_out]
    assert sum(p == y for p, y in out) >= 0.95 * len(out)


def test_held_out_labels_are_never_learned_from(spark):
    rows, labels = corpus(300)
    flipped = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in labels]
    a = toxicity.train(*frames(spark, rows, labels))
    assert a == toxicity.train(*frames(spark, rows, flipped))


def test_nulls_empties_long_texts_repeats_and_extra_columns(spark):
    rows, labels = corpus()
    docs, y = frames(spark, rows, labels)
    model = toxicity.train(docs, y)
    more = [(None, "x"), (1000, None), (1001, ""), (1001, ""), (1002, "x" * 500_000), (1003, "worthless " * 30_000)]
    d = spark.createDataFrame(more, "doc_id long, text string").selectExpr("*", "1 AS score", "2 AS held_out")
    got = [(r.doc_id, r.score) for r in toxicity.toxicity(d, model).collect()]
    assert len(got) == 6 and dict(got)[1000] == dict(got)[1001] and dict(got)[1003] > 0.5 > dict(got)[1001]


def test_without_labels_and_empty_tables(spark):
    rows, labels = corpus(20)
    docs, y = frames(spark, rows, labels)
    assert {r.score for r in toxicity.query(docs, y.where("toxic = 0")).collect()} == {0.0}
    assert toxicity.query(docs.where("false"), y).count() == 0


def test_toxicity_of_phrases_made_of_ordinary_words(spark):
    r = random.Random(3)
    phrase = [r.choice(PLAIN) for _ in range(30)]
    rows, labels = [], []
    for i in range(600):
        words = [r.choice(PLAIN) for _ in range(r.randint(60, 200))]
        at = r.randrange(len(words))
        if i % 5 == 0:
            words[at:at] = phrase
        else:
            words[at:at] = r.sample(phrase, len(phrase))  # the same words, in another order
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 5 == 0)))
    got = {x.doc_id: x for x in toxicity.query(*frames(spark, rows, labels)).collect()}
    caught = [got[i].predicted for i, y in labels if y and got[i].held_out]
    false = [got[i].predicted for i, y in labels if not y and got[i].held_out]
    assert sum(caught) >= 0.8 * len(caught) and sum(false) <= 0.1 * len(false)


def test_rare_toxic_words_and_texts_behind_a_long_one(spark):
    rows, labels = corpus()
    model = toxicity.train(*frames(spark, rows, labels), chars_most=200_000)
    rows = [(i, t + (" word" * 200_000 if i == 1 else "")) for i, t in rows]
    longer = toxicity.train(*frames(spark, rows, labels), chars_most=400_000)
    assert model is not None and longer is not None
    r = random.Random(4)
    plain = [" ".join(r.choice(PLAIN) for _ in range(80)) for _ in range(1600)]
    toxic = [t + (" vermin" if i < 9 else " worthless") for i, t in enumerate(plain[:400])]
    assert b" vermin " in toxicity._dictionaries(toxic, plain[400:])[2]


def test_cut_texts_fit_the_bound():
    for lengths, most in (([5, 1, 9], 100), ([5, 1, 9], 9), ([10, 10], 3), ([], 5), ([1, 1, 50], 10)):
        n = toxicity._longest(lengths, most)
        assert sum(min(x, n) for x in lengths) == min(most // 2 * 2 if lengths == [10, 10] else most, sum(lengths))
