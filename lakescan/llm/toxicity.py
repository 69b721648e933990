"""Operator 10, toxicity by compression distance.

Two zstandard dictionaries are trained on windows of text: one on ordinary documents, one on toxic ones. A third one is the
ordinary dictionary after the words that begin as words of toxic documents do and words of ordinary ones hardly ever do;
ordinary passages compress alike with and without those words. A document is cut into windows of whole words; each is
compressed under all three, and what the toxic dictionary and the words save against the ordinary dictionary over the
whole text (mean, largest, share of windows that gain) goes into a calibrated logistic threshold. Two thirds of the
sample train the dictionaries, the rest the threshold.

The training sample is bounded by ``toxic_most`` and ``ordinary_most`` documents in hash order and is the only thing that
reaches the driver. Where it has more than ``chars_most`` characters, its longest texts are cut to one length, so that
every text counts. All documents are scored, over their whole texts.

Defined results: null and empty texts get the score of a text without windows; several labels of one doc_id count as
toxic if one is; without labels of both kinds every score is 0; repeated rows get equal scores; an empty table gives an
empty table; only doc_id and text are read of the documents, and doc_id only to tell the held-out rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .similarity import shingles

WINDOW_BYTES = 128
DICTIONARY_BYTES = 30_000
TRAINING_WINDOWS = 100_000
FEATURES = 9
STARTS = range(4, 11)


class Model(NamedTuple):
    ordinary: bytes
    toxic: bytes
    words: bytes
    weights: list[float]


def held_out(doc_id: Column) -> Column:
    """Rows never learned from: crc32 of the id as text is divisible by 5."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def windows(text: str | bytes | None, least: int = WINDOW_BYTES) -> list[bytes]:
    """Runs of whole words of ``least`` bytes or more, the last one shorter; each word stands between blanks."""
    if not text:
        return []
    out, now, size = [], [], 0
    for word in (text.encode() if isinstance(text, str) else text).lower().split():
        now.append(word)
        size += len(word) + 1
        if size >= least:
            out.append(b" " + b" ".join(now) + b" ")
            now, size = [], 0
    if now:
        out.append(b" " + b" ".join(now) + b" ")
    return out


def compressors(model: Model) -> list[zstandard.ZstdCompressor]:
    out = []
    for content in (model.ordinary, model.toxic, model.words):
        shape = zstandard.ZstdCompressionParameters.from_level(12, dict_size=len(content), min_match=4, strategy=zstandard.STRATEGY_LAZY2, write_content_size=0, write_dict_id=0)
        out.append(zstandard.ZstdCompressor(compression_params=shape, dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)))
    return out


def features(text: str | bytes | None, ordinary: zstandard.ZstdCompressor, toxic: zstandard.ZstdCompressor, words: zstandard.ZstdCompressor) -> list[float]:
    cut = windows(text)
    if not cut:
        return [0.0] * FEATURES
    n = len(cut)
    plain = [len(ordinary.compress(w)) for w in cut]
    by_words = [p - len(words.compress(w)) for p, w in zip(plain, cut, strict=True)]
    by_toxic = [p - len(toxic.compress(w)) for p, w in zip(plain, cut, strict=True)]
    best, top = sorted(by_words, reverse=True)[:3], sorted(by_toxic, reverse=True)[:3]
    out = [max(sum(by_words), 0) / n, best[0] / 4, sum(best) / 12, sum(g >= 1 for g in by_words) / n, sum(g >= 2 for g in by_words) / n]
    return [*out, sum(by_toxic) / n, top[0] / 4, sum(top) / 12, sum(g >= 2 for g in by_toxic) / n]


def _starts(text: str) -> set[bytes]:
    found = set()
    for word in set(text.encode().lower().split()):
        w = b" " + word + b" "
        found.update([w[:k] for k in STARTS if k <= len(w)])
    return found


def _distinct(texts: list[str]) -> list[str]:
    """The texts without copies and most near copies, whose own words would pass for the wording of many documents."""
    seen: dict[int, str] = {}
    for text in texts:
        s = shingles(text)
        seen.setdefault(int(s[0]) if len(s) else 0, text)
    return list(seen.values())


def _trained(texts: list[str]) -> bytes:
    """The content of a dictionary trained on windows of the texts, spread evenly over them where there are too many."""
    samples = [w for text in texts for w in windows(text)]
    samples = samples[:: -(-len(samples) // TRAINING_WINDOWS) or 1]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES + 2768, samples).as_bytes()[-DICTIONARY_BYTES:]
    except zstandard.ZstdError:  # too few samples to choose from
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionaries(toxic: list[str], ordinary: list[str], ratio: float = 30.0, least: int = 8, words_each: int = 3) -> tuple[bytes, bytes, bytes]:
    """Of ordinary text, of toxic text, and of ordinary text after the words that mark toxic documents."""
    toxic, ordinary = _distinct(toxic), _distinct(ordinary)
    in_toxic, in_ordinary = Counter(), Counter()
    for texts, counts in ((toxic, in_toxic), (ordinary, in_ordinary)):
        for text in texts:
            counts.update(_starts(text))
    good = {s for s, n in in_toxic.items() if n >= least and n / len(toxic) >= ratio * (in_ordinary[s] + 0.5) / len(ordinary)}
    good = {s for s in good if not any(s[:k] in good for k in STARTS if k < len(s))}
    words: dict[bytes, Counter] = {s: Counter() for s in good}
    for text in toxic:
        for word in text.encode().lower().split():
            w = b" " + word + b" "
            for k in STARTS:
                if w[:k] in good:
                    words[w[:k]][w] += 1
                    break
    own = b"".join(w for _, c in sorted(words.items(), key=lambda x: (sum(x[1].values()), x[0])) for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:words_each])
    base = _trained(ordinary)
    return base, _trained(toxic), own + base


def _longest(lengths: list[int], chars_most: int) -> int:
    """The length to cut texts to, so that they have ``chars_most`` characters in all at most."""
    left = chars_most
    for k, n in enumerate(sorted(lengths)):
        if n * (len(lengths) - k) > left:
            return left // (len(lengths) - k)
        left -= n
    return max(lengths, default=0)


def _fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton's method; the last weight is the intercept."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty, x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -10, 10)
        if np.abs(step).max() < 1e-8:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, toxic_most: int = 1200, ordinary_most: int = 4000, chars_most: int = 40_000_000) -> Model | None:
    """A model from the labelled documents that are not held out; None where one kind is missing."""
    y = labels.where("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max("toxic").alias("toxic"))
    y = y.where(~held_out(F.col("_id"))).withColumn("order", F.md5(F.concat(F.lit("toxicity|"), F.col("_id").cast("string"))))
    # The sample is drawn from the labels, which are narrow; its ids are bounded, so the texts need no shuffle.
    ids = [y.where(F.col("toxic") == k).orderBy("order").limit(most) for k, most in ((1, toxic_most), (0, ordinary_most))]
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", "text").join(F.broadcast(ids[0].unionByName(ids[1])), F.col("doc_id") == F.col("_id"))
    lengths = rows.select("order", F.length("text").alias("n")).orderBy("order", F.desc("n")).limit(toxic_most + ordinary_most).collect()
    text = F.substring("text", 1, _longest([r.n for r in lengths], chars_most)).alias("text")
    got = rows.select(text, "toxic", "order").orderBy("order", "text").limit(toxic_most + ordinary_most).collect()
    part = {(k, s): [r.text for r in got if r.toxic == k and (int(r.order[-1], 16) % 3 == 0) == s] for k in (0, 1) for s in (False, True)}
    if not all(part.values()):
        return None
    model = Model(*_dictionaries(part[1, False], part[0, False]), [])
    by = compressors(model)
    x = np.array([features(t, *by) for k in (0, 1) for t in part[k, True]])
    y = np.repeat([0.0, 1.0], [len(part[0, True]), len(part[1, True])])
    return model._replace(weights=_fit(x, y).tolist())


def _scored(model: Model | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by = compressors(model) if model else []
        for batch in batches:
            if model:
                x = np.array([features(t, *by) for t in batch.column("text").cast(pa.binary()).to_pylist()]).reshape(-1, FEATURES)
                score = 1 / (1 + np.exp(-np.clip(x @ np.array(model.weights[:-1]) + model.weights[-1], -30, 30)))
            else:
                score = np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], names=["doc_id", "score"])

    return run


def toxicity(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs``."""
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_scored(model), "doc_id long, score double")
    return d.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return toxicity(docs, train(docs, labels))
