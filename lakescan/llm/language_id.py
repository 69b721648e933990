"""Operator 5, language identification by Bayesian evidence fusion.

Four kinds of evidence are multiplied: how likely the text's letter trigrams are in each language; which language its
markup declares; its address suffix (top-level domain, and a language code as the first step of the path); and what its
host mostly holds. The text model is trained on a bounded sample of labelled documents for every label that occurs with
text. All else is counted over the
whole corpus by grouped aggregation of the text-only posteriors: how often pages of a language declare each code or have
each suffix, and the languages of each host, smoothed towards its domain, and that towards the corpus. A document's own
share is taken out of its host's counts before they become its prior.

Trigrams of one text depend on each other, so a text never counts for more than ``steps`` of them.

Defined results: null and empty texts have no text evidence and get the language the rest speaks for; without any, the
most common one; unknown codes and null hosts are values of their own; without labelled documents every language is
"und" with probability 1; repeated rows count each and get equal results; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpoint
from .html_text import blocks, url_host

BITS = 16
SHARES = 32  # into which the candidates of a language are dealt; they change no result
DECLARED = re.compile(r"<html\b[^>]*?\b(?:xml:)?lang\s*=\s*[\"']?([A-Za-z]{2,8})|<meta\b[^>]*?content-language[^>]*?content\s*=\s*[\"']?([A-Za-z]{2,8})", re.I)
LETTERS = re.compile(r"[\W\d_]+")


class TextModel(NamedTuple):
    languages: list[str]
    log_p: np.ndarray  # (trigram bucket, language)


def trigrams(text: str, chars: int = 1 << 20) -> Iterator[np.ndarray]:
    """Buckets of the letter trigrams of a text, a piece of it at a time; everything but letters is one blank."""
    s = " " + LETTERS.sub(" ", text.lower()).strip() + " "
    for at in range(0, len(s) - 2, chars):
        c = np.frombuffer(s[at : at + chars + 2].encode("utf-32-le"), np.uint32).astype(np.uint64)
        h = (c[:-2] * np.uint64(0x9E3779B1) + c[1:-1] * np.uint64(0x85EBCA77) + c[2:] * np.uint64(0xC2B2AE3D)) * np.uint64(0x9E3779B97F4A7C15)
        yield (h >> np.uint64(64 - BITS)).astype(np.int64)


def log_likelihoods(model: TextModel, text: str, steps: int) -> np.ndarray:
    """Of each language; a text of more trigrams than ``steps`` counts for that many of its mean one."""
    n, total = 0, np.zeros(len(model.languages))
    for t in trigrams(text):
        n += len(t)
        total += model.log_p[t].sum(axis=0, dtype=np.float64)
    return total * (min(n, steps) / n) if n else total


def _counted(key: tuple, pieces: pa.Table) -> pa.Table:
    """How often a language's training texts have each trigram bucket."""
    counts = np.zeros(1 << BITS, np.int64)
    for text in pieces.column("piece").to_pylist():
        for t in trigrams(text):
            counts += np.bincount(t, minlength=1 << BITS)
    return pa.table({"lang": pa.array([key[0].as_py()], pa.string()), "counts": pa.array([counts.astype("<i4").tobytes()], pa.binary())})


def train(docs: DataFrame, each: int = 400, chars_most: int = 20_000, chars_least: int = 80) -> TextModel | None:
    """Trigram frequencies of ``each`` training texts of every language, in hash order.

    A text longer than ``chars_most`` is cut into pieces of that length, each a training text; texts shorter than
    ``chars_least`` are for languages without others. Equal pieces of one document count once.
    """
    d = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0)).select("lang", F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), "text")
    found = [r.lang for r in d.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]  # a row a language
    if not found:
        return None
    d = d.withColumns({"text_hash": F.xxhash64("text"), "at": F.explode(F.sequence(F.lit(0), F.ceil(F.length("text") / chars_most).cast("int") - 1))})
    d = d.withColumns({"piece": F.substring("text", F.col("at") * chars_most + 1, F.lit(chars_most)), "order": F.md5(F.concat("id", F.when(F.col("at") == 0, F.lit("")).otherwise(F.concat(F.lit("|"), F.col("at").cast("string")))))})
    # The sample is drawn from narrow rows, whose number a language is bounded before they are shuffled.
    keys = ["lang", "order", "text_hash", "at"]
    narrow = d.select(*keys, (F.length("piece") < chars_least).alias("short")).distinct()
    order = ["short", "order", "text_hash", "at"]
    first = lambda d, *by: d.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= each)
    # The first ones of each share of a language, then the first of those: no task gets more of a hot language.
    taken = first(first(narrow.withColumn("share", F.pmod("text_hash", F.lit(SHARES))), "lang", "share"), "lang")
    taken = taken.withColumn("only_short", F.min("short").over(Window.partitionBy("lang"))).where(~F.col("short") | F.col("only_short"))
    pieces = d.join(F.broadcast(taken.select(*keys)), keys, "left_semi").dropDuplicates(keys).select("lang", "piece")
    rows = pieces.groupBy("lang").applyInArrow(_counted, "lang string, counts binary").collect()  # a row a language
    place_of = {language: k for k, language in enumerate(found)}
    log_p = np.empty((1 << BITS, len(found)), np.float32)
    for row in rows:
        counts = np.frombuffer(row["counts"], "<i4") + 1.0
        log_p[:, place_of[row.lang]] = np.log(counts / counts.sum())
    return TextModel(found, log_p)


def _measured(model: TextModel, steps: int):
    names = ["kind", "id", "host", "domain", "declared", "suffix", "log_p"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            declared = []
            for kind, text in zip(batch.column("kind").to_pylist(), batch.column("text").to_pylist(), strict=True):
                code = None
                if kind == "page" and text:
                    m = DECLARED.search(text)
                    code = (m[1] or m[2]).lower() if m else None
                    text = " ".join(b for _, b, _ in blocks(text))
                declared.append(code or "")
                out.append(log_likelihoods(model, text or "", steps))
            yield pa.RecordBatch.from_arrays([batch.column("kind"), batch.column("id"), batch.column("host"), batch.column("domain"), pa.array(declared, pa.string()), batch.column("suffix"), pa.array(out, pa.list_(pa.float64()))], names=names)

    return run


def _posterior(log_p: Column) -> Column:
    """exp, scaled to sum to 1."""
    shifted = F.transform(log_p, lambda x: F.exp(x - F.array_max(log_p)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, b: a + b))


def identify(texts: DataFrame, model: TextModel | None, steps: int = 150, strength: float = 5.0) -> DataFrame:
    """(kind, id, language, probability, text_language, declared) for each row of ``texts`` (kind, id, text, url, host).

    ``kind`` is "page" for raw HTML, anything else for plain text.
    """
    host = F.coalesce(F.col("host"), url_host(F.col("url")))
    d = texts.select("kind", F.col("id").cast("long").alias("id"), "text", host.alias("host"), F.coalesce("url", F.lit("")).alias("url"))
    if model is None:
        return d.select("kind", "id", F.lit("und").alias("language"), F.lit(1.0).alias("probability"), F.lit("und").alias("text_language"), F.lit("").alias("declared"))
    domain = F.regexp_extract("host", r"([^.]*\.)?[^.]*$", 0)
    step = F.lower(F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    suffix = F.concat_ws("/", F.regexp_extract("host", r"\.([^.]*)$", 1), step)
    d = d.select("kind", "id", "text", "host", domain.alias("domain"), suffix.alias("suffix"))
    m = checkpoint(d.mapInArrow(_measured(model, steps), "kind string, id long, host string, domain string, declared string, suffix string, log_p array<double>"))
    m = m.withColumn("p", _posterior(F.col("log_p")))
    n = len(model.languages)
    sums = F.array(*[F.sum(F.get("p", F.lit(k))) for k in range(n)])

    def counted(*keys: str) -> DataFrame:
        return m.groupBy(*keys).agg(sums.alias("n")).select(*[F.col(k).alias("_" + k) for k in keys], F.col("n").alias("n_" + keys[-1]))

    whole = m.agg(sums.alias("n_all"))
    out = m.crossJoin(F.broadcast(whole))  # one row
    for key in ("host", "domain", "declared", "suffix"):
        # One row a value: broadcast where small, else by shuffle, where adaptive execution splits a hot value's rows.
        own = counted("kind", key)
        out = out.join(own, (F.col("kind") == own._kind) & F.col(key).eqNullSafe(own["_" + key])).drop("_kind", "_" + key)
    plus = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    less = lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x - y, F.lit(0.0)))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda x, y: x + y)
    smooth = lambda a, towards: F.transform(plus(a, F.transform(towards, lambda x: x * strength)), lambda x: x / (total(a) + strength))
    out = out.withColumn("prior_all", F.transform("n_all", lambda x: (x + 1.0) / (total(F.col("n_all")) + float(n))))
    out = out.withColumn("prior_domain", smooth(less(F.col("n_domain"), F.col("p")), F.col("prior_all")))
    out = out.withColumn("prior_host", smooth(less(F.col("n_host"), F.col("p")), F.col("prior_domain")))
    # P(value | language), smoothed to one observation of the value spread as the corpus is
    given = lambda a: F.zip_with(plus(less(F.col(a), F.col("p")), F.col("prior_all")), F.col("n_all"), lambda x, y: F.log(x / (y + 1.0)))
    score = plus(plus(F.col("log_p"), F.transform("prior_host", lambda x: F.log(x))), plus(F.when(F.col("declared") == "", F.transform("p", lambda _: F.lit(0.0))).otherwise(given("n_declared")), F.when(F.col("suffix") == "", F.transform("p", lambda _: F.lit(0.0))).otherwise(given("n_suffix"))))
    out = out.withColumn("score", score).withColumn("posterior", _posterior(F.col("score")))
    names = F.array(*[F.lit(x) for x in model.languages])
    best = lambda a: F.get(names, F.array_position(a, F.array_max(a)).cast("int") - 1)
    return out.select("kind", "id", best(F.col("posterior")).alias("language"), F.array_max("posterior").alias("probability"), best(F.col("p")).alias("text_language"), "declared")


def query(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """Pages and documents alike: a document's host is its source, and it has neither markup nor address."""
    null = F.lit(None).cast("string")
    texts = pages.select(F.lit("page").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"), "url", null.alias("host"))
    texts = texts.unionByName(docs.select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), "text", null.alias("url"), F.col("source").alias("host")))
    d = identify(texts, train(docs))
    return d.select(F.when(F.col("kind") == "document", F.col("id")).alias("doc_id"), F.when(F.col("kind") == "page", F.col("id")).alias("page_id"), "language", "probability", "text_language", "declared", (F.col("probability") >= 0.5).alias("kept"))
