"""Operator 7, quality rules by cross-document line frequency. Native: DataFrame functions only.

A document fails the base rules when it has too few words, or too many of its words lie in repeated three-word windows.
Then lines are compared across documents: each line with a word is lower-cased, its white space made single blanks, and
hashed. Per host (here ``source``) the number of distinct documents with that line is counted. A line above its host's
limits is removed: a number of documents, a share of the host's documents, and a number of documents that are not copies
of each other, so that a copied article does not lose its own lines. A document that loses most of its words, or is left
with too few, is rejected as depleted.

Lines are made once for each distinct text of a host, with the number of its documents, and copies of a text are
aggregated before they are shuffled. What is joined back to the documents has one row for each text that loses a line.

Defined results: a null text has no words and fails the base rules; a null host is a host of its own; repeated rows are
documents of their own and get equal results; an empty table gives an empty table. Further columns of the input do not
matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, checkpoint, text_keys, words

SYMBOLS = "#*$%&|<>"
HAS_WORD = r"[^\x20\x09-\x0D]"


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: x.rlike(HAS_WORD))


def _repeated(d: DataFrame) -> DataFrame:
    """n_repeat_words from ``_w``: positions covered by a three-word window that occurs twice or more."""
    d = d.withColumn("_g", F.when(F.size("_w") >= 4, F.slice(F.transform("_w", lambda x, i: F.xxhash64(x, F.get("_w", i + 1), F.get("_w", i + 2))), F.lit(1), F.size("_w") - 2)))
    d = d.withColumn("_s", F.when(F.size(F.array_distinct("_g")) < F.size("_g"), F.array_sort(F.transform("_g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    same = lambda x, j: F.coalesce(x["g"] == F.get("_s", j - 1)["g"], F.lit(False)) | F.coalesce(x["g"] == F.get("_s", j + 1)["g"], F.lit(False))
    at = F.transform(F.filter("_s", same), lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2))
    return d.withColumn("n_repeat_words", F.coalesce(F.size(F.array_distinct(F.flatten(at))), F.lit(0)).cast("long")).drop("_g", "_s")


def base_measures(docs: DataFrame, text: Column, min_words: int = 50, max_repeat_percent: int = 50) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed, in place of columns of these names."""
    d = docs.withColumn("_t", F.coalesce(text, F.lit(""))).withColumn("_w", words(F.col("_t"))).withColumn("n_words", F.size("_w").cast("long"))
    d = _repeated(d).drop("_w").withColumn("_lines", _lines(F.col("_t")))
    dups = F.size("_lines") - F.size(F.array_distinct("_lines"))
    symbols = F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))
    chars = F.length(F.regexp_replace("_t", WORD_GAP, ""))
    d = d.withColumns({"word_chars": chars.cast("long"), "n_symbols": symbols.cast("long"), "n_dup_lines": dups.cast("long")}).drop("_t", "_lines")
    return d.withColumn("base_failed", (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_percent * F.col("n_words")))


def _normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), WORD_GAP, " "))


def line_removals(docs: DataFrame, text: str = "text", host: str = "source", min_documents: int = 10, per_mille: int = 10, min_texts: int = 10) -> DataFrame:
    """(host, text_a, text_b, words_removed, lines_removed, removed) for the texts that lose a line; removed has the lines' places.

    A line goes when more than ``min_documents`` and more than ``per_mille`` thousandths of the host's documents hold it,
    and more than ``min_texts`` of them differ.
    """
    placed = F.filter(F.transform(F.split("t", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda x: x["x"].rlike(HAS_WORD))
    normal = F.transform(placed, lambda x: F.struct(x["i"].alias("i"), _normal(x["x"]).alias("x")))
    hashed = F.transform(normal, lambda m: F.struct(m["i"].alias("i"), F.xxhash64(m["x"]).alias("line"), (F.length(m["x"]) - F.length(F.replace(m["x"], F.lit(" "), F.lit(""))) + 1).alias("n")))
    d = docs.select(F.col(host).alias("host"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    texts = d.select("host", *text_keys(F.col("t")), hashed.alias("l")).groupBy("host", "text_a", "text_b").agg(F.first("l").alias("l"), F.count("*").alias("copies"))
    lines = texts.select("host", "text_a", "text_b", "copies", F.explode("l").alias("l")).groupBy("host", "text_a", "text_b", "l.line").agg(F.first("copies").alias("copies"), F.sum("l.n").alias("n"), F.count("*").alias("times"), F.collect_list("l.i").alias("at"))
    lines = checkpoint(lines)  # hashes and places, read twice
    limits = d.groupBy("host").agg(F.greatest(F.lit(1000 * min_documents), F.count("*") * per_mille).alias("most"))
    often = lines.groupBy("host", "line").agg(F.sum("copies").alias("documents"), F.count("*").alias("texts")).where(F.col("texts") > min_texts)
    often = often.join(limits, often.host.eqNullSafe(limits.host)).where("1000 * documents > most").select(often.host.alias("h"), F.col("line").alias("often"))
    return lines.join(often, F.col("host").eqNullSafe(F.col("h")) & (F.col("line") == F.col("often"))).groupBy("host", "text_a", "text_b").agg(F.sum("n").alias("words_removed"), F.sum("times").alias("lines_removed"), F.flatten(F.collect_list("at")).alias("removed"))


def _judged(base: DataFrame, gone: DataFrame, text: Column, host: Column, min_words: int, max_removed_percent: int) -> DataFrame:
    """``base`` with what its texts lose, words_left and kept."""
    t = F.coalesce(text, F.lit(""))
    # Written first, so that both sides are shuffled for the join and adaptive execution can split a text that a third
    # of all documents share.
    gone = checkpoint(gone.withColumnsRenamed({"host": "_host", "text_a": "_ta", "text_b": "_tb", "words_removed": "_words"}))
    base = base.withColumns({"_a": F.xxhash64(t), "_b": F.xxhash64(F.lit(7), t)})
    d = base.join(gone, host.eqNullSafe(F.col("_host")) & (F.col("_a") == F.col("_ta")) & (F.col("_b") == F.col("_tb")), "left")
    removed = F.coalesce("_words", F.lit(0))
    depleted = (removed > 0) & ((100 * removed > max_removed_percent * F.col("n_words")) | (F.col("n_words") - removed < min_words))
    d = d.withColumns({"words_left": F.col("n_words") - removed, "lines_removed": F.coalesce("lines_removed", F.lit(0)), "kept": ~F.col("base_failed") & ~depleted})
    return d.drop("_a", "_b", "_host", "_ta", "_tb", "_words")


def quality_rules(docs: DataFrame, text: str = "text", host: str = "source", min_words: int = 50, max_repeat_percent: int = 50, max_removed_percent: int = 50, **limits: int) -> DataFrame:
    """``docs`` with the base measures, lines_removed, removed (their places), words_left and kept, in place of columns of these names.

    ``limits`` are those of ``line_removals``.
    """
    base = base_measures(docs.drop("lines_removed", "removed"), F.col(text), min_words, max_repeat_percent)
    return _judged(base, line_removals(docs, text, host, **limits), F.col(text), F.col(host), min_words, max_removed_percent)


def kept_documents(docs: DataFrame, text: str = "text", host: str = "source", min_words: int = 50, max_repeat_percent: int = 50, max_removed_percent: int = 50, **limits: int) -> DataFrame:
    """The rows of ``docs`` that pass, without the lines above their host's limits."""
    own_text, own_host = F.col("_row").getField(text), F.col("_row").getField(host)
    # A text is shuffled once, inside its row, and only if the row passes the base rules. Verdicts go through an explode:
    # a filter on them directly would be pushed below the measures and make each window of a text measure the whole anew.
    only = lambda d, ok: d.withColumn("_ok", F.explode_outer(F.array(ok))).where("_ok").drop("_ok")
    base = only(base_measures(docs.select(F.struct(*docs.columns).alias("_row")), own_text, min_words, max_repeat_percent), ~F.col("base_failed"))
    d = only(_judged(base, line_removals(docs, text, host, **limits), own_text, own_host, min_words, max_removed_percent), F.col("kept"))
    d = d.withColumn("_split", F.when(F.size("removed") > 0, F.split(own_text, "\n")))
    left = F.transform(F.array_except(F.sequence(F.lit(0), F.size("_split") - 1), "removed"), lambda i: F.get("_split", i))
    new = F.when(F.col("_split").isNull(), own_text).otherwise(F.array_join(left, "\n"))
    return d.select(F.col("_row").withField(text, new).alias("_row")).select("_row.*")


def query(docs: DataFrame) -> DataFrame:
    d = quality_rules(docs.select("doc_id", "text", "source"))
    return d.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lines_removed", "words_left")


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM d),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS gram FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
gg AS (SELECT r, i, count(*) OVER (PARTITION BY r, gram) AS c FROM g),
rep AS (SELECT r, count(DISTINCT p) AS n_repeat_words FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM gg WHERE c > 1) GROUP BY r),
l AS (SELECT r, source, t, unnest(string_split(t, chr(10))) AS line FROM d),
ll AS (SELECT r, source, t, line, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
dl AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM ll GROUP BY r),
often AS (SELECT source, norm, count(DISTINCT r) AS c, count(DISTINCT t) AS texts FROM ll GROUP BY source, norm),
lim AS (SELECT source, greatest(10000, 10 * count(*)) AS most FROM d GROUP BY source),
bad AS (SELECT o.source, o.norm FROM often o JOIN lim ON o.source IS NOT DISTINCT FROM lim.source WHERE o.texts > 10 AND 1000 * o.c > lim.most),
gone AS (SELECT r, sum(length(ll.norm) - length(replace(ll.norm, ' ', '')) + 1) AS words_removed, count(*) AS lines_removed
         FROM ll JOIN bad ON ll.source IS NOT DISTINCT FROM bad.source AND ll.norm = bad.norm GROUP BY r),
m AS (SELECT d.doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(words_removed, 0)::BIGINT AS rem, coalesce(lines_removed, 0)::BIGINT AS lines_removed
      FROM d JOIN w USING (r) LEFT JOIN rep USING (r) LEFT JOIN dl USING (r) LEFT JOIN gone USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT (rem > 0 AND (100 * rem > 50 * n_words OR n_words - rem < 50)) AS kept,
       lines_removed, n_words - rem AS words_left
FROM m
"""
