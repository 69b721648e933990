"""Operator 8, line dedup over overlapping three-line windows.

The lines of a document that hold a word are lower-cased, their white space made single blanks, and hashed. Every three
such lines in a row are a window. Of all windows of the corpus with equal content the one with the smallest (doc_id,
position) stays; every other occurrence covers its three lines, overlapping covers merge, and covered lines are removed.

Defined results: documents with fewer than three such lines have no window and stay whole; a null text stays null; lines
without a word stay where they are, unless the whole text goes; a document whose every such line is covered becomes the
empty text; rows without doc_id come last in the order; rows that share doc_id and text are one document and get the
same text. An empty table gives an empty table; further columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD_GAP, checkpoint, text_keys


def _has_word(x: Column) -> Column:
    return x.rlike(r"[^\x20\x09-\x0D]")


def windows(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, text_a, text_b, at, win_a, win_b): one row for each window; at holds its lines' places in the text."""
    normal = lambda x: F.trim(F.regexp_replace(F.lower(x), WORD_GAP, " "))
    placed = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    held = F.transform(F.filter(placed, lambda x: _has_word(x["x"])), lambda x: F.struct(x["i"].alias("i"), normal(x["x"]).alias("x")))
    d = docs.where("text IS NOT NULL").select("doc_id", *text_keys(F.col("text")), held.alias("l"))
    part = lambda i: F.slice("l", i, size)
    starts = F.sequence(F.lit(1), F.greatest(F.size("l") - size + 1, F.lit(1)))
    d = d.withColumn("w", F.when(F.size("l") >= size, F.transform(starts, lambda i: F.struct(part(i)["i"].alias("at"), F.concat_ws("\n", part(i)["x"]).alias("win")))))
    # An outer explode, since a plain one would add a filter below that makes the lines anew for every window.
    d = d.select("doc_id", "text_a", "text_b", F.explode_outer("w").alias("w")).where("w IS NOT NULL")
    return d.select("doc_id", "text_a", "text_b", "w.at", F.xxhash64("w.win").alias("win_a"), F.xxhash64(F.lit(11), "w.win").alias("win_b"))


def repeats(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, text_a, text_b, covered): for each document that repeats earlier windows, the places of the lines they cover."""
    win = checkpoint(windows(docs, size))  # a few hashes a line, read twice
    place = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", F.get("at", F.lit(0)).alias("at"))
    first = win.groupBy("win_a", "win_b").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("win_a").alias("a"), F.col("win_b").alias("b"), "first")
    # Written first, so that both sides of the join are shuffled for it and adaptive execution can split a window that a
    # third of all documents share.
    first = checkpoint(first)
    late = win.join(first, (F.col("win_a") == F.col("a")) & (F.col("win_b") == F.col("b"))).where(place != F.col("first"))
    return late.groupBy("doc_id", "text_a", "text_b").agg(F.collect_set("at").alias("at")).select(
        "doc_id", "text_a", "text_b", F.array_distinct(F.flatten("at")).alias("covered"))


def line_dedup(docs: DataFrame, size: int = 3) -> DataFrame:
    """(row, text, n_lines, n_removed): each row of ``docs`` as a struct, its reduced text, and its lines with a word before and taken."""
    gone = repeats(docs, size).withColumnsRenamed({"doc_id": "_id", "text_a": "_a", "text_b": "_b"})
    a, b = text_keys(F.col("text"))
    # A row's text is shuffled once, inside the row.
    d = docs.select(F.struct(*docs.columns).alias("row"), a.alias("_ta"), b.alias("_tb"))
    d = d.join(gone, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.col("_ta") == F.col("_a")) & (F.col("_tb") == F.col("_b")), "left").withColumn("text", F.col("row.text"))
    full = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), _has_word)
    d = d.select("row", "text", "covered", F.size(full).cast("long").alias("n_lines"), F.coalesce(F.size("covered"), F.lit(0)).cast("long").alias("n_removed"), F.when(F.size("covered") > 0, F.split("text", "\n")).alias("split"))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("split") - 1), "covered"), lambda i: F.get("split", i))
    text = F.when(F.col("split").isNull(), F.col("text")).when(F.col("n_removed") >= F.col("n_lines"), "").otherwise(F.array_join(kept, "\n"))
    return d.select("row", text.alias("text"), "n_lines", "n_removed")


def kept_documents(docs: DataFrame, size: int = 3) -> DataFrame:
    """The rows of ``docs`` with their reduced texts; those that lose all their lines go."""
    d = line_dedup(docs, size).where("n_removed = 0 OR n_removed < n_lines")
    return d.select(F.col("row").withField("text", F.col("text")).alias("row")).select("row.*")


def query(docs: DataFrame) -> DataFrame:
    return line_dedup(docs.select("doc_id", "text")).select("row.doc_id", "n_lines", "n_removed", "text")


SQL = r"""
WITH d AS (SELECT doc_id, text FROM documents),
l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id) AS p, line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d)),
n AS (SELECT doc_id, p, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS k
      FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT a.doc_id, a.k, a.norm || chr(10) || b.norm || chr(10) || c.norm AS win FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.k = a.k + 1 JOIN n c ON a.doc_id = c.doc_id AND c.k = a.k + 2),
late AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY win ORDER BY doc_id, k) AS o FROM w) WHERE o > 1),
gone AS (SELECT DISTINCT doc_id, x.k + j AS k FROM late x, (SELECT unnest([0, 1, 2]) AS j)),
cut AS (SELECT n.doc_id, n.p FROM n JOIN gone USING (doc_id, k)),
s AS (SELECT doc_id, (SELECT count(*) FROM n WHERE n.doc_id = d.doc_id) AS n_lines, (SELECT count(*) FROM cut WHERE cut.doc_id = d.doc_id) AS n_removed, text FROM d),
t AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.p) AS kept FROM l LEFT JOIN cut ON l.doc_id = cut.doc_id AND l.p = cut.p WHERE cut.p IS NULL GROUP BY l.doc_id)
SELECT s.doc_id, n_lines, n_removed, CASE WHEN n_removed = 0 THEN text WHEN n_removed >= n_lines THEN '' ELSE kept END AS text FROM s LEFT JOIN t USING (doc_id)
"""
