"""The registered queries of the training-data operators, with their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, embedding_dedup, hard_negatives, html_text, language_id, license_scan, line_dedup, mixing, packing, quality_rules, similarity, toxicity, warc
from .common import table


def _documents(run: Callable[[DataFrame], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: run(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": lambda spark, sf_dir: warc.query(table(spark, sf_dir, "pages")),
    "op10_toxicity": lambda spark, sf_dir: toxicity.query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")),
    "op11_license_scan": _documents(license_scan.query),
    "op12_collocations": _documents(collocations.query),
    "op13_hard_negatives": lambda spark, sf_dir: hard_negatives.query(table(spark, sf_dir, "embeddings")),
    "op2_mixing": _documents(mixing.query),
    "op3_packing": _documents(packing.query),
    "op4_html_extraction": lambda spark, sf_dir: html_text.query(table(spark, sf_dir, "pages")),
    "op5_language_id": lambda spark, sf_dir: language_id.query(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")),
    "op6_ngram_jaccard_join": _documents(similarity.query),
    "op7_quality_rules": _documents(quality_rules.query),
    "op8_line_dedup": _documents(line_dedup.query),
    "op9_embedding_dedup": lambda spark, sf_dir: embedding_dedup.query(table(spark, sf_dir, "embeddings")),
}

SQL: dict[str, str] = {
    "op12_collocations": collocations.SQL,
    "op13_hard_negatives": hard_negatives.SQL,
    "op2_mixing": mixing.SQL,
    "op6_ngram_jaccard_join": similarity.SQL,
    "op7_quality_rules": quality_rules.SQL,
    "op8_line_dedup": line_dedup.SQL,
    "op9_embedding_dedup": embedding_dedup.SQL,
}
