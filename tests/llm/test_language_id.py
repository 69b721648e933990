from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lakescan.llm import language_id


def texts(spark, rows):
    return spark.createDataFrame(rows, "kind string, id long, text string, url string, host string")


def labelled(spark):
    en = "the quick brown fox jumps over the lazy dog and runs through the old forest with its friends number {}"
    de = "der schnelle braune fuchs springt über den faulen hund und läuft durch den alten wald mit freunden nummer {}"
    rows = [(i, (en if i % 2 else de).format(i), "en" if i % 2 else "de") for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_text_markup_suffix_and_host_each_speak(spark):
    model = language_id.train(labelled(spark))
    page = "<html lang='{}'><body><article><p>{}</p></article></body></html>"
    rows = [("page", i, page.format("de", "der alte hund läuft durch den wald und springt"), f"http://a.de/{i}", None) for i in range(20)]
    rows += [("page", 100 + i, page.format("en", "the old dog runs through the forest and jumps"), f"http://b.com/en/{i}", None) for i in range(20)]
    rows += [("page", 200, page.format("de", "42"), "http://c.org/", None), ("page", 201, "<p>42</p>", "http://d.de/", None), ("page", 202, None, "http://www.b.com/x", None)]
    rows += [("document", 1, "the dog", None, "s"), ("document", 2, None, None, None), ("document", 2, None, None, None)]
    got = {(r.kind, r.id): r.language for r in language_id.identify(texts(spark, rows), model).collect()}
    assert all(got["page", i] == "de" and got["page", 100 + i] == "en" for i in range(20))
    assert got["page", 200] == "de" and got["page", 201] == "de" and got["page", 202] == "en"
    assert got["document", 1] == "en" and got["document", 2] in ("de", "en")


def test_a_wrong_declaration_loses_to_a_long_text(spark):
    model = language_id.train(labelled(spark))
    rows = [("page", 1, "<html lang=de><p>" + "the quick dog runs with friends through the old forest " * 20, "http://x.org/", None)]
    r = language_id.identify(texts(spark, rows), model).first()
    assert (r.language, r.declared) == ("en", "de") and r.probability > 0.9


def test_without_labels_and_empty_tables(spark):
    none = labelled(spark).where("false")
    assert language_id.train(none) is None
    assert language_id.identify(texts(spark, [("document", 1, "x", None, "s")]), None).first().language == "und"
    assert language_id.identify(texts(spark, []), language_id.train(labelled(spark))).count() == 0


def test_pieces_of_long_texts_add_up():
    text = "wort " * 5000
    whole = np.concatenate(list(language_id.trigrams(text)))
    assert (np.concatenate(list(language_id.trigrams(text, 1000))) == whole).all()


def test_held_out_accuracy(spark):
    docs = labelled(spark)
    model = language_id.train(docs.where("doc_id < 40"))
    rows = docs.where("doc_id >= 40").selectExpr("'document' AS kind", "doc_id AS id", "text", "CAST(NULL AS string) AS url", "'s' AS host")
    got = language_id.identify(rows, model).join(docs.withColumnRenamed("doc_id", "id"), "id").collect()
    assert len(got) == 20 and all(r.language == r.lang for r in got)


def test_every_label_is_learned_from_short_and_long_texts_alike(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    word = lambda k: letters[k % 26] + letters[k // 26 + 3] + letters[(k * 7 + 1) % 26]
    rows = [(k * 10 + j, " ".join([word(k) + letters[(j + x) % 4] for x in range(40)]), f"l{k}") for k in range(70) for j in range(3 - (k > 64))]
    rows += [(9001, "ŝaĝa ĉevalo ĵetas", "short"), (9002, "ŝaĝa ĉevalo", "short"), (9003, "жёлтый конь " * 3000, "long")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    assert set(model.languages) == {f"l{k}" for k in range(70)} | {"short", "long"}
    best = lambda text: model.languages[int(language_id.log_likelihoods(model, text, 150).argmax())]
    assert best("жёлтый конь") == "long" and best("ŝaĝa ĉevalo") == "short"
    assert all(best(" ".join([word(k) + c for c in "abcd"])) == f"l{k}" for k in range(70))


def test_a_long_text_gives_all_its_pieces_and_short_ones_give_way(spark):
    rows = [(1, "aa " * 40 + "zzz " * 40, "x"), (2, "qqq", "x")]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), chars_most=120)
    at = lambda s: np.concatenate(list(language_id.trigrams(s)))
    assert model.log_p[at("zzz")[1], 0] > model.log_p[at("qqq")[1], 0] == model.log_p.min()


def test_query_over_pages_and_documents(spark):
    docs = labelled(spark).withColumn("source", F.lit("wiki")).selectExpr("*", "1 AS kind", "2 AS id", "3 AS url", "4 AS p")
    docs = docs.unionByName(spark.createDataFrame([(900, None, None, None), (901, "", "en", "x"), (902, "der alte hund und der wald " * 4_000, None, None)], "doc_id long, text string, lang string, source string").selectExpr("*", "1 AS kind", "2 AS id", "3 AS url", "4 AS p"))
    pages = spark.createDataFrame([(1, None, "<p>der alte hund läuft durch den wald</p>"), (2, "http://b.com/", None), (2, "http://b.com/", None), (3, "http://b.com/", "<p>the old dog runs through the forest</p>" * 2_000)], "page_id long, url string, html string").selectExpr("*", "1 AS kind", "2 AS text", "3 AS host", "4 AS lang")
    got = language_id.query(pages, docs).collect()
    by_doc, by_page = {r.doc_id: r.language for r in got if r.doc_id is not None}, {r.page_id: r.language for r in got if r.page_id is not None}
    assert len(got) == 67 and by_doc[902] == "de" and by_page[1] == "de" and by_page[3] == "en" and all(by_doc[i] == ("en" if i % 2 else "de") for i in range(60))
    assert language_id.query(pages.where("false"), docs.where("false")).count() == 0
