from __future__ import annotations

import corpus_pipeline
from lakescan.llm import queries, similarity

from . import brute
from .test_text_operators import corpus


def test_equals_brute_force_stage_by_stage(spark, tmp_path):
    rows = corpus(21, 260)
    d = spark.createDataFrame([(*r[:2], "en", r[2], len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.doc_id, r.sequence_id): (r.start, r.length, r.ids_crc32, r.doc_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    kept = [(r[0], left, r[2]) for r, (ok, left, *_) in zip(rows, brute.kept_texts(rows), strict=True) if ok]
    lines = brute.deduped([r[:2] for r in kept])
    kept = [(d, lines[d][2], s) for d, _, s in kept if not lines[d][1] or lines[d][1] < lines[d][0]]
    found = brute.jaccard([r[:2] for r in kept])
    kept = [r for r in kept if found[r[0]][1] == r[0]]
    _, taken = brute.mixed(kept)
    want = []
    for d, t, _ in kept:
        want += [(d, *p) for p in brute.pieces(t) for _ in range(taken[d] // max(1, len(brute.words(t))))]
    assert sorted((d, *x) for (d, _), x in got.items()) == sorted(want) and want


def test_stages_keep_the_columns_and_clash_with_no_extra_ones(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "ngram_jaccard_join", "mixing", "packing"]
    d = spark.createDataFrame([(1, None, "en", None, 0, 1)], "doc_id long, text string, lang string, source string, n_chars long, kept int").where("false")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        d = stage(spark, d, "")
        assert d.columns == ["doc_id", "text", "lang", "source", "n_chars", "kept"] and d.count() == 0


def test_near_duplicates_write_only_what_documents_share(spark, monkeypatch):
    """To find cells, the stage writes no shingle that one document has alone; texts that merely share a passage all stay."""
    own = lambda n, k: " ".join(f"d{n}x{i}" for i in range(k))
    rows = [(n, f"{own(n, 250)} {own(-1, 60)}", "en", "s", 0) for n in range(50)] + [(90, own(90, 300), "en", "s", 0), (91, own(90, 299) + " z", "en", "s", 0)]
    written, edges = [], similarity._edges
    monkeypatch.setattr(similarity, "_edges", lambda prefixes: written.append(prefixes.count()) or edges(prefixes))
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    kept = dict(corpus_pipeline.STAGES)["ngram_jaccard_join"](spark, d, "")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == [*range(50), 90]
    assert 0 < written[0] <= 2 * similarity.prefix_length(296)


def test_every_operator_is_registered_once():
    assert sorted(int(k[2:].split("_")[0]) for k in queries.QUERIES) == list(range(1, 11)) and set(queries.SQL) <= set(queries.QUERIES)
