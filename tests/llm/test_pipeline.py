"""The pipeline stage by stage against brute force, and its entry."""

import re

import cases
import pytest
from test_pair_operators import contaminated

import corpus_pipeline
from veilframe.llm import decontaminate, langid, pii

public_tokenizers = pytest.importorskip("public_tokenizers")


def stages(spark, docs, sf_dir):
    out = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != "bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
        docs = docs.cache()
        out.append(docs.collect())
    return out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{cases.SF}/documents.parquet")
    language, near, clean, private, coded = stages(spark, docs, cases.SF)
    texts = dict(cases.table("documents", ["doc_id", "text"]))
    assert {r.doc_id for r in language} == {i for i, t in texts.items() if re.search(r"[^\W\d_]", t)}
    groups = cases.components([(r.doc_id, r.text) for r in language])
    assert sorted(r.doc_id for r in near) == sorted(i for i, (_, c) in groups.items() if i == c)
    items = cases.table("benchmark", ["item_id", "text"])
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in near if not contaminated(r.text, items)[3])
    assert sorted(r.doc_id for r in private) == sorted(r.doc_id for r in clean)
    for r in private:
        assert r.n_chars == len(r.text)
        assert r.text == texts[r.doc_id] or any(cases.personal(texts[r.doc_id])["counts"])
        assert not any(cases.personal(r.text)["counts"])
    done = {r.doc_id: r for r in coded}
    assert {r.doc_id for r in private} == {*done}
    for r in private:
        assert done[r.doc_id].text_sha256 == cases.sha(r.text)
        assert done[r.doc_id].n_tokens == len(done[r.doc_id].ids)


def test_run_equals_the_stages(spark):
    assert corpus_pipeline.run(spark, cases.SF).count() == len(stages(spark, spark.read.parquet(f"{cases.SF}/documents.parquet"), cases.SF)[-1])
    assert 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_take_odd_and_empty_documents(spark):
    odd = cases.odd_documents(spark)
    language, near, clean, private, coded = stages(spark, odd, cases.SF)
    assert len(language) >= len(near) >= len(clean) == len(private) == len(coded)
    assert not {0, 1, 2} & {r.doc_id for r in language}
    assert [r.doc_id for r in near].count(6) == 1
    assert all(not x for x in stages(spark, cases.empty_documents(spark), cases.SF))


def test_operators_that_keep_columns(spark):
    odd = cases.odd_documents(spark)
    network = langid.fit(spark.read.parquet(f"{cases.SF}/documents.parquet"))
    told = {(r.doc_id, r.lang_pred, round(r.score, 6)) for r in langid.predict(odd, network).collect()}
    kept = langid.annotate(odd, network)
    assert {(r.doc_id, r.lang_pred, round(r.score, 6)) for r in kept.collect()} == told
    assert kept.columns == [*odd.columns, "lang_pred", "score"]
    benchmark = spark.createDataFrame([(1, "x y z a b c"), (2, "one two three four five")], "item_id long, text string")
    for size in (8 << 20, 10):
        left = decontaminate.clean(odd, benchmark, block_bytes=size)
        assert left.columns == odd.columns
        bad = decontaminate.contamination(odd, benchmark, block_bytes=size).where("contaminated").count()
        assert left.count() == odd.count() - bad < odd.count()
    assert pii.sanitise(odd).columns == odd.columns


def test_rows_of_one_id_are_told_apart_and_rows_without_an_id_compared(spark):
    a, b, c = ("one two three four five six", "a b c d e f g h", "no id here at all today")
    rows = [(1, a), (1, b), (1, a), (2, a), (None, b), (None, c), (None, c)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    found = [(r.doc_id, r.text) for r in corpus_pipeline.jaccard_join(spark, docs, cases.SF).collect()]
    assert sorted(found, key=str) == sorted([(1, a), (1, b), (None, c)], key=str)


def test_documents_stay_where_no_language_can_be_learned(spark):
    rows = [(1, "some words"), (2, "é"), (3, "12 _ 3"), (4, ""), (5, None)]
    docs = spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.language_id(spark, docs, cases.SF).collect()} == {1, 2}
