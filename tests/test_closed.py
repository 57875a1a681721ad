"""Nothing personal leaves: null and repeated ids, entities that a mapping lacks, mappings of any size."""

import json

from pyspark.sql import functions as F

from veilframe.operators import mapping, rewrite
from veilframe.sources import chat

ANN, BOB = "ann.lee@post.example", "bob@mail.example"


def test_entities_that_the_mapping_lacks_get_pseudonyms(spark):
    docs = spark.createDataFrame([(1, f"to {ANN}"), (2, f"cc {BOB} and {ANN}")], "id long, text string")
    known = rewrite.build_mapping(docs.where("id = 1"), "id", salt="s")
    changed, replaced, used = rewrite.run(docs, "id", known=known, salt="s")
    out = {r.id: r.text for r in changed.collect()}
    assert not any(x in t for t in out.values() for x in (ANN, BOB))
    assert {r.original for r in used.collect()} == {ANN, BOB}
    assert replaced.count() == 3
    assert {r.id: r.text for r in rewrite.restore(changed, used).collect()} == {r.id: r.text for r in docs.collect()}
    assert BOB not in str(rewrite.pseudonymize(docs, known, "id")[0].collect())


def test_null_and_repeated_ids(spark):
    docs = spark.createDataFrame([(None, f"a {ANN}"), (None, f"b {BOB}"), (7, f"c {ANN}"), (7, "d 10.1.2.3"), (7, f"c {ANN}")], "id long, text string")
    known = rewrite.build_mapping(docs, "id", salt="s")
    changed, replaced = rewrite.pseudonymize(docs, known, "id")
    texts = [r.text for r in changed.collect()]
    assert sorted(t[0] for t in texts) == ["a", "b", "c", "c", "d"]
    assert not any(x in t for t in texts for x in (ANN, BOB, "10.1.2.3"))
    assert replaced.where("id IS NULL").count() == 2


def test_columns_with_names_of_our_own(spark):
    docs = spark.createDataFrame([(1, f"to {ANN}", "mine", "k")], "id long, text string, entities string, v string")
    changed = rewrite.run(docs, "id").changed
    assert changed.columns == docs.columns
    assert (changed.first().entities, changed.first().v) == ("mine", "k")
    assert ANN not in changed.first().text


def test_requests_without_an_id(spark):
    body = lambda t: json.dumps({"messages": [{"role": "user", "content": t}]})
    rows = [(None, "/v1/messages", body(f"x {ANN}")), (None, "/v1/messages", body(f"y {BOB} {BOB}")), (3, "/v1/messages", body(f"z {ANN}")), (3, "/v1/chat/completions", body("plain")), (4, "/v1/messages", '{"messages":')]
    out, _, bad = chat.pseudonymize_requests(spark.createDataFrame(rows, "request_id long, path string, body string"), salt="s")
    got = [(r.request_id, json.loads(r.body)["messages"][0]["content"], r.pii_count) for r in out.collect()]
    assert sorted((t[0], n) for _, t, n in got) == [("p", 0), ("x", 1), ("y", 2), ("z", 1)]
    assert not any(x in t for _, t, _ in got for x in (ANN, BOB))
    assert [r.request_id for r in bad.collect()] == [4]


def test_bodies_that_cannot_be_rewritten_are_quarantined():
    assert chat.set_paths('{"a":1}', ["b.text"], ["x"], strict=True) is None
    assert chat.set_paths("no", ["b"], ["x"], strict=True) is None


def test_large_mappings_restore_alike(spark, monkeypatch):
    known = spark.createDataFrame([("Zoe", "Kim"), ("Zoe Quist", "Kim Strand"), ('a"b', 'q"\\'), ("él", "x")], "pseudonym string, original string")
    docs = spark.createDataFrame([(1, "Zoe Quist, Zoe; él"), (2, None), (3, ""), (4, "nothing"), (1, "Zoe Quist, Zoe; él")], "id long, text string")
    bodies = spark.createDataFrame([(1, json.dumps({"Zoe": ['say a"b', {"t": "Zoe Quist é"}, 1, None]})), (2, "raw Zoe"), (3, None), (4, "{}")], "id long, body string")
    want = sorted(map(str, rewrite.restore(docs, known).collect())), sorted(map(str, chat.restore_responses(bodies, known).collect()))
    assert json.loads(chat.restore_responses(bodies, known).where("id = 1").first().body) == {"Zoe": ['say q"\\', {"t": "Kim Strand é"}, 1, None]}
    monkeypatch.setattr(rewrite, "AUTOMATON_BYTES", 10)
    assert sorted(map(str, rewrite.restore(docs, known).collect())) == want[0]
    assert sorted(map(str, chat.restore_responses(bodies, known).collect())) == want[1]


def test_new_pseudonyms_are_no_originals_and_none_that_is_known(spark):
    found = spark.createDataFrame([("SURNAME", f"n{i}") for i in range(60)], "entity_type string, value string")
    first = mapping.build(found.limit(1), "s").withColumn("original", F.lit("first"))
    drawn = [r.pseudonym for r in mapping.build(found, "s").collect()]
    known = spark.createDataFrame([(d, f"taken {i}") for i, d in enumerate(drawn[:30])] + [(f"old {i}", d) for i, d in enumerate(drawn[30:45])], "original string, pseudonym string")
    rows = mapping.extend(known, found, "s").collect()
    assert len({r.pseudonym for r in rows}) == len(rows) == 105
    assert not {r.pseudonym for r in rows} & {r.original for r in rows}
    assert first.count() == 1


def test_white_space_costs_time_in_proportion(spark):
    from time import time

    from veilframe.operators import detect

    text = "pass" + "word" + " " * 200_000 + "x"
    began = time()
    assert detect.entities(spark.createDataFrame([(1, text)], "id long, text string"), "id").count() == 0
    assert time() - began < 60
