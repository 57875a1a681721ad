"""Token classifiers' output to entities."""

import pytest

from pyspark.sql import functions as F
from veilframe.operators import labels

LABELS = ["B-EMAIL", "I-GIVENNAME", "O"]


def decoded(spark, text, tokens, offset=0):
    rows = [(1, text, [(s, e) for s, e, *_ in tokens], [(k, c) for *_, k, c in tokens])]
    df = spark.createDataFrame(rows, "doc long, text string, offsets array<struct<s:int,e:int>>, preds array<struct<label_id:int,confidence:double>>")
    return [(r.entity_type, r.value, r.start, r.end, round(r.confidence, 4)) for r in labels.decode(df, LABELS, offset=F.lit(offset)).orderBy("start").collect()]


def test_decode(spark):
    text = "hi Marie Curie me@x.io"
    assert decoded(spark, text, [(0, 2, 2, 1.0), (3, 8, 1, 0.85), (9, 14, 1, 0.95), (15, 22, 0, 0.5)]) == [("GIVEN_NAME", "Marie Curie", 3, 14, 0.9)]
    assert decoded(spark, text, [(3, 8, 1, 0.9), (0, 0, 1, 0.9), (9, 14, 1, 0.9)], 100) == [("GIVEN_NAME", "Marie", 103, 108, 0.9), ("GIVEN_NAME", "Curie", 109, 114, 0.9)]
    assert decoded(spark, text, [(2, 9, 1, 0.9), (14, 15, 0, 0.9)]) == [("GIVEN_NAME", "Marie", 3, 8, 0.9)]
    assert decoded(spark, text, [(3, 8, 17, 0.9)]) == []


def test_softmax_takes_the_last_of_equals(spark):
    row = spark.createDataFrame([([1.0, 3.0, 3.0],)], "x array<float>").select(labels.prediction(F.col("x")).alias("p"), labels.softmax(F.col("x")).alias("s")).first()
    assert row.p.label_id == 2
    assert sum(row.s) == pytest.approx(1)


def test_segments(spark):
    assert labels.cut("short") == [(0, "short")]
    assert labels.cut("") == labels.cut(None) == [(0, "")]
    text = "word " * 1000
    pieces = labels.cut(text)
    assert all(text[at : at + len(p)] == p and len(p) <= labels.SEGMENT for at, p in pieces)
    assert all(p.endswith(" ") for _, p in pieces)
    assert all(b <= a + len(p) for (a, p), (b, _) in zip(pieces, pieces[1:], strict=False))
    assert pieces[-1][0] + len(pieces[-1][1]) == len(text)
    solid = labels.cut("x" * 5000)
    assert solid[-1][0] + len(solid[-1][1]) == 5000
    rows = labels.segments(spark.createDataFrame([(1, text), (2, None)], "id long, text string"), "id").collect()
    assert [(r.global_offset, r.segment) for r in sorted(rows, key=lambda r: (r.id, r.seg)) if r.id == 1] == pieces


def test_label_map():
    assert labels.label_map('{"id2label": {"0": "B-X", "3": "I-X"}}') == ["B-X", "O", "O", "I-X"]
    assert labels.label_map("{}") == []


def test_merge(spark):
    rows = [(1, 0, 5, 15, "EMAIL", 0.8), (1, 1, 6, 15, "EMAIL", 0.92), (1, 1, 40, 44, "CITY", 0.8), (2, 0, 5, 15, "EMAIL", 0.9), (2, 1, 10, 18, "CITY", 0.9)]
    df = spark.createDataFrame(rows, "doc long, seg int, start int, end int, entity_type string, confidence double")
    found = sorted((r.doc, r.start, r.end, r.entity_type) for r in labels.merge_segments(df, "doc").collect())
    assert found == [(1, 6, 15, "EMAIL"), (1, 40, 44, "CITY"), (2, 5, 15, "EMAIL")]
