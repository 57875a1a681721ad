"""Generators, mapping, rewriting and restoring."""

import re

import pytest
from pyspark.sql import functions as F

from veilframe.functions import validators
from veilframe.operators import detect, generate, mapping, rewrite


def pseudonyms(spark, kind, originals, salt="s"):
    rows = spark.createDataFrame([(o,) for o in originals], "o string")
    return [r.p for r in rows.select(generate.pseudonym(F.lit(kind), F.col("o"), salt).alias("p")).collect()]


def test_pools():
    for pool in (generate.FIRST_NAMES, generate.LAST_NAMES):
        assert len(pool) == len({*pool}) >= 40


@pytest.mark.parametrize(
    ("kind", "original", "pattern"),
    [
        ("EMAIL", "a@b.fr", r"[a-z]+\d+@example\.com"),
        ("PHONE_NUMBER", "06 12-34.56 78", r"\d\d \d\d-\d\d\.\d\d \d\d"),
        ("CREDIT_CARD", "4111 1111 1111 1111", r"4\d{15}"),
        ("IBAN", "FR7630006000011234567890189", r"FR\d{25}"),
        ("API_KEY", "ghp_" + "a" * 36, r"ghp_[A-Za-z0-9]{36}"),
        ("PASSWORD", "abc-defghijk", r"[A-Za-z0-9]{12}"),
        ("NATIONAL_ID", "1 85 05 78 006 084 36", r"\d \d\d \d\d \d\d \d{3} \d{3} \d\d"),
        ("IP_ADDRESS", "10.1.2.33", r"\d+\.\d+\.\d+\.33"),
        ("IP_ADDRESS", "1:2:3:4:5:6:7:8", r"fd00::[0-9a-f]+:[0-9a-f]+"),
        ("DATE_OF_BIRTH", "x", r"[0-2]\d/[01]\d/(19[5-9]|200)\d"),
        ("ZIP_CODE", "x", r"\d{5}"),
        ("USERNAME", "x", r"user_[a-z]+\d\d"),
        ("UNKNOWN", "x", r"\[PSEUDO-\d{4}\]"),
        ("STREET", "x", r"\d+ rue des Tilleuls"),
        ("POSTAL_ADDRESS", "x", r"\d+ rue des Tilleuls, 59000 Lille"),
    ],
)
def test_formats(spark, kind, original, pattern):
    (p,) = pseudonyms(spark, kind, [original])
    assert re.fullmatch(pattern, p)
    assert pseudonyms(spark, kind, [original]) == [p]
    assert p != original


def test_generated_numbers_are_valid(spark):
    cards = spark.createDataFrame([(p,) for p in pseudonyms(spark, "CREDIT_CARD", map(str, range(50)))], "p string")
    assert cards.where(~validators.luhn_valid(F.col("p"))).count() == 0
    ibans = spark.createDataFrame([(p,) for p in pseudonyms(spark, "IBAN", map(str, range(50)))], "p string")
    assert ibans.where(~validators.iban_valid(F.col("p"))).count() == 0
    names = pseudonyms(spark, "GIVEN_NAME", generate.FIRST_NAMES)
    assert {*names} <= {*generate.FIRST_NAMES}
    assert all(a.lower() != b.lower() for a, b in zip(names, generate.FIRST_NAMES, strict=True))


def test_networks_stay_together(spark):
    a, b, c, d = pseudonyms(spark, "IP_ADDRESS", ["10.1.2.10", "10.1.2.20", "010.1.2.30", "10.1.3.10"])
    net = lambda x: x.rpartition(".")[0]
    assert net(a) == net(b) == net(c) != net(d)
    assert [x.rpartition(".")[2] for x in (a, b, c, d)] == ["10", "20", "30", "10"]


def test_mapping_is_injective_and_typed_once(spark):
    rows = [("SURNAME", f"n{i}") for i in range(400)] + [("GIVEN_NAME", "n1"), ("EMAIL", "a@b.fr")]
    built = mapping.build(spark.createDataFrame(rows, "entity_type string, value string"), "s").collect()
    assert len(built) == 401
    assert len({r.pseudonym for r in built}) == len({r.id for r in built}) == 401
    assert not {r.pseudonym for r in built} & {r.original for r in built}


def test_extending_keeps_what_is_known(spark):
    old = mapping.build(spark.createDataFrame([("EMAIL", "a@b.fr")], "entity_type string, value string"), "s")
    new = mapping.extend(old, spark.createDataFrame([("EMAIL", "a@b.fr"), ("EMAIL", "c@d.fr")], "entity_type string, value string"), "s").collect()
    assert sorted(r.original for r in new) == ["a@b.fr", "c@d.fr"]
    assert old.first().pseudonym in {r.pseudonym for r in new}


def test_encryption(spark):
    plain = mapping.build(spark.createDataFrame([("EMAIL", "é@b.fr"), ("EMAIL", "x@y.zz")], "entity_type string, value string"))
    key = F.unhex(F.sha2(F.lit("k"), 256))
    locked = mapping.encrypted(plain, key)
    assert "original" not in locked.columns
    assert sorted(r.original for r in mapping.decrypted(locked, key).collect()) == ["x@y.zz", "é@b.fr"]
    assert mapping.decrypted(locked, F.unhex(F.sha2(F.lit("other"), 256))).count() == 0
    assert [r.pseudonym for r in mapping.longest_first(plain).collect()] == sorted((r.pseudonym for r in plain.collect()), key=lambda p: (-len(p), p))


def test_round_trip(spark):
    texts = ["mail lena@box.org twice lena@box.org", "hosts 10.0.0.1, 10.0.0.2 and é 06 12 34 56 78", "nothing", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    known = rewrite.build_mapping(docs, "id", salt="s").cache()
    changed, replaced = rewrite.pseudonymize(docs, known, "id")
    out = {r.id: r.text for r in changed.collect()}
    assert "lena@box.org" not in out[0]
    assert len({*re.findall(r"\S+@example\.com", out[0])}) == 1
    assert out[2] == "nothing"
    assert out[3] is None
    assert replaced.count() == 5
    assert {r.id: r.text for r in rewrite.restore(changed, known).collect()} == dict(enumerate(texts))


@pytest.mark.parametrize("size", [64 << 20, 70])
def test_longest_first(spark, monkeypatch, size):
    monkeypatch.setattr(rewrite, "AUTOMATON_BYTES", size)
    known = spark.createDataFrame([("Odile", "Rosa"), ("Odile Brun", "Ines Klar"), ("un", "zinc")], "pseudonym string, original string")
    docs = spark.createDataFrame([(1, "Odile Brun and Odile, un"), (2, None)], "id long, text string")
    assert {r.id: r.text for r in rewrite.restore(docs, known).collect()} == {1: "Ines Klar and Rosa, zinc", 2: None}


def test_fragments(spark):
    rows = [("IP_ADDRESS", "10.20.30.40", "77.88.99.40"), ("CREDIT_CARD", "4111111111111111", "4222333344445555"), ("IP_ADDRESS", "12.20.30.1", "77.66.55.1"), ("EMAIL", "a@b.c", "d@e.f")]
    known = spark.createDataFrame(rows, "entity_type string, original string, pseudonym string")
    pairs = {tuple(r) for r in rewrite.fragments(known).collect()}
    assert ("88", "20") in pairs
    assert ("3333", "1111") in pairs
    assert ("77", "10") in pairs
    clear = dict(tuple(r) for r in rewrite.unambiguous(rewrite.fragments(known)).collect())
    assert "77" not in clear
    docs = spark.createDataFrame([("octet 88 and x88, group 3333, whole 10.20.30.40, 1",)], "text string")
    assert rewrite.restore_fragments(docs, known).first().text == "octet 20 and x88, group 1111, whole 10.20.30.40, 1"


def test_subnets(spark):
    found = detect.entities(spark.createDataFrame([(1, "10.0.0.1 10.0.0.2 10.0.1.1")], "id long, text string"), "id")
    assert [tuple(r) for r in mapping.subnets(found).collect()] == [("10.0.0", 2)]
