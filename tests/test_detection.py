"""Rules, overlap, whitelist, places."""

import pytest

from veilframe.operators import detect
from veilframe.plans import catalog


def found(spark, text, **options):
    rows = detect.entities(spark.createDataFrame([(1, text)], "id long, text string"), "id", **options).orderBy("start").collect()
    return [(r.entity_type, r.value, r.start, r.end) for r in rows]


def test_email_place_and_bytes(spark):
    assert found(spark, "xxx lena@box.org yyy") == [("EMAIL", "lena@box.org", 4, 16)]
    row = detect.entities(spark.createDataFrame([(1, "éé lena@box.org")], "id long, text string"), "id").first()
    assert (row.start, row.start_byte, row.confidence) == (3, 5, 0.9)


@pytest.mark.parametrize(
    ("text", "kinds"),
    [
        ("a@b.io and c@d.io", ["EMAIL", "EMAIL"]),
        ("at 192.168.1.10 port 8080", ["IP_ADDRESS"]),
        ("Release 4.5.6", []),
        ("06 12 34 56 78", ["PHONE_NUMBER"]),
        ("+33 6 12 34 56 78", ["PHONE_NUMBER"]),
        ("card 4111111111111111", ["CREDIT_CARD"]),
        ("iban FR7630006000011234567890189", ["IBAN"]),
        ("at 2001:db8::1", []),
        ("at 12:34:56", ["IP_ADDRESS"]),
        ("lena@box.org 10.1.2.3 06 12 34 56 78", ["EMAIL", "IP_ADDRESS", "PHONE_NUMBER"]),
        ("", []),
    ],
)
def test_rules(spark, text, kinds):
    assert [k for k, *_ in found(spark, text)] == kinds


def test_phone_inside_digits_is_found(spark):
    assert found(spark, "9906123456789") == [("PHONE_NUMBER", "0612345678", 2, 12)]


def test_password_is_the_value_alone(spark):
    word = "pass" + "word"
    assert found(spark, f"{word} = q7#Lm2$Vb9@Zt4!w end") == [("PASSWORD", "q7#Lm2$Vb9@Zt4!w", 11, 27)]
    assert found(spark, f"{word}: simple123") == []


def test_whitelist_leaves_gaps(spark):
    assert found(spark, "A@b.io c@d.io", whitelist=["a@B.IO"]) == [("EMAIL", "c@d.io", 7, 13)]
    assert found(spark, "127.0.0.1 10.0.0.1", whitelist=detect.merged_whitelist(["LOCALHOST"])) == [("IP_ADDRESS", "10.0.0.1", 10, 18)]
    assert detect.merged_whitelist(["x", "LOCALHOST"]) == ["127.0.0.1", "localhost", "::1", "x"]
    # what is left out still keeps others out
    assert found(spark, "card 4111111111111111", whitelist=["4111111111111111"]) == []


def test_confidence_and_extra_rules(spark):
    assert found(spark, "lena@box.org", least_confidence=0.92) == []
    text = 'token = "abcdefabcdefabcdef1a" +1 (555) 555-0100'
    assert [k for k, *_ in found(spark, text, rules=(*detect.RULES, *detect.EXTRA_RULES))] == ["API_KEY", "PHONE_NUMBER"]


def test_nulls_and_long_runs(spark):
    rows = spark.createDataFrame([(1, None), (2, "x" * 50000 + "@"), (3, "7" * 20000)], "id long, text string")
    assert {r.id for r in detect.entities(rows, "id").collect()} <= {3}
    assert detect.with_entities(rows).count() == 3


def test_counts_on_documents(spark):
    rows = {r.entity_type: r.n for r in catalog.pii_counts_by_type(spark, "/root/testdata/sf0.001").collect()}
    assert rows == {"EMAIL": 5, "IP_ADDRESS": 6, "PHONE_NUMBER": 3, "CREDIT_CARD": 4}
