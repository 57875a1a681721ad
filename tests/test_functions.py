"""Validators, small functions and types against vectors."""

import pytest
from pyspark.sql import functions as F

from veilframe.functions import types, validators


def column(spark, values, use):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", use(F.col("v")).alias("x")).orderBy("i").collect()]


def test_iban(spark):
    good = ["CH9300762011623852957", "CH93 0076 2011 6238 5295 7", "BE68539007547034", "NL91ABNA0417164300", "be68539007547034"]
    bad = ["CH9300762011623852956", "CH93007", "9876543210", "", "CH93é0762011623852957"]
    assert column(spark, good + bad, validators.iban_valid) == [True] * 5 + [False] * 5


def test_luhn(spark):
    good = ["4012888888881881", "4012 8888 8888 1881", "5105105105105100", "6011000990139424"]
    bad = ["4012888888881882", "401288888", "", "x"]
    assert column(spark, good + bad, validators.luhn_valid) == [True] * 4 + [False] * 4
    assert column(spark, ["411111111111111"], validators.luhn_check_digit) == ["1"]
    assert column(spark, ["18"], lambda v: validators.luhn_valid(v, 2, 99)) == [True]


def test_entropy_and_secrets(spark):
    e = column(spark, ["zzzzzz", "xyzxyz", "q7#Lm2$Vb9@Zt4", "", "éé"], validators.shannon_entropy)
    assert e[0] < 1 < e[1] < 2.5 < 3.5 < e[2]
    assert e[3] == 0
    assert e[4] == pytest.approx(0.5)  # two characters of four bytes
    assert column(spark, ["Plum" + "&Tree7-Onyx", "q7#Lm2$Vb9@Zt4!w", "pass" + "word", "goodbye", "12345678", "q7#Lm2"], validators.looks_like_secret) == [True, True, False, False, False, False]


def test_addresses_urls_and_sizes(spark):
    assert column(spark, ["010.020.3.4", "1.2.3", "x"], validators.ip_prefix) == ["10.20.3", None, None]
    assert column(spark, ["1.2.3.004"], validators.ip_host) == ["004"]
    assert column(spark, ["http://a.b/", "HTTP://A.b", "http://10.0.0.1", "http://[::1]/", "ftp://a", "nonsense", "http://169.254.169.254/"], validators.url_verdict) == ["ok", "ok", "private", "local", "scheme", "unparseable", "private"]
    assert column(spark, ["/v1/messages/x", "/v1/models", "/other"], validators.provider_of) == ["a", "b", None]
    assert column(spark, ["https://x/", "ftp://x"], lambda v: validators.upstream_url(v, F.lit("/p"))) == ["https://x/p", None]


def test_labels_and_thresholds(spark):
    assert column(spark, ["B-IBAN", "I-GIVENNAME", "O", "SSN", "B-WHAT", "IP"], types.type_of_label) == ["ACCOUNT_NUMBER", "GIVEN_NAME", None, "NATIONAL_ID", "UNKNOWN", "IP_ADDRESS"]
    assert column(spark, ["API_KEY", "IBAN", "EMAIL"], types.threshold) == [0.5, 0.6, 0.75]
    assert len(types.TYPES) == len({*types.TYPES}) == 24


def test_sql_functions(spark):
    validators.register(spark)
    assert spark.sql("SELECT luhn_valid('4111 1111 1111 1111') AS a, luhn_valid('4111111111111112') AS b, format_size(1536) AS c").first() == (True, False, "1.5 KB")


def test_intermediate_tables_are_written_and_cleaned(spark):
    from pathlib import Path

    from veilframe import session

    session.clean(spark)
    back = session.written(spark.range(3), "test")
    assert back.count() == 3
    (path,) = session._WRITTEN
    assert Path(path.removeprefix("file:")).exists()
    assert session.clean(spark) == 1
    assert not Path(path.removeprefix("file:")).exists()
