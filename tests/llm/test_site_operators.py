"""WARC archives and the quality classifier."""

import base64
import gzip
import hashlib
import io

import cases
import pytest

from veilframe.llm import quality, queries, warc


@pytest.fixture(scope="module")
def odd_pages(spark):
    rows = [(1, "http://a/1", "<p>same</p>"), (5, "http://a/5", "<p>same</p>"), (3, None, "<p>same</p>"), (5, "http://a/5", "<p>same</p>"), (7, "http://a/é\r\nX: y", "漢字 \r\n\r\n <b>"), (8, "u", None), (9, "u", ""), (None, "u", "<p>same</p>"), (10, "http://big/", "WARC/1.1\r\n\r\n" * 200000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_pages_round_trip(spark, odd_pages):
    read = warc.archive_and_read(odd_pages, payload=True).collect()
    assert len(read) == odd_pages.count()
    sent = {f"urn:x-page:{r.page_id if r.page_id is not None else ''}": r for r in odd_pages.collect()}
    for r in read:
        body = (sent[r.record_id].html or "").encode()
        assert r.payload_length == len(body)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(body).digest()).decode()
        assert (r.payload is None) == (r.record_type == "revisit")
        assert r.payload is None or bytes(r.payload) == body
    kinds = sorted((r.record_id.rpartition(":")[2], r.record_type, (r.refers_to or "").rpartition(":")[2]) for r in read)
    assert kinds == sorted([("1", "revisit", "5"), ("5", "response", ""), ("3", "revisit", "5"), ("5", "response", ""), ("7", "response", ""), ("8", "revisit", "9"), ("9", "response", ""), ("", "response", ""), ("10", "response", "")])
    assert {r.target_uri for r in read if r.record_id.endswith(":7")} == {"http://a/é%0D%0AX: y"}
    small = warc.archive_and_read(odd_pages, min_bytes=5).where("record_id = 'urn:x-page:8'").first()
    assert small.record_type == "response"


def test_filters_and_payloads_are_pushed_down(spark, odd_pages, tmp_path):
    warc.write_pages(odd_pages, str(tmp_path))
    read = spark.read.format("warc").load(str(tmp_path))
    assert read.where("record_type = 'revisit'").count() == 3
    assert read.where("record_type IN ('response', 'other') AND payload_length > 100").count() == 1
    assert read.where("target_uri = 'http://a/1'").first().record_id == "urn:x-page:1"
    raw = b"".join(warc._member(warc.record("response", f"r{i}", "u", "D", b"x" * i, i, None)) for i in range(50))
    assert [r[0] for r in warc.records(io.BytesIO(raw), {"warc-record-id": {"r7", "r9"}}, payloads=False)] == ["r7", "r9"]
    assert [len(r[-1]) for r in warc.records(io.BytesIO(gzip.decompress(raw)))] == [*range(50)]
    with pytest.raises(ValueError, match="cut short"):
        list(warc.records(io.BytesIO(gzip.decompress(raw)[:-10])))


def test_blocks_without_the_end_of_a_header():
    def raw(kind, block):
        return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <x>\r\nContent-Type: application/http\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    data = raw("response", b"HTTP/1.1 200 OK\r\nno end") + raw("response", b"HTTP/1.1 200 OK\r\n\r\nbody") + raw("response", b"") + raw("revisit", b"HTTP/1.1 200 OK\r\nContent-Length: 12\r\n\r\n")
    assert [(r[4], r[-1]) for r in warc.records(io.BytesIO(data))] == [(23, b"HTTP/1.1 200 OK\r\nno end"), (4, b"body"), (0, b""), (12, None)]
    assert [r[4] for r in warc.records(io.BytesIO(data), payloads=False)] == [23, 4, 0, 12]


def test_pages_with_columns_of_our_own_names(spark):
    pages = spark.createDataFrame([(1, "u", "same", 1, "x"), (2, "u", "same", 2, "y"), (None, "u", "other", 3, "z")], "page_id long, url string, html string, id int, sha1 string")
    read = warc.archive_and_read(pages.selectExpr("*", "'a' AS again", "'p' AS payload", "1 AS last"), payload=True).collect()
    assert sorted((r.record_id.rpartition(":")[2], r.record_type) for r in read) == [("", "response"), ("1", "revisit"), ("2", "response")]


def test_warc_query_and_empty_table(spark):
    pages = {k: (h or "").encode() for k, h in cases.table("pages", ["page_id", "html"])}
    rows = queries.op8_warc(spark, cases.SF).collect()
    assert {r.page_id for r in rows} == {*pages}
    last = {}
    for k, b in pages.items():
        last[b] = max(k, last.get(b, k))
    for r in rows:
        b = pages[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode())
        assert (r.record_type, r.refers_to) == (("response", None) if last[b] == r.page_id else ("revisit", last[b]))
    assert warc.archive_and_read(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_quality_on_unseen_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    found = quality.classify(docs, labels.where("doc_id % 3 <> 0")).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    truth = {r.doc_id: (r["quality"], r.toxic) for r in labels.collect()}
    rows = quality.classify(docs, labels.where("doc_id % 3 <> 0")).where("doc_id % 3 = 0").collect()
    judged = [(r, *truth[r.doc_id]) for r in rows if r.doc_id in truth]
    assert len(found) == len(judged)
    assert sum((r.quality >= 0.5) == (q == 1) for r, q, _ in judged) / len(judged) > 0.96
    assert sum(r.keep for r, q, t in judged if q and not t) / sum(q and not t for _, q, t in judged) > 0.98
    assert sum(r.keep for r, q, t in judged if t) / sum(t for _, q, t in judged) < 0.15


def test_words_late_in_a_long_document_are_learned(spark):
    long = " ".join(f"a{i}" for i in range(2500))
    docs = spark.createDataFrame([(i, f"{long} {'żółw' if i % 2 else 'zebra'}") for i in range(60)], "doc_id long, text string")
    labels = spark.range(60).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality")
    words = quality.fit(docs, labels, ["quality"])["quality"].words
    assert words["żółw".encode()] > 0.5
    assert words[b"zebra"] < -0.5


def test_sites_shrink_towards_their_parents(spark):
    rows = [("big", f"big/{i % 2}", 2.0) for i in range(400)] + [("low", "low/a", -3.0)] * 200 + [("one", "one/x", -3.0)]
    scored = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, host string, path string, t double")
    sites = quality.posteriors(scored, "t")
    found = {r.path: r for r in sites.rows.collect()}
    p = lambda x: 1 / (1 + 2.718281828459045**-x)
    assert abs(found["low/a"].by_path - p(-3.0)) < 0.02
    assert abs(found["big/0"].by_path - p(2.0)) < 0.02
    assert p(-3.0) < found["one/x"].by_path < found["one/x"].by_host + 1e-9 < sites.prior


def _weights(groups):
    """Brute force: within over between variance, for {site: (parent, [values])}."""
    n = sum(len(v) for _, v in groups.values())
    within = sum((x - sum(v) / len(v)) ** 2 for _, v in groups.values() for x in v) / (n - len(groups))
    b = d = 0.0
    for parent in {q for q, _ in groups.values()}:
        own = [v for q, v in groups.values() if q == parent]
        size, mean = sum(map(len, own)), sum(map(sum, own)) / sum(map(len, own))
        b += sum(len(v) * (sum(v) / len(v) - mean) ** 2 for v in own)
        d += size - sum(len(v) ** 2 for v in own) / size
    between = (b - (len(groups) - len({q for q, _ in groups.values()})) * within) / d
    return max(1.0, within / max(between, 1e-6))


def test_posteriors_and_odds_against_brute_force(spark, monkeypatch):
    import math
    import random

    random.seed(3)
    rows = [(i, f"h{i % 3}", f"p{i % 3}/{i % 7 % 4}", random.gauss(i % 3 - 1 + i % 7 % 4 / 2, 1.0)) for i in range(90)] + [(90, "solo", "solo/1", 0.3)]
    scored = spark.createDataFrame(rows, "doc_id long, host string, path string, quality double").withColumn("toxic", __import__("pyspark").sql.functions.col("quality") * 0 - 3)
    sigma = lambda x: 1 / (1 + math.exp(-x))
    hosts, paths = {}, {}
    for _, h, p, z in rows:
        hosts.setdefault(h, (0, []))[1].append(sigma(z))
        paths.setdefault(p, (h, []))[1].append(sigma(z))
    k_host, k_path = _weights(hosts), _weights(paths)
    prior = sum(sigma(z) for *_, z in rows) / len(rows)
    sites = quality.posteriors(scored, "quality")
    assert (sites.k_host, sites.k_path, sites.prior) == pytest.approx((k_host, k_path, prior))
    monkeypatch.setattr(quality, "fit", lambda *a, **k: {"quality": None, "toxic": None})
    monkeypatch.setattr(quality, "evidence", lambda docs, *a, **k: docs.select("doc_id", "host", "path", "quality", "toxic"))
    shown = scored.withColumnsRenamed({}).selectExpr("*", "host AS source", "'x' AS lang", "'t' AS text")
    got = {r.doc_id: r for r in quality.classify(shown, None).collect()}
    logit = lambda p: math.log(min(max(p, 1e-4), 1 - 1e-4) / (1 - min(max(p, 1e-4), 1 - 1e-4)))
    for i, h, p, z in rows:
        host, path = hosts[h][1], paths[p][1]
        by_host = (sum(host) - sigma(z) + k_host * prior) / (len(host) - 1 + k_host)
        by_path = (sum(path) - sigma(z) + k_path * by_host) / (len(path) - 1 + k_path)
        assert got[i].quality == pytest.approx(sigma(z + logit(by_path) - logit(prior)))
        assert got[i].host_quality == pytest.approx((sum(host) + k_host * prior) / (len(host) + k_host))


def test_quality_takes_columns_of_its_own_names(spark):
    docs = spark.createDataFrame([(i, f"word{i % 2} again", "s", "en", 1, 2, 3) for i in range(20)], "doc_id long, text string, source string, lang string, i int, l0 int, l1 int")
    labels = spark.range(20).selectExpr("id AS doc_id", "CAST(id % 2 AS int) AS quality", "0 AS toxic")
    assert quality.classify(docs, labels).count() == 20


def test_quality_of_odd_documents(spark):
    odd = cases.odd_documents(spark)
    labels = spark.createDataFrame([(3, 1, 0), (6, 0, 1), (7, 1, None), (None, 1, 1), (6, 0, 1)], "doc_id long, quality int, toxic int")
    rows = quality.classify(odd, labels).collect()
    assert len(rows) == odd.count()
    assert all(0 <= r.quality <= 1 and 0 <= r.toxicity <= 1 for r in rows)
    assert all(r.quality is not None for r in quality.classify(odd, labels.limit(0)).collect())
    assert quality.classify(cases.empty_documents(spark), labels).count() == 0
