"""The registered query of each operator, with production parameters over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bpe, decontaminate, fingerprint, jaccard, langid, oracles, pii, quality, secret_scan, sharding, warc
from veilframe.llm.common import prepare, read_documents


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read_documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read_documents(spark, sf_dir), n_shards=40)


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secrets(read_documents(spark, sf_dir)))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.with_edits(read_documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.encode(read_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        "contaminated",
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    read = warc.archive_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    number = lambda c: F.substring(c, len("urn:x-page:") + 1, 40).try_cast("long")
    return read.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to").alias("refers_to"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_documents(spark, sf_dir)
    found = langid.predict(docs, langid.fit(docs))
    return found.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(read_documents(spark, sf_dir)))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_sharding": op3_sharding,
    "op4_secret_scan": op4_secret_scan,
    "op5_fingerprints": op5_fingerprints,
    "op6_bpe": op6_bpe,
    "op7_decontamination": op7_decontamination,
    "op8_warc": op8_warc,
    "op9_language_id": op9_language_id,
    "op10_pii": op10_pii,
}
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_BENCH_WORDS = "regexp_extract_all(" + _ASCII_LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op4_secret_scan": oracles.SECRETS,
    "op10_pii": oracles.PERSONAL,
    "op2_jaccard_join": f"""
WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({_ASCII_LOWER.format("text")}, '[^\\x20\\x09-\\x0D]+'), []) AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(list_transform(range(1, greatest(len(w) - 4, least(len(w), 1)) + 1), lambda i: array_to_string(w[i:i + 4], ' ')))) AS s FROM w),
c AS (SELECT s, len(s) AS n, md5(array_to_string(s, chr(10))) AS k, min(doc_id) AS lo FROM s WHERE len(s) > 0 GROUP BY s),
e AS (SELECT lo, n, unnest(s) AS g FROM c),
o AS (SELECT x.lo AS a, y.lo AS b, count(*) AS o, any_value(x.n) AS na, any_value(y.n) AS nb FROM e x JOIN e y ON x.g = y.g AND x.lo < y.lo GROUP BY x.lo, y.lo),
l AS (SELECT a, b FROM o WHERE 100 * o >= 80 * (na + nb - o)),
z AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT lo AS a, lo AS b FROM c UNION SELECT r.a, z.b FROM r JOIN z ON r.b = z.a),
m AS (SELECT c.s, min(r.b) AS component_id FROM c JOIN r ON c.lo = r.a GROUP BY c.s)
SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id FROM s LEFT JOIN m ON s.s = m.s
""",
    "op7_decontamination": f"""
WITH d AS (SELECT doc_id, coalesce({_BENCH_WORDS.format("text")}, []) AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_BENCH_WORDS.format("text")} AS w FROM benchmark WHERE text IS NOT NULL),
s AS (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM s)),
dw AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM s))),
m AS (SELECT DISTINCT doc_id, item, dw.n, i FROM dw JOIN bw ON dw.g = bw.g AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
""",
    "op8_warc": """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b, sha1(encode(coalesce(html, ''))) AS h FROM pages),
g AS (SELECT h, max(page_id) AS last FROM p GROUP BY h)
SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + CAST((CAST('0x' || h[CAST(i // 4 * 5 + 1 AS INT):CAST(i // 4 * 5 + 5 AS INT)] AS BIGINT) >> CAST(15 - i % 4 * 5 AS INT)) & 31 AS INT)]), '') AS payload_digest,
    CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> last THEN last END AS refers_to
FROM p JOIN g USING (h)
""",
}
