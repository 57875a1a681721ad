"""Registered queries and the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe import session
from veilframe.functions import types, udtf, validators
from veilframe.operators import detect, generate, labels, mapping, rewrite
from veilframe.plans import files, sql
from veilframe.sources import chat, documents
from veilframe.streaming import audit, restore, sse

FLAGSHIP = "pii_counts_by_lang_source"
SALT = "veilframe"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(oracle: str | None):
    def register(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    session.prepare(spark)
    return session.spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def document_entities(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return detect.entities(table(spark, sf_dir, "documents"), "doc_id", **options)


# --- one rule ---------------------------------------------------------------------------------------------------


def _one(name: str) -> None:
    r = detect.rule(name)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = table(spark, sf_dir, "documents").select("doc_id", F.explode(detect.matches(F.col("text"), r)).alias("x"))
        return found.select("doc_id", F.col("x.s").alias("start"), F.col("x.v").alias("value"))

    key = {"email": "detect_email", "ipv4": "detect_ipv4", "card": "detect_card_luhn", "phone": "detect_phone_raw"}[name]
    QUERIES[key] = run
    ORACLES[key] = f"SELECT id AS doc_id, s AS start, v AS value FROM ({sql.candidates('documents', 'doc_id', 'text', [r])})"


for _name in ("email", "ipv4", "card", "phone"):
    _one(_name)

# --- vectors of rules and validators ----------------------------------------------------------------------------

_MIXED = "aB3dE5gH7jK9mN1pQ3sT5vW7yZ9bC1dF3hJ5kL7nP9rS1tV3xY5"
KEYS = [
    ("key_vendor_1", "use sk-" + "ant-" + _MIXED + " now"),
    ("key_vendor_2", "use sk-" + "proj-" + _MIXED + " now"),
    ("key_vendor_2_plain", "use sk-" + _MIXED + " now"),
    ("key_payment", "pay sk_" + "live_" + _MIXED[:30] + " now"),
    ("key_forge", "push gh" + "p_" + _MIXED[:36] + " now"),
    ("key_chat", "say xox" + "b-1234567890-ABCDEFGHIJ now"),
    ("key_cloud", "id AK" + "IA" + "ABCDEFGHIJ123456 now"),
    ("key_jwt", "jwt ey" + "J" + "abcdefghij.abcdefghij.abcdefghij now"),
    ("key_generic", "a token-" + _MIXED[:20] + " now"),
    ("ipv6", "at 2001:db8:1:2:3:4:5:6 now"),
    ("ipv6_compressed", "at 2001:db8::1 now"),
    ("clock", "at 12:34:56 now"),
    ("national_id", "nir 1 85 05 78 006 084 36 now"),
    ("phone", "tel 06 12 34 56 78 or +33 6 12 34 56 78"),
    ("password", "pass" + "word: q7#Lm2$Vb9@Zt4!w end"),
    ("password_weak", "pass" + "word = simple123"),
    ("iban", "pay CH93 0076 2011 6238 5295 7 now"),
    ("iban_wrong", "pay CH9300762011623852956 now"),
    ("card", "card 4012 8888 8888 1881 now"),
    ("mixed", "lena@box.org at 10.1.2.3 or 06 12 34 56 78"),
    ("none", "Release 4.5.6 of nothing"),
]


@query(f"SELECT id AS name, t AS entity_type, s AS start, v AS value FROM {sql.entities('(SELECT * FROM ' + sql.values('name, text', KEYS) + ')', 'name', 'text')}")
def detect_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.entities(spark.createDataFrame(KEYS, "name string, text string"), "name")
    return found.select("name", "entity_type", "start", "value")


VALIDATED = [
    "CH9300762011623852957", "BE68 5390 0754 7034", "nl91abna0417164300", "NL91ABNA0417164301", "CH93", "CH93-0076-2011", "0000", "4012888888881881", "5105 1051 0510 5100", "6011-0009-9013-9424",
    "4012888888881882", "18", "0", "zzzz", "xyzxyzxyz", "Plum" + "&Tree7-Onyx", "q7#Lm2$Vb9@Zt4!w", "only lower words here", "UPPER9lower", "ñandú-ÉTÉ-2049-ŝip", " ", "",
]
_VALIDATED = "(SELECT * FROM " + sql.values("value", [(v,) for v in VALIDATED]) + ")"


def _validated(name: str, use, oracle: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: spark.createDataFrame([(v,) for v in VALIDATED], "value string").select("value", use(F.col("value")).alias("result"))
    ORACLES[name] = f"SELECT value, {oracle} AS result FROM {_VALIDATED}"


_validated("validators_iban", validators.iban_valid, sql.iban("value"))
_validated("validators_luhn", validators.luhn_valid, sql.luhn("value"))
_validated("validators_luhn_short", lambda v: validators.luhn_valid(v, 2, 99), f"(length({sql.digits('value')}) BETWEEN 2 AND 99 AND {sql.luhn_sum(sql.digits('value'))} % 10 = 0)")
_validated("validators_entropy", lambda v: F.round(validators.shannon_entropy(v), 6), f"CAST(round({sql.entropy('value')}, 6) AS DOUBLE)")
_validated("validators_secret", validators.looks_like_secret, sql.secret("value"))

# --- resolved entities and counts -------------------------------------------------------------------------------

_DOCS = sql.entities("documents", "doc_id", "text")
_PAGES = sql.entities("pages", "page_id", "html")


@query(f"SELECT id AS doc_id, t AS entity_type, s AS start, e AS end_, v AS value, CAST(strlen(left(text, s)) AS INT) AS start_byte FROM {_DOCS} JOIN documents ON id = doc_id")
def entities_resolved(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_entities(spark, sf_dir).select("doc_id", "entity_type", "start", F.col("end").alias("end_"), "value", "start_byte")




@query(f"WITH x AS (SELECT * FROM {_DOCS}) SELECT id AS doc_id, t AS entity_type, s AS start, v AS value FROM x WHERE lower(v) NOT IN ('127.0.0.1', 'localhost', '::1') AND NOT (t = 'IP_ADDRESS' AND v LIKE '1%')")
def entities_whitelisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms in a table are an anti-join: here the addresses that begin with 1, and the default terms."""
    found = document_entities(spark, sf_dir, whitelist=detect.merged_whitelist([]))
    terms = found.where("entity_type = 'IP_ADDRESS' AND value LIKE '1%'").select(F.lower("value").alias("term")).distinct()
    return found.join(terms, F.lower("value") == F.col("term"), "left_anti").select("doc_id", "entity_type", "start", "value")


@query(f"SELECT id AS doc_id, t AS entity_type, v AS value, s AS start FROM {_DOCS}")
def udtf_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules as a table function in SQL."""
    docs = table(spark, sf_dir, "documents")
    udtf.register(spark)
    return spark.sql("SELECT doc_id, e.entity_type, e.value, e.start FROM {docs}, LATERAL pii_entities(text) e", docs=docs)


@query(f"SELECT t AS entity_type, count(*) AS n, count(DISTINCT id) AS n_docs FROM {_DOCS} GROUP BY t")
def pii_counts_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_entities(spark, sf_dir).groupBy("entity_type").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query(f"SELECT lang, source, t AS entity_type, count(*) AS n FROM {_DOCS} JOIN documents ON id = doc_id GROUP BY ROLLUP (lang, source, t)")
def pii_counts_by_lang_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.with_entities(table(spark, sf_dir, "documents")).select("lang", "source", F.explode("entities.entity_type").alias("entity_type"))
    return found.rollup("lang", "source", "entity_type").agg(F.count("*").alias("n"))


@query(f"SELECT quality, toxic, count(*) AS n_docs, count(n) AS n_with_pii, CAST(coalesce(sum(n), 0) AS BIGINT) AS n_entities FROM labels LEFT JOIN (SELECT id, count(*) AS n FROM {_DOCS} GROUP BY id) ON id = doc_id GROUP BY quality, toxic")
def pii_rate_by_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = document_entities(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n"))
    joined = table(spark, sf_dir, "labels").join(counts, "doc_id", "left")
    return joined.groupBy("quality", "toxic").agg(F.count("*").alias("n_docs"), F.count("n").alias("n_with_pii"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_entities"))


@query(f"SELECT id AS page_id, t AS entity_type, s AS start, v AS value FROM {_PAGES}")
def pages_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.entities(table(spark, sf_dir, "pages"), "page_id", "html").select("page_id", "entity_type", "start", "value")


@query(f"SELECT {sql.prefix('v')} AS prefix, count(*) AS n FROM {_DOCS} WHERE t = 'IP_ADDRESS' AND regexp_full_match(v, '([0-9]{{1,3}}\\.){{3}}[0-9]{{1,3}}') GROUP BY 1 HAVING count(*) >= 2")
def subnet_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.subnets(document_entities(spark, sf_dir))


# --- mapping, rewriting, restoring ------------------------------------------------------------------------------

_MAPPING = f"SELECT v, min(t) AS t FROM {_DOCS} GROUP BY v"


@query(f"SELECT sha256(v) AS original_hash, t AS entity_type, {sql.pseudonym('t', 'v', SALT)} AS pseudonym FROM ({_MAPPING})")
def mapping_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mapping.build(document_entities(spark, sf_dir), SALT).select("original_hash", "entity_type", "pseudonym")


@query(f"SELECT sha256(v) AS original_hash, v AS original, TRUE AS sealed FROM ({_MAPPING})")
def mapping_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encrypts and decrypts; with another key nothing opens. sealed: nonce, text and tag are all there."""
    key = F.unhex(F.sha2(F.lit("a test key"), 256))
    locked = mapping.encrypted(mapping.build(document_entities(spark, sf_dir), SALT), key)
    opened = mapping.decrypted(locked.withColumn("size", F.octet_length("encrypted_original")), key)
    return opened.select("original_hash", "original", (F.col("size") == F.octet_length("original") + 28).alias("sealed"))


@query(f"SELECT id AS doc_id, s AS start, v AS value, {sql.pseudonym('t', 'v', SALT)} AS pseudonym, v AS original FROM {_DOCS}")
def mapping_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both ways through an encrypted mapping: from values by their hash, and back from pseudonyms."""
    key = F.unhex(F.sha2(F.lit("a test key"), 256))
    found = document_entities(spark, sf_dir).select("doc_id", "start", "value")
    locked = session.written(mapping.encrypted(mapping.build(document_entities(spark, sf_dir), SALT), key), "mapping")
    return mapping.lookup_pseudonym(mapping.lookup_original(found, locked, "value"), locked, "pseudonym", key)


_PUT = f"""WITH x AS (SELECT id, list({{'s': s, 'e': e, 'to': {sql.pseudonym('t', 'v', SALT)}}} ORDER BY s) AS k FROM {_DOCS} GROUP BY id)
SELECT doc_id, coalesce(len(k), 0) AS n_replaced, md5(CASE WHEN k IS NULL THEN text ELSE
array_to_string(list_transform(range(1, len(k) + 1), lambda i: substr(text, CASE WHEN i = 1 THEN 1 ELSE k[i - 1].e + 1 END, k[i].s - CASE WHEN i = 1 THEN 0 ELSE k[i - 1].e END) || k[i].to), '') || substr(text, k[len(k)].e + 1) END) AS text_md5
FROM documents LEFT JOIN x ON id = doc_id"""


def _pseudonymized(spark: SparkSession, sf_dir: str) -> rewrite.Pseudonymized:
    return rewrite.run(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", salt=SALT)


@query(_PUT)
def pseudonymize_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed, replaced, _ = _pseudonymized(spark, sf_dir)
    counts = replaced.groupBy(F.col("doc_id").alias("d")).agg(F.count("*").alias("n"))
    return changed.join(counts, F.col("doc_id") == F.col("d"), "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_replaced"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def restore_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed, _, known = _pseudonymized(spark, sf_dir)
    return rewrite.restore(changed, known).select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def restore_documents_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way of a mapping that is too large to send: the texts' stretches meet it in a join."""
    changed, _, known = _pseudonymized(spark, sf_dir)
    found = rewrite._matched(changed, "text", known.select("pseudonym", "original"), "found")
    back = rewrite._resolved(found, "text", F.col("found"), rewrite._nothing())
    return back.select("doc_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"SELECT sha256(v) AS original_hash, {sql.pseudonym('t', 'v', SALT)} AS pseudonym, max(n % 2) = 0 AS old FROM (SELECT v, min(t) OVER (PARTITION BY v) AS t, CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END + CASE WHEN min(CASE WHEN id % 2 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY v) = 0 AND id % 2 <> 0 THEN 1 ELSE 0 END AS n FROM {_DOCS}) GROUP BY 1, 2")
def mapping_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session's mapping grows: what the documents of even ids need stays as it is, the others' originals are added."""
    found = session.written(document_entities(spark, sf_dir), "entities")
    known = session.written(mapping.build(found.where("doc_id % 2 = 0"), SALT).withColumn("old", F.lit(True)), "mapping")
    return mapping.extend(known, found, SALT).select("original_hash", "pseudonym", F.coalesce("old", F.lit(False)).alias("old"))


@query(f"SELECT {sql.pseudonym('t', 'v', SALT)} AS pseudonym FROM ({_MAPPING}) ORDER BY strlen(pseudonym) DESC, pseudonym LIMIT 50")
def mapping_longest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report of the 50 longest pseudonyms."""
    return mapping.longest_first(mapping.build(document_entities(spark, sf_dir), SALT)).select("pseudonym").limit(50)


#: What a pseudonym of each type looks like; {digits} stands for the original with other digits.
SHAPES = {
    "GIVEN_NAME": "[A-Z][a-z]+", "PERSON_NAME": "[A-Z][a-z]+", "SURNAME": "[A-Z][a-z]+", "EMAIL": r"[a-z]+[0-9]+@example\.com", "IP_ADDRESS": r"10\.0\.[0-9]+\.[0-9]+", "PHONE_NUMBER": "Customer#[0-9]{9}",
    "NATIONAL_ID": "Customer#[0-9]{9}", "TAX_NUMBER": "Customer#[0-9]{9}", "DRIVER_LICENSE": "Customer#[0-9]{9}", "CREDIT_CARD": "4[0-9]{15}", "IBAN": "FR[0-9]{25}", "ACCOUNT_NUMBER": "FR[0-9]{25}",
    "API_KEY": "[A-Za-z0-9]{18}", "PASSWORD": "[A-Za-z0-9]{18}", "USERNAME": "user_[a-z]+[0-9]{2}", "STREET": "[0-9]+ rue des Tilleuls", "CITY": "Villeneuve-[0-9]+", "ZIP_CODE": "[0-9]{5}",
    "DATE_OF_BIRTH": "[0-2][0-9]/[01][0-9]/(19|20)[0-9]{2}", "INTERNAL_URL": r"https://internal-[0-9]+\.example\.com", "SERVER_NAME": r"https://internal-[0-9]+\.example\.com", "FILE_PATH": "/path/to/file-[0-9]+",
    "POSTAL_ADDRESS": "[0-9]+ rue des Tilleuls, 59000 Lille", "UNKNOWN": r"\[PSEUDO-[0-9]{4}\]",
}


@query(f"SELECT t AS entity_type, n, n AS n_shaped, n AS n_changed FROM (SELECT count(*) AS n FROM customer), {sql.values('t', [(t,) for t in types.TYPES])}")
def generator_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every customer's name as an original of every type: pseudonyms have the type's shape, and none is the original."""
    kinds = spark.createDataFrame([(t, f"^{SHAPES[t]}$") for t in types.TYPES], "entity_type string, shape string")
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("original"))
    drawn = names.join(F.broadcast(kinds)).withColumn("p", generate.pseudonym(F.col("entity_type"), F.col("original"), SALT))  # 24 types
    return drawn.groupBy("entity_type").agg(F.count("*").alias("n"), F.count(F.when(F.rlike("p", F.col("shape")), 1)).alias("n_shaped"), F.count(F.when(F.col("p") != F.col("original"), 1)).alias("n_changed"))


#: Rules of users, one with a pattern of its own.
ORDER_RULE = detect.Rule("order", "FILE_PATH", r"\b[A-Z]{3}-[0-9]{4,}\b", 0.8)
USER_RULES = (*detect.RULES, *detect.EXTRA_RULES, ORDER_RULE)


@query(f"SELECT id AS doc_id, p AS priority, s AS start, v AS value FROM {sql.entities(chr(40) + 'SELECT doc_id, text || CASE WHEN doc_id % 2 = 0 THEN chr(10) || ' + chr(39) + ' order ABC-12345, token = abcdefabcdefabcdef1a, +1 (555) 555-0100' + chr(39) + ' ELSE ' + chr(39) * 2 + ' END AS text FROM documents' + chr(41), 'doc_id', 'text', USER_RULES)}")
def user_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with more rules than the usual ones; every other document also holds what these find."""
    more = F.when(F.col("doc_id") % 2 == 0, "\n order ABC-12345, token = abcdefabcdefabcdef1a, +1 (555) 555-0100").otherwise("")
    docs = table(spark, sf_dir, "documents").select("doc_id", F.concat("text", more).alias("text"))
    found = detect.with_entities(docs, rules=USER_RULES).select("doc_id", F.explode("entities").alias("x"))
    return found.select("doc_id", F.col("x.priority").alias("priority"), F.col("x.s").alias("start"), F.col("x.v").alias("value"))


KNOWN = [
    ("IP_ADDRESS", "10.20.30.40", "77.88.99.40"),
    ("IP_ADDRESS", "10.20.30.41", "77.88.99.41"),
    ("IP_ADDRESS", "11.20.31.5", "77.15.16.5"),
    ("CREDIT_CARD", "4012888888881881", "4222333344445555"),
    ("NATIONAL_ID", "1 85 05 78 006 084 36", "2 71 05 33 104 217 90"),
    ("EMAIL", "a@b.example", "x@example.com"),
]
_KNOWN = "(SELECT * FROM " + sql.values("t, o, p", KNOWN) + ")"
_FRAGMENTS = f"""(SELECT x[1] AS pseudo_fragment, x[2] AS original_fragment FROM (SELECT unnest(CASE t
WHEN 'IP_ADDRESS' THEN list_zip(string_split(p, '.'), string_split(o, '.'))
WHEN 'CREDIT_CARD' THEN list_zip(list_transform(range(0, length(p) // 4), lambda i: substr(p, CAST(i * 4 + 1 AS INT), 4)), list_transform(range(0, length(o) // 4), lambda i: substr(o, CAST(i * 4 + 1 AS INT), 4)))
WHEN 'NATIONAL_ID' THEN list_zip(string_split(p, ' '), string_split(o, ' ')) END) AS x FROM {_KNOWN}) WHERE x[1] <> x[2])"""


def _known(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(KNOWN, "entity_type string, original string, pseudonym string")


@query(f"SELECT * FROM {_FRAGMENTS}")
def fragments_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.fragments(_known(spark))


@query(f"SELECT pseudo_fragment, min(original_fragment) AS original_fragment FROM {_FRAGMENTS} GROUP BY 1 HAVING count(DISTINCT original_fragment) = 1")
def fragments_unambiguous(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite.unambiguous(rewrite.fragments(_known(spark)))


_PIECES = "octet 88 and x88, group 3333, whole 10.20.30.40, 5 of 71"


@query(f"SELECT * FROM {sql.values('least, text', [(1, 'octet 20 and x88, group 8888, whole 10.20.30.40, 5 of 85'), (2, 'octet 20 and x88, group 8888, whole 10.20.30.40, 5 of 85'), (3, 'octet 88 and x88, group 8888, whole 10.20.30.40, 5 of 71')])}")
def fragments_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fragments in a text, from one, two and three characters on; whole originals and parts of words stay."""
    out = None
    for least in (1, 2, 3):
        one = rewrite.restore_fragments(spark.createDataFrame([(least, _PIECES)], "least int, text string"), _known(spark), least=least)
        out = one if out is None else out.unionByName(one)
    return out


# --- chat -------------------------------------------------------------------------------------------------------


def chat_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A request (request_id, path, body) for each conversation, of one provider or the other."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    messages = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    body = F.to_json(F.struct(F.lit("m-1").alias("model"), F.lit(9).alias("max_tokens"), messages.alias("messages")))
    return turns.select(F.col("conv_id").alias("request_id"), F.when(F.col("conv_id") % 2 == 0, "/v1/messages").otherwise("/v1/chat/completions").alias("path"), body.alias("body"))


_TURNS = "SELECT conv_id AS request_id, CAST(row_number() OVER w - 1 AS INT) AS field_ord, 'messages.' || (row_number() OVER w - 1) || '.content' AS json_path, {} AS text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)"


@query(_TURNS.format("text"))
def chat_text_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.text_fields(chat_bodies(spark, sf_dir))


@query(_TURNS.format("'<' || text || '>'"))
def chat_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = chat_bodies(spark, sf_dir)
    fields = chat.text_fields(bodies).withColumn("text", F.concat(F.lit("<"), "text", F.lit(">")))
    return chat.text_fields(chat.rebuild(bodies, fields))


#: What every request of private_bodies() holds, by type; all values are invented.
PRIVATE = {"EMAIL": "ann.lee@post.example", "IP_ADDRESS": "10.9.8.7", "PHONE_NUMBER": "06 98 76 54 32", "CREDIT_CARD": "4012888888881881"}


def _json_string(text) -> Column:
    whole = F.to_json(F.struct(text.alias("v")))
    return F.substring(whole, F.lit(6), F.length(whole) - 6)


def private_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of all conversations with personal data in them: system prompts, strings and blocks of both providers."""
    said = F.concat("text", F.when(F.col("turn") % 2 == 0, f" mail {PRIVATE['EMAIL']} at {PRIVATE['IP_ADDRESS']}").otherwise(f" call {PRIVATE['PHONE_NUMBER']}"))
    content = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit('[{"type":"text","text":'), _json_string(said), F.lit('},{"type":"image","text":"a@b.example"}]'))).otherwise(_json_string(said))
    message = F.concat(F.lit('{"role":'), _json_string(F.col("role")), F.lit(',"content":'), content, F.lit("}"))
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", message.alias("m")))).alias("t"))
    prompt = f"card {PRIVATE['CREDIT_CARD']}"
    system = F.when(F.col("conv_id") % 4 == 0, f'"{prompt}"').otherwise(f'[{{"type":"text","text":"{prompt}"}}]')
    body = F.concat(F.lit('{"model":"m-1","system":'), system, F.lit(',"messages":['), F.array_join("t.m", ","), F.lit("]}"))
    return turns.select(F.col("conv_id").alias("request_id"), F.when(F.col("conv_id") % 2 == 0, "/v1/messages").otherwise("/v1/chat/completions").alias("path"), body.alias("body"))


def _private(of) -> str:
    """SQL (conv_id, path, ord, text, n, t) of the fields of private_bodies(), with of(type) in place of each value."""
    said = f"text || CASE WHEN turn % 2 = 0 THEN ' mail ' || {of('EMAIL')} || ' at ' || {of('IP_ADDRESS')} ELSE ' call ' || {of('PHONE_NUMBER')} END"
    place = "'messages.' || (row_number() OVER w - 1) || '.content' || CASE WHEN conv_id % 3 = 0 THEN '.0.text' ELSE '' END"
    system = f"SELECT DISTINCT conv_id, CASE WHEN conv_id % 4 = 0 THEN 'system' ELSE 'system.0.text' END, 'card ' || {of('CREDIT_CARD')} FROM conversations WHERE conv_id % 2 = 0"
    return f"(SELECT conv_id, {place} AS json_path, {said} AS text FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text) UNION ALL {system})"


def _pseudonym_of(t: str) -> str:
    return sql.pseudonym(f"'{t}'", f"'{PRIVATE[t]}'", SALT)


_PRIVATE_COUNTS = """(SELECT conv_id, sum(CASE WHEN turn % 2 = 0 THEN 1 ELSE 0 END) AS e, sum(CASE WHEN turn % 2 = 0 THEN 0 ELSE 1 END) AS p, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 0 END AS c FROM conversations GROUP BY conv_id)"""
_COUNTED = f"""SELECT conv_id, CAST(2 * e + p + c AS BIGINT) AS pii_count, concat_ws(',', CASE WHEN c > 0 THEN 'CREDIT_CARD:' || c END, CASE WHEN e > 0 THEN 'EMAIL:' || e END, CASE WHEN e > 0 THEN 'IP_ADDRESS:' || e END, CASE WHEN p > 0 THEN 'PHONE_NUMBER:' || p END) AS pii_types FROM {_PRIVATE_COUNTS}"""


@query(f"SELECT f.conv_id AS request_id, json_path, text, pii_count, pii_types FROM {_private(_pseudonym_of)} f JOIN ({_COUNTED}) c ON f.conv_id = c.conv_id")
def chat_pseudonymize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fields of the bodies that go out, with the counts of their requests."""
    out, _, _ = chat.pseudonymize_requests(private_bodies(spark, sf_dir), salt=SALT)
    counts = out.select(F.col("request_id").alias("r"), "pii_count", F.array_join("pii_types", ",").alias("pii_types"))
    return chat.text_fields(out).join(counts, F.col("request_id") == F.col("r")).select("request_id", "json_path", "text", "pii_count", "pii_types")


@query("SELECT conv_id AS request_id, json_path, text FROM " + _private(lambda t: f"'{PRIVATE[t]}'"))
def chat_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same bodies restored as if they were responses."""
    out, known, _ = chat.pseudonymize_requests(private_bodies(spark, sf_dir), salt=SALT)
    return chat.text_fields(chat.restore_responses(out, known)).select("request_id", "json_path", "text")


@query("SELECT DISTINCT conv_id AS request_id, TRUE AS unchanged, CAST(0 AS BIGINT) AS pii_count FROM conversations")
def chat_passthrough(spark: SparkSession, sf_dir: str) -> DataFrame:
    bodies = private_bodies(spark, sf_dir).withColumn("sent", F.col("body"))
    out, _, _ = chat.pseudonymize_requests(bodies, passthrough=True)
    return out.select("request_id", (F.col("body") == F.col("sent")).alias("unchanged"), "pii_count")


@query("SELECT DISTINCT conv_id AS request_id, conv_id % 5 > 1 AS passed FROM conversations")
def chat_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fifth request is for an unknown path, and every fifth is cut off: neither is passed on."""
    kind = F.col("request_id") % 5
    bodies = private_bodies(spark, sf_dir).withColumn("path", F.when(kind == 0, "/v2/other").otherwise(F.col("path")))
    bodies = bodies.withColumn("body", F.when(kind == 1, F.substring("body", 1, 40)).otherwise(F.col("body")))
    out, _, bad = chat.pseudonymize_requests(bodies, salt=SALT)
    return out.select("request_id", F.lit(True).alias("passed")).unionByName(bad.select("request_id", F.lit(False).alias("passed")))


@query(f"SELECT CASE WHEN conv_id % 2 = 0 THEN 'a' ELSE 'b' END AS provider, 'm-1' AS model, '{audit.REQUEST}' AS direction, FALSE AS passthrough, pii_count, pii_types, count(*) AS n FROM ({_COUNTED}) GROUP BY ALL")
def chat_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The audit events of the requests, counted."""
    out, _, _ = chat.pseudonymize_requests(private_bodies(spark, sf_dir), salt=SALT)
    events = audit.request_events(out, F.current_timestamp()).withColumn("pii_types", F.array_join("pii_types", ","))
    return events.groupBy("provider", "model", "direction", "passthrough", "pii_count", "pii_types").agg(F.count("*").alias("n"))


# --- documents --------------------------------------------------------------------------------------------------

_PLAIN = "trim(regexp_replace(text, '[^!-~]+', ' ', 'g'))"


def office_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(item_id, kind, media_type, data): every benchmark item as a DOCX and as a PDF."""
    plain = F.trim(F.regexp_replace("text", "[^!-~]+", " "))
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.lit(m).alias("media_type")) for k, m in (("docx", documents.DOCX), ("pdf", documents.PDF)))))
    rows = table(spark, sf_dir, "benchmark").select("item_id", plain.alias("plain"), kinds.alias("x")).select("item_id", "plain", "x.*")

    @F.pandas_udf("binary")
    def made(texts: pd.Series, kinds: pd.Series) -> pd.Series:
        return pd.Series([files.docx(t) if k == "docx" else files.pdf(t) for t, k in zip(texts, kinds, strict=True)], dtype=object)

    return rows.select("item_id", "kind", "media_type", made("plain", "kind").alias("data"))


@query(f"SELECT item_id, kind, CASE kind WHEN 'docx' THEN '[document DOCX]' || chr(10) || '{documents.CONTENT}' ELSE '[document PDF]' || chr(10) || '[page 1]' END || chr(10) || {_PLAIN} AS text FROM benchmark, {sql.values('kind', [('docx',), ('pdf',)])}")
def document_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return office_files(spark, sf_dir).select("item_id", "kind", documents.extract_text("data", "media_type").alias("text"))


@query(f"SELECT item_id, kind, CAST(1 AS INT) AS converted, CASE kind WHEN 'docx' THEN '[document DOCX]' || chr(10) || '{documents.CONTENT}' ELSE '[document PDF]' || chr(10) || '[page 1]' END || chr(10) || {_PLAIN} AS text FROM benchmark, {sql.values('kind', [('docx',), ('pdf',)])}")
def media_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files as base64 blocks of chat requests, which become text blocks."""
    source = F.struct(F.lit("base64").alias("type"), "media_type", F.translate(F.base64("data"), "\r\n", "").alias("data"))
    block = F.array(F.struct(F.lit("document").alias("type"), source.alias("source")))
    body = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), block.alias("content"))).alias("messages")))
    bodies = office_files(spark, sf_dir).select(F.concat_ws(":", F.col("item_id").cast("string"), "kind").alias("request_id"), F.lit("/v1/messages").alias("path"), body.alias("body"))
    done = chat.convert_documents(bodies)
    counts = done.select(F.col("request_id").alias("r"), "converted")
    id_ = lambda part: F.element_at(F.split("request_id", ":"), part)
    return chat.text_fields(done).join(counts, F.col("request_id") == F.col("r")).select(id_(1).cast("long").alias("item_id"), id_(2).alias("kind"), "converted", "text")


PATHS = [("/v1/messages",), ("/v1/messages/count_tokens",), ("/v1/chat/completions",), ("/v1/embeddings",), ("/v1/models/x",), ("/v2/messages",), ("/",), ("",)]


@query(f"SELECT path, CASE WHEN path LIKE '/v1/messages%' THEN 'a' WHEN path LIKE '/v1/chat/completions%' OR path LIKE '/v1/embeddings%' OR path LIKE '/v1/models%' THEN 'b' END AS provider, 'https://up.example' || path AS upstream FROM {sql.values('path', PATHS)}")
def route_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("path")
    return spark.createDataFrame(PATHS, "path string").select("path", validators.provider_of(p).alias("provider"), validators.upstream_url(F.lit("https://up.example//"), p).alias("upstream"))


@query(f"SELECT value, {sql.luhn('value')} AS luhn, CASE WHEN strlen(value) < 1024 THEN strlen(value) || ' B' END AS size FROM {_VALIDATED}")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The functions that SQL users have."""
    validators.register(spark)
    rows = spark.createDataFrame([(v,) for v in VALIDATED], "value string")
    return spark.sql("SELECT value, luhn_valid(value) AS luhn, format_size(octet_length(value)) AS size FROM {rows}", rows=rows)


URLS = [(u,) for u in ("https://api.example.com", "http://api.example.com/x", "http://localhost:80/", "http://LOCALHOST/", "https://127.0.0.1/", "http://0.0.0.0/", "http://10.1.2.3/", "http://192.168.0.1/", "http://172.16.0.1/", "http://172.32.0.1/", "http://169.254.169.254/latest", "ftp://api.example.com/", "http://[::1]/", "http://172.31.1.1/")]
_HOST = "lower(regexp_extract(url, '^[A-Za-z]+://(\\[[^]]*\\]|[^/:?#]*)', 1))"
_PRIVATE = " OR ".join(f"starts_with({_HOST}, '{p}')" for p in validators.PRIVATE_PREFIXES)
_VERDICT = f"CASE WHEN NOT regexp_matches(url, '^https?://') THEN 'scheme' WHEN {_HOST} IN ('localhost', '127.0.0.1', '::1', '[::1]', '0.0.0.0') THEN 'local' WHEN {_PRIVATE} THEN 'private' ELSE 'ok' END"


@query(f"SELECT url, {_VERDICT} AS verdict, count(*) AS n FROM (SELECT url FROM pages UNION ALL SELECT url FROM {sql.values('url', URLS)}) GROUP BY 1, 2")
def url_safety(spark: SparkSession, sf_dir: str) -> DataFrame:
    urls = table(spark, sf_dir, "pages").select("url").unionByName(spark.createDataFrame(URLS, "url string"))
    return urls.select("url", validators.url_verdict(F.col("url")).alias("verdict")).groupBy("url", "verdict").agg(F.count("*").alias("n"))


SIZES = [(n,) for n in (0, 1, 1023, 1024, 1536, 10240, 1048575, 1048576, 5 * 1048576 + 524288)]


@query(f"SELECT CAST(n AS BIGINT) AS n, CASE WHEN n < 1024 THEN n || ' B' WHEN n < 1048576 THEN printf('%.1f KB', n / 1024.0) ELSE printf('%.1f MB', n / 1048576.0) END AS shown FROM {sql.values('n', SIZES)}")
def format_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame(SIZES, "n long").select("n", validators.format_size(F.col("n")).alias("shown"))


# --- token classifiers ------------------------------------------------------------------------------------------

CONFIG = '{"id2label": {"0": "B-EMAIL", "3": "I-EMAIL", "2": "O"}}'


@query(f"SELECT CAST(id AS INT) AS id, label FROM {sql.values('id, label', [(0, 'B-EMAIL'), (1, 'O'), (2, 'O'), (3, 'I-EMAIL')])}")
def label_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([*enumerate(labels.label_map(CONFIG))], "id int, label string")


LABELS = ["B-EMAIL", "I-EMAIL", "B-GIVENNAME", "I-GIVENNAME", "B-CITY", "O", "B-PASSWORD", "I-NEWKIND"]
_TEXT = "Call Marie Curie in Paris, key hunter2 me@here.org ok"
TOKENS = [(d, _TEXT, k, s, e, label, c) for d, cs in ((1, (0.9, 0.9, 0.8, 0.55, 0.99)), (2, (0.95, 0.4, 0.7, 0.45, 0.76))) for k, (s, e, label, c) in enumerate([(0, 0, 5, 1.0), (0, 4, 5, 0.99), (5, 10, 2, cs[0]), (11, 16, 2, cs[1]), (17, 19, 5, 0.9), (20, 25, 4, cs[2]), (31, 38, 6, cs[3]), (39, 41, 0, cs[4]), (41, 50, 1, cs[4]), (51, 53, 7, 0.9)])]
_NAMED = "CASE regexp_replace(l, '^[BI]-', '') WHEN 'EMAIL' THEN 'EMAIL' WHEN 'GIVENNAME' THEN 'GIVEN_NAME' WHEN 'CITY' THEN 'CITY' WHEN 'PASSWORD' THEN 'PASSWORD' WHEN 'O' THEN NULL ELSE 'UNKNOWN' END"
_RUNS = f"""WITH x AS (SELECT d, text, k, s, e, c, CASE WHEN s <> e THEN {_NAMED} END AS t FROM (SELECT *, [{', '.join(map(sql.quoted, LABELS))}][l0 + 1] AS l FROM {sql.values('d, text, k, s, e, l0, c', TOKENS)})),
r AS (SELECT *, sum(CASE WHEN t IS NOT DISTINCT FROM p THEN 0 ELSE 1 END) OVER (PARTITION BY d ORDER BY k) AS run FROM (SELECT *, lag(t) OVER (PARTITION BY d ORDER BY k) AS p FROM x)),
g AS (SELECT d, run, t, any_value(text) AS text, min(s) AS s, max(e) AS e, avg(CAST(c AS DOUBLE)) AS c FROM r WHERE t IS NOT NULL GROUP BY d, run, t)
SELECT CAST(d AS BIGINT) AS doc, t AS entity_type, substr(text, s + 1, e - s) AS value, CAST(s AS INT) AS start, CAST(round(c, 6) AS DOUBLE) AS confidence FROM g WHERE c >= {sql.threshold('t')}"""


@query(_RUNS)
def label_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(TOKENS, "doc long, text string, k int, s int, e int, label_id int, confidence double")
    lists = rows.groupBy("doc", "text").agg(F.array_sort(F.collect_list(F.struct("k", F.struct("s", "e").alias("o"), F.struct("label_id", "confidence").alias("p")))).alias("x"))
    found = labels.decode(lists.select("doc", "text", F.col("x.o").alias("offsets"), F.col("x.p").alias("preds")), LABELS)
    return found.select("doc", "entity_type", "value", "start", F.round("confidence", 6).alias("confidence"))


@query("""WITH p AS (SELECT vec_id, e, list_transform(e, lambda x: exp(x - list_max(e))) AS z FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings))
SELECT vec_id, CAST(len(e) - list_position(list_reverse(e), list_max(e)) AS INT) AS label_id, CAST(round(list_max(z) / list_sum(z), 6) AS DOUBLE) AS confidence FROM p""")
def softmax_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "embeddings").select("vec_id", labels.prediction(F.col("embedding")).alias("p"))
    return found.select("vec_id", "p.label_id", F.round("p.confidence", 6).alias("confidence"))


CLASSIFIED = [("EMAIL", 3, 14, 0.95), ("GIVEN_NAME", 15, 20, 0.9), ("UNKNOWN", 21, 26, 0.9), ("CITY", 18, 26, 0.8)]


@query("SELECT * FROM " + sql.values("entity_type, start, end_", [("EMAIL", 3, 14), ("GIVEN_NAME", 15, 20)]))
def classifier_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An e-mail by rule, and of a classifier's entities the ones that overlap nothing before them."""
    text = F.col("text")
    rows = F.array(*(F.struct(F.lit(k).alias("priority"), F.lit(s).alias("s"), F.lit(e).alias("e"), F.lit(t).alias("entity_type"), F.substring(text, s + 1, e - s).alias("v"), F.lit(c).alias("confidence")) for k, (t, s, e, c) in enumerate(CLASSIFIED)))
    one = spark.createDataFrame([("to me@here.org Marie Curie",)], "text string")
    found = one.select(F.explode(detect.with_classified(detect.resolve(detect.candidates(text)), rows)).alias("x"))
    return found.select("x.entity_type", F.col("x.s").alias("start"), F.col("x.e").alias("end_"))


SEGMENT_ENTITIES = [(1, 0, 0, 10, "EMAIL", 0.9), (1, 0, 20, 30, "CITY", 0.8), (2, 0, 5, 15, "EMAIL", 0.8), (2, 1, 6, 15, "EMAIL", 0.92), (2, 1, 40, 44, "CITY", 0.8), (3, 0, 5, 15, "EMAIL", 0.9), (3, 1, 10, 18, "CITY", 0.9), (3, 1, 15, 20, "CITY", 0.8)]


@query(f"""WITH c AS (SELECT doc, list([{{'s': s, 'e': e, 't': t, 'c': c}}] ORDER BY s, seg) AS k FROM {sql.values('doc, seg, s, e, t, c', SEGMENT_ENTITIES)} GROUP BY doc),
m AS (SELECT doc, unnest(list_reduce(k, lambda a, x: CASE WHEN x[1].s >= a[-1].e THEN list_concat(a, x) WHEN x[1].c > a[-1].c THEN list_concat(a[1:len(a) - 1], x) ELSE a END)) AS x FROM c)
SELECT CAST(doc AS BIGINT) AS doc, x.t AS entity_type, CAST(x.s AS INT) AS start, CAST(x.e AS INT) AS end_, CAST(x.c AS DOUBLE) AS confidence FROM m""")
def segment_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(SEGMENT_ENTITIES, "doc long, seg int, start int, end int, entity_type string, confidence double")
    return labels.merge_segments(rows, "doc").withColumnRenamed("end", "end_")


def _segment_end(st: str) -> str:
    window = f"regexp_replace(substr(text, {st} + 1, {labels.SEGMENT}), '[^\\s]*$', '')"
    return f"CASE WHEN {st} + {labels.SEGMENT} >= length(text) THEN length(text) WHEN {window} = '' THEN {st} + {labels.SEGMENT} ELSE {st} + length({window}) END"


@query(f"""WITH RECURSIVE r AS (SELECT doc_id, text, 0 AS seg, CAST(0 AS BIGINT) AS st, CAST({_segment_end('0')} AS BIGINT) AS e FROM documents
UNION ALL SELECT doc_id, text, seg + 1, nst, {_segment_end('nst')} FROM (SELECT *, greatest(CASE WHEN e > {labels.OVERLAP} THEN e - {labels.OVERLAP} ELSE e END, st + 1) AS nst FROM r WHERE e < length(text)))
SELECT doc_id, CAST(seg AS INT) AS seg, CAST(st AS INT) AS global_offset, CAST(e - st AS INT) AS n_chars FROM r""")
def segment_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.segments(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "seg", "global_offset", F.length("segment").alias("n_chars"))


@query(f"SELECT t AS label, CAST({sql.threshold('t')} AS DOUBLE) AS threshold FROM {sql.values('t', [(t,) for t in types.TYPES])}")
def type_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in types.TYPES], "label string").select("label", types.threshold(F.col("label")).alias("threshold"))


# --- streams ----------------------------------------------------------------------------------------------------


def stream_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations")
    a = F.to_json(F.struct(F.lit("content_block_delta").alias("type"), F.struct(F.lit("text_delta").alias("type"), F.col("text")).alias("delta")))
    b = F.to_json(F.struct(F.array(F.struct(F.struct(F.col("text").alias("content")).alias("delta"))).alias("choices")))
    is_a = F.col("conv_id") % 2 == 0
    chunk = F.concat(F.when(is_a, F.lit("event: content_block_delta\n")).otherwise(""), F.lit("data: "), F.when(is_a, a).otherwise(b), F.lit("\n\n"))
    return said.select("conv_id", "turn", F.when(is_a, "a").otherwise("b").alias("provider"), chunk.alias("chunk"))


@query("SELECT conv_id, turn, CASE WHEN conv_id % 2 = 0 THEN 'content_block_delta' END AS event_type, text AS text_delta, FALSE AS is_done FROM conversations")
def sse_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sse.parse(stream_chunks(spark, sf_dir)).select("conv_id", "turn", "event_type", "text_delta", "is_done")


@query("SELECT conv_id, turn, '[' || text || ']' AS text_delta FROM conversations")
def sse_rebuild(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = sse.parse(stream_chunks(spark, sf_dir)).withColumn("new", F.concat(F.lit("["), "text_delta", F.lit("]")))
    return sse.parse(sse.rebuild(events, "new").drop("event_type", "data", "text_delta", "is_done")).select("conv_id", "turn", "text_delta")


@query("SELECT conv_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM conversations GROUP BY conv_id")
def sse_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's events in one piece of raw text, split again."""
    raw = stream_chunks(spark, sf_dir).groupBy("conv_id", "provider").agg(F.array_join(F.array_sort(F.collect_list("chunk")), "").alias("raw"))
    events = sse.parse(sse.split_events(raw, "raw"))
    return events.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(F.length("text_delta")).cast("long").alias("n_chars"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents")
def stream_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pseudonymized documents, cut into pieces and restored by a streaming query: the texts come back."""
    changed, _, known = _pseudonymized(spark, sf_dir)
    size = 37
    last = F.greatest(F.floor((F.length("text") - 1) / size), F.lit(0)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.col("last")), lambda i: F.substring(F.col("text"), i * size + 1, F.lit(size)))
    # last is computed below the explode: once for each text, not for each piece
    rows = changed.withColumn("last", last).select(F.col("doc_id").alias("stream_id"), "last", F.posexplode(pieces).alias("seq", "text")).select("stream_id", F.col("seq").cast("long").alias("seq"), "text", (F.col("seq") == F.col("last")).alias("is_done"))
    place = session.shared_path(spark, "stream")
    rows.write.parquet(f"{place}/in")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    pairs = restore.session_pairs(known)
    source = spark.readStream.schema("stream_id long, seq long, text string, is_done boolean").parquet(f"{place}/in")
    sink = restore.restore_stream(source, pairs).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    sink.awaitTermination()
    back = spark.read.parquet(f"{place}/out").groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("p"))
    texts = back.select("stream_id", F.md5(F.array_join("p.text", "").cast("binary")).alias("text_md5"))
    return table(spark, sf_dir, "documents").select("doc_id").join(texts, F.col("doc_id") == F.col("stream_id"), "left").select("doc_id", "text_md5")


def audit_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as if a proxy had sent them."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    request = F.col("event_id") % 2 == 0
    return e.select(
        "event_id",
        F.col("ts").alias("timestamp"),
        F.when(F.col("user_id") % 2 == 0, "a").otherwise("b").alias("provider"),
        F.concat(F.lit("/v1/"), "event_type").alias("path"),
        F.when(request, audit.REQUEST).otherwise(audit.RESPONSE).alias("direction"),
        F.when(request, k % 5).otherwise(0).alias("pii_count"),
        F.lit(False).alias("passthrough"),
        F.when(~request, (200 + 100 * (k % 4)).cast("int")).alias("status_code"),
        F.when(~request, k).alias("duration_ms"),
        F.lit("m-1").alias("model"),
        F.lit(None).cast("string").alias("error"),
    )


_K = "CAST(json_extract_string(props, '$.k') AS BIGINT)"


@query(f"SELECT count(*) FILTER (event_id % 2 = 0) AS total_requests, CAST(sum(CASE WHEN event_id % 2 = 0 THEN {_K} % 5 ELSE 0 END) AS BIGINT) AS total_pii FROM events")
def audit_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.counters(audit_events(spark, sf_dir))


@query("SELECT event_id, CAST(ts AS TIMESTAMP) AS timestamp FROM events ORDER BY ts DESC, event_id DESC LIMIT 200")
def audit_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.newest(audit_events(spark, sf_dir), 200, ("timestamp", "event_id")).select("event_id", "timestamp")


@query(f"SELECT CASE WHEN event_id % 2 = 0 THEN 'none' WHEN {_K} % 4 = 0 THEN '2xx' WHEN {_K} % 4 < 3 THEN '4xx' ELSE '5xx' END AS status_class, count(*) AS n, CAST(sum(CASE WHEN event_id % 2 = 1 THEN {_K} END) AS BIGINT) AS duration_ms FROM events GROUP BY 1")
def audit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = audit_events(spark, sf_dir).withColumn("status_class", audit.status_class(F.col("status_code")))
    return found.groupBy("status_class").agg(F.count("*").alias("n"), F.sum("duration_ms").alias("duration_ms"))


@query("SELECT event_id, strftime(ts, '[%H:%M:%S] ') || CASE WHEN event_id % 2 = 0 THEN concat_ws(' ', '→', 'PII', CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END, '/v1/' || event_type, 'm-1') ELSE concat_ws(' ', '←', CAST(200 + 100 * (" + _K + " % 4) AS VARCHAR), CASE WHEN user_id % 2 = 0 THEN 'a' ELSE 'b' END, '/v1/' || event_type, " + _K + " || 'ms') END AS line FROM events")
def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.line(audit_events(spark, sf_dir)).select("event_id", "line")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, CAST(round(sum(value), 4) AS DOUBLE) AS total FROM events GROUP BY 1, 2")
def events_windowed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.windowed(table(spark, sf_dir, "events"), "ts", "event_type", "value").withColumn("total", F.round("total", 4))


@query("""WITH x AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM x)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, count(*) AS n FROM s GROUP BY user_id, g""")
def events_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.sessions(table(spark, sf_dir, "events"), "ts", "user_id")
