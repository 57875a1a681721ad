"""A corpus pipeline over documents: each stage works on all that the one before it kept.

Language ID drops what has no language, the Jaccard join keeps one document of each group, decontamination drops
what holds benchmark passages, sanitisation rewrites texts, and byte-level BPE turns what is left into tokens.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bpe, common, decontaminate, jaccard, langid, pii
from veilframe.llm.spans import row_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which no language is found: without a letter, or without text."""
    common.prepare(spark)
    network = langid.fit(docs)
    if network is None:
        return langid.with_letter(docs.select(*COLUMNS))
    found = langid.annotate(docs.select(*COLUMNS), network)
    return found.where(F.col("lang_pred") != langid.UNDETERMINED).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates the row of the smallest id, once; one without an id only where none has one.

    Rows are told apart by id and text, so rows of one id that aren't near copies all stay.
    """
    common.prepare(spark)
    both = row_key(F.col("doc_id"), F.coalesce("text", F.lit("")))
    keyed = docs.select(*COLUMNS, F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), both["a"].alias("a"), both["b"].alias("b")).alias("key"))
    first = jaccard.near_duplicates(keyed, "key").where("doc_id = component_id").select(F.col("doc_id").alias("first"))
    return keyed.join(first, F.col("key") == F.col("first"), "left_semi").dropDuplicates(["key"]).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold enough of the benchmark's passages."""
    common.prepare(spark)
    return decontaminate.clean(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def sanitisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks personal data, and generalises or removes words that reveal them; n_chars follows the text."""
    clean = pii.sanitise(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, text_sha256): the tokens of each text, which decode to the text whose digest is given."""
    import public_tokenizers

    common.prepare(spark)
    coded = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, decoded=True)
    return coded.select("doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"), F.sha2("decoded", 256).alias("text_sha256"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("jaccard_join", jaccard_join),
    ("decontamination", decontamination),
    ("pii", sanitisation),
    ("bpe", tokens),
]
#: The stages use a trained network and a tokenizer, which SQL can't express; tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over documents, each one's result written as Parquet and read again."""
    docs = common.read_documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.write_table(docs, f"pipeline-{name}")
    return docs
