"""The two-way mapping of originals and pseudonyms, one for each session."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.operators.generate import pseudonym
from veilframe.session import written

SESSION = "default"


def original_hash(value: Column) -> Column:
    return F.sha2(value, 256)


@lru_cache(maxsize=16)
def _drawn(salt: str, gateway: int) -> Column:
    """Building the expression takes seconds, so it is kept for as long as its JVM lives."""
    return pseudonym(F.col("entity_type"), F.col("original"), salt)


def _named(originals: DataFrame, salt: str, used: DataFrame | None = None) -> DataFrame:
    """originals with a pseudonym each: none twice, none an original, none that used (a mapping) has in either column.

    The original with the least hash has the name that was drawn, others the hash's first 12 digits behind it, and
    where that is taken as well the whole hash. Names are counted by aggregates that combine before the shuffle, so a
    name that many originals draw gathers nowhere.
    """
    drawn = _drawn(salt, id(originals.sparkSession.sparkContext._gateway))
    rows = written(originals.withColumn("name", drawn), "drawn")
    taken = rows.select(F.col("original").alias("taken"))
    if used is not None:
        taken = taken.unionByName(used.select(F.col("original").alias("taken"))).unionByName(used.select(F.col("pseudonym").alias("taken")))

    def judged(rows: DataFrame, taken: DataFrame) -> DataFrame:
        least = rows.groupBy(F.col("name").alias("n")).agg(F.min("original_hash").alias("least"))
        both = rows.join(least, F.col("name") == F.col("n")).join(taken.distinct(), F.col("name") == F.col("taken"), "left")
        return both.withColumn("free", (F.col("original_hash") == F.col("least")) & F.col("taken").isNull()).select(*rows.columns, "free")

    columns = [*originals.columns, F.col("name").alias("pseudonym")]
    first = written(judged(rows, taken), "named")
    kept, rest = first.where("free"), first.where("NOT free").drop("free")
    again = judged(rest.withColumn("drawn", F.col("name")).withColumn("name", F.concat("name", F.lit("~"), F.substring("original_hash", 1, 12))), taken.unionByName(kept.select(F.col("name").alias("taken"))))
    last = again.withColumn("name", F.when(F.col("free"), F.col("name")).otherwise(F.concat("drawn", F.lit("~"), "original_hash")))
    return kept.select(*columns).unionByName(last.select(*columns))


def _originals(found: DataFrame) -> DataFrame:
    rows = found.groupBy(F.col("value").alias("original")).agg(F.min("entity_type").alias("entity_type"))
    return rows.withColumn("original_hash", original_hash(F.col("original")))


def _mapping(named: DataFrame, session: str) -> DataFrame:
    return named.select(F.lit(session).alias("session_id"), F.conv(F.substring("original_hash", 1, 15), 16, 10).cast("long").alias("id"), "original_hash", "original", "pseudonym", "entity_type")


def build(found: DataFrame, salt: str = "", session: str = SESSION) -> DataFrame:
    """(session_id, id, original_hash, original, pseudonym, entity_type) from entities (entity_type, value).

    An original has one pseudonym whatever its types; the first type by name decides. No pseudonym stands for two
    originals, and none is an original: values that would are told apart by the original's hash behind them.
    """
    return _mapping(_named(_originals(found), salt), session)


def extend(mapping: DataFrame, found: DataFrame, salt: str = "", session: str = SESSION) -> DataFrame:
    """mapping with the originals of found that it lacks; what it has stays.

    No new pseudonym is one that mapping has, or an original of either. A new original may be a pseudonym that mapping
    has: it has one of its own, so that no text shows it as it came.
    """
    new = found.join(mapping.select(F.col("original").alias("known")), F.col("value") == F.col("known"), "left_anti")
    return mapping.unionByName(_mapping(_named(_originals(new), salt, mapping), session), allowMissingColumns=True)


def encrypted(mapping: DataFrame, key: Column) -> DataFrame:
    """mapping with AES-GCM of the original (nonce, text and tag) in its place. key is a column, so no plan shows it."""
    return mapping.withColumn("encrypted_original", F.aes_encrypt(F.col("original").cast("binary"), key, F.lit("GCM"))).drop("original")


def decrypted(mapping: DataFrame, key: Column) -> DataFrame:
    """Its inverse; rows that key doesn't open are left out."""
    opened = F.try_aes_decrypt(F.col("encrypted_original"), key, F.lit("GCM")).cast("string")
    return mapping.withColumn("original", opened).where("original IS NOT NULL").drop("encrypted_original")


def lookup_original(df: DataFrame, mapping: DataFrame, value_col: str) -> DataFrame:
    """df with the pseudonym of a column's values, null where there is none; values are matched by their hash."""
    known = mapping.select(F.col("original_hash").alias("__h"), "pseudonym")
    return df.join(known, original_hash(F.col(value_col)) == F.col("__h"), "left").drop("__h")


def lookup_pseudonym(df: DataFrame, mapping: DataFrame, pseudonym_col: str, key: Column | None = None) -> DataFrame:
    """df with the original of a column's pseudonyms, null where there is none; key opens an encrypted mapping."""
    opened = decrypted(mapping, key) if key is not None else mapping
    return df.join(opened.select(F.col("pseudonym").alias("__p"), "original"), F.col(pseudonym_col) == F.col("__p"), "left").drop("__p")


def longest_first(mapping: DataFrame) -> DataFrame:
    return mapping.orderBy(F.desc(F.octet_length("pseudonym")), "pseudonym")


def subnets(found: DataFrame, least: int = 2) -> DataFrame:
    """(prefix, n): networks of least IPv4 entities or more."""
    from veilframe.functions.validators import ip_prefix

    prefixes = found.where("entity_type = 'IP_ADDRESS'").select(ip_prefix(F.col("value")).alias("prefix")).where("prefix IS NOT NULL")
    return prefixes.groupBy("prefix").agg(F.count("*").alias("n")).where(F.col("n") >= least)
