"""Pseudonyms into texts, and originals back."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.validators import digits
from veilframe.operators import detect, mapping
from veilframe.session import written

#: Bytes of a mapping that is sent to the executors; a larger one is joined with the texts.
AUTOMATON_BYTES = 64 << 20
#: log2 of the bits of the filter for what may be a pseudonym of a larger mapping; a false hit costs time only.
FILTER_BITS = 27
MATCHES = "array<struct<s:int,n:int,o:string>>"
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def splice(text: Column, spans: Column) -> Column:
    """text with spans (s, e, to), by start and apart, replaced."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    step = lambda acc, x: F.struct(x["e"].alias("at"), F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), x["to"]).alias("out"))
    return F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))


#: What stands for a text with entities whose replacements got lost: nothing goes out as it came.
WITHHELD = "[WITHHELD]"


class Pseudonymized(NamedTuple):
    """changed: the rows, rewritten. replaced: (id, original, pseudonym, entity_type, start, end). known: the mapping used."""

    changed: DataFrame
    replaced: DataFrame
    known: DataFrame


def run(df: DataFrame, id_col: str, text_col: str = "text", known: DataFrame | None = None, salt: str = "", **options) -> Pseudonymized:
    """df with text_col pseudonymized, by known and by what its entities need besides.

    An entity that known lacks gets a pseudonym drawn with salt; the mapping that comes back has it too. The corpus
    is searched once, and what was found is written. Replacements belong to a text, not to an id: ids may repeat or be
    null. An entity without a replacement is shown as its type, never as it came. Rows without entities aren't moved.
    """
    text = F.col(text_col)
    found = written(detect.with_entities(df, text_col, into="__found", **options), "found")
    dirty = found.where(F.size("__found") > 0).withColumn("__text_key", F.sha2(text.cast("binary"), 256))
    texts = dirty.groupBy("__text_key").agg(F.first("__found").alias("x"))
    rows = texts.select("__text_key", F.explode("x").alias("x")).select("__text_key", "x.*")
    values = rows.select("entity_type", F.col("v").alias("value"))
    known = written(mapping.extend(known, values, salt) if known is not None else mapping.build(values, salt), "mapping")
    to = known.groupBy("original").agg(F.min("pseudonym").alias("pseudonym"))
    joined = rows.join(to, F.col("v") == F.col("original"), "left")
    put = F.coalesce("pseudonym", F.concat(F.lit("["), "entity_type", F.lit("]")))
    one = F.struct("s", "e", put.alias("to"), F.col("v").alias("original"), "entity_type")
    spans = joined.groupBy("__text_key").agg(F.array_sort(F.collect_list(one)).alias("__spans"))
    both = dirty.join(spans, "__text_key", "left")
    done = both.withColumn(text_col, F.when(F.col("__spans").isNull(), F.lit(WITHHELD)).otherwise(splice(text, F.col("__spans"))))
    changed = found.where(F.size("__found") == 0).select(*df.columns).unionByName(done.select(*df.columns))
    replaced = dirty.select(id_col, "__text_key").join(spans, "__text_key").select(id_col, F.explode("__spans").alias("x"))
    replaced = replaced.select(id_col, "x.original", F.col("x.to").alias("pseudonym"), "x.entity_type", F.col("x.s").alias("start"), F.col("x.e").alias("end"))
    return Pseudonymized(changed, replaced, known)


def pseudonymize(df: DataFrame, known: DataFrame, id_col: str, text_col: str = "text", salt: str = "", **options) -> tuple[DataFrame, DataFrame]:
    """The first two of run(). Entities that known lacks are pseudonymized too; run() gives the mapping that has them."""
    changed, replaced, _ = run(df, id_col, text_col, known, salt, **options)
    return changed, replaced


def _automaton(pairs: list[tuple[str, str]]):
    import ahocorasick

    out = ahocorasick.Automaton()
    for pseudo, original in pairs:
        if pseudo:
            out.add_word(pseudo, (len(pseudo), original))
    if len(out):
        out.make_automaton()
    return out


def leftmost_longest(text: str, automaton) -> list[tuple[int, int, str]]:
    """(start, end, original) of the leftmost, then longest pseudonyms, apart."""
    if not text or not len(automaton):
        return []
    found = sorted((end - n + 1, -n, original) for end, (n, original) in automaton.iter(text))
    out, at = [], 0
    for start, n, original in found:
        if start >= at:
            out.append((start, start - n, original))
            at = start - n
    return out


def put(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, to in spans:
        out += [text[at:s], to]
        at = e
    return "".join([*out, text[at:]])


def restore(df: DataFrame, known: DataFrame, text_col: str = "text") -> DataFrame:
    """df with pseudonyms in text_col replaced by their originals, leftmost-longest. A null text stays null.

    A mapping of up to AUTOMATON_BYTES is sent to the executors; a larger one is joined with what in the texts may be
    a pseudonym, so that no worker holds it. The result is the same.
    """
    text, pairs = F.col(text_col), known.select("pseudonym", "original")
    if (held := _sent(pairs)) is not None:
        return df.withColumn(text_col, _direct(held)(text))
    return _resolved(_matched(df, text_col, pairs, "__found"), text_col, F.col("__found"), _nothing()).drop("__found")


def _nothing() -> Column:
    return F.array().cast(MATCHES)


def _sent(*tables: DataFrame):
    """Tables (pseudonym, original) as a broadcast of lists, unless they are larger than AUTOMATON_BYTES in all."""
    size = 0
    for pairs in tables:
        size += pairs.agg(F.sum(F.octet_length("pseudonym") + F.octet_length("original") + 64).alias("n")).first().n or 0
    if size > AUTOMATON_BYTES:
        return None
    return tables[0].sparkSession.sparkContext.broadcast([[tuple(r) for r in pairs.select("pseudonym", "original").collect()] for pairs in tables])


def _direct(held, words: bool = False):
    """A function of texts: matches of the first table put in, outside of those of the second if there is one."""
    cache = {}

    @F.pandas_udf("string")
    def put_in(texts: pd.Series) -> pd.Series:
        if "a" not in cache:
            cache["a"] = [_automaton(pairs) for pairs in held.value]
        first, *protected = cache["a"]
        out = []
        for t in texts:
            found = _all(t, first, words)
            if found and protected:
                kept = _leftmost(_all(t, protected[0], False))
                found = [x for x in found if not any(s < x[0] + x[1] and x[0] < e for s, e, _ in kept)]
            out.append(put(t, _leftmost(found)) if found else t)
        return pd.Series(out, dtype=object)

    return put_in


def _between(t: str, s: int, e: int) -> bool:
    inside = lambda i: 0 <= i < len(t) and (t[i].isalnum() or t[i] == "_")
    return inside(s - 1) != inside(s) and inside(e - 1) != inside(e)


def _all(t: str | None, automaton, words: bool) -> list[tuple[int, int, str]]:
    """(start, size, original) of every match; with words, of those between word boundaries."""
    if not t or not len(automaton):
        return []
    return [(e - n + 1, n, o) for e, (n, o) in automaton.iter(t) if not words or _between(t, e - n + 1, e + 1)]


def _leftmost(found: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, original) of the leftmost, then longest of matches (start, size, original), apart."""
    out, at = [], 0
    for s, n, o in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if s >= at:
            out.append((s, s + n, o))
            at = s + n
    return out


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)


class _Hashes:
    """Hashes of all stretches of a text of a given size: differences of a running polynomial, mixed."""

    def __init__(self, text: str):
        points = _code_points(text) + np.uint64(1)
        self.size = len(points)
        powers, self.inverse = (np.cumprod(np.concatenate(([np.uint64(1)], np.full(self.size, x, np.uint64))), dtype=np.uint64) for x in (_BASE, _INVERSE))
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(points * powers[:-1], dtype=np.uint64)))

    def of(self, n: int) -> np.ndarray:
        """The hash of each stretch of n code points, by its start."""
        starts = np.arange(self.size - n + 1)
        h = (self.sums[starts + n] - self.sums[starts]) * self.inverse[starts]
        h = (h ^ (h >> np.uint64(31))) * _MIX
        return h ^ (h >> np.uint64(29))


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64), (h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def _matched(df: DataFrame, text_col: str, pairs: DataFrame, into: str, words: bool = False) -> DataFrame:
    """df with a column of all matches (MATCHES) of pairs (pseudonym, original) in text_col, for mappings of any size.

    Stretches of texts as long as some pseudonym are hashed; a filter of fixed size leaves those that may be one. These
    meet the mapping in a join by hash, and are compared with the pseudonym itself when they are back at their text.
    """
    spark = df.sparkSession

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = batch.column(0).to_pylist()
            h = np.array([full(x) for x in p], np.uint64)
            a, b = _places(h)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array([len(x) for x in p], pa.int32()), pa.array(a), pa.array(b), *batch.columns], ["h", "n", "a", "b", "p", "o"])

    def full(pseudonym: str) -> np.uint64:
        return _Hashes(pseudonym).of(len(pseudonym))[0]

    rows = pairs.where("pseudonym <> ''").select("pseudonym", "original").mapInArrow(hashed, "h long, n int, a long, b long, p string, o string")
    rows = written(rows, "pseudonyms")
    sizes = sorted(r.n for r in rows.select("n").distinct().collect())
    place, block = F.explode(F.array("a", "b")).alias("at"), 1 << 15  # of the maps that Spark builds
    maps = rows.select(place).groupBy(F.shiftright("at", 15).alias("k")).agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(block - 1).cast("long")).alias("m")).collect()
    bits = np.zeros((1 << FILTER_BITS) // 8, np.uint8)  # fixed size, whatever the mapping
    for r in maps:
        bits[r.k * block // 8 : (r.k + 1) * block // 8] = np.frombuffer(bytes(r.m), np.uint8)
    shared = spark.sparkContext.broadcast((sizes, bits))

    def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes, bits = shared.value
        has = lambda at: bits[at >> 3] >> (at & 7).astype(np.uint8) & 1 != 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                every, out = _Hashes(text), []
                for n in sizes:
                    if n > every.size:
                        break
                    h = every.of(n)
                    a, b = _places(h)
                    at = np.flatnonzero(has(a))
                    at = at[has(b[at])]
                    out.append((at, np.full(len(at), n), h[at]))
                if sum(len(x[0]) for x in out):
                    s, n, h = (np.concatenate(x) for x in zip(*out, strict=True))
                    key = hashlib.sha256(text.encode()).hexdigest()
                    yield pa.RecordBatch.from_arrays([pa.array([key] * len(s)), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(h.view(np.int64))], ["key", "s", "n", "h"])

    text = F.col(text_col)
    near = df.where(text.isNotNull()).select(text).mapInArrow(likely, "key string, s int, n int, h long").distinct()
    got = near.join(rows.select("h", "n", "p", "o"), ["h", "n"]).groupBy(F.col("key").alias("__own_text")).agg(F.collect_list(F.struct("s", "n", "o", "p")).alias("__near"))

    @F.pandas_udf(MATCHES)
    def checked(texts: pd.Series, near: pd.Series) -> pd.Series:
        out = []
        for t, found in zip(texts, near, strict=True):
            ok = [x for x in found if t[x["s"] : x["s"] + x["n"]] == x["p"]] if found is not None else []
            out.append([{"s": x["s"], "n": x["n"], "o": x["o"]} for x in ok if not words or _between(t, x["s"], x["s"] + x["n"])])
        return pd.Series(out, dtype=object)

    joined = df.withColumn("__own_text", F.sha2(text.cast("binary"), 256)).join(got, "__own_text", "left")
    return joined.withColumn(into, checked(text, F.col("__near"))).drop("__own_text", "__near")


def _resolved(df: DataFrame, text_col: str, found: Column, protected: Column) -> DataFrame:
    text = F.col(text_col)
    return df.withColumn(text_col, F.when(text.isNotNull(), _resolve()(text, found, protected)))


def _resolve():
    """Of found, what lies outside of the resolved matches of protected, leftmost-longest, put into the text."""

    def resolved(found) -> list[tuple[int, int, str]]:
        return _leftmost([(x["s"], x["n"], x["o"]) for x in found])

    @F.pandas_udf("string")
    def resolve(texts: pd.Series, found: pd.Series, protected: pd.Series) -> pd.Series:
        out = []
        for t, f, p in zip(texts, found, protected, strict=True):
            kept = resolved(p)
            free = [x for x in f if not any(s < x["s"] + x["n"] and x["s"] < e for s, e, _ in kept)] if kept else f
            out.append(put(t or "", resolved(free)))
        return pd.Series(out)

    return resolve


def fragments(known: DataFrame) -> DataFrame:
    """(pseudo_fragment, original_fragment): parts of pseudonyms that may come alone, with their originals' parts.

    Octets of IPv4 addresses, groups of four digits of cards, and parts between white space of identifiers, where
    both have as many parts; parts that are alike are left out.
    """
    groups = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / 4).cast("int")), lambda i: F.substring(s, i * 4 + 1, F.lit(4)))
    pair = lambda a, b: F.zip_with(a, b, lambda x, y: F.struct(x.alias("pseudo_fragment"), y.alias("original_fragment")))
    p, o, t = F.col("pseudonym"), F.col("original"), F.col("entity_type")
    v4 = r"^[0-9]+(?:\.[0-9]+){3}$"
    words = lambda s: F.split(F.trim(s), r"\s+")
    parts = (
        F.when((t == "IP_ADDRESS") & p.rlike(v4) & o.rlike(v4), pair(F.split(p, r"\."), F.split(o, r"\.")))
        .when((t == "CREDIT_CARD") & (F.length(digits(p)) == F.length(digits(o))) & (F.length(digits(p)) >= 8), pair(groups(digits(p)), groups(digits(o))))
        .when(t.isin("NATIONAL_ID", "TAX_NUMBER", "DRIVER_LICENSE") & (F.size(words(p)) == F.size(words(o))) & (F.size(words(p)) >= 2), pair(words(p), words(o)))
    )
    return known.select(F.explode(parts).alias("x")).select("x.*").where("pseudo_fragment <> original_fragment")


def unambiguous(pairs: DataFrame) -> DataFrame:
    """Fragments that stand for one original fragment only."""
    return pairs.groupBy("pseudo_fragment").agg(F.min("original_fragment").alias("original_fragment"), F.max("original_fragment").alias("most")).where("original_fragment = most").drop("most")


def restore_fragments(df: DataFrame, known: DataFrame, text_col: str = "text", least: int = 2) -> DataFrame:
    """df with fragments of least characters or more replaced, as words of their own, outside of whole originals.

    All are found before any is replaced, so what is put in is never replaced again. With least 1 single characters
    are fragments too.
    """
    pairs = unambiguous(fragments(known)).where(F.length("pseudo_fragment") >= least).select(F.col("pseudo_fragment").alias("pseudonym"), F.col("original_fragment").alias("original"))
    whole = known.select(F.col("original").alias("pseudonym"), "original")
    if (held := _sent(pairs, whole)) is not None:
        return df.withColumn(text_col, _direct(held, words=True)(F.col(text_col)))
    both = _matched(_matched(df, text_col, pairs, "__found", words=True), text_col, whole, "__whole")
    return _resolved(both, text_col, F.col("__found"), F.col("__whole")).drop("__found", "__whole")


def build_mapping(df: DataFrame, id_col: str, text_col: str = "text", salt: str = "", **options) -> DataFrame:
    """The mapping of all entities of a table."""
    return mapping.build(detect.entities(df, id_col, text_col, **options), salt)
