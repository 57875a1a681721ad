"""Entities by rules: candidates of every rule, then a fold by priority that drops what overlaps.

Users may add rules: a pattern, the group that is the value, a validator and a confidence; the place in the list is
the priority.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions import validators
from veilframe.functions.spans import find_all, let

ENTITY = "struct<priority:int,s:int,e:int,entity_type:string,v:string,confidence:double>"


@dataclass(frozen=True)
class Rule:
    """guard is a cheap necessary condition: a pattern, or literals of which a text must have one, whatever the case.

    digits says that a match holds two digits with one separator between them at most, so that one look at a text
    spares all rules of that kind. plain is the pattern where other engines must run it.
    """

    name: str
    entity_type: str
    pattern: str
    confidence: float = 0.9
    validator: Callable[[Column], Column] | None = None
    suffix_group: int = 0
    guard: str | tuple[str, ...] | None = None
    plain: str | None = None
    digits: bool = False


_OCTET = "(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
_PLAIN_EMAIL = r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_PLAIN_PASSWORD = r"(?i)(?:password|passwd|pwd|mdp|secret|mot\s+de\s+passe)\s*(?:=|:|\s+est|\s+is)\s*(\S{8,})"
#: The patterns, in the order of their priority. The e-mail rule tries a run from its start alone, and the
#: password rule takes each run of white space once.
RULES: tuple[Rule, ...] = (
    Rule("iban", "IBAN", r"\b[A-Z]{2}\d{2}(?:\s?[A-Z0-9]{4}){2,7}(?:\s?[A-Z0-9]{1,4})?\b", 0.95, validators.iban_valid, guard=r"[A-Z]{2}\d{2}", digits=True),
    Rule("card", "CREDIT_CARD", r"\b(?:4[0-9]{3}|5[1-5][0-9]{2}|3[47][0-9]{2}|6(?:011|5[0-9]{2}))[0-9 \-]{8,15}[0-9]\b", 0.95, validators.luhn_valid, guard=r"[3-6][0-9]{3}[0-9 \-]{8}", digits=True),
    Rule("password", "PASSWORD", r"(?i)(?:password|passwd|pwd|mdp|secret|mot\s++de\s++passe)\s*+(?:=|:|(?<=\s)est|(?<=\s)is)\s*+(\S{8,})", 0.95, validators.looks_like_secret, 1, ("passw", "pwd", "mdp", "secret", "passe"), _PLAIN_PASSWORD),
    Rule("key_vendor_1", "API_KEY", r"\bsk-ant-[a-zA-Z0-9\-_]{40,}\b", guard=("sk-ant-",)),
    Rule("key_vendor_2", "API_KEY", r"\bsk-(?:proj-)?[a-zA-Z0-9]{48,}\b", guard=("sk-",)),
    Rule("key_payment", "API_KEY", r"\b(?:sk|pk)_(?:live|test)_[a-zA-Z0-9]{24,}\b", guard=("k_live_", "k_test_")),
    Rule("key_forge", "API_KEY", r"\bgh[pousr]_[a-zA-Z0-9]{36,}\b", guard=("ghp_", "gho_", "ghu_", "ghs_", "ghr_")),
    Rule("key_chat", "API_KEY", r"\bxox[bpas]-[0-9A-Z]{10,}-[0-9A-Z]{10,}(?:-[0-9a-zA-Z]{24,})?\b", guard=("xox",)),
    Rule("key_cloud", "API_KEY", r"\b(?:AKIA|ASIA|ABIA|ACCA)[A-Z0-9]{16}\b", guard=r"A[KSBC][IC]A[A-Z0-9]{16}"),
    Rule("key_jwt", "API_KEY", r"\beyJ[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\.[a-zA-Z0-9_-]{10,}\b", guard=("eyj",)),
    Rule("key_generic", "API_KEY", r"\b(?:sk|pk|api|token|bearer)[-_][a-zA-Z0-9_\-\.]{16,}\b", guard=r"[-_][a-zA-Z0-9_\-\.]{16}"),
    Rule("email", "EMAIL", r"(?:\G|(?<![a-zA-Z0-9._%+-]))[a-zA-Z0-9._%+-]++@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}", guard=("@",), plain=_PLAIN_EMAIL),
    Rule("ipv4", "IP_ADDRESS", rf"\b(?:{_OCTET}\.){{3}}{_OCTET}\b", guard=r"\d\.\d+\.\d+\.\d", digits=True),
    Rule("ipv6", "IP_ADDRESS", r"\b(?:[0-9a-fA-F]{1,4}:){2,7}[0-9a-fA-F]{1,4}\b", guard=r":[0-9a-fA-F]{1,4}:"),
    Rule("phone", "PHONE_NUMBER", r"(?:\+33|0)\s?[1-9](?:[\s.-]?\d{2}){4}", guard=r"[1-9](?:[\s.-]?\d{2}){4}", digits=True),
    Rule("national_id", "NATIONAL_ID", r"\b[12]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}\s?\d{3}\s?\d{2}\b", guard=r"[12]\s?\d{2}\s?\d{2}\s?\d{2}\s?\d{3}", digits=True),
)
#: What all rules with digits have.
_DIGITS = r"\d[\s.-]?\d"
#: Off by default: secrets and phones that the rules above leave out.
EXTRA_RULES: tuple[Rule, ...] = (
    Rule("token_assignment", "API_KEY", r"""(?i)\b(?:token|api_?key)["']?\s*[:=]\s*["']?([A-Za-z0-9+/_.=-]{16,})""", suffix_group=1),
    Rule("phone_international", "PHONE_NUMBER", r"\+[0-9][ ().0-9-]{6,}[0-9]"),
)
#: What is never an entity.
DEFAULT_WHITELIST = ("127.0.0.1", "localhost", "::1")


def rule(name: str) -> Rule:
    return next(r for r in RULES + EXTRA_RULES if r.name == name)


def _none() -> Column:
    return F.array().cast(f"array<{ENTITY}>")


def _possible(r: Rule, text: Column, lower: Column) -> Column:
    if isinstance(r.guard, tuple):
        found = F.contains(lower, F.lit(r.guard[0].lower()))
        for literal in r.guard[1:]:
            found = found | F.contains(lower, F.lit(literal.lower()))
        return found
    return text.rlike(r.guard or r.pattern)


def _matches(text: Column, lower: Column, r: Rule, priority: int) -> Column:
    def entity(m: Column) -> Column:
        value = F.regexp_extract(m["v"], r.pattern, r.suffix_group) if r.suffix_group else m["v"]
        return F.struct(F.lit(priority).alias("priority"), (m["e"] - F.length(value)).alias("s"), m["e"].alias("e"), F.lit(r.entity_type).alias("entity_type"), value.alias("v"), F.lit(r.confidence).alias("confidence"))

    found = F.transform(find_all(text, r.pattern), entity)
    found = F.filter(found, lambda x: r.validator(x["v"])) if r.validator else found
    return F.when(_possible(r, text, lower), found).otherwise(_none())


def matches(text: Column, r: Rule, priority: int = 0) -> Column:
    """The valid matches of a rule: array of ENTITY. A suffix group is the value and ends where the match ends."""
    return let(F.lower(text), lambda lower: _matches(text, lower, r, priority))


def candidates(text: Column, rules: Sequence[Rule] = RULES) -> Column:
    """The matches of all rules, those of a rule with digits only looked for where a text has some."""

    def all_(lower: Column) -> Column:
        some = {True: [_none()], False: [_none()]}
        for i, r in enumerate(rules):
            some[r.digits].append(_matches(text, lower, r, i))
        return F.concat(F.when(text.rlike(_DIGITS), F.concat(*some[True])).otherwise(_none()), *some[False])

    return let(F.lower(text), all_)


def resolve(found: Column) -> Column:
    """Candidates by priority, then start, each kept unless it overlaps one kept before; the result by start."""

    def step(kept: Column, c: Column) -> Column:
        return F.when(F.exists(kept, lambda k: (c["s"] < k["e"]) & (k["s"] < c["e"])), kept).otherwise(F.concat(kept, F.array(c)))

    kept = F.aggregate(F.array_sort(found), F.array().cast(f"array<{ENTITY}>"), step)
    by_start = lambda a, b: F.when(a["s"] < b["s"], -1).when(a["s"] > b["s"], 1).otherwise(0)
    return F.array_sort(kept, by_start)


def with_classified(found: Column, classified: Column) -> Column:
    """Entities of rules, and those of a classifier that overlap none before them and are of a known type, by start."""
    known = F.filter(classified, lambda x: x["entity_type"] != "UNKNOWN")
    later = F.transform(known, lambda x: x.withField("priority", x["priority"] + len(RULES) + len(EXTRA_RULES)))
    return resolve(F.concat(found, later))


def without(found: Column, terms: Sequence[str]) -> Column:
    """Entities whose whole text isn't one of terms, whatever the case; what they kept out stays out."""
    terms = [t.lower() for t in terms]
    return F.filter(found, lambda x: ~F.lower(x["v"]).isin(*terms)) if terms else found


def merged_whitelist(terms: Sequence[str]) -> list[str]:
    """The default terms and more, each once whatever its case."""
    merged: dict[str, str] = {}
    for t in (*DEFAULT_WHITELIST, *terms):
        merged.setdefault(t.lower(), t)
    return [*merged.values()]


@lru_cache(maxsize=64)
def _found(text_col: str, rules: tuple[Rule, ...], whitelist: tuple[str, ...], least_confidence: float, gateway: int) -> Column:
    """The expression of with_entities(): building it takes seconds, so it is kept for as long as its JVM lives."""
    found = without(resolve(candidates(F.coalesce(F.col(text_col), F.lit("")), rules)), whitelist)
    return F.filter(found, lambda x: x["confidence"] >= least_confidence)


def with_entities(df: DataFrame, text_col: str = "text", rules: Sequence[Rule] = RULES, whitelist: Sequence[str] = (), least_confidence: float = 0.0, into: str = "entities") -> DataFrame:
    """df with a column of array of ENTITY, resolved, under the name of into. A null text has none."""
    gateway = id(df.sparkSession.sparkContext._gateway)
    return df.withColumn(into, _found(text_col, tuple(rules), tuple(whitelist), float(least_confidence), gateway))


def entities(df: DataFrame, id_col: str, text_col: str = "text", **options) -> DataFrame:
    """(id, entity_type, value, start, end, start_byte, confidence): a row for each entity."""
    found = with_entities(df.select(id_col, text_col), text_col, into="__entities", **options)
    x = F.col("x")
    return found.select(id_col, text_col, F.explode("__entities").alias("x")).select(
        id_col,
        x["entity_type"].alias("entity_type"),
        x["v"].alias("value"),
        x["s"].alias("start"),
        x["e"].alias("end"),
        F.octet_length(F.substring(F.col(text_col), F.lit(1), x["s"])).alias("start_byte"),
        x["confidence"].alias("confidence"),
    )
