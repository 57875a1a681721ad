"""The rules as a table function, for LATERAL use in SQL: pii_entities(text).

Catalyst plans with veilframe.operators.detect are faster; this is for SQL users, in Python over Arrow batches.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

COLUMNS = "entity_type string, value string, start int, end int, confidence double"


def luhn_valid(s: str) -> bool:
    d = [int(c) for c in s if "0" <= c <= "9"][::-1]
    return 13 <= len(d) <= 19 and sum(sum(divmod(x * (1 + i % 2), 10)) for i, x in enumerate(d)) % 10 == 0


def iban_valid(s: str) -> bool:
    c = s.replace(" ", "").replace("-", "").upper()
    return bool(re.fullmatch("[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}", c)) and int("".join(str(int(x, 36)) for x in c[4:] + c[:4])) % 97 == 1


def looks_like_secret(s: str) -> bool:
    size = len(s.encode())
    kinds = [any(x.isupper() for x in s), any(x.islower() for x in s), any("0" <= x <= "9" for x in s), any(not x.isalnum() for x in s)]
    return size >= 12 and sum(kinds) >= 3 and -sum(n / size * math.log2(n / size) for n in Counter(s).values()) > 3.5


CHECKS = {"iban": iban_valid, "card": luhn_valid, "password": looks_like_secret}


@lru_cache(maxsize=1)
def _compiled():
    from veilframe.operators.detect import RULES

    return [(r, re.compile(r.plain or r.pattern, re.ASCII)) for r in RULES]


def entities(text: str | None) -> list[tuple[str, str, int, int, float]]:
    """Resolved entities by start."""
    kept: list[tuple[str, str, int, int, float]] = []
    for r, pattern in _compiled() if text else ():
        for m in pattern.finditer(text):
            value, (s, e) = m[r.suffix_group], m.span(r.suffix_group)
            if (r.name not in CHECKS or CHECKS[r.name](value)) and not any(s < k[3] and k[2] < e for k in kept):
                kept.append((r.entity_type, value, s, e, r.confidence))
    return sorted(kept, key=lambda k: k[2])


def register(spark: SparkSession) -> None:
    """Makes pii_entities(text) known to SQL."""

    class PiiEntities:
        def eval(self, text: str):
            yield from entities(text)

    spark.udtf.register("pii_entities", udtf(PiiEntities, returnType=COLUMNS, useArrow=True))
