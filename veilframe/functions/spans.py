"""Places of regular expressions in code points, with built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = "struct<s:int,e:int,v:string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def find_all(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as array of (s, e, v): gaps and matches alternate, so lengths add up to places."""

    def place(both: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(f"array<{MATCH}>").alias("out"))

        def step(acc: Column, match: Column) -> Column:
            s = acc["at"] + F.length(F.element_at(both["g"], acc["i"] + 1))
            e = s + F.length(match)
            return F.struct(e.alias("at"), (acc["i"] + 1).alias("i"), F.concat(acc["out"], F.array(F.struct(s.alias("s"), e.alias("e"), match.alias("v")))).alias("out"))

        return F.aggregate(both["m"], start, step, lambda acc: acc["out"])

    return let(F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("g")), place)
