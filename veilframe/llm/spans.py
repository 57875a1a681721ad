"""Spans of regular expressions in code points, with built-in expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The element type of found().
FOUND = "struct<s:int,e:int,v:string,before:string,after:string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def found(text: Column, pattern: str, context: int = 0, keep: Callable[[Column], Column] | None = None) -> Column:
    """The leftmost non-overlapping matches of a pattern that never matches nothing: array of FOUND.

    The matches and the gaps between them alternate, so a running length gives their places. before and after hold
    up to context code points of the gaps around a match. Matches that keep is not true for are passed over.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    near = lambda gap, side: side(gap, F.lit(context)) if context else F.lit("")

    def place(both: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("i"), F.array().cast(f"array<{FOUND}>").alias("out"))

        def step(acc: Column, match: Column) -> Column:
            gap = F.element_at(both["g"], acc["i"] + 1)
            s = acc["at"] + F.length(gap)
            one = F.struct(s.alias("s"), (s + F.length(match)).alias("e"), match.alias("v"), near(gap, F.right).alias("before"), near(F.element_at(both["g"], acc["i"] + 2), F.left).alias("after"))
            out = F.concat(acc["out"], F.array(one))
            out = F.when(keep(match), out).otherwise(acc["out"]) if keep else out
            return F.struct((s + F.length(match)).alias("at"), (acc["i"] + 1).alias("i"), out.alias("out"))

        return F.aggregate(both["m"], start, step, lambda acc: acc["out"])

    return let(F.struct(matches.alias("m"), gaps.alias("g")), place)


def none() -> Column:
    return F.array().cast(f"array<{FOUND}>")


def listed(spans: Column) -> Column:
    """kind:start:end of each of an array of structs (kind, s, e), comma-joined."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def row_key(id_column: Column, text: Column) -> Column:
    """128 bits that rows share only if they are equal in both."""
    return F.struct(F.xxhash64(id_column, text).alias("a"), F.xxhash64(text, F.lit(1), id_column).alias("b"))
