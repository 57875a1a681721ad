"""Connected components of a links table, by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import spread_join, write_table


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b): the smallest node that it is linked with, over any others.

    Each step is an aggregate and a join on a node, written to the shared folder; no group is collected, and a node of
    many links is dealt to several tasks. Rows that
    link a node with itself or repeat a link change nothing. No links give an empty table.
    """
    edges = write_table(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    while True:
        before = _state(edges)
        if not before[0]:
            break
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # large star: larger neighbours move to the smallest one
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = write_table(spread_join(both.where("v > u"), least, ["u"], ["v"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct(), "links")
        # small star: smaller neighbours, and the node, move to the smallest one
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        moved = spread_join(edges, least, ["u"], ["v"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = write_table(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        if _state(edges) == before:
            break
    node = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return node.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _state(edges: DataFrame) -> tuple:
    r = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
    return r.n, r.x
