"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from snapledger.llm.common import cut, gathered

#: Links a task takes.
PER_TASK = 50_000


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one lesser neighbour, or only greater ones."""
    ends = edges.select(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up > 1 OR (up = 1 AND down = 1)").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in ``links`` (a, b), two longs; root is the least node it is linked with, itself included.

    Null ends and links of a node to itself are left out; an empty table gives an empty
    one. Alternates large-star and small-star steps, each a minimum by node joined back to
    the links, until every node hangs on its root alone. Every round's links are written to
    the shared folder; no node's neighbours are gathered in one place.
    """
    edges = cut(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    rows = edges.count()
    few = lambda df: gathered(df, rows, PER_TASK)
    edges = few(edges)
    while not _are_stars(edges):
        # large star: the greater neighbours of a node go to its least neighbour
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        joined = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v")
        edges = cut(few(joined.distinct()))
        # small star: a node and its lesser neighbours go to the least of them
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = edges.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = cut(few(edges.distinct()))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
