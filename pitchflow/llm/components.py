"""Connected components of a link table by alternating star contractions (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Table, join_counted


def _least(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each node, and how many it has: a third of all nodes may hang on one."""
    return edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each neighbour above a node links to the smallest of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = _least(both).withColumn("m", F.least("a", "m"))
    return join_counted(both, least, ["a"], "n").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its lower neighbours link to the lowest of them. Edges go from a down to b."""
    least = _least(edges)
    lower = join_counted(edges, least, ["a"], "n").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return lower.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """``links(a, b)`` to ``(id, component)`` for every linked id but the smallest of each component.

    Self links are ignored, repeated links count once, and an empty table gives an empty result.
    Each round writes its edges to the shared folder, so a lost executor repeats one round at most.
    """
    start = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a > b").distinct()
    now, before = Table(start, "edges"), None
    while True:
        sign = now.df.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if sign == before or not sign["n"]:
            return now.df.select(F.col("a").alias("id"), F.col("b").alias("component"))
        before, last = sign, now
        large = Table(_large_star(last.df), "edges")
        now = Table(_small_star(large.df), "edges")
        last.drop()
        large.drop()
