"""Connected components of a link table by alternating large-star and small-star steps.

Each step sends every node's larger neighbours (large star) or its neighbours that are not larger (small star)
to the smallest node in sight, until nothing moves: every node then points at the smallest of its component.
Only aggregates of a node's links meet in a task, and joins on nodes may be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rigtable.llm.common import stage


def _least(edges: DataFrame) -> DataFrame:
    """edges: u, v.  Adds m, the smaller of u and its least neighbour."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    return edges.join(least, "u").withColumn("m", F.least("m", "u"))


def _star(edges: DataFrame) -> DataFrame:
    """One large star, then one small star; edges: u > v, distinct."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    large = _least(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    small = _least(large)
    sent = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return sent.unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _settled(edges: DataFrame) -> bool:
    """True if every u has one v and no v is a u: all nodes point at the smallest of their component."""
    forked = edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").select("u")
    chained = edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").select("u")
    return forked.unionByName(chained).isEmpty()


def components(links: DataFrame) -> DataFrame:
    """links: a, b (long).  Rows (id, component) of every id in a link; component: the smallest id reachable."""
    edges = stage(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    while not _settled(edges):
        edges = stage(_star(edges), "stars")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(
        edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    )


def merged(known: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: only links between components of ``known`` are worked on."""
    for side in ("a", "b"):
        own = known.select(F.col("id").alias(side), F.col("component").alias(f"c_{side}"))
        links = links.join(own, side, "left").withColumn(f"c_{side}", F.coalesce(f"c_{side}", side))
    across = stage(links.where("c_a <> c_b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct(), "links")
    if across.isEmpty():
        return known
    up = components(across).select(F.col("id").alias("component"), F.col("component").alias("root"))
    fresh = up.select(F.col("component").alias("id"), F.col("root").alias("component"))  # ids that were alone, and old roots
    moved = known.join(up, "component", "left").select("id", F.coalesce("root", "component").alias("component"))
    return stage(moved.unionByName(fresh.join(known.select("id"), "id", "left_anti")), "components")
