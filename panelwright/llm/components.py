"""Connected components of an edge table, by large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.session import cut_lineage, drop_table


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """Links neighbours to the smallest node next to them: the larger ones, or the smaller ones and the node itself."""
    both = edges.union(edges.select("b", "a")) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = cut_lineage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m")))
    met = both.join(least, "a")
    out = met.where("b > a").select("b", "m") if larger else met.select("b", "m").union(least.select("a", "m"))
    return out.toDF("a", "b").where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; the root is the smallest node it is joined to.

    ``edges`` holds pairs (a, b) of one ordered type; loops and repeats do no
    harm, pairs with a null are left out.  Ends when a round changes nothing,
    after about log n rounds.
    """
    stars = cut_lineage(edges.select("a", "b").where("a <> b").distinct())
    while True:
        after = cut_lineage(_star(_star(stars, True), False))
        settled = after.count() == stars.count() and after.exceptAll(stars.select("a", "b")).isEmpty()
        drop_table(stars)
        stars = after
        if settled:
            roots = stars.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
