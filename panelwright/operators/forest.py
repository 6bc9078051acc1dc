"""Maximum spanning forests of keyed edge tables, and what can be read from them at any threshold.

``union_forest`` keeps, per node that is not the last of its component, the
heaviest edge that ties it in and the node that stands for its group from that
weight on.  Weights never rise on the way up, so the graph cut at any threshold
has the same components as the forest cut there: a threshold is a filter on at
most n - 1 rows, not another search for components.

Each round every group takes its heaviest edge (ties by the edge's ends), and
the groups met that way become one; the number of groups at least halves.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.session import cut_lineage, drop_table


def _lookup(table: DataFrame, keys: Sequence[str], column: str, **columns: str) -> DataFrame:
    """``columns`` of a node table, to be joined on (keys, column)."""
    return table.select(*keys, F.col("node").alias(column), *[F.col(c).alias(name) for name, c in columns.items()])


def _roots(hooks: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, node, root): follows the chosen edges to their end by doubling the steps."""
    back = _lookup(hooks, keys, "parent", _back="parent")
    # two groups that chose the same edge point at each other; the smaller node is the end
    state = hooks.select(*keys, "node", "parent").join(back, [*keys, "parent"])
    ends = (F.col("_back") == F.col("node")) & (F.col("node") < F.col("parent"))
    state = cut_lineage(state.select(*keys, "node", F.when(ends, F.col("node")).otherwise(F.col("parent")).alias("root")))
    for _ in count():
        hop = state.join(_lookup(state, keys, "root", _far="root"), [*keys, "root"])
        fresh = cut_lineage(hop.select(*keys, "node", F.col("_far").alias("root"), (F.col("_far") != F.col("root")).alias("_moved")))
        moved = not fresh.where("_moved").isEmpty()
        drop_table(state)
        state = fresh.drop("_moved")
        if not moved:
            return state


def union_forest(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, parent, weight, src, dst) of a maximum spanning forest.

    ``edges`` has (keys, src, dst, weight); (src, dst) of a row is the tree edge
    that ties ``node`` in, and ``parent`` the node that stands for the group it
    joins.  On the way up weights never rise.  Loops, null ends and null weights
    are left out; of parallel edges the heaviest counts; a component of n nodes
    has n - 1 rows.  No edges give no rows.
    """
    keys = list(keys)
    ends = [F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")]
    usable = edges.where((F.col("src") != F.col("dst")) & F.col("weight").isNotNull()).select(*keys, *ends, F.col("weight").cast("double").alias("weight"))
    best = F.max("weight").alias("weight")
    links = cut_lineage(usable.groupBy(*keys, "src", "dst").agg(best).select("*", F.col("src").alias("a"), F.col("dst").alias("b")))
    forest = None
    while not links.isEmpty():
        edge = F.struct("weight", "src", "dst")
        heaviest = lambda here, there: links.groupBy(*keys, F.col(here).alias("node")).agg(F.max(F.struct(edge.alias("edge"), F.col(there).alias("to"))).alias("best"))
        both = heaviest("a", "b").unionByName(heaviest("b", "a")).groupBy(*keys, "node").agg(F.max("best").alias("best"))
        hooks = cut_lineage(both.select(*keys, "node", F.col("best.to").alias("parent"), "best.edge"))
        roots = _roots(hooks, keys)
        tied = hooks.join(roots, [*keys, "node"]).where("node <> root").select(*keys, "node", F.col("root").alias("parent"), "edge.*")
        tied = cut_lineage(tied)
        forest = tied if forest is None else forest.unionByName(tied)
        moved = links.join(_lookup(roots, keys, "a", _a="root"), [*keys, "a"]).join(_lookup(roots, keys, "b", _b="root"), [*keys, "b"])
        inner = moved.where("_a <> _b").select(*keys, F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b"), edge.alias("edge"))
        fresh = cut_lineage(inner.groupBy(*keys, "a", "b").agg(F.max("edge").alias("edge")).select(*keys, "edge.*", "a", "b"))
        for done in (links, hooks, roots):
            drop_table(done)
        links = fresh
    if forest is None:
        return links.select(*keys, F.col("a").alias("node"), F.col("b").alias("parent"), "weight", "src", "dst")
    return _settled(forest, keys)


def _settled(forest: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The same forest with weights that never rise on the way up.

    Whoever joined its parent no earlier than that parent joined another group
    joined that other group as well, and may point there.
    """
    forest = cut_lineage(forest)
    for _ in count():
        up = _lookup(forest, keys, "parent", _weight="weight", _far="parent")
        jump = F.coalesce(F.col("weight") <= F.col("_weight"), F.lit(False))
        met = forest.join(up, [*keys, "parent"], "left")
        fresh = cut_lineage(met.select(*keys, "node", F.when(jump, F.col("_far")).otherwise(F.col("parent")).alias("parent"), "weight", "src", "dst", jump.alias("_moved")))
        moved = not fresh.where("_moved").isEmpty()
        drop_table(forest)
        forest = fresh.drop("_moved")
        if not moved:
            return forest


def group_sizes(forest: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, node, parent, weight, size): the nodes that stand behind each node when it joins its parent.

    Sums over paths of doubling length, so the number of rounds grows with the
    logarithm of the forest's height.
    """
    keys = list(keys)
    state = cut_lineage(forest.select(*keys, "node", "parent", "weight", F.lit(1).cast("long").alias("size"), F.col("parent").alias("_to")))
    while not state.where(F.col("_to").isNotNull()).isEmpty():
        given = state.where(F.col("_to").isNotNull()).groupBy(*keys, F.col("_to").alias("node")).agg(F.sum("size").alias("_more"))
        met = state.join(given, [*keys, "node"], "left").join(_lookup(state, keys, "_to", _far="_to"), [*keys, "_to"], "left")
        fresh = cut_lineage(met.select(*keys, "node", "parent", "weight", (F.col("size") + F.coalesce("_more", F.lit(0))).alias("size"), F.col("_far").alias("_to")))
        drop_table(state)
        state = fresh
    return state.drop("_to")


def _level(weight: Column, thresholds: Sequence[float]) -> Column:
    """How many of the ascending thresholds a weight reaches."""
    return F.size(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= weight))


def percolation_levels(edges: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """(keys, threshold, giant, n_edges, n_components) at every threshold that any edge reaches.

    ``giant`` is the number of nodes of the largest component of the edges with
    a weight at or above the threshold; components of a single node count only
    if a loop touches them.
    """
    keys = list(keys)
    grid = sorted({float(t) for t in thresholds})
    edges = cut_lineage(edges.where(F.col("weight").isNotNull()).withColumn("_level", _level(F.col("weight"), grid)))
    sized = group_sizes(union_forest(edges, keys), keys).withColumn("_level", _level(F.col("weight"), grid)).where("_level > 0")
    sized = cut_lineage(sized)

    def events(df: DataFrame, **made: Column) -> DataFrame:
        names = ("giant", "edges", "nodes", "ties")
        return df.groupBy(*keys, "_level").agg(*[made.get(n, F.lit(0).cast("long")).alias(n) for n in names])

    # a node's own group grows by what hangs on it, heaviest first: one row per node and level
    hung = sized.groupBy(*keys, "parent", "_level").agg(F.sum("size").alias("size"))
    falling = Window.partitionBy(*keys, "parent").orderBy(F.desc("_level"))
    grown = hung.withColumn("size", 1 + F.sum("size").over(falling))
    one = F.lit(1).cast("long")
    ends = edges.select(*keys, F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"), "_level")
    first = ends.groupBy(*keys, "node").agg(F.max("_level").alias("_level"))
    parts = [
        events(grown, giant=F.max("size")),
        events(edges, edges=F.sum(one)),
        events(first, nodes=F.sum(one), giant=F.max(one)),
        events(sized, ties=F.sum(one)),
    ]
    total = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3]).where("_level > 0")
    per_level = total.groupBy(*keys, "_level").agg(F.max("giant").alias("giant"), *[F.sum(c).alias(c) for c in ("edges", "nodes", "ties")])
    # at most one row per threshold and graph from here on
    steps = per_level.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("_level"))))
    curve = steps.groupBy(*keys, "_k").agg(F.max("giant").alias("giant"), F.sum("edges").alias("n_edges"), (F.sum("nodes") - F.sum("ties")).alias("n_components"))
    at = F.get(F.array(*[F.lit(t) for t in grid]), F.col("_k") - 1)
    return curve.select(*keys, at.alias("threshold"), "giant", "n_edges", "n_components")
