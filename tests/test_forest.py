import random

import pytest

from panelwright.operators import forest, graph


def kruskal(edges):
    """Weights of a maximum spanning forest, by key."""
    out, up = {}, {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for key, a, b, w in sorted((e for e in edges if e[3] is not None), key=lambda e: -e[3]):
        ra, rb = root((key, a)), root((key, b))
        if ra != rb:
            up[ra] = rb
            out.setdefault(key, []).append(w)
    return {k: sorted(v) for k, v in out.items()}


def curve(edges, t):
    """Largest component, edges, components among the touched nodes."""
    kept = [e for e in edges if e[3] is not None and e[3] >= t]
    near = {}
    for _, a, b, _ in kept:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    seen, sizes = set(), []
    for start in near:
        if start in seen:
            continue
        todo, n = [start], 0
        seen.add(start)
        while todo:
            n += 1
            fresh = near[todo.pop()] - seen
            seen |= fresh
            todo += fresh
        sizes.append(n)
    return max(sizes, default=0), len(kept), len(sizes)


def some_edges(seed):
    rng = random.Random(seed)
    edges = [(k, f"n{rng.randint(0, 40)}", f"n{rng.randint(0, 40)}", rng.choice([0.1, 0.2, 0.5, rng.random()])) for k in (1, 2) for _ in range(60)]
    # a path whose weights rise, and one whose weights fall, end to end
    edges += [(3, f"p{i}", f"p{i + 1}", i / 50) for i in range(40)] + [(4, f"p{i}", f"p{i + 1}", 1 - i / 50) for i in range(40)]
    return edges + [(1, "loop", "loop", 0.9), (1, "n1", "n2", None)]


@pytest.mark.parametrize("seed", [1, 2])
def test_forest_has_the_weights_of_kruskal(frame, seed):
    edges = some_edges(seed)
    rows = forest.union_forest(frame(edges, "year int, src string, dst string, weight double"), ["year"]).collect()
    got = {}
    for r in rows:
        got.setdefault(r.year, []).append(r.weight)
    assert {k: sorted(v) for k, v in got.items()} == kruskal([e for e in edges if e[1] != e[2]])
    above = {(r.year, r.node): r for r in rows}
    assert len(above) == len(rows)
    real = {(k, min(a, b), max(a, b), w) for k, a, b, w in edges}
    for r in rows:
        assert (r.year, r.src, r.dst, r.weight) in real
        if (r.year, r.parent) in above:
            assert above[(r.year, r.parent)].weight < r.weight


@pytest.mark.parametrize("seed", [3])
def test_every_threshold_is_read_from_one_forest(frame, seed):
    edges = some_edges(seed)
    grid = [i / 40 for i in range(41)]
    rows = forest.percolation_levels(frame(edges, "year int, src string, dst string, weight double"), grid, ["year"]).collect()
    got = {(r.year, r.threshold): (r.giant, r.n_edges, r.n_components) for r in rows}
    for year in (1, 2, 3, 4):
        own = [e for e in edges if e[0] == year]
        for t in grid:
            assert got.get((year, t), (0, 0, 0)) == curve(own, t)


def test_a_hub_is_one_round(spark):
    from pyspark.sql import functions as F

    star = spark.range(20_000).select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"), (F.col("id") % 10 + 1.0).alias("weight"))
    rows = {r.threshold: (r.giant, r.n_components) for r in forest.percolation_levels(star, [1.0, 5.0, 10.0, 11.0]).collect()}
    assert rows == {1.0: (20_001, 1), 5.0: (12_001, 1), 10.0: (2_001, 1)}


def test_empty_graph(frame):
    none = frame([], "src string, dst string, weight double")
    assert forest.union_forest(none).collect() == []
    assert forest.percolation_levels(none, [0.5]).collect() == []
    assert graph.percolation_curve(none, [0.5]).collect() == []
