import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import similarity as sim


def vectors(cells):
    out = {}
    for n, f, x in cells:
        out.setdefault(n, {})[f] = x
    return out


def brute_pairs(cells, t):
    vs = vectors(cells)
    size = {n: math.sqrt(sum(x * x for x in v.values())) for n, v in vs.items()}
    out = {}
    for a in vs:
        for b in vs:
            if a < b and size[a] and size[b]:
                w = sum(x * vs[b].get(f, 0) for f, x in vs[a].items()) / size[a] / size[b]
                if w >= t:
                    out[(a, b)] = w
    return out


@pytest.mark.parametrize(("seed", "threshold"), [(1, 0.9), (2, 0.5), (3, 0.2), (4, 0.99)])
def test_cosine_pairs_equal_brute_force(frame, seed, threshold):
    rng = random.Random(seed)
    cells = []
    for n in range(90):
        for f in rng.sample(range(40), rng.randint(1, 12)):
            cells.append((f"n{n:02d}", f"f{min(f, 12)}_{f % 3}" if f > 12 else "common", rng.choice([1.0, 2.0, 9.0, -1.0, rng.random()])))
    cells = [(n, f, x) for (n, f), x in {(n, f): x for n, f, x in cells}.items()]
    cells += [("zero", "common", 0.0), ("twin1", "own", 3.0), ("twin2", "own", 5.0)]
    got = {(r.src, r.dst): r.weight for r in sim.cosine_pairs(frame(cells, "node string, f string, x double"), threshold).collect()}
    want = brute_pairs(cells, threshold)
    sure = {p for p, w in want.items() if w > threshold + 1e-9}
    assert sure <= set(got) <= set(want) | {p for p in got if abs(got[p] - threshold) < 1e-9}
    assert ("twin1", "twin2") in got
    assert all(abs(got[p] - want[p]) < 1e-9 for p in sure)


def test_a_hub_of_many_neighbours_makes_no_pairs(spark):
    n = 100_000
    own = spark.range(n).select(F.col("id").alias("node"), F.concat(F.lit("own"), (F.col("id") / 2).cast("long").cast("string")).alias("f"), F.lit(3.0).alias("x"))
    hub = spark.range(n).select(F.col("id").alias("node"), F.lit("hub").alias("f"), F.lit(1.0).alias("x"))
    cells = own.unionByName(hub)
    entries = sim.cut_lineage(sim.postings(sim.unit_cells(cells), 0.9))
    assert entries.where("f = 'hub'").count() == 0
    assert sim.candidates(entries, 0.9).count() == n // 2
    assert sim.cosine_pairs(cells, 0.9).agg(F.count("*").alias("n"), F.min("weight").alias("w")).first() == (n // 2, pytest.approx(1.0))


def test_entries_of_a_hub_meet_by_angle(spark):
    # everybody has most of its length on one of two rare features and the rest on the hub
    turn = lambda i: (i % 4) * 0.5 + 0.01
    rows = [(i, f"rare{i // 4}", math.cos(turn(i))) for i in range(400)] + [(i, "hub", math.sin(turn(i))) for i in range(400)]
    entries = sim.postings(spark.createDataFrame(rows, "node long, f string, x double"), 0.9)
    hub = entries.where("f = 'hub'").count()
    met = sim.candidates(entries, 0.9).count()
    assert hub < 400 and met < 400 * 399 // 2 / 3


def brute_nearest(points, k):
    out = {}
    for a, v in points:
        scored = sorted(((sum(x * y for x, y in zip(v, w, strict=True)), b) for b, w in points if b != a), reverse=True)[:k]
        out[a] = [b for _, b in scored]
    return out


def units(rng, n, dims, clusters):
    centres = rng.normal(size=(clusters, dims))
    x = centres[rng.integers(0, clusters, n)] + rng.normal(scale=0.1, size=(n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_nearest_equal_brute_force_with_ties_and_zeros(frame):
    rng = np.random.default_rng(3)
    x = units(rng, 120, 3, 4)
    points = [(f"p{i:03d}", v.tolist()) for i, v in enumerate(x)]
    points += [(f"twin{i}", points[0][1]) for i in range(6)] + [("zero1", [0.0] * 3), ("a-zero", [0.0] * 3)]
    got = {}
    for r in sim.nearest_by_cosine(frame(points, "node string, v array<double>"), 4).collect():
        got.setdefault(r.node, []).append((r.s, r.other))
    assert {n: [o for _, o in sorted(v, reverse=True)] for n, v in got.items()} == brute_nearest(points, 4)


def test_few_nodes_have_few_neighbours(frame):
    points = [("a", [1.0, 0.0]), ("b", [-1.0, 0.0]), ("z", [0.0, 0.0])]
    rows = {(r.node, r.other) for r in sim.nearest_by_cosine(frame(points, "node string, v array<double>"), 5).collect()}
    assert rows == {(a, b) for a in "abz" for b in "abz" if a != b}
    assert sim.nearest_by_cosine(frame([], "node string, v array<double>"), 3).collect() == []
    assert sim.nearest_by_cosine(frame(points[:1], "node string, v array<double>"), 3).collect() == []


def test_five_thousand_points_compare_less_than_a_tenth(spark):
    n, k = 5000, 4
    x = units(np.random.default_rng(9), n, 5, 60)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "node long, v array<double>")
    cells = sim.Cells.of(df, df.schema["node"].dataType, n)
    first = sim.cut_lineage(sim.within_blocks(cells, k, df.schema["node"].dataType))
    asked = sim.probes(first, cells, df.schema["node"].dataType)
    size = cells.blocks.select("cell", "chunk", F.size("members").alias("n"))
    own = size.agg(F.sum(F.col("n") * F.col("n"))).first()[0]
    beyond = asked.join(size, ["cell", "chunk"]).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    assert own + beyond + n * len(cells.pivots) < n * n / 10
    got = {}
    for r in sim.nearest_by_cosine(df, k).collect():
        got.setdefault(r.node, set()).add(r.other)
    scores = x @ x.T
    np.fill_diagonal(scores, -2)
    want = np.argsort(-scores, axis=1)[:, :k]
    assert all(got[i] == set(want[i].tolist()) for i in range(n))
