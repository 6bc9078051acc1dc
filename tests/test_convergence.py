"""Iterations run until they are done, and intermediate tables need no setting."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright import session
from panelwright.functions import ordered
from panelwright.operators import graph


def path(spark, n):
    return spark.createDataFrame([(f"n{i:03d}", f"n{i + 1:03d}", 1.0) for i in range(n - 1)], "src string, dst string, weight double")


def test_communities_of_a_long_path(spark):
    edges = path(spark, 32)
    found = session.cut_lineage(graph.communities(edges))
    score = graph.modularity(edges, found).first()
    assert found.count() == 32 and score.modularity >= 0.62 and score.n_communities <= 9


def test_eigenvector_of_a_path_is_exact(spark):
    n = 24
    got = {r.node: r.eigenvector for r in graph.eigenvector_centrality(path(spark, n)).collect()}
    want = np.sin(np.pi * np.arange(1, n + 1) / (n + 1))
    want /= np.linalg.norm(want)
    assert np.abs(np.array([got[f"n{i:03d}"] for i in range(n)]) - want).max() < 1e-6


def test_eigenvector_restarts_when_the_basis_is_small(spark):
    rng = np.random.default_rng(1)
    pairs = sorted({tuple(sorted(p)) for p in rng.integers(0, 14, (40, 2)).tolist() if p[0] != p[1]})
    edges = spark.createDataFrame([(a, b, 1.0 + (a + b) % 3) for a, b in pairs], "src long, dst long, weight double")
    got = {r.node: r.eigenvector for r in graph.eigenvector_centrality(edges, basis=6).collect()}
    dense = np.zeros((14, 14))
    for a, b in pairs:
        dense[a, b] = dense[b, a] = 1.0 + (a + b) % 3
    want = np.abs(np.linalg.eigh(dense)[1][:, -1])
    assert max(abs(got[k] - want[k]) for k in got) < 1e-6
    assert graph.eigenvector_centrality(edges.limit(0)).count() == 0


@pytest.mark.parametrize("weight", [0.0, -1.0, None])
def test_betweenness_refuses_distances_without_a_shortest_path(spark, weight):
    edges = spark.createDataFrame([("a", "b", weight), ("b", "c", 1.0)], "src string, dst string, weight double")
    with pytest.raises(ValueError):
        graph.betweenness(edges)


def test_ordered_sums_keep_null_keys(spark):
    df = spark.createDataFrame([(None, 1, 2.0), (None, 2, 3.0), ("a", 1, 5.0)], "k string, v int, x double")
    got = {(r.k, r.v): r.s for r in ordered.prefix_sums(df, ["k"], "v", {"s": "x"}, 4).collect()}
    assert got == {(None, 1): 2.0, (None, 2): 5.0, ("a", 1): 5.0}


def test_tables_without_a_configured_folder(spark, monkeypatch):
    class Unset:
        def get(self, key, default=None):
            return default

        def getConf(self):
            return self

    context = spark.sparkContext
    fake = type("S", (), {"conf": Unset(), "sparkContext": type("C", (), {"getConf": lambda s: Unset(), "master": "local[2]", "applicationId": "app-x"})()})()
    folder = session.shared_folder(fake)
    assert os.path.isdir(folder) and session.shared_folder(fake) == folder
    fake.sparkContext.__class__.master = "spark://somewhere"
    with pytest.raises(RuntimeError):
        session.shared_folder(fake)
    kept = session.cut_lineage(spark.range(5))
    assert kept.agg(F.sum("id")).first()[0] == 10 and context.applicationId in kept.inputFiles()[0]
    session.drop_table(kept)
    with pytest.raises(ValueError):
        session.drop_table(spark.read.parquet("/root/testdata/sf0.001/region.parquet"))
