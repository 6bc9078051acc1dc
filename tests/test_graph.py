import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.catalog import graph_queries
from panelwright.operators import graph

CLUSTERS = [("A", "S1", 50, 1), ("A", "S2", 40, 1), ("B", "S1", 45, 1), ("B", "S2", 30, 1), ("C", "S3", 60, 1),
            ("C", "S4", 50, 1), ("D", "S3", 40, 1), ("D", "S4", 70, 1), ("A", "S3", 1, 1)]
SCHEMA = "maker string, state_code string, regs int, year int"


def line(frame, n):
    return frame([(f"n{i:02d}", f"n{i + 1:02d}") for i in range(n - 1)], "state_a string, state_b string")


def test_two_planted_clusters(frame):
    edges = graph.bipartite_edges(frame(CLUSTERS, SCHEMA), min_weight=5)
    assert graph.node_table(edges).count() == 8
    groups = graph.communities(edges)
    sides = {}
    for r in groups.collect():
        sides.setdefault(r.community, set()).add(r.node)
    assert sorted(map(sorted, sides.values())) == [["A", "B", "S1", "S2"], ["C", "D", "S3", "S4"]]
    assert graph.modularity(edges, groups).first().modularity > 0.4
    assert graph.share_edges(frame(CLUSTERS, SCHEMA), min_share=0.05).where("src = 'A' and dst = 'S3'").count() == 0


def test_summary_flow_and_births(frame):
    df = frame(CLUSTERS, SCHEMA)
    edges = graph.bipartite_edges(df)
    members = frame([(n, "x") for n in ("A", "B", "S1", "S2")] + [(n, "y") for n in ("C", "D", "S3", "S4")], "node string, community string")
    rows = {r.community: r for r in graph.community_summary(edges, graph.node_table(edges), members).collect()}
    assert rows["x"].oems == "A, B" and rows["x"].internal_weight == 165 and rows["x"].cross_weight == 1
    cross = graph.cross_community_edges(edges, members)
    assert [(r.oem, r.state) for r in cross.collect()] == [("A", "S3")]
    matrix = {r.community: (r.x, r.y) for r in graph.community_flow_matrix(cross, ["x", "y"]).collect()}
    assert matrix == {"x": (0.0, 1.0), "y": (0.0, 0.0)}
    later = graph.bipartite_edges(frame([*CLUSTERS, ("B", "S3", 20, 1)], SCHEMA))
    born = graph.edge_changes(edges, later).where("status = 'born'").collect()
    assert [(r.node_a, r.node_b, r.after) for r in born] == [("B", "S3", 20.0)]


def test_projection_and_similarity_against_brute_force(frame, monkeypatch):
    monkeypatch.setattr(graph, "BLOCK", 3)
    rng = np.random.default_rng(0)
    mat = rng.integers(0, 4, (10, 8))
    df = frame([(f"m{j}", f"s{i}", int(mat[i, j]), 1) for i in range(10) for j in range(8) if mat[i, j]], SCHEMA)
    got = {(r.src, r.dst): r.weight for r in graph.project(graph.bipartite_edges(df)).collect()}
    sims = {(r.src, r.dst): r.weight for r in graph.similarity_edges(df, min_similarity=0.6).collect()}
    for i in range(10):
        for j in range(i + 1, 10):
            shared = int(((mat[i] > 0) & (mat[j] > 0)).sum())
            assert got.get((f"s{i}", f"s{j}"), 0) == shared
            cos = mat[i] @ mat[j] / (np.linalg.norm(mat[i]) * np.linalg.norm(mat[j]))
            if abs(cos - 0.6) > 1e-9:
                assert ((f"s{i}", f"s{j}") in sims) == (cos > 0.6)


def test_economic_groups(frame):
    rows = [(f"r{i}", 10.0 + 0.1 * i, 80.0 + i) for i in range(3)] + [(f"p{i}", 1.0 + 0.1 * i, 20.0 + i) for i in range(3)]
    edges = graph.economic_similarity_edges(frame(rows, "state string, income double, urban double"), "state", ["income", "urban"], 2)
    assert all(r.src[0] == r.dst[0] for r in edges.collect())


def test_planted_comovement(frame):
    rng = np.random.default_rng(3)
    walk = np.cumsum(rng.normal(0, 1, 14))
    cols = {"A": walk + rng.normal(0, 0.05, 14), "B": walk + rng.normal(0, 0.05, 14)}
    cols |= {f"X{i}": np.cumsum(rng.normal(0, 1, 14)) for i in range(4)}
    df = frame([(k, 2000 + t, float(v[t])) for k, v in cols.items() for t in range(14)], "node string, year int, v double")
    edges = {(r.src, r.dst): r for r in graph.coadoption_edges(df, "node", "year", "v").collect()}
    assert ("A", "B") in edges and edges[("A", "B")].weight > 0.9


def test_cascades_on_a_line(frame):
    near = graph.adjacency_list(line(frame, 6))
    seeds = frame([("n00", 0.5), ("n00", 0.9)], "node string, tau double")
    steps = {}
    for r in graph.threshold_cascade(near, seeds).collect():
        steps.setdefault(r.tau, {})[r.node] = r.step
    assert steps[0.5] == {f"n{i:02d}": i for i in range(6)}
    assert steps[0.9] == {"n00": 0}
    years = frame([(f"n{i:02d}", 2014 + i) for i in range(6)], "node string, year int")
    rows = {r.tau: r for r in graph.fit_tau(near, years, [0.5, 0.9], n_seeds=1).collect()}
    assert rows[0.5].spearman_rho > 0.95 and rows[0.5].cascade_size == 6 and rows[0.9].cascade_size == 1
    reach = {r.seed: r.cascade_size for r in graph.seed_influence(near, 0.5).collect()}
    assert reach["n00"] == 6


def test_moran_on_a_clustered_line(frame):
    near = graph.adjacency_list(line(frame, 20))
    values = frame([(f"n{i:02d}", 1.0 if i < 10 else 0.0) for i in range(20)], "node string, value double")
    out = graph.morans_i(values, near, permutations=199).first()
    assert out.moran_i > 0.5 and out.p_value < 0.05 and out.n == 20
    assert out.expected_i == pytest.approx(-1 / 19)


def brandes(adj):
    """Plain shortest-path betweenness of a small unweighted graph."""
    out = dict.fromkeys(adj, 0.0)
    for s in adj:
        dist, sigma, order, queue = {s: 0}, dict.fromkeys(adj, 0.0), [], [s]
        sigma[s] = 1.0
        while queue:
            v = queue.pop(0)
            order.append(v)
            for w in adj[v]:
                if w not in dist:
                    dist[w] = dist[v] + 1
                    queue.append(w)
                if dist[w] == dist[v] + 1:
                    sigma[w] += sigma[v]
        delta = dict.fromkeys(adj, 0.0)
        for w in reversed(order):
            for v in adj[w]:
                if dist[v] == dist[w] - 1:
                    delta[v] += sigma[v] / sigma[w] * (1 + delta[w])
            if w != s:
                out[w] += delta[w]
    n = len(adj)
    return {k: v / ((n - 1) * (n - 2)) for k, v in out.items()}


def test_betweenness_against_brute_force(frame):
    pairs = [("a", "b"), ("b", "c"), ("c", "d"), ("d", "a"), ("c", "e"), ("e", "f"), ("b", "f")]
    adj = {}
    for u, v in pairs:
        adj.setdefault(u, []).append(v)
        adj.setdefault(v, []).append(u)
    want = brandes(adj)
    edges = frame([(u, v, 1.0) for u, v in pairs], "src string, dst string, weight double")
    got = {r.node: r.betweenness for r in graph.betweenness(edges).collect()}
    assert got == pytest.approx(want)


def all_pairs(edges):
    """Betweenness from all distances and path counts, in whole numbers as weights."""
    nodes = sorted({x for a, b, _ in edges for x in (a, b)})
    far = {(a, b): 0 if a == b else 10**9 for a in nodes for b in nodes}
    near = [(a, b, w) for a, b, w in edges] + [(b, a, w) for a, b, w in edges]
    for a, b, w in near:
        far[a, b] = min(far[a, b], w) if a != b else 0
    for k in nodes:
        for a in nodes:
            for b in nodes:
                far[a, b] = min(far[a, b], far[a, k] + far[k, b])
    paths = {}
    for s in nodes:
        for v in sorted(nodes, key=lambda v: far[s, v]):
            paths[s, v] = 1 if v == s else sum(paths[s, a] for a, b, w in near if b == v and a != v and far[s, a] + w == far[s, v] and far[s, v] < 10**9)
    n = len(nodes)
    return {
        v: sum(paths[s, v] * paths[v, t] / paths[s, t] for s in nodes for t in nodes if len({s, v, t}) == 3 and far[s, t] < 10**9 and far[s, v] + far[v, t] == far[s, t]) / ((n - 1) * (n - 2))
        for v in nodes
    }


@pytest.mark.parametrize("batch_rows", [10**6, 700])
def test_weighted_betweenness_in_batches(frame, batch_rows):
    import random

    rng = random.Random(5)
    edges = list({(min(a, b), max(a, b)): (f"n{min(a, b)}", f"n{max(a, b)}", rng.randint(1, 4)) for a, b in ((rng.randint(0, 24), rng.randint(0, 24)) for _ in range(45)) if a != b}.values())
    edges += [("x", "y", 2), ("y", "z", 2), ("x", "w", 1), ("w", "z", 3)]  # another component with two equal ways
    got = {r.node: r.betweenness for r in graph.betweenness(frame([(a, b, float(w)) for a, b, w in edges], "src string, dst string, weight double"), batch_rows).collect()}
    assert got == pytest.approx(all_pairs(edges))


def test_eigenvector_against_numpy(frame):
    rng = np.random.default_rng(1)
    w = rng.random((4, 3)) + 0.1
    edges = frame([(f"m{i}", f"s{j}", float(w[i, j])) for i in range(4) for j in range(3)], "src string, dst string, weight double")
    a = np.zeros((7, 7))
    a[:4, 4:] = w
    a += a.T
    vec = np.abs(np.linalg.eigh(a)[1][:, -1])
    got = {r.node: r.eigenvector for r in graph.eigenvector_centrality(edges).collect()}
    names = [f"m{i}" for i in range(4)] + [f"s{j}" for j in range(3)]
    assert [got[n] for n in names] == pytest.approx(vec, abs=1e-5)


def test_percolation_falls(frame):
    rng = np.random.default_rng(7)
    shares = rng.dirichlet([0.4] * 10, 20)
    df = frame([(f"m{j}", f"s{i}", float(1000 * shares[i, j])) for i in range(20) for j in range(10)],
               "maker string, state_code string, regs double")
    curve = sorted(graph.percolation_curve(graph.share_edges(df, min_share=0.0), [0.0001, 0.01, 0.1, 0.3, 0.6, 0.9]).collect(), key=lambda r: r.threshold)
    sizes = [r.giant_frac for r in curve]
    assert sizes[0] > 0.95 and sizes[-1] < 0.5 and sizes == sorted(sizes, reverse=True)


def test_rewiring_keeps_degrees_and_moves_edges(frame):
    edges = graph.as_edges(line(frame, 16))
    copies = graph.rewire(edges.select("src", "dst"), 5, rounds=4)
    want = {r.node: r.degree for r in graph.degree_strength(edges).collect()}
    weighted = copies.withColumn("weight", F.lit(1.0))
    got = {}
    for r in graph.degree_strength(weighted, ["replicate"]).collect():
        got.setdefault(r.replicate, {})[r.node] = r.degree
    assert all(d == want for d in got.values()) and len(got) == 5
    assert copies.count() == copies.distinct().count() == 75
    kept = copies.join(edges.select("src", "dst"), ["src", "dst"], "left_semi").count()
    assert kept < 60


def test_true_network_wins_and_beats_rewiring(frame):
    edges = graph.as_edges(line(frame, 16))
    years = frame([(f"n{i:02d}", 2010 + i) for i in range(16)], "node string, year int")
    rng = np.random.default_rng(13)
    order = rng.permutation(16)
    fake = frame([(f"n{order[i]:02d}", f"n{order[i + 1]:02d}") for i in range(15)], "state_a string, state_b string")
    both = edges.withColumn("network", F.lit("true")).unionByName(graph.as_edges(fake).withColumn("network", F.lit("fake")))
    race = {r.network: r for r in graph.horserace(both, years).collect()}
    assert race["true"].mae_years < race["fake"].mae_years and race["true"].n_edges == 15
    held = {r.network: r for r in graph.holdout_horserace(both, years, 2017).collect()}
    assert held["true"].n_train_adopters == 8
    out = graph.rewiring_null_test(edges, years, replicates=30, rounds=5).first()
    assert out.p_value < 0.1 and out.n_null == 30


def test_shift_test_equals_one_pair_at_a_time():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(5, 20))
    y = np.vstack([x[:2] + rng.normal(size=(2, 20)) * 0.1, rng.normal(size=(2, 20)), np.full((1, 20), 0.3)])
    x[0, 3:9], y[2, 5], x[4, 2:18] = np.nan, np.nan, np.nan

    def corr(a, b):
        both = np.isfinite(a) & np.isfinite(b)
        if both.sum() < 5 or np.ptp(a[both]) == 0 or np.ptp(b[both]) == 0:
            return np.nan
        return np.corrcoef(a[both], b[both])[0, 1]

    r, part = graph.shift_test(x, y, 5)
    for i in range(5):
        for j in range(5):
            want = corr(x[i], y[j])
            null = np.array([corr(x[i], np.roll(y[j], s)) for s in range(1, 19)])
            null = null[np.isfinite(null)]
            assert r[i, j] == pytest.approx(want, nan_ok=True)
            if np.isfinite(want):
                assert part[i, j] == pytest.approx((abs(null) >= abs(want)).mean())


def test_coadoption_over_several_tiles(frame, monkeypatch):
    monkeypatch.setattr(graph, "TILE_BITS", 2)
    rng = np.random.default_rng(7)
    shape = rng.normal(size=(3, 60)).cumsum(1)
    rows = [(f"n{i:02d}", t, float(shape[i % 3, t] + rng.normal() * 0.02)) for i in range(18) for t in range(60) if (i + t) % 17]
    edges = graph.coadoption_edges(frame(rows, "state string, t int, share double"), "state", "t", "share").collect()
    got = {(r.src, r.dst) for r in edges}
    assert {(f"n{i:02d}", f"n{j:02d}") for i in range(18) for j in range(i + 1, 18) if i % 3 == j % 3} <= got
    assert all(r.src < r.dst and 0 < r.weight <= 1 and r.p_value <= 0.05 for r in edges) and len(got) < 18 * 17 // 2
    assert graph.coadoption_edges(frame([], "state string, t int, share double"), "state", "t", "share").collect() == []


def test_rewiring_does_not_depend_on_the_number_of_ranges(frame, monkeypatch):
    import random

    rng = random.Random(2)
    edges = frame([(min(a, b), max(a, b)) for a, b in {tuple(sorted(rng.sample(range(30), 2))) for _ in range(90)}], "src long, dst long")
    plain = {tuple(r) for r in graph.rewire(edges, 2, 3).collect()}
    whole = graph.hash_positions
    monkeypatch.setattr(graph, "hash_positions", lambda df, keys, value, tie, out, buckets: whole(df, keys, value, tie, out, 7))
    assert {tuple(r) for r in graph.rewire(edges, 2, 3).collect()} == plain


def test_horserace_queries_leave_out_networks_that_predict_nothing(frame, monkeypatch):
    edges = [("near", "a", "b", 1.0), ("near", "b", "c", 1.0), ("far", "x", "y", 1.0)]
    years = [("a", 1996), ("b", 1998)]
    monkeypatch.setattr(graph_queries, "networks", lambda m: frame(edges, "network string, src string, dst string, weight double"))
    monkeypatch.setattr(graph_queries, "adoption", lambda m: frame(years, "node string, year int"))
    (row,) = graph_queries.horserace(None).collect()
    assert (row.network, row.n_predicted, row.n_edges, row.mae_years) == ("near", 2, 2, 2.0)
    assert row.spearman == pytest.approx(-1.0)
    (row,) = graph_queries.holdout(None).collect()
    assert (row.network, row.n_test, row.mae_years, row.n_train_adopters) == ("near", 1, None, 1)
    monkeypatch.setattr(graph_queries, "adoption", lambda m: frame([], "node string, year int"))
    assert graph_queries.horserace(None).count() == graph_queries.holdout(None).count() == 0
