"""Graphs as edge tables: building, projection, metrics, spreading, network races.

An edge table has (src, dst, weight) with each undirected edge once, and any
number of key columns in front (period, threshold, tau, seed, replicate), so
many graphs run in one job.  Iterative operators keep their edges in one
reliable checkpoint and cut the lineage of the moving frame every round.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.columns import ratio
from panelwright.functions.ordered import average_ranks, hash_positions
from panelwright.operators.forest import percolation_levels
from panelwright.operators.similarity import cosine_pairs, nearest_by_cosine
from panelwright.session import cut_lineage, drop_table


def symmetrised(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Both directions of every edge."""
    rest = [c for c in edges.columns if c not in ("src", "dst", *keys)]
    flipped = edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), *rest)
    return edges.select(*keys, "src", "dst", *rest).unionByName(flipped)


def adjacency_list(pairs: DataFrame, a: str = "state_a", b: str = "state_b") -> DataFrame:
    """Directed neighbour list of an undirected pair table, without loops or duplicates."""
    one = pairs.select(F.col(a).alias("src"), F.col(b).alias("dst")).where(F.col(a) != F.col(b))
    return symmetrised(one).dropDuplicates(["src", "dst"])


def as_edges(pairs: DataFrame, a: str = "state_a", b: str = "state_b") -> DataFrame:
    """Unit-weight edge table with ordered ends."""
    return (
        pairs.where(F.col(a) != F.col(b))
        .select(F.least(a, b).alias("src"), F.greatest(a, b).alias("dst"))
        .distinct()
        .withColumn("weight", F.lit(1.0))
    )


def bipartite_edges(
    df: DataFrame, keys: Sequence[str] = (), region: str = "state_code", maker: str = "maker",
    weight: str = "regs", min_weight: float = 0,
) -> DataFrame:
    """Maker to state edges with summed weight above the minimum."""
    return (
        df.groupBy(*keys, F.col(maker).alias("src"), F.col(region).alias("dst"))
        .agg(F.sum(weight).cast("double").alias("weight"))
        .where(F.col("weight") > min_weight)
    )


def share_edges(
    df: DataFrame, keys: Sequence[str] = (), region: str = "state_code", maker: str = "maker",
    weight: str = "regs", min_share: float = 0.005,
) -> DataFrame:
    """Edges weighted by the share within the state, at or above the minimum share."""
    cell = bipartite_edges(df, keys, region, maker, weight, float("-inf"))
    whole = F.sum("weight").over(Window.partitionBy(*keys, "dst"))
    return cell.withColumn("weight", ratio("weight", whole)).where(F.col("weight") >= min_share)


def node_table(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Nodes of a maker-state edge table with their kind."""
    makers = edges.select(*keys, F.col("src").alias("node"), F.lit("oem").alias("kind"))
    states = edges.select(*keys, F.col("dst").alias("node"), F.lit("state").alias("kind"))
    return makers.unionByName(states).distinct()


def project(edges: DataFrame, side: str = "dst", keys: Sequence[str] = ()) -> DataFrame:
    """One-mode projection weighted by the number of shared neighbours.

    Every two nodes of a neighbour are a pair of the result, so nodes meet by
    neighbour; meetings are counted before the shuffle and after it, and a
    neighbour of many is split where it is joined.
    """
    other = "src" if side == "dst" else "dst"
    ends = cut_lineage(edges.select(*keys, F.col(side).alias("node"), F.col(other).alias("_by")).distinct())
    met = ends.withColumnRenamed("node", "src").join(ends.withColumnRenamed("node", "dst"), [*keys, "_by"]).where("src < dst")
    return met.groupBy(*keys, "src", "dst").agg(F.count(F.lit(1)).cast("double").alias("weight"))


def similarity_edges(
    df: DataFrame, region: str = "state_code", maker: str = "maker", weight: str = "regs",
    min_similarity: float = 0.5,
) -> DataFrame:
    """Pairs of states whose maker mixes have cosine similarity at or above the minimum."""
    cell = df.groupBy(F.col(region).alias("node"), F.col(maker).alias("f")).agg(
        F.sum(weight).cast("double").alias("x")
    )
    return cosine_pairs(cell, min_similarity)


def economic_similarity_edges(
    features: DataFrame, node: str, columns: Sequence[str], k: int = 4
) -> DataFrame:
    """k nearest neighbours by cosine of z-scored covariates; either end may pick the edge.

    Nulls take the column median.  The search looks beyond a state's own cell
    only where another can hold a nearer one.
    """
    stats = features.agg(
        *[F.percentile(F.col(c).cast("double"), F.lit(0.5)).alias(f"_m_{c}") for c in columns]
    ).withColumn("_one", F.lit(1))
    filled = features.withColumn("_one", F.lit(1)).join(stats, "_one").select(
        F.col(node).alias("node"),
        "_one",
        *[F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")).alias(c) for c in columns],
    )
    spread = filled.groupBy("_one").agg(
        *[F.avg(c).alias(f"_a_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns]
    )
    z = filled.join(spread, "_one").select(
        "node",
        F.array(
            *[
                (F.col(c) - F.col(f"_a_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(1.0)
                for c in columns
            ]
        ).alias("z"),
    )

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    length = F.sqrt(dot(F.col("z"), F.col("z")))
    unit = z.select(
        "node", F.transform("z", lambda v: v / F.when(length == 0, 1.0).otherwise(length)).alias("v")
    )
    picked = nearest_by_cosine(unit, k)
    return picked.groupBy(
        F.least("node", "other").alias("src"), F.greatest("node", "other").alias("dst")
    ).agg(F.max("s").alias("weight"))


def coadoption_edges(
    df: DataFrame, node: str, order: str, value: str, alpha: float = 0.05, draws: int = 500,
    min_points: int = 6, min_pairs: int = 5,
) -> DataFrame:
    """Pairs of states whose share changes move together beyond a circular-shift null.

    With t changes only t - 2 shifts exist, so all are scored instead of drawn:
    p = (f N + 1) / (N + 1), f the part of shifts with |r| at least as large and
    N the stated number of draws; of a pair the larger id is shifted.  Nodes lie
    in tiles in the order of their ids, and a row scores one tile against
    another: matrix products of values, squares and masks give the sums over
    the periods that both nodes have, for all pairs of the two tiles at once and
    one shift after the other.
    """
    w = Window.partitionBy(node).orderBy(order)
    moved = df.select(
        F.col(node).alias("node"),
        F.col(order).alias("t"),
        (F.col(value) - F.lag(value).over(w)).cast("double").alias("d"),
        F.lag(order).over(w).alias("_pt"),
    ).where(F.col("d").isNotNull() & (F.col("t") - F.col("_pt") == 1))
    moved = cut_lineage(moved.select("node", "t", "d"))
    span = moved.agg(F.min("t"), F.max("t")).first()
    node_type = moved.schema["node"].dataType
    schema = T.StructType([T.StructField("src", node_type), T.StructField("dst", node_type), T.StructField("weight", T.DoubleType()), T.StructField("p_value", T.DoubleType())])
    if span[0] is None:
        return df.sparkSession.createDataFrame([], schema)
    size = span[1] - span[0] + 1
    filled = F.map_from_entries(F.collect_list(F.struct("t", "d")))
    calendar = F.sequence(F.lit(span[0]), F.lit(span[1]))
    arrays = moved.groupBy("node").agg(filled.alias("_m"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_points)
    values = F.transform(calendar, lambda t: F.coalesce(F.try_element_at("_m", t), F.lit(float("nan"))))
    # the rows of a sorted partition are numbered on, so a tile's ids all come before the next tile's
    ordered = arrays.select("node", values.alias("v")).orderBy("node").withColumn("_at", F.monotonically_increasing_id())
    tiled = cut_lineage(ordered.withColumn("_tile", F.shiftright("_at", TILE_BITS)))
    numbers = tiled.select("_tile").distinct().withColumn("_all", F.lit(1))
    numbers = cut_lineage(numbers.select("_tile", F.row_number().over(Window.partitionBy("_all").orderBy("_tile")).alias("tile")))  # a row per tile
    tiles = cut_lineage(tiled.join(numbers, "_tile").groupBy("tile").agg(F.sort_array(F.collect_list(F.struct("node", "v"))).alias("members")))
    n_tiles = numbers.count()
    pairs = tiles.select(F.col("members").alias("first"), "tile", F.explode(F.sequence("tile", F.lit(n_tiles))).alias("_with"))
    met = pairs.join(tiles.select(F.col("tile").alias("_with"), F.col("members").alias("second")), "_with")

    def run(batches):
        for batch in batches:
            rows = zip(batch.column("tile").to_pylist(), batch.column("_with").to_pylist(), tile_members(batch.column("first")), tile_members(batch.column("second")), strict=True)
            for a, b, (src, x), (dst, y) in rows:
                r, part = shift_test(x.reshape(-1, size), y.reshape(-1, size), min_pairs)
                p = (part * draws + 1) / (draws + 1)
                keep = (r > 0) & (p <= alpha)
                if a == b:
                    keep &= np.triu(np.ones(keep.shape, bool), 1)
                i, j = np.nonzero(keep)
                yield pa.RecordBatch.from_arrays([src.take(pa.array(i)), dst.take(pa.array(j)), pa.array(r[i, j]), pa.array(p[i, j])], names=schema.names)

    return met.select("tile", "_with", "first", "second").mapInArrow(run, schema)


#: A tile has up to 2 to this power nodes.
TILE_BITS = 7


def tile_members(column: pa.ListArray):
    """Ids and values of each row's members."""
    at = column.offsets.to_numpy(zero_copy_only=False)
    for a, b in zip(at[:-1], at[1:], strict=True):
        node, values = column.values.slice(a, b - a).flatten()
        ends = values.offsets.to_numpy(zero_copy_only=False)
        yield node, values.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]


def shift_test(x: np.ndarray, y: np.ndarray, min_pairs: int) -> tuple[np.ndarray, np.ndarray]:
    """Correlations of the rows of x with those of y, and the part of the circular shifts of y at least as large in size.

    Missing values are not numbers; a correlation needs ``min_pairs`` common
    periods and some spread.  Without a scored shift the part is not a number.
    """
    kx, ky = np.isfinite(x), np.isfinite(y)
    x, y = np.where(kx, x, 0.0), np.where(ky, y, 0.0)
    kx = kx.astype(float)

    def correlations(shift: int) -> np.ndarray:
        k, v = np.roll(ky, shift, 1).astype(float).T, np.roll(y, shift, 1).T
        n, sx, sy = kx @ k, x @ k, kx @ v
        spread_x, spread_y = (x * x) @ k * n - sx * sx, kx @ (v * v) * n - sy * sy
        known = (n >= min_pairs) & (spread_x > 1e-12 * n * ((x * x) @ k)) & (spread_y > 1e-12 * n * (kx @ (v * v)))
        with np.errstate(invalid="ignore", divide="ignore"):
            return np.where(known, ((x @ v) * n - sx * sy) / np.sqrt(spread_x * spread_y), np.nan)

    seen = correlations(0)
    scored, beyond = np.zeros(seen.shape), np.zeros(seen.shape)
    for shift in range(1, x.shape[1] - 1):
        r = correlations(shift)
        scored += np.isfinite(r)
        beyond += np.abs(r) >= np.abs(seen) - 1e-12
    with np.errstate(invalid="ignore", divide="ignore"):
        return seen, np.where(scored > 0, beyond / scored, np.nan)


# -------------------------------------------------------------------- races on timing


def predict_years(edges: DataFrame, years: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Weighted mean of the neighbours' years for each node with a known year."""
    known = years.select(F.col("node").alias("dst"), F.col("year").alias("_y"))
    pairs = symmetrised(edges, keys).join(known, "dst")
    w = F.coalesce(F.col("weight"), F.lit(1.0))
    means = pairs.groupBy(*keys, "src").agg(
        ratio(F.sum(w * F.col("_y")), F.sum(w)).alias("predicted_year")
    )
    return means.withColumnRenamed("src", "node").join(
        years.select("node", F.col("year").alias("observed_year")), "node"
    )


def horserace(edges: DataFrame, years: DataFrame, min_nodes: int = 5) -> DataFrame:
    """MAE and rank correlation per ``network`` of the leave-one-out prediction."""
    predicted = cut_lineage(predict_years(edges, years, ["network"]))
    long = predicted.select(
        "network", F.explode(F.array(
            F.struct(F.lit("o").alias("side"), F.col("observed_year").cast("double").alias("v")),
            F.struct(F.lit("p").alias("side"), F.col("predicted_year").alias("v")),
        )).alias("s")
    ).select("network", "s.*")
    ranks = average_ranks(long, ["network", "side"], "v")
    observed = ranks.where(F.col("side") == "o").select("network", F.col("v").alias("_ov"), F.col("rank").alias("_or"))
    guess = ranks.where(F.col("side") == "p").select("network", F.col("v").alias("_pv"), F.col("rank").alias("_pr"))
    ranked = (
        predicted.withColumn("_ov", F.col("observed_year").cast("double"))
        .withColumn("_pv", F.col("predicted_year"))
        .join(observed, ["network", "_ov"])
        .join(guess, ["network", "_pv"])
    )
    enough = F.count(F.lit(1)) >= min_nodes
    scores = ranked.groupBy("network").agg(
        F.count(F.lit(1)).alias("n_predicted"),
        F.when(enough, F.avg(F.abs(F.col("_pv") - F.col("_ov")))).alias("mae_years"),
        F.when(enough, F.corr("_or", "_pr")).alias("spearman"),
    )
    sizes = edges.groupBy("network").agg(F.count(F.lit(1)).alias("n_edges"))
    return sizes.join(scores, "network", "left")


def holdout_horserace(
    edges: DataFrame, years: DataFrame, split_year: int, min_nodes: int = 3
) -> DataFrame:
    """Neighbours at or before the split predict nodes after it."""
    train = years.where(F.col("year") <= split_year)
    test = years.where(F.col("year") > split_year)
    known = train.select(F.col("node").alias("dst"), F.col("year").alias("_y"))
    w = F.coalesce(F.col("weight"), F.lit(1.0))
    predicted = (
        symmetrised(edges, ["network"])
        .join(known, "dst")
        .groupBy("network", "src")
        .agg(ratio(F.sum(w * F.col("_y")), F.sum(w)).alias("_p"))
        .join(test.select(F.col("node").alias("src"), "year"), "src")
    )
    enough = F.count(F.lit(1)) >= min_nodes
    scores = predicted.groupBy("network").agg(
        F.count(F.lit(1)).alias("n_test"),
        F.when(enough, F.avg(F.abs(F.col("_p") - F.col("year")))).alias("mae_years"),
    )
    adopters = train.agg(F.count(F.lit(1)).alias("n_train_adopters")).withColumn("_one", F.lit(1))
    return (
        edges.select("network").distinct().join(scores, "network", "left")
        .fillna(0, ["n_test"])
        .withColumn("_one", F.lit(1))
        .join(adopters, "_one")
        .drop("_one")
    )


def rewire(edges: DataFrame, replicates: int, rounds: int = 12, seed: int = 42) -> DataFrame:
    """Degree-preserving double-edge swaps, many replicates at once.

    Each round puts the edges of a replicate in one hash order, pairs neighbours
    in that order, and proposes one swap per pair; how many ranges the order is
    numbered in changes no pair.  Proposals
    that make a loop, repeat an existing edge or collide with another proposal
    are dropped, so degrees never change.
    """
    base = edges.select("src", "dst").distinct()
    state = cut_lineage(
        base.select(F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"), "src", "dst")
    )
    buckets = max(1, base.count() // 4096)
    for i in range(rounds):
        h = F.xxhash64(F.lit(seed + i), "replicate", "src", "dst")
        placed = hash_positions(state.withColumn("_edge", F.struct("src", "dst")), ["replicate"], h, "_edge", "_at", buckets)
        numbered = placed.withColumn("_pair", F.floor((F.col("_at") - 1) / 2))
        # Orientation of the second edge is a coin from its hash.
        coin = F.pmod(F.shiftright(h, 7), F.lit(2)) == 0
        one = numbered.where(F.col("_at") % 2 == 1).select("replicate", "_pair", "src", "dst")
        two = numbered.where(F.col("_at") % 2 == 0).select(
            "replicate", "_pair",
            F.when(coin, F.col("src")).otherwise(F.col("dst")).alias("u"),
            F.when(coin, F.col("dst")).otherwise(F.col("src")).alias("v"),
        )
        proposal = one.join(two, ["replicate", "_pair"]).select(
            "replicate",
            F.struct("src", "dst").alias("old1"),
            F.struct(F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).alias("old2"),
            F.struct(F.least("src", "v").alias("src"), F.greatest("src", "v").alias("dst")).alias("new1"),
            F.struct(F.least("u", "dst").alias("src"), F.greatest("u", "dst").alias("dst")).alias("new2"),
        ).where(
            (F.col("new1.src") != F.col("new1.dst")) & (F.col("new2.src") != F.col("new2.dst"))
            & (F.col("new1") != F.col("new2"))
        ).withColumn("_id", F.xxhash64("replicate", "old1", "old2"))
        wanted = proposal.select("replicate", "_id", F.explode(F.array("new1", "new2")).alias("e")).select(
            "replicate", "_id", "e.*"
        )
        taken = wanted.join(state, ["replicate", "src", "dst"], "left_semi").select("replicate", "_id")
        clash = wanted.withColumn(
            "_first", F.min("_id").over(Window.partitionBy("replicate", "src", "dst"))
        ).where(F.col("_first") != F.col("_id")).select("replicate", "_id")
        accepted = proposal.join(taken.unionByName(clash).distinct(), ["replicate", "_id"], "left_anti")
        gone = accepted.select("replicate", F.explode(F.array("old1", "old2")).alias("e")).select("replicate", "e.*")
        born = accepted.select("replicate", F.explode(F.array("new1", "new2")).alias("e")).select("replicate", "e.*")
        state = cut_lineage(
            state.join(gone, ["replicate", "src", "dst"], "left_anti").unionByName(born)
        )
    return state


def rewiring_null_test(
    edges: DataFrame, years: DataFrame, replicates: int = 200, rounds: int = 12, min_nodes: int = 5, seed: int = 42
) -> DataFrame:
    """Leave-one-out MAE of the unweighted network against its rewired copies."""
    plain = edges.select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    copies = rewire(plain, replicates, rounds, seed).unionByName(
        plain.withColumn("replicate", F.lit(0))
    ).withColumn("weight", F.lit(1.0))
    predicted = predict_years(copies, years, ["replicate"])
    maes = predicted.groupBy("replicate").agg(
        F.when(
            F.count(F.lit(1)) >= min_nodes, F.avg(F.abs(F.col("predicted_year") - F.col("observed_year")))
        ).alias("mae")
    )
    observed = F.max(F.when(F.col("replicate") == 0, F.col("mae")))
    null = F.when(F.col("replicate") > 0, F.col("mae"))
    base = maes.agg(
        observed.alias("observed_mae"),
        F.avg(null).alias("null_mean_mae"),
        F.percentile(null, F.lit(0.05)).alias("null_p5_mae"),
        F.count(null).alias("n_null"),
        F.array_sort(F.collect_list(null)).alias("_nulls"),
    )
    below = F.size(F.filter("_nulls", lambda v: v <= F.col("observed_mae")))
    return base.select(
        "observed_mae", "null_mean_mae", "null_p5_mae",
        F.when(F.col("n_null") > 0, (below + 1) / (F.col("n_null") + 1)).alias("p_value"),
        "n_null",
    )


# ------------------------------------------------------------------------- metrics


def degree_strength(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return (
        symmetrised(edges, keys).groupBy(*keys, F.col("src").alias("node"))
        .agg(F.count(F.lit(1)).alias("degree"), F.sum("weight").alias("strength"))
    )


def eigenvector_centrality(edges: DataFrame, tolerance: float = 1e-10, basis: int = 48) -> DataFrame:
    """Leading eigenvector of the weighted adjacency, scaled to length one.

    Lanczos steps from the all-ones vector: each step is one join and one
    aggregation, the new vector is made orthogonal to all before it, and the
    small projected matrix gives the best vector they span.  After ``basis``
    steps the search starts again from that vector, and it ends when the
    residual is below ``tolerance`` times the eigenvalue, however many steps
    that takes.  An edgeless graph has no rows.
    """
    links = cut_lineage(symmetrised(edges).select("src", "dst", F.col("weight").cast("double").alias("weight")))
    nodes = links.select(F.col("src").alias("node")).distinct()
    size = nodes.count()
    if not size:
        return nodes.withColumn("eigenvector", F.lit(0.0))
    state = cut_lineage(nodes.withColumn("q", F.array(F.lit(1 / size**0.5))))
    while True:
        best, residual, value = _lanczos(links, state, min(basis, size), tolerance)
        weights = F.array(*[F.lit(float(x)) for x in best[0]])
        vector = F.aggregate(F.zip_with("q", weights, lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
        state = cut_lineage(best[1].select("node", F.array(vector).alias("q")))
        if residual <= tolerance * abs(value) or size <= basis:
            break
    sign = -1.0 if state.agg(F.sum(F.element_at("q", 1))).first()[0] < 0 else 1.0
    return state.select("node", (F.element_at("q", 1) * sign).alias("eigenvector"))


def _lanczos(links: DataFrame, state: DataFrame, steps: int, tolerance: float):
    """Up to ``steps`` orthonormal vectors as an array per node; their best combination, its residual and value."""
    diagonal: list[float] = []
    beside: list[float] = []
    while True:
        k = len(diagonal)
        last = state.select(F.col("node").alias("dst"), F.get("q", F.lit(k)).alias("v"))
        image = links.join(last, "dst").groupBy(F.col("src").alias("node")).agg(F.sum(F.col("weight") * F.col("v")).alias("w"))
        grown = cut_lineage(state.join(image, "node"))
        # made orthogonal twice, so that rounding does not bring earlier vectors back
        w, square = F.col("w"), 0.0
        for again in (False, True):
            dots = [F.sum(F.get("q", F.lit(i)) * w) for i in range(k + 1)]
            *parts, square = map(float, grown.agg(*dots, F.sum(w * w)).first())
            if not again:
                diagonal.append(parts[k])
            w = sum((F.lit(-parts[i]) * F.get("q", F.lit(i)) for i in range(k + 1)), w)
        length = max(square - sum(x * x for x in parts), 0.0) ** 0.5
        small = np.diag(diagonal) + np.diag(beside, 1) + np.diag(beside, -1)
        values, vectors = np.linalg.eigh(small)
        residual = length * abs(vectors[-1, -1])
        if residual <= tolerance * abs(values[-1]) or k + 1 == steps:
            return (vectors[:, -1], grown.select("node", "q")), residual, float(values[-1])
        beside.append(length)
        state = grown.select("node", F.concat("q", F.array(w / length)).alias("q"))


#: Rows (source, node) and (source, edge) that one batch of sources may hold.
BATCH_ROWS = 8_000_000


def betweenness(edges: DataFrame, batch_rows: int = BATCH_ROWS) -> DataFrame:
    """Weighted shortest-path betweenness, normalised; the weight is read as distance.

    Sources are taken in batches, as many at once as keep (source, edge) rows
    within ``batch_rows``.  A batch finds its distances, settles path counts wave
    by wave (a node follows when all nodes before it are settled), carries the
    dependencies back through the waves, and leaves one sum per node; its tables
    go before the next batch begins.  Parallel edges are paths of their own.  A
    distance must be above zero: with zeros there are endlessly many shortest
    walks, with less than zero no shortest one, so both are refused.
    """
    if not edges.where(~F.coalesce(F.col("weight") > 0, F.lit(False))).isEmpty():
        raise ValueError("betweenness reads weights as distances; they must be above zero")
    links = cut_lineage(symmetrised(edges).select("src", "dst", F.col("weight").cast("double").alias("w")))
    nodes = cut_lineage(links.select(F.col("src").alias("node")).distinct())
    n, m = nodes.count(), links.count()
    if not n:
        return nodes.withColumn("betweenness", F.lit(0.0))
    batches = -(-n // max(1, batch_rows // max(n, m)))
    sums = None
    for k in range(batches):
        sources = nodes.where(F.pmod(F.xxhash64("node"), F.lit(batches)) == k)
        if sources.isEmpty():
            continue
        own = _dependencies(links, sources)
        if sums is None:
            sums = own
        else:
            both = cut_lineage(sums.unionByName(own).groupBy("node").agg(F.sum("v").alias("v")))
            drop_table(sums)
            drop_table(own)
            sums = both
    scale = float((n - 1) * (n - 2))
    value = F.coalesce("v", F.lit(0.0)) / scale if n > 2 else F.lit(0.0)
    return nodes.join(sums, "node", "left").select("node", value.alias("betweenness"))


def _distances(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(s, node, d); each round only rows that changed reach out."""
    state = cut_lineage(sources.select(F.col("node").alias("s"), "node", F.lit(0.0).alias("d"), F.lit(True).alias("fresh")))
    while not state.where("fresh").isEmpty():
        step = state.where("fresh").join(links, F.col("node") == F.col("src")).select("s", F.col("dst").alias("node"), (F.col("d") + F.col("w")).alias("new"))
        known = state.select("s", "node", F.lit(None).cast("double").alias("new"), F.col("d").alias("old"))
        met = known.unionByName(step.withColumn("old", F.lit(None).cast("double"))).groupBy("s", "node").agg(F.min("new").alias("new"), F.min("old").alias("old"))
        nearer = F.col("new").isNotNull() & (F.col("old").isNull() | (F.col("new") < F.col("old") * (1 - 1e-12)))
        after = cut_lineage(met.select("s", "node", F.when(nearer, F.col("new")).otherwise(F.col("old")).alias("d"), nearer.alias("fresh")))
        drop_table(state)
        state = after
    return state.drop("fresh")


def _dependencies(links: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, v): what the shortest paths of the sources to all other nodes depend on each node."""
    dist = _distances(links, sources)
    ahead = dist.join(links, F.col("node") == F.col("src")).select("s", "src", "dst", F.col("d").alias("_from"), (F.col("d") + F.col("w")).alias("_via"))
    met = ahead.join(dist.select("s", F.col("node").alias("dst"), F.col("d").alias("_best")), ["s", "dst"])
    on_path = (F.abs(F.col("_via") - F.col("_best")) <= 1e-9 * F.greatest(F.lit(1.0), F.col("_best"))) & (F.col("_from") < F.col("_best"))
    tight = cut_lineage(met.where(on_path).select("s", "src", "dst"))
    need = tight.groupBy("s", F.col("dst").alias("node")).agg(F.count("*").alias("need"))
    first = dist.join(need, ["s", "node"], "left").select(
        "s", "node", F.coalesce("need", F.lit(0)).alias("need"), F.when(F.col("need").isNull(), 1.0).otherwise(0.0).alias("paths"), F.when(F.col("need").isNull(), 0).alias("wave")
    )
    state, wave = cut_lineage(first), 0
    drop_table(dist)
    while True:
        given = state.where(F.col("wave") == wave).select("s", F.col("node").alias("src"), F.col("paths").alias("_p")).join(tight, ["s", "src"])
        given = given.groupBy("s", F.col("dst").alias("node")).agg(F.sum("_p").alias("_p"), F.count("*").alias("_k"))
        left = F.col("need") - F.coalesce("_k", F.lit(0))
        settled = F.when(F.col("wave").isNull() & (left == 0), wave + 1).otherwise(F.col("wave"))
        after = state.join(given, ["s", "node"], "left").select("s", "node", left.alias("need"), (F.col("paths") + F.coalesce("_p", F.lit(0.0))).alias("paths"), settled.alias("wave"))
        after = cut_lineage(after)
        drop_table(state)
        state, wave = after, wave + 1
        if state.where(F.col("wave") == wave).isEmpty():
            break
    state = cut_lineage(state.select("s", "node", "paths", "wave", F.lit(0.0).alias("v")))
    for last in range(wave - 1, 0, -1):
        back = state.where(F.col("wave") == last).select("s", F.col("node").alias("dst"), ((1 + F.col("v")) / F.col("paths")).alias("_c")).join(tight, ["s", "dst"])
        back = back.groupBy("s", F.col("src").alias("node")).agg(F.sum("_c").alias("_c"))
        grown = F.col("v") + F.col("paths") * F.coalesce("_c", F.lit(0.0))
        after = cut_lineage(state.join(back, ["s", "node"], "left").select("s", "node", "paths", "wave", grown.alias("v")))
        drop_table(state)
        state = after
    out = cut_lineage(state.where(F.col("s") != F.col("node")).groupBy("node").agg(F.sum("v").alias("v")))
    drop_table(state)
    drop_table(tight)
    return out


def modularity(edges: DataFrame, membership: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Modularity and number of communities per graph, from sums over edges and nodes."""
    keys = list(keys)
    ends = edges.join(
        membership.select(*keys, F.col("node").alias("src"), F.col("community").alias("_cs")), [*keys, "src"]
    ).join(membership.select(*keys, F.col("node").alias("dst"), F.col("community").alias("_cd")), [*keys, "dst"])
    one = F.lit(1).alias("_one")
    inside = ends.groupBy(*keys, one).agg(
        F.sum("weight").alias("_m"),
        F.sum(F.when(F.col("_cs") == F.col("_cd"), F.col("weight")).otherwise(0.0)).alias("_in"),
        F.count(F.lit(1)).alias("n_edges"),
    )
    strength = degree_strength(edges, keys).join(membership, [*keys, "node"])
    groups = strength.groupBy(*keys, "community").agg(F.sum("strength").alias("_k"))
    squares = groups.groupBy(*keys, one).agg(
        F.sum(F.col("_k") * F.col("_k")).alias("_kk"), F.count(F.lit(1)).alias("n_communities")
    )
    return inside.join(squares, [*keys, "_one"]).select(
        *keys,
        "n_edges",
        "n_communities",
        (ratio("_in", "_m") - ratio("_kk", 4 * F.col("_m") * F.col("_m"))).alias("modularity"),
    )


def communities(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Communities by rounds of best modularity moves and contraction, many graphs at once.

    A node takes the neighbouring community of largest gain (ties to the smallest
    id).  Even rounds allow moves to smaller ids only and odd rounds to larger
    ones, so two nodes never swap places for ever.  A level ends when a pair of
    rounds moves nothing, or no longer raises the modularity (summed over the
    graphs); its best membership counts.  Levels contract communities to nodes
    until nothing moves.
    """
    keys = list(keys)
    base = cut_lineage(
        edges.select(*keys, "src", "dst", F.col("weight").cast("double").alias("weight"))
    )
    original = cut_lineage(symmetrised(base, keys).select(*keys, F.col("src").alias("node")).distinct())
    membership = original.withColumn("community", F.col("node"))
    level_edges = symmetrised(base, keys)
    loops = None
    total = cut_lineage(base.groupBy(*keys, F.lit(1).alias("_one")).agg((2 * F.sum("weight")).alias("_m2")))
    for _ in count():
        level_edges = cut_lineage(level_edges)
        strength = level_edges.groupBy(*keys, F.col("src").alias("node")).agg(F.sum("weight").alias("k"))
        if loops is not None:
            strength = strength.unionByName(loops.select(*keys, "node", F.col("w").alias("k"))).groupBy(
                *keys, "node"
            ).agg(F.sum("k").alias("k"))
        state = cut_lineage(strength.withColumn("community", F.col("node")))
        moved_any = False
        pair_moved = False
        best_state, best_score = state, _level_score(level_edges, loops, state, total, keys)
        for round_no in count():
            mass = state.groupBy(*keys, "community").agg(F.sum("k").alias("_kc"))
            toward = (
                level_edges.join(
                    state.select(*keys, F.col("node").alias("dst"), "community"), [*keys, "dst"]
                )
                .groupBy(*keys, F.col("src").alias("node"), "community")
                .agg(F.sum("weight").alias("_kin"))
            )
            own = state.select(*keys, "node", "k", F.col("community").alias("_own"))
            options = (
                toward.unionByName(
                    state.select(*keys, "node", "community", F.lit(0.0).alias("_kin"))
                )
                .groupBy(*keys, "node", "community").agg(F.max("_kin").alias("_kin"))
                .join(own, [*keys, "node"])
                .join(mass, [*keys, "community"])
                .withColumn("_one", F.lit(1))
                .join(total, [*keys, "_one"])
            )
            stay = F.col("community") == F.col("_own")
            others = F.col("_kc") - F.when(stay, F.col("k")).otherwise(0.0)
            gain = F.col("_kin") - others * F.col("k") / F.col("_m2")
            # A move must beat staying by more than rounding noise.
            score = F.round(gain, 9) + F.when(stay, 1e-9).otherwise(0.0)
            ranked = options.select(*keys, "node", "k", "_own", "community", score.alias("_g"))
            best = ranked.groupBy(*keys, "node", "k", "_own").agg(
                F.min_by("community", F.struct(-F.col("_g"), "community")).alias("_best")
            )
            upward = F.col("_best") > F.col("_own")
            turn = upward if round_no % 2 else ~upward
            fresh = cut_lineage(
                best.select(
                    *keys, "node", "k", F.when(turn, F.col("_best")).otherwise(F.col("_own")).alias("community"),
                    (turn & (F.col("_best") != F.col("_own"))).alias("_moved"),
                )
            )
            moves = fresh.where("_moved").limit(1).count()
            state = fresh.drop("_moved")
            moved_any = moved_any or moves > 0
            pair_moved = moves > 0 or (round_no % 2 == 1 and pair_moved)
            if round_no % 2 == 1:
                reached = _level_score(level_edges, loops, state, total, keys)
                if reached > best_score + 1e-9:
                    best_state, best_score = state, reached
                else:
                    pair_moved = False
                if not pair_moved:
                    break
        state = best_state
        moved_any = not state.where(F.col("community") != F.col("node")).isEmpty()
        if not moved_any:
            break
        membership = cut_lineage(
            membership.withColumnRenamed("community", "_c")
            .join(state.select(*keys, F.col("node").alias("_c"), "community"), [*keys, "_c"])
            .select(*keys, "node", "community")
        )
        to = state.select(*keys, F.col("node").alias("src"), F.col("community").alias("_cs"))
        fro = state.select(*keys, F.col("node").alias("dst"), F.col("community").alias("_cd"))
        contracted = cut_lineage(
            level_edges.join(to, [*keys, "src"]).join(fro, [*keys, "dst"])
            .groupBy(*keys, F.col("_cs").alias("src"), F.col("_cd").alias("dst"))
            .agg(F.sum("weight").alias("weight"))
        )
        inner = contracted.where(F.col("src") == F.col("dst")).select(
            *keys, F.col("src").alias("node"), F.col("weight").alias("w")
        )
        if loops is not None:
            carried = loops.join(
                state.select(*keys, "node", "community"), [*keys, "node"]
            ).select(*keys, F.col("community").alias("node"), "w")
            inner = inner.unionByName(carried).groupBy(*keys, "node").agg(F.sum("w").alias("w"))
        loops = cut_lineage(inner)
        level_edges = contracted.where(F.col("src") != F.col("dst"))
    return membership


def _level_score(level_edges: DataFrame, loops: DataFrame | None, state: DataFrame, total: DataFrame, keys: list[str]) -> float:
    """Modularity of a level's membership, summed over the graphs."""
    a = state.select(*keys, F.col("node").alias("src"), F.col("community").alias("_a"))
    b = state.select(*keys, F.col("node").alias("dst"), F.col("community").alias("_b"))
    inside = level_edges.join(a, [*keys, "src"]).join(b, [*keys, "dst"]).where(F.col("_a") == F.col("_b"))
    held = inside.select(*keys, "weight")
    if loops is not None:
        held = held.unionByName(loops.select(*keys, F.col("w").alias("weight")))
    one = F.lit(1).alias("_one")
    within = held.groupBy(*keys, one).agg(F.sum("weight").alias("_in"))
    mass = state.groupBy(*keys, "community").agg(F.sum("k").alias("_k")).groupBy(*keys, one).agg(F.sum(F.col("_k") * F.col("_k")).alias("_kk"))
    parts = total.join(mass, [*keys, "_one"]).join(within, [*keys, "_one"], "left")
    share = F.coalesce("_in", F.lit(0.0)) / F.col("_m2") - F.col("_kk") / (F.col("_m2") * F.col("_m2"))
    return float(parts.agg(F.sum(share)).first()[0] or 0.0)


def community_summary(edges: DataFrame, nodes: DataFrame, membership: DataFrame) -> DataFrame:
    """Members by kind and internal and cross weight per community."""
    named = membership.join(nodes, "node")

    def members(kind: str) -> Column:
        return F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("node")))), ", ")

    who = named.groupBy("community").agg(
        F.count_if(F.col("kind") == "oem").alias("n_oems"),
        F.count_if(F.col("kind") == "state").alias("n_states"),
        members("oem").alias("oems"),
        members("state").alias("states"),
    )
    a = membership.select(F.col("node").alias("src"), F.col("community").alias("_a"))
    b = membership.select(F.col("node").alias("dst"), F.col("community").alias("_b"))
    both = symmetrised(edges).join(a, "src").join(b, "dst")
    same = F.col("_a") == F.col("_b")
    weights = both.groupBy(F.col("_a").alias("community")).agg(
        F.sum(F.when(same, F.col("weight") / 2).otherwise(0.0)).alias("internal_weight"),
        F.sum(F.when(~same, F.col("weight")).otherwise(0.0)).alias("cross_weight"),
    )
    return (
        who.join(weights, "community", "left")
        .fillna(0.0, ["internal_weight", "cross_weight"])
        .withColumn(
            "cross_share",
            F.col("cross_weight")
            / F.greatest(F.col("internal_weight") + F.col("cross_weight"), F.lit(1e-12)),
        )
    )


def cross_community_edges(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Maker-state edges whose ends lie in different communities."""
    a = membership.select(F.col("node").alias("src"), F.col("community").alias("oem_community"))
    b = membership.select(F.col("node").alias("dst"), F.col("community").alias("state_community"))
    return (
        edges.join(a, "src").join(b, "dst")
        .where(F.col("oem_community") != F.col("state_community"))
        .select(
            F.col("src").alias("oem"), F.col("dst").alias("state"), "oem_community", "state_community", "weight"
        )
    )


def community_flow_matrix(cross: DataFrame, communities: Sequence[str]) -> DataFrame:
    """Maker community by state community weights, dense with zeros."""
    names = list(communities)
    wide = (
        cross.groupBy(F.col("oem_community").alias("community"))
        .pivot("state_community", names)
        .agg(F.sum("weight"))
    )
    rows = cross.sparkSession.createDataFrame([(n,) for n in names], ["community"])
    return rows.join(wide, "community", "left").fillna(0.0)


def edge_changes(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Born, died and changed edges between two vintages."""
    def ordered(df: DataFrame, name: str) -> DataFrame:
        return df.select(
            F.least("src", "dst").alias("node_a"), F.greatest("src", "dst").alias("node_b"),
            F.col("weight").alias(name),
        )

    both = ordered(previous, "before").join(ordered(current, "after"), ["node_a", "node_b"], "full_outer").fillna(
        0.0, ["before", "after"]
    )
    status = F.when(F.col("before") == 0, "born").when(F.col("after") == 0, "died").otherwise("changed")
    return both.withColumn("change", F.col("after") - F.col("before")).withColumn("status", status)


def metric_series(edges: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Nodes, edges, density, modularity and communities per graph key."""
    stable = cut_lineage(edges)
    groups = communities(stable, keys)
    scores = modularity(stable, groups, keys)
    sizes = groups.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_nodes"))
    n = F.col("n_nodes")
    return sizes.join(scores, list(keys)).withColumn(
        "density", F.when(n > 1, 2 * F.col("n_edges") / (n * (n - 1))).otherwise(0.0)
    )


def at_thresholds(edges: DataFrame, thresholds: Sequence[float], name: str = "threshold") -> DataFrame:
    """Repeats each edge for every threshold at or below its weight."""
    grid = F.array(*[F.lit(float(t)) for t in thresholds])
    return edges.withColumn(name, F.explode(F.filter(grid, lambda t: t <= F.col("weight"))))


def ego_network(edges: DataFrame, node: str) -> DataFrame:
    """Edges among a node and its neighbours."""
    around = (
        symmetrised(edges).where(F.col("src") == node).select(F.col("dst").alias("n"))
        .unionByName(edges.sparkSession.createDataFrame([(node,)], "n string"))
        .distinct()
    )
    return edges.join(around.withColumnRenamed("n", "src"), "src", "left_semi").join(
        around.withColumnRenamed("n", "dst"), "dst", "left_semi"
    )


def connected_components(edges: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Component label (smallest node id) per node of every keyed graph.

    Labels spread to neighbours and then jump to their own label's label, so the
    number of rounds grows with the logarithm of the diameter.
    """
    keys = list(keys)
    links = cut_lineage(symmetrised(edges, keys).select(*keys, "src", "dst"))
    state = cut_lineage(
        links.select(*keys, F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    )
    for _ in count():
        near = links.join(
            state.select(*keys, F.col("node").alias("dst"), "label"), [*keys, "dst"]
        ).select(*keys, F.col("src").alias("node"), "label")
        lowest = near.unionByName(state).groupBy(*keys, "node").agg(F.min("label").alias("label"))
        hop = state.select(*keys, F.col("node").alias("label"), F.col("label").alias("_next"))
        fresh = cut_lineage(
            lowest.join(hop, [*keys, "label"], "left").select(
                *keys, "node", F.least("label", F.coalesce("_next", F.col("label"))).alias("label")
            )
        )
        moved = fresh.join(state.withColumnRenamed("label", "_old"), [*keys, "node"]).where(
            F.col("label") != F.col("_old")
        ).limit(1).count()
        state = fresh
        if not moved:
            break
    return state


def percolation_curve(shares: DataFrame, thresholds: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Giant-component fraction, edges and components per share threshold, all read from one spanning forest.

    ``shares`` holds the edges with the within-state share as weight; the
    fraction is of all nodes before thresholding, and an empty graph gives 0.
    """
    keys = list(keys)
    stable = cut_lineage(shares)
    levels = percolation_levels(stable, thresholds, keys)
    one = F.lit(1).alias("_one")
    everyone = node_table(stable, keys).groupBy(*keys, one).agg(F.count(F.lit(1)).alias("_all"))
    grid = everyone.withColumn("threshold", F.explode(F.array(*[F.lit(float(t)) for t in thresholds])))
    by = [*keys, "threshold"]
    return grid.join(levels, by, "left").select(
        *by,
        F.coalesce(F.col("giant") / F.col("_all"), F.lit(0.0)).alias("giant_frac"),
        F.coalesce("n_edges", F.lit(0)).alias("n_edges"),
        F.coalesce("n_components", F.lit(0)).alias("n_components"),
    )


def critical_threshold(curve: DataFrame, keys: Sequence[str] = (), column: str = "giant_frac") -> DataFrame:
    """Upper threshold of the steepest fall between neighbouring thresholds."""
    one = F.lit(1).alias("_one")
    w = Window.partitionBy(*keys, "_one").orderBy("threshold")
    drops = curve.select(*keys, "threshold", one, F.col(column)).withColumn(
        "_d", F.col(column) - F.lag(column).over(w)
    ).where(F.col("_d").isNotNull())
    return drops.groupBy(*keys, "_one").agg(
        F.min_by("threshold", F.struct("_d", "threshold")).alias("critical_threshold")
    ).drop("_one")


# ---------------------------------------------------------------------- contagion


def morans_i(
    values: DataFrame, neighbours: DataFrame, permutations: int = 999, seed: int = 42, min_nodes: int = 5
) -> DataFrame:
    """Moran's I with a two-sided permutation p-value.

    ``values`` (node, value), ``neighbours`` a directed list.  Permutation r puts
    the value at position i of the hash order of (0, node) on the node at
    position i of the hash order of (r, node); the permutation is a key column.  Only edges with a value at
    both ends count.
    """
    known = values.join(neighbours.select(F.col("src").alias("node")).distinct(), "node", "left_semi").where(
        F.col("value").isNotNull()
    )
    centre = known.agg(
        F.avg("value").alias("_mean"), F.count(F.lit(1)).alias("_n")
    ).withColumn("_one", F.lit(1))
    z = cut_lineage(
        known.withColumn("_one", F.lit(1)).join(centre, "_one").select("node", (F.col("value") - F.col("_mean")).alias("z"), "_n")
    )
    ids = z.select("node")
    links = cut_lineage(
        neighbours.join(ids.withColumnRenamed("node", "src"), "src", "left_semi")
        .join(ids.withColumnRenamed("node", "dst"), "dst", "left_semi").select("src", "dst")
    )
    sums = z.agg(F.sum(F.col("z") * F.col("z")).alias("_zz"), F.max("_n").alias("n")).withColumn("_one", F.lit(1))
    weight = links.agg(F.count(F.lit(1)).alias("_w")).withColumn("_one", F.lit(1))
    draws = F.explode(F.sequence(F.lit(0), F.lit(permutations))).alias("r")
    buckets = max(1, ids.count() // 4096)
    slots = hash_positions(ids.select("node", draws), ["r"], F.xxhash64(F.lit(seed), "r", "node"), "node", "_i", buckets)
    ranks = hash_positions(
        z.withColumn("r", F.lit(0)), ["r"], F.xxhash64(F.lit(seed), "r", "node"), "node", "_i", buckets
    )
    shuffled = cut_lineage(slots.join(ranks.select("_i", "z"), "_i").select("r", "node", "z"))
    cross = (
        shuffled.select("r", F.col("node").alias("src"), F.col("z").alias("_za")).join(links, "src")
        .join(shuffled.select("r", F.col("node").alias("dst"), F.col("z").alias("_zb")), ["r", "dst"])
        .groupBy("r").agg(F.sum(F.col("_za") * F.col("_zb")).alias("_c"))
    )
    one = F.lit(1).alias("_one")
    scored = cross.withColumn("_one", F.lit(1)).join(sums, "_one").join(weight, "_one").select(
        "r", one, "n", ratio(F.col("n") * F.col("_c"), F.col("_w") * F.col("_zz")).alias("i")
    )
    observed = scored.where(F.col("r") == 0).select("_one", F.col("i").alias("_obs"))
    tested = scored.where(F.col("r") > 0).join(observed, "_one").groupBy("_one").agg(
        F.count_if(F.abs("i") >= F.abs("_obs")).alias("_over"), F.count(F.lit(1)).alias("_draws")
    )
    enough = F.col("n") >= min_nodes
    return scored.where(F.col("r") == 0).join(tested, "_one").select(
        F.when(enough, F.col("i")).alias("moran_i"),
        F.when(enough, -1.0 / (F.col("n") - 1)).alias("expected_i"),
        F.when(enough, (F.col("_over") + 1) / (F.col("_draws") + 1)).alias("p_value"),
        "n",
    )


def threshold_cascade(
    neighbours: DataFrame, seeds: DataFrame, keys: Sequence[str] = (), max_rounds: int | None = None
) -> DataFrame:
    """Synchronous spread: a node adopts once its adopted share of neighbours reaches tau.

    ``seeds`` has (keys, node, tau); every key is one run.  Returns (keys, node, step).
    Ends when no node adopts any more, or after ``max_rounds`` if that is given.
    """
    keys = list(keys)
    stable = cut_lineage(neighbours.select("src", "dst"))
    degree = stable.groupBy("src").agg(F.count(F.lit(1)).alias("_deg"))
    links = cut_lineage(stable.join(degree, "src"))
    seeds = seeds.join(stable.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    state = cut_lineage(seeds.select(*keys, "node", "tau", F.lit(0).alias("step")).distinct())
    for i in count(1) if max_rounds is None else range(1, max_rounds + 1):
        reach = (
            state.select(*keys, "tau", F.col("node").alias("dst"))
            .join(links, "dst")
            .groupBy(*keys, "tau", F.col("src").alias("node"), "_deg")
            .agg(F.count(F.lit(1)).alias("_hit"))
            .where(F.col("_hit") / F.col("_deg") >= F.col("tau"))
        )
        new = cut_lineage(
            reach.join(state.select(*keys, "tau", "node"), [*keys, "tau", "node"], "left_anti")
            .select(*keys, "node", "tau", F.lit(i).alias("step"))
        )
        if new.limit(1).count() == 0:
            break
        state = cut_lineage(state.unionByName(new))
    return state


def fit_tau(
    neighbours: DataFrame, years: DataFrame, taus: Sequence[float], n_seeds: int = 3
) -> DataFrame:
    """Rank agreement of cascade order and observed years per tau, seeds being the earliest nodes.

    Nodes the cascade never reaches share the worst rank.
    """
    observed = years.where(F.col("year").isNotNull())
    first = observed.orderBy("year", "node").limit(n_seeds).select("node")
    first = cut_lineage(first)
    grid = F.explode(F.array(*[F.lit(float(t)) for t in taus])).alias("tau")
    runs = threshold_cascade(neighbours, first.select("node", grid))
    common = observed.join(neighbours.select(F.col("src").alias("node")).distinct(), "node", "left_semi")
    rows = cut_lineage(
        common.select("node", F.col("year").cast("double").alias("_y"), grid).join(runs, ["node", "tau"], "left")
    )
    worst = rows.groupBy("tau").agg(F.coalesce(F.max("step") + 1, F.lit(1)).alias("_w"))
    filled = cut_lineage(
        rows.join(worst, "tau").withColumn("_s", F.coalesce("step", F.col("_w")).cast("double"))
    )
    ys = average_ranks(filled, ["tau"], "_y").withColumnRenamed("rank", "_ry")
    ss = average_ranks(filled, ["tau"], "_s").withColumnRenamed("rank", "_rs")
    names = first.agg(F.array_join(F.array_sort(F.collect_list("node")), ",").alias("seeds")).withColumn("_one", F.lit(1))
    scores = (
        filled.join(ys, ["tau", "_y"]).join(ss, ["tau", "_s"]).groupBy("tau")
        .agg(
            F.corr("_ry", "_rs").alias("spearman_rho"),
            F.count("step").alias("cascade_size"),
            F.count(F.lit(1)).alias("n_states"),
        )
    )
    return scores.withColumn("_one", F.lit(1)).join(names, "_one").drop("_one")


def seed_influence(neighbours: DataFrame, tau: float, candidates: DataFrame | None = None) -> DataFrame:
    """Reach and mean step of the cascade each node starts alone; the seed is the key."""
    nodes = candidates if candidates is not None else neighbours.select(F.col("src").alias("node")).distinct()
    runs = threshold_cascade(
        neighbours, nodes.select(F.col("node").alias("seed"), "node", F.lit(float(tau)).alias("tau")), ["seed"]
    )
    return runs.groupBy("seed").agg(
        F.count(F.lit(1)).alias("cascade_size"), F.avg("step").alias("mean_step")
    )
