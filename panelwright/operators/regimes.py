"""Latent regimes: a Gaussian hidden Markov model over many sequences.

The sequences stay distributed as one array row per entity.  Each EM round is
one job for all (k, restart) models at once: tasks run the recursions over their
sequences, all of one length together, and emit sums; Spark adds them, and the
driver turns them into the next parameters.  Everything is kept as logarithms,
so likelihoods are exact densities and comparable across models.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.columns import SHARE_COLUMNS
from panelwright.session import cut_lineage

FUEL_COLUMNS = ["petrol_share", "diesel_share", "cng_share", "ev_share", "hybrid_share"]
VARIANCE_FLOOR = 1e-4
Key = tuple[int, int]

assert sorted(FUEL_COLUMNS) == sorted(SHARE_COLUMNS)


@dataclass(frozen=True)
class Hmm:
    """Logarithms of the first state's and the moves' probabilities; centre and variance per state and column."""

    log_first: np.ndarray
    log_move: np.ndarray
    centre: np.ndarray
    variance: np.ndarray

    @property
    def move(self) -> np.ndarray:
        return np.exp(self.log_move)

    def log_density(self, x: np.ndarray) -> np.ndarray:
        """Log density of each point (sequence, step, column) in each state."""
        precision = 1 / self.variance
        square = (x**2) @ precision.T - 2 * x @ (self.centre * precision).T + (self.centre**2 * precision).sum(1)
        return -0.5 * (square + np.log(2 * np.pi * self.variance).sum(1))


def sequences(
    df: DataFrame, entity: str, order: str, columns: Sequence[str], min_length: int = 8
) -> DataFrame:
    """(entity, times, x): one row per entity with enough complete rows."""
    point = F.struct(F.col(order).alias("t"), F.array(*[F.col(c).cast("double") for c in columns]).alias("v"))
    return (
        df.dropna(subset=list(columns))
        .groupBy(F.col(entity).alias("entity"))
        .agg(F.array_sort(F.collect_list(point)).alias("_s"))
        .where(F.size("_s") >= min_length)
        .select(
            "entity",
            F.transform("_s", lambda s: s["t"].cast("bigint")).alias("times"),
            F.transform("_s", lambda s: s["v"]).alias("x"),
        )
    )


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    return np.logaddexp.reduce(values, axis=axis)


def _by_length(rows) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions, points) of the sequences of each length, stacked."""
    stacked: dict[int, list[int]] = {}
    points = [np.stack([np.asarray(v, dtype=float) for v in x]) for x in rows]
    for i, x in enumerate(points):
        stacked.setdefault(len(x), []).append(i)
    for places in stacked.values():
        yield np.array(places), np.stack([points[i] for i in places])


def _sums(x: np.ndarray, model: Hmm) -> np.ndarray:
    """What EM needs of sequences of one length: log likelihood, first states, moves, weights and moments."""
    density = model.log_density(x)
    steps = x.shape[1]
    ahead = [model.log_first + density[:, 0]]
    for t in range(1, steps):
        ahead.append(_log_sum(ahead[-1][:, :, None] + model.log_move, 1) + density[:, t])
    behind = [np.zeros_like(ahead[0])]
    for t in range(steps - 1, 0, -1):
        behind.append(_log_sum(model.log_move + (density[:, t] + behind[-1])[:, None, :], 2))
    forward, backward = np.stack(ahead, 1), np.stack(behind[::-1], 1)
    likelihood = _log_sum(ahead[-1], 1)
    state = np.exp(forward + backward - likelihood[:, None, None])
    moves = forward[:, :-1, :, None] + model.log_move + (density + backward)[:, 1:, None, :] - likelihood[:, None, None, None]
    first, second = np.einsum("ntk,ntd->kd", state, x), np.einsum("ntk,ntd->kd", state, x**2)
    parts = [likelihood.sum(), state[:, 0].sum(0), np.exp(moves).sum((0, 1)), state.sum((0, 1)), first, second]
    return np.concatenate([np.ravel(p) for p in parts])


def _improved(sums: np.ndarray, k: int, d: int) -> tuple[float, Hmm]:
    """Log likelihood of the model that gave the sums, and the model they lead to."""
    sizes = [1, k, k * k, k, k * d]
    likelihood, first, moves, weight, linear, square = np.split(sums, np.cumsum(sizes))
    moves, weight = moves.reshape(k, k), weight[:, None]
    seen = weight > 0
    centre = np.divide(linear.reshape(k, d), weight, out=np.zeros((k, d)), where=seen)
    variance = np.divide(square.reshape(k, d), weight, out=np.zeros((k, d)), where=seen) - centre**2
    left = moves.sum(1, keepdims=True)
    share = np.where(left > 0, moves / np.where(left > 0, left, 1), 1 / k)
    with np.errstate(divide="ignore"):
        return float(likelihood[0]), Hmm(np.log(first / first.sum()), np.log(share), centre, np.maximum(variance, VARIANCE_FLOOR))


def _first_models(seqs: DataFrame, ks: Sequence[int], restarts: int, seed: int) -> dict[Key, Hmm]:
    """Points in the order of a seeded hash as centres, the global variance, moves that mostly stay."""
    points = seqs.select("entity", F.posexplode("x").alias("i", "v"))
    d = len(points.first()["v"])
    spread = points.agg(*[F.var_pop(F.get("v", F.lit(j))) for j in range(d)]).first()
    variance = np.maximum(np.array(spread, dtype=float), VARIANCE_FLOOR)
    models: dict[Key, Hmm] = {}
    for r in range(restarts):
        drawn = points.orderBy(F.xxhash64(F.lit(seed + r), "entity", "i"), "entity", "i").limit(max(ks)).collect()
        centres = np.array([list(row["v"]) for row in drawn], dtype=float)
        for k in ks:
            stay = np.eye(k) if k == 1 else 0.9 * np.eye(k) + 0.1 / (k - 1) * (1 - np.eye(k))
            models[k, r] = Hmm(np.full(k, -np.log(k)), np.log(stay), centres[:k], np.repeat(variance[None], k, 0))
    return models


def fit_models(
    seqs: DataFrame, ks: Sequence[int], restarts: int = 4, max_rounds: int = 200, tolerance: float = 1e-5, seed: int = 42
) -> dict[Key, tuple[float, Hmm, bool]]:
    """EM for every (k, restart): log likelihood, model, and whether it settled within ``max_rounds``."""
    models = _first_models(seqs, ks, restarts, seed)
    d = next(iter(models.values())).centre.shape[1]
    last = {key: -np.inf for key in models}
    settled: set[Key] = set()
    for _ in range(max_rounds):
        running = {key: m for key, m in models.items() if key not in settled}
        if not running:
            break

        def add_up(batches: Iterator[pd.DataFrame], running: dict[Key, Hmm] = running) -> Iterator[pd.DataFrame]:
            for batch in batches:
                groups = [x for _, x in _by_length(batch["x"])]
                for (k, r), model in running.items():
                    total = sum(_sums(x, model) for x in groups)
                    yield pd.DataFrame({"k": k, "r": r, "i": np.arange(len(total)), "v": total})

        parts = seqs.select("x").mapInPandas(add_up, "k int, r int, i int, v double")
        sums = parts.groupBy("k", "r", "i").agg(F.sum("v").alias("v")).toPandas().set_index(["k", "r", "i"])["v"].sort_index()
        for key in running:
            likelihood, models[key] = _improved(sums.loc[key].to_numpy(), key[0], d)
            if abs(likelihood - last[key]) < tolerance * abs(likelihood):
                settled.add(key)
            last[key] = likelihood
    return {key: (last[key], model, key in settled) for key, model in models.items()}


def parameter_count(k: int, d: int) -> int:
    return (k - 1) + k * (k - 1) + 2 * k * d


def best_paths(x: np.ndarray, model: Hmm) -> np.ndarray:
    """Most likely states of sequences of one length; ties go to the lower state."""
    density = model.log_density(x)
    best, origin = model.log_first + density[:, 0], []
    for t in range(1, x.shape[1]):
        reached = best[:, :, None] + model.log_move
        origin.append(reached.argmax(1))
        best = np.take_along_axis(reached, origin[-1][:, None, :], 1)[:, 0] + density[:, t]
    path = [best.argmax(1)]
    for came in reversed(origin):
        path.insert(0, np.take_along_axis(came, path[0][:, None], 1)[:, 0])
    return np.stack(path, 1)


def viterbi(seqs: DataFrame, model: Hmm) -> DataFrame:
    """Most likely state per entity and time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for places, x in _by_length(batch["x"]):
                steps = x.shape[1]
                rows = batch.iloc[places]
                yield pd.DataFrame({
                    "entity": np.repeat(rows["entity"].to_numpy(), steps),
                    "time": np.concatenate(rows["times"].to_list()),
                    "regime": best_paths(x, model).ravel(),
                })

    return seqs.mapInPandas(run, f"entity {dict(seqs.dtypes)['entity']}, time bigint, regime bigint")


def label_regimes(means: DataFrame, columns: Sequence[str], regime: str = "regime") -> DataFrame:
    """Name of each regime after its most distinctive column, repeats numbered in regime order."""
    centre = means.agg(*[F.avg(c).alias(f"_g_{c}") for c in columns]).withColumn("_one", F.lit(1))
    compared = means.withColumn("_one", F.lit(1)).join(centre, "_one")
    best = F.greatest(*[F.col(c) - F.col(f"_g_{c}") for c in columns])
    name = F.lit(None).cast("string")
    for c in reversed(columns):
        name = F.when(F.col(c) - F.col(f"_g_{c}") == best, c.replace("_share", "") + "-heavy").otherwise(name)
    named = compared.withColumn("_label", name)
    repeat = F.row_number().over(Window.partitionBy("_label").orderBy(regime))
    return named.withColumn("_repeat", repeat).select(
        *means.columns,
        F.when(F.col("_repeat") == 1, F.col("_label"))
        .otherwise(F.concat_ws("-", "_label", "_repeat"))
        .alias("regime_label"),
    )


def fit_fuel_regimes(
    panel_year: DataFrame, ks: Sequence[int] = (2, 3, 4), min_years: int = 8, restarts: int = 4,
    max_rounds: int = 200, order: str = "year",
) -> dict[str, DataFrame]:
    """Model choice by BIC, regime calendar, labelled means and transition matrix.

    ``selection`` also tells whether the best restart of each k settled within ``max_rounds``.
    """
    spark = panel_year.sparkSession
    local = panel_year.where(F.col("state_code") != "ALL")
    seqs = cut_lineage(sequences(local, "state_code", order, FUEL_COLUMNS, min_years))
    points = seqs.agg(F.sum(F.size("x"))).first()[0]
    d = len(FUEL_COLUMNS)
    fitted = fit_models(seqs, ks, restarts, max_rounds)
    chosen = {k: max((fitted[k, r] for r in range(restarts)), key=lambda f: f[0]) for k in ks}
    size = {k: parameter_count(k, d) for k in ks}
    bic = {k: size[k] * float(np.log(points)) - 2 * chosen[k][0] for k in ks}
    model = chosen[min(ks, key=lambda k: (bic[k], k))][1]
    states = range(len(model.centre))
    means = spark.createDataFrame(
        [(i, *map(float, model.centre[i])) for i in states], "regime bigint, " + ", ".join(f"{c} double" for c in FUEL_COLUMNS)
    )
    labelled = label_regimes(means, FUEL_COLUMNS)
    names = labelled.select("regime", "regime_label")
    calendar = viterbi(seqs, model).withColumnsRenamed({"entity": "state_code", "time": order}).join(names, "regime")
    return {
        "selection": spark.createDataFrame(
            [(k, chosen[k][0], 2 * size[k] - 2 * chosen[k][0], bic[k], chosen[k][2]) for k in ks],
            "k bigint, loglik double, aic double, bic double, converged boolean",
        ),
        "calendar": calendar,
        "regime_means": labelled,
        "transition_matrix": spark.createDataFrame(
            [(i, j, float(model.move[i, j])) for i in states for j in states], "regime bigint, next_regime bigint, probability double"
        ),
    }
