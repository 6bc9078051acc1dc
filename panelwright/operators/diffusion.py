"""Diffusion curves: bounded fits per series, projections, milestones, intervals.

Market size enters every curve linearly, so only two shape parameters are
searched: a coarse grid inside the bounds, then a grid that shrinks around the
best cell until it is narrower than the fit needs.  One array per series and
scenario travels to the task that fits it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.columns import col, ratio
from panelwright.operators.series import prepare_adoption_series

M_MAX_MULTIPLE = 50.0


def bass_cumulative(t: str | Column, p: str | Column, q: str | Column, m: str | Column) -> Column:
    """Closed-form cumulative adoption at time t."""
    e = F.exp(-(col(p) + col(q)) * col(t))
    return col(m) * (1 - e) / (1 + col(q) / col(p) * e)


def _bass(t: np.ndarray, p: np.ndarray, q: np.ndarray) -> np.ndarray:
    e = np.exp(-(p + q) * t)
    return (1 - e) / (1 + q / p * e)


def _logistic(t: np.ndarray, rate: np.ndarray, mid: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(np.clip(-rate * (t - mid), -700, 700)))


def _gompertz(t: np.ndarray, rate: np.ndarray, mid: np.ndarray) -> np.ndarray:
    return np.exp(-np.exp(np.clip(-rate * (t - mid), -700, 700)))


# Shape, bounds of its two parameters for n points, and which axes are logarithmic.
CURVES: dict[str, tuple[Callable, Callable[[int], list[tuple[float, float]]], tuple[bool, bool]]] = {
    "bass": (_bass, lambda n: [(1e-6, 0.5), (1e-6, 2.0)], (True, True)),
    "logistic": (_logistic, lambda n: [(1e-5, 2.0), (-n, 3 * n)], (True, False)),
    "gompertz": (_gompertz, lambda n: [(1e-5, 2.0), (-n, 3 * n)], (True, False)),
}


def fit_curve(y: np.ndarray, curve: str = "bass") -> dict | None:
    """Least-squares shape parameters and market size of one cumulative series."""
    n = len(y)
    if n < 5 or y[-1] <= 0:
        return None
    shape, bounds, logarithmic = CURVES[curve]
    t = np.arange(n, dtype=float)
    limits = [
        (np.log(lo), np.log(hi)) if is_log else (float(lo), float(hi))
        for (lo, hi), is_log in zip(bounds(n), logarithmic, strict=True)
    ]

    def score(axes: list[np.ndarray]):
        grid = [g.ravel() for g in np.meshgrid(*axes, indexing="ij")]
        a, b = (np.exp(g) if is_log else g for g, is_log in zip(grid, logarithmic, strict=True))
        f = shape(t[None, :], a[:, None], b[:, None])
        m = np.clip((f @ y) / np.maximum((f * f).sum(axis=1), 1e-300), y[-1], y[-1] * M_MAX_MULTIPLE)
        sse = ((y[None, :] - m[:, None] * f) ** 2).sum(axis=1)
        best = int(np.argmin(sse))
        return sse[best], [g[best] for g in grid], m[best]

    axes = [np.linspace(lo, hi, 40) for lo, hi in limits]
    width = [2.0 * (hi - lo) / 39 for lo, hi in limits]
    sse, at, m = score(axes)
    for _ in range(60):
        axes = [
            np.clip(np.linspace(c - w, c + w, 9), lo, hi)
            for c, w, (lo, hi) in zip(at, width, limits, strict=True)
        ]
        new_sse, new_at, new_m = score(axes)
        moved = any(abs(a - b) > w * 0.7 for a, b, w in zip(at, new_at, width, strict=True))
        if new_sse <= sse:
            sse, at, m = new_sse, new_at, new_m
        if not moved:
            width = [w / 2.5 for w in width]
        if max(width) < 1e-9:
            break
    a, b = (float(np.exp(v)) if is_log else float(v) for v, is_log in zip(at, logarithmic, strict=True))
    params = np.array([a, b, m])
    jacobian = np.empty((n, 3))
    for i in range(3):
        step = 1e-6 * max(abs(params[i]), 1e-9)
        hi, lo = params.copy(), params.copy()
        hi[i] += step
        lo[i] -= step
        jacobian[:, i] = (hi[2] * shape(t, hi[0], hi[1]) - lo[2] * shape(t, lo[0], lo[1])) / (2 * step)
    covariance = np.linalg.pinv(jacobian.T @ jacobian) * sse / max(n - 3, 1)
    total = float(((y - y.mean()) ** 2).sum())
    return {
        "a": a,
        "b": b,
        "m": float(m),
        "se": np.sqrt(np.maximum(np.diag(covariance), 0)),
        "r2": 1 - sse / total if total > 0 else None,
    }


def series_arrays(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """One row per series: keys and the values in order."""
    point = F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(point)).alias("_s"))
        .select(*keys, F.transform("_s", lambda s: s["v"]).alias("y"))
    )


def fit_bass_arrays(arrays: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Bass parameters, errors, R2 and peak time per row (keys, y)."""
    kinds = dict(arrays.dtypes)
    fields = ["p", "q", "m", "p_se", "q_se", "m_se", "r2", "peak_time"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for y in batch["y"]:
                values = np.asarray(y, dtype=float)
                fit = fit_curve(values)
                if fit is None:
                    rows.append([None] * len(fields) + [len(values), None])
                    continue
                p, q, m = fit["a"], fit["b"], fit["m"]
                peak = float(np.log(q / p) / (p + q)) if q > p else None
                bound = bool(m >= 0.95 * values[-1] * M_MAX_MULTIPLE)
                rows.append([p, q, m, *map(float, fit["se"]), fit["r2"], peak, len(values), bound])
            out = batch[list(keys)].reset_index(drop=True)
            yield out.join(pd.DataFrame(rows, columns=[*fields, "n", "m_at_bound"]))

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return arrays.mapInPandas(
        run, f"{schema}, " + ", ".join(f"{f} double" for f in fields) + ", n bigint, m_at_bound boolean"
    )


def fit_bass(df: DataFrame, keys: Sequence[str], order: str, cumulative: str) -> DataFrame:
    return fit_bass_arrays(series_arrays(df, keys, order, cumulative), keys)


def fit_bass_by_entity(
    df: DataFrame, keys: Sequence[str], order: str, counts: str,
    min_total: float = 500, drop_last: int = 2, onset_units: float = 50.0, min_points: int = 1,
) -> DataFrame:
    """Prepared cumulative series, small totals skipped, one fit per entity."""
    arrays = series_arrays(
        prepare_adoption_series(df, keys, order, counts, drop_last, onset_units), keys, "t", "cum"
    )
    kept = arrays.where(
        (F.element_at("y", -1) >= min_total) & (F.size("y") >= min_points)
    )
    return fit_bass_arrays(kept, keys)


def project_bass(
    fits: DataFrame, keys: Sequence[str], horizon: int, t0: int = 0,
    p_mult: float | Column = 1.0, q_mult: float | Column = 1.0, m_mult: float | Column = 1.0,
) -> DataFrame:
    """Cumulative and incremental path per fit under multipliers."""
    times = F.explode(F.sequence(F.lit(t0), F.lit(t0 + horizon - 1))).alias("t")
    scaled = fits.where(F.col("p").isNotNull()).select(
        *keys,
        (F.col("p") * p_mult).alias("_p"), (F.col("q") * q_mult).alias("_q"), (F.col("m") * m_mult).alias("_m"),
        times,
    )
    path = bass_cumulative(F.col("t").cast("double"), "_p", "_q", "_m")
    before = bass_cumulative((F.col("t") - 1).cast("double"), "_p", "_q", "_m")
    first = F.lit(0.0) if t0 == 0 else F.lit(None).cast("double")
    return scaled.select(
        *keys,
        "t",
        path.alias("cumulative"),
        F.when(F.col("t") == t0, first).otherwise(path - before).alias("incremental"),
    )


def curve_comparison(df: DataFrame, keys: Sequence[str], order: str, cumulative: str) -> DataFrame:
    """Held-out error of Bass, logistic, Gompertz and the naive trend per series."""
    kinds = dict(df.dtypes)
    arrays = series_arrays(df, keys, order, cumulative).where(F.size("y") >= 8)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for *key, y in batch[[*keys, "y"]].itertuples(index=False, name=None):
                y = np.asarray(y, dtype=float)
                held = min(12, max(3, len(y) // 5))
                train, test = y[:-held], y[-held:]
                t = np.arange(len(train), len(y), dtype=float)
                paths = {}
                for curve, (shape, *_) in CURVES.items():
                    fit = fit_curve(train, curve)
                    if fit is not None:
                        paths[curve] = fit["m"] * shape(t, fit["a"], fit["b"])
                slope = np.diff(train)[-12:].mean()
                paths["naive_trend"] = np.maximum(train[-1] + slope * (t - (len(train) - 1)), 0)
                for name, path in paths.items():
                    gap = np.abs(path - test)
                    rows.append(
                        [*key, name, held, gap.mean(), (gap / np.maximum(test, 1)).mean()]
                    )
            yield pd.DataFrame(rows, columns=[*keys, "model", "holdout", "mae", "mape"])

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    scores = arrays.mapInPandas(run, f"{schema}, model string, holdout int, mae double, mape double")
    best = F.min("mape").over(Window.partitionBy(*keys))
    grade = F.when(best < 0.05, "A").when(best < 0.10, "B").when(best < 0.20, "C").otherwise("D")
    return scores.withColumn("fit_grade", grade)


def bootstrap_interval(
    df: DataFrame, keys: Sequence[str], order: str, cumulative: str, replicates: int = 80, seed: int = 42
) -> DataFrame:
    """5/50/95% of p, q, m over resampled increments; draws come from a hash, so reruns agree."""
    arrays = series_arrays(df, keys, order, cumulative)
    y = F.col("y")
    steps = F.transform(
        y, lambda v, i: F.greatest(v - F.when(i == 0, F.lit(0.0)).otherwise(F.get(y, i - 1)), F.lit(0.0))
    )
    keyed = arrays.select(
        *keys,
        steps.alias("_inc"),
        F.explode(F.sequence(F.lit(1), F.lit(replicates))).alias("replicate"),
    ).repartition(*keys, "replicate")
    n = F.size("_inc")
    drawn = F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: F.get("_inc", F.pmod(F.xxhash64(F.lit(seed), "replicate", *keys, i), n).cast("int")),
    )
    # Running sums of the drawn increments, built inside the row.
    running = F.aggregate(
        "_drawn",
        F.array().cast("array<double>"),
        lambda acc, v: F.array_append(acc, F.coalesce(F.get(acc, F.size(acc) - 1), F.lit(0.0)) + v),
    )
    sampled = keyed.withColumn("_drawn", drawn).select(*keys, "replicate", running.alias("y"))
    fits = fit_bass_arrays(sampled, [*keys, "replicate"]).where(F.col("p").isNotNull())
    points = F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95))
    quantiles = fits.groupBy(*keys).agg(
        *[F.percentile(c, points).alias(f"_{c}") for c in ("p", "q", "m")],
        F.count(F.lit(1)).alias("replicates"),
    )
    return quantiles.select(
        *keys,
        *[
            F.get(f"_{c}", F.lit(i)).alias(f"{c}_{label}")
            for c in ("p", "q", "m")
            for i, label in enumerate(("p05", "p50", "p95"))
        ],
        "replicates",
    )


def milestones(
    fits: DataFrame, keys: Sequence[str], start: str, marks: Sequence[float] = (0.05, 0.10, 0.20), span: int = 360
) -> DataFrame:
    """First month at or above each part of the fitted market, with its calendar date.

    ``fits`` carries a start date column and the number of fitted points ``n``.
    """
    months = F.explode(F.sequence(F.lit(0), (F.col("n") + span - 1).cast("int"))).alias("t")
    paths = fits.where(F.col("p").isNotNull()).select(*keys, start, "p", "q", "m", months)
    reached = paths.select(
        *keys,
        start,
        "t",
        "m",
        bass_cumulative(F.col("t").cast("double"), "p", "q", "m").alias("_path"),
        F.explode(F.array(*[F.lit(v) for v in marks])).alias("share"),
    )
    first = reached.groupBy(*keys, start, "share").agg(
        F.min(F.when(F.col("_path") >= F.col("m") * F.col("share"), F.col("t"))).alias("month_from_onset")
    )
    return first.withColumn("calendar_date", F.add_months(F.trunc(start, "month"), F.col("month_from_onset")))


def start_scan(
    df: DataFrame, keys: Sequence[str], order: str, counts: str, starts: Sequence, min_points: int = 8,
    drop_last: int = 2, onset_units: float = 50.0,
) -> DataFrame:
    """Refit for every start; the start is a key, so all windows run in one job."""
    begun = [F.when(F.col(order) >= F.lit(s), F.lit(s)) for s in starts]
    keyed = df.withColumn("start", F.explode(F.array_compact(F.array(*begun))))
    return fit_bass_by_entity(
        keyed, [*keys, "start"], order, counts, 1.0, drop_last, onset_units, min_points
    ).where(F.col("p").isNotNull())


def tax_parity_scenarios(
    fits: DataFrame, keys: Sequence[str], elasticities: Sequence[float] = (1.0, 1.5, 2.0),
    horizon: int = 60, price_cut: float = 0.266, q_mult: float = 1.2,
) -> DataFrame:
    """Cumulative adoption at the horizon per elasticity against the base, and the uplift."""
    grid = [F.struct(F.lit("baseline").alias("scenario"), F.lit(1.0).alias("mm"), F.lit(1.0).alias("qm"))]
    grid += [
        F.struct(
            F.lit(f"elasticity_{e:g}").alias("scenario"),
            F.lit(1 + price_cut * e).alias("mm"),
            F.lit(q_mult).alias("qm"),
        )
        for e in elasticities
    ]
    keyed = fits.select("*", F.explode(F.array(*grid)).alias("_g")).select("*", "_g.*")
    paths = project_bass(
        keyed, [*keys, "scenario"], horizon, q_mult=F.col("qm"), m_mult=F.col("mm")
    )
    final = paths.groupBy(*keys, "scenario").agg(F.max_by("cumulative", "t").alias("cumulative"))
    base = F.max(F.when(F.col("scenario") == "baseline", F.col("cumulative"))).over(
        Window.partitionBy(*keys)
    )
    return final.withColumn("uplift", ratio("cumulative", base))
