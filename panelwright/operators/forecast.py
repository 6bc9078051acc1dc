"""Short-horizon forecasts, rolling backtests and the retail nowcast.

A series is one row per (keys, period).  Origins are key columns, so a backtest
is one job over all series and origins.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.columns import ratio
from panelwright.functions.linalg import fit2

Forecast = Callable[[DataFrame, Sequence[str], str, str, int, int], DataFrame]


def seasonal_naive(
    df: DataFrame, keys: Sequence[str], order: str, value: str, horizon: int, season: int = 12
) -> DataFrame:
    """Value one season back times the mean of the last three yearly ratios, with a 1.96 sd band."""
    w = Window.partitionBy(*keys).orderBy(order)
    back = Window.partitionBy(*keys).orderBy(F.desc(order))
    known = (
        df.where(F.col(value).isNotNull())
        .select(
            *keys,
            order,
            F.col(value).cast("double").alias("_y"),
            F.lag(F.col(value).cast("double"), season).over(w).alias("_l"),
            F.row_number().over(back).alias("_back"),
        )
        .withColumn("_r", ratio("_y", "_l"))
    )
    # The last three ratios are the newest rows that have one.
    newest = Window.partitionBy(*keys).orderBy(F.col("_r").isNull(), F.desc(order))
    ranked = known.withColumn("_newest", F.row_number().over(newest))
    paired = F.col("_l").isNotNull()
    stats = ranked.groupBy(*keys).agg(
        F.count("_r").alias("_nr"),
        F.avg(F.when(F.col("_newest") <= 3, F.col("_r"))).alias("_d3"),
        F.var_samp(F.when(paired, F.col("_y"))).alias("_vy"),
        F.var_samp("_l").alias("_vl"),
        F.covar_samp("_y", "_l").alias("_c"),
        F.count(F.lit(1)).alias("_n"),
    )
    drift = F.when(F.col("_nr") >= 3, F.col("_d3")).otherwise(1.0)
    base = known.where(F.col("_back") <= season).select(
        *keys, "_y", F.explode(F.sequence(F.lit(season) - F.col("_back"), F.lit(horizon + season), F.lit(season))).alias("h")
    ).where(F.col("h") < horizon)
    spread = F.sqrt(
        F.greatest(F.col("_vy") + drift * drift * F.col("_vl") - 2 * drift * F.col("_c"), F.lit(0.0))
    )
    mean = F.when(F.col("_n") >= season, F.col("_y") * drift)
    floor = F.lit(0.0)

    def floored(c: Column) -> Column:
        return F.when(c.isNotNull(), F.greatest(c, floor))

    return base.join(stats, list(keys)).select(
        *keys,
        "h",
        floored(mean).alias("mean"),
        floored(mean - 1.96 * spread).alias("lo"),
        floored(mean + 1.96 * spread).alias("hi"),
    )


def _per_series(
    df: DataFrame, keys: Sequence[str], order: str, value: str, horizon: int,
    model: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray] | None],
) -> DataFrame:
    """Applies a series model to one array per calendar series."""
    kinds = dict(df.dtypes)
    point = F.struct(F.col(order).alias("o"), F.col(value).cast("double").alias("v"))
    arrays = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(point)).alias("_s"))
        .select(*keys, F.transform("_s", lambda s: s["v"]).alias("_y"))
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = []
            for *key, y in batch[[*keys, "_y"]].itertuples(index=False, name=None):
                result = model(np.asarray(y, dtype=float))
                if result is None:
                    continue
                mean, lo, hi = (np.maximum(part, 0.0) for part in result)
                out = pd.DataFrame({"h": range(horizon), "mean": mean, "lo": lo, "hi": hi})
                parts.append(out.assign(**dict(zip(keys, key, strict=True))))
            if parts:
                yield pd.concat(parts)[[*keys, "h", "mean", "lo", "hi"]]

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return arrays.mapInPandas(run, f"{schema}, h int, mean double, lo double, hi double")


def holt_winters(
    df: DataFrame, keys: Sequence[str], order: str, value: str, horizon: int, season: int = 12
) -> DataFrame:
    """Additive trend and season; the three weights minimise the one-step squared error.

    All weight combinations run side by side through the series: a coarse grid,
    then two finer grids around the best point.
    """

    def smooth(y: np.ndarray, a: np.ndarray, b: np.ndarray, g: np.ndarray):
        level = np.full(len(a), y[:season].mean())
        trend = np.full(len(a), (y[season : 2 * season].mean() - y[:season].mean()) / season)
        cycle = np.repeat((y[:season] - y[:season].mean())[:, None], len(a), axis=1)
        errors = np.zeros((len(y), len(a)))
        for t, actual in enumerate(y):
            s = t % season
            before, old = level, cycle[s]
            errors[t] = actual - (level + trend + old)
            level = a * (actual - old) + (1 - a) * (before + trend)
            trend = b * (level - before) + (1 - b) * trend
            cycle[s] = g * (actual - level) + (1 - g) * old
        return level, trend, cycle, errors

    def model(y: np.ndarray):
        if len(y) < 2 * season:
            return None
        centre, width = np.array([0.5, 0.5, 0.5]), 0.45
        for _ in range(3):
            axes = [np.clip(np.linspace(c - width, c + width, 7), 0.001, 0.999) for c in centre]
            a, b, g = (m.ravel() for m in np.meshgrid(*axes, indexing="ij"))
            *_, errors = smooth(y, a, b, g)
            best = int((errors**2).sum(axis=0).argmin())
            centre, width = np.array([a[best], b[best], g[best]]), width / 3
        level, trend, cycle, errors = smooth(y, *(centre[i : i + 1] for i in range(3)))
        ahead = np.arange(1, horizon + 1)
        mean = level[0] + ahead * trend[0] + cycle[(len(y) + ahead - 1) % season, 0]
        band = 1.96 * errors[:, 0].std()
        return mean, mean - band, mean + band

    return _per_series(df, keys, order, value, horizon, model)


def seasonal_polynomial(near: float, far: float, season: int) -> np.ndarray:
    """Coefficients of (1 + near B)(1 + far B^season) by power of B."""
    out = np.zeros(season + 2)
    out[[0, 1, season, season + 1]] = 1.0, near, far, near * far
    return out


def innovations(w: np.ndarray, params: np.ndarray, season: int) -> np.ndarray:
    """One-step errors of a (1,1)(1,1) product model, 0 before the first full set of lags."""
    phi, far_phi, theta, far_theta = params
    first = season + 1
    own = seasonal_polynomial(-phi, -far_phi, season)
    e = np.zeros(len(w))
    e[first:] = sum(own[k] * w[first - k : len(w) - k] for k in (0, 1, season, season + 1))
    both = theta * far_theta
    for t in range(first, len(w)):
        e[t] -= theta * e[t - 1] + far_theta * e[t - season] + both * e[t - season - 1]
    return e


def fit_seasonal(w: np.ndarray, season: int, rounds: int = 100) -> tuple[np.ndarray, float]:
    """(phi, seasonal phi, theta, seasonal theta) with the least squared errors, and the errors' variance.

    Starts from a regression on lags and on the residuals of a longer
    autoregression, product terms left free, and goes on by damped Gauss-Newton
    steps on the errors of the product model itself.  No coefficient is bounded:
    a step that makes the errors grow is not taken.
    """
    first = season + 1
    lags = (1, 2, season, season + 1)
    long = np.column_stack([w[first - k : len(w) - k] for k in lags])
    e = np.zeros(len(w))
    e[first:] = w[first:] - long @ np.linalg.lstsq(long, w[first:], rcond=None)[0]
    lo = 2 * first
    stage = [v[lo - k : len(w) - k] for v in (w, e) for k in (1, season, season + 1)]
    free = np.linalg.lstsq(np.column_stack(stage), w[lo:], rcond=None)[0]

    def loss(p: np.ndarray) -> float:
        with np.errstate(over="ignore", invalid="ignore"):
            total = float((innovations(w, p, season)[first:] ** 2).sum())
        return total if np.isfinite(total) else np.inf

    starts = [free[[0, 1, 3, 4]], np.zeros(4)]
    params = min(starts, key=loss)
    now, damping = loss(params), 1e-3
    for _ in range(rounds):
        base = innovations(w, params, season)[first:]
        slopes = np.column_stack([(innovations(w, params + 1e-6 * unit, season)[first:] - base) / 1e-6 for unit in np.eye(4)])
        square, pull = slopes.T @ slopes, slopes.T @ base
        while True:
            step = np.linalg.lstsq(square + damping * np.diag(np.diag(square) + 1e-12), -pull, rcond=None)[0]
            new = loss(params + step)
            if new < now or damping > 1e8:
                break
            damping *= 10
        if not new < now:
            break
        done = now - new <= 1e-10 * now
        params, now, damping = params + step, new, max(damping / 10, 1e-9)
        if done:
            break
    return params, now / (len(w) - first)


def psi_weights(params: np.ndarray, season: int, horizon: int) -> np.ndarray:
    """Effect of an error on the level h steps later, differences undone."""
    phi, far_phi, theta, far_theta = params
    above = seasonal_polynomial(theta, far_theta, season)
    below = np.convolve(seasonal_polynomial(-phi, -far_phi, season), seasonal_polynomial(-1.0, -1.0, season))
    out = np.zeros(horizon)
    for h in range(horizon):
        out[h] = (above[h] if h < len(above) else 0.0) - sum(below[k] * out[h - k] for k in range(1, min(h, len(below) - 1) + 1))
    return out


def sarima(
    df: DataFrame, keys: Sequence[str], order: str, value: str, horizon: int, season: int = 12
) -> DataFrame:
    """(1,1,1)(1,1,1) seasonal product model with a 95 percent interval.

    Coefficients minimise the squared one-step errors, both product terms
    included; the interval uses the errors' variance and the psi weights.
    Series with too few seasons have no rows.
    """

    def model(y: np.ndarray):
        w = np.diff(y[season:] - y[:-season]) if len(y) > season else np.zeros(0)
        if len(w) < 2 * (season + 1) + 6:
            return None
        params, variance = fit_seasonal(w, season)
        own, errors = seasonal_polynomial(-params[0], -params[1], season), seasonal_polynomial(params[2], params[3], season)
        path, e, levels = list(w), list(innovations(w, params, season)), list(y)
        for _ in range(horizon):
            path.append(sum(errors[k] * e[-k] - own[k] * path[-k] for k in (1, season, season + 1)))
            e.append(0.0)
            levels.append(path[-1] + levels[-1] + levels[-season] - levels[-season - 1])
        mean = np.array(levels[len(y) :])
        band = 1.96 * np.sqrt(variance * np.cumsum(psi_weights(params, season, horizon) ** 2))
        return mean, mean - band, mean + band

    return _per_series(df, keys, order, value, horizon, model)


MODELS: dict[str, Forecast] = {
    "seasonal_naive": seasonal_naive,
    "holt_winters": holt_winters,
    "sarima": sarima,
}


def backtest_detail(
    df: DataFrame, keys: Sequence[str], order: str, value: str, model: str,
    horizon: int = 3, n_origins: int = 8, season: int = 12,
) -> DataFrame:
    """Errors per series and rolling origin; short training spans are skipped."""
    w = Window.partitionBy(*keys).orderBy(order)
    indexed = (
        df.where(F.col(value).isNotNull())
        .select(*keys, order, F.col(value).cast("double").alias("_v"), (F.row_number().over(w) - 1).alias("_i"))
        .withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    )
    origins = F.array(*[F.lit(k) for k in range(n_origins, 0, -1)])
    keyed = (
        indexed.withColumn("origin", F.explode(origins))
        .withColumn("_cut", F.col("_n") - horizon - (F.col("origin") - 1))
        .where(F.col("_cut") >= 2 * season + 4)
    )
    by = [*keys, "origin"]
    train = keyed.where(F.col("_i") < F.col("_cut"))
    actual = keyed.where(
        (F.col("_i") >= F.col("_cut")) & (F.col("_i") < F.col("_cut") + horizon)
    ).select(*by, (F.col("_i") - F.col("_cut")).alias("h"), F.col("_v").alias("_a"))
    predicted = MODELS[model](train, by, "_i", "_v", horizon, season)
    error = F.col("mean") - F.col("_a")
    magnitude = F.abs(F.col("_a"))
    covered = (F.col("_a") >= F.col("lo")) & (F.col("_a") <= F.col("hi"))
    return actual.join(predicted, [*by, "h"]).groupBy(*by).agg(
        F.avg(F.abs(error) / F.greatest(magnitude, F.lit(1.0))).alias("mape"),
        F.sum(F.abs(error)).alias("absolute_error"),
        F.sum(magnitude).alias("actual_units"),
        F.sum(error).alias("signed_error"),
        F.count(F.lit(1)).alias("n_predictions"),
        F.count_if(covered).alias("covered"),
    )


def backtest(
    df: DataFrame, keys: Sequence[str], order: str, value: str, model: str,
    horizon: int = 3, n_origins: int = 8, season: int = 12,
) -> DataFrame:
    """MAPE, WAPE, MAE, bias and interval coverage per series."""
    detail = backtest_detail(df, keys, order, value, model, horizon, n_origins, season)
    n = F.sum("n_predictions")
    return detail.groupBy(*keys).agg(
        F.avg("mape").alias("mape"),
        ratio(F.sum("absolute_error"), F.sum("actual_units")).alias("wape"),
        ratio(F.sum("absolute_error"), n).alias("mae"),
        ratio(F.sum("signed_error"), n).alias("bias"),
        ratio(F.sum("covered"), n).alias("interval_coverage"),
        F.count(F.lit(1)).alias("n_origins"),
    ).withColumn("model", F.lit(model))


def benchmark(
    df: DataFrame, keys: Sequence[str], order: str, value: str, horizon: int = 3, n_origins: int = 8
) -> DataFrame:
    """Backtest of every model with its skill against the naive one, ranked per series."""
    scores = None
    for model in MODELS:
        one = backtest(df, keys, order, value, model, horizon, n_origins)
        scores = one if scores is None else scores.unionByName(one)
    naive = F.max(F.when(F.col("model") == "seasonal_naive", F.col("mape"))).over(
        Window.partitionBy(*keys)
    )
    ranked = Window.partitionBy(*keys).orderBy(F.asc_nulls_last("mape"), "model")
    return scores.withColumn("naive_relative_skill", 1 - ratio("mape", naive)).withColumn(
        "rank", F.row_number().over(ranked)
    )


def cross_correlation(
    df: DataFrame, keys: Sequence[str], order: str, a: str, b: str, max_lag: int = 6, on_growth: bool = True
) -> DataFrame:
    """corr(a_t, b_{t-k}) per key and lag; a positive lag means b leads."""
    w = Window.partitionBy(*keys).orderBy(order)

    def series(c: str) -> Column:
        return ratio(c, F.lag(c).over(w)) - 1 if on_growth else F.col(c).cast("double")

    rows = df.select(
        *keys, F.row_number().over(w).alias("_i"), series(a).alias("_a"), series(b).alias("_b")
    )
    lags = F.explode(F.sequence(F.lit(-max_lag), F.lit(max_lag))).alias("lag")
    shifted = rows.select(*keys, lags, "_i", "_b").select(
        *keys, "lag", (F.col("_i") + F.col("lag")).alias("_i"), "_b"
    )
    return (
        rows.select(*keys, "_i", "_a")
        .join(shifted, [*keys, "_i"])
        .where(F.col("_a").isNotNull() & F.col("_b").isNotNull())
        .groupBy(*keys, "lag")
        .agg(F.corr("_a", "_b").alias("corr"))
    )


def nowcast_predictions(
    df: DataFrame, keys: Sequence[str], order: str = "date", test_months: int = 12, min_train: int = 18
) -> DataFrame:
    """One-step expanding regression of retail on dispatch and retail a year back.

    Each row's coefficients come from running sums over the rows before it.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    last_three = w.rowsBetween(-3, -1)
    y, x, h = F.col("_y"), F.col("_x"), F.col("_h")
    rows = df.select(
        *keys,
        order,
        F.col("retail").cast("double").alias("actual"),
        F.col("wholesale").cast("double").alias("_ws"),
        F.lag(F.col("retail").cast("double"), 12).over(w).alias("_l12"),
        F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))).alias("_back"),
    )
    complete = F.col("actual").isNotNull() & F.col("_ws").isNotNull() & F.col("_l12").isNotNull()
    rows = (
        rows.withColumn("_y", F.when(complete, F.col("actual")))
        .withColumn("_x", F.when(complete, F.col("_ws")))
        .withColumn("_h", F.when(complete, F.col("_l12")))
        .withColumn("_ratio", ratio("actual", "_l12"))
    )
    n = F.count(y).over(past)
    moments = rows.select(
        *keys,
        order,
        "actual",
        "_ws",
        "_l12",
        "_back",
        n.alias("_n"),
        F.avg(x).over(past).alias("_mx"),
        F.avg(h).over(past).alias("_mh"),
        F.avg(y).over(past).alias("_my"),
        (F.var_pop(x).over(past) * n).alias("_sxx"),
        (F.var_pop(h).over(past) * n).alias("_shh"),
        (F.var_pop(y).over(past) * n).alias("_syy"),
        (F.covar_pop(x, h).over(past) * n).alias("_sxh"),
        (F.covar_pop(x, y).over(past) * n).alias("_sxy"),
        (F.covar_pop(h, y).over(past) * n).alias("_shy"),
        F.coalesce(F.avg("_ratio").over(last_three), F.lit(1.0)).alias("_drift"),
    )
    c = fit2()
    return moments.where(
        (F.col("_back") <= test_months)
        & (F.col("_n") >= min_train)
        & F.col("_ws").isNotNull()
        & F.col("_l12").isNotNull()
    ).select(
        *keys,
        order,
        "actual",
        (c["b0"] + c["bx"] * F.col("_ws") + c["bh"] * F.col("_l12")).alias("nowcast"),
        (F.col("_l12") * F.col("_drift")).alias("baseline"),
    )


def nowcast_scores(predictions: DataFrame, keys: Sequence[str]) -> DataFrame:
    """MAPE of the nowcast and of the drift baseline, with the number of months."""
    return predictions.groupBy(*keys).agg(
        F.avg(ratio(F.abs(F.col("nowcast") - F.col("actual")), "actual")).alias("mape_nowcast"),
        F.avg(ratio(F.abs(F.col("baseline") - F.col("actual")), "actual")).alias("mape_baseline"),
        F.count(F.lit(1)).alias("n_oos"),
    )
