"""Window and time-series operators.

Every function works on rows at one per (keys, period): panels collapse their
facts to that grain first, so a window partition holds one calendar series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.columns import normal_two_sided, ratio, row_entropy


def guarded(aggregate: Column, value: str, frame, least: int) -> Column:
    """Windowed aggregate that is null with fewer than ``least`` non-null values."""
    return F.when(F.count(value).over(frame) >= least, aggregate.over(frame))


def rolling(
    df: DataFrame, keys: Sequence[str], order: str, value: str, out: str, aggregate: Column,
    first: int, last: int, least: int = 1,
) -> DataFrame:
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(first, last)
    return df.withColumn(out, guarded(aggregate, value, frame, least))


def centred(window: int) -> tuple[int, int]:
    """Row bounds of a centred window; an even one reaches one row further back."""
    return -(window // 2), window - window // 2 - 1


def detrend(
    df: DataFrame, keys: Sequence[str], order: str, value: str, window: int = 12, out: str = "residual"
) -> DataFrame:
    """Value minus its centred rolling mean."""
    first, last = centred(window)
    trend = rolling(
        df, keys, order, value, "_trend", F.avg(value), first, last, max(2, window // 2)
    )
    return trend.withColumn(out, F.col(value) - F.col("_trend")).drop("_trend")


def _lag1_correlation(values: Column) -> Column:
    n = F.size(values) - 1
    a, b = F.slice(values, F.lit(1), n), F.slice(values, F.lit(2), n)

    def add(items: Column) -> Column:
        return F.aggregate(items, F.lit(0.0), lambda s, x: s + x)

    ma, mb = add(a) / n, add(b) / n
    cross = add(F.zip_with(a, b, lambda x, y: (x - ma) * (y - mb)))
    va = add(F.transform(a, lambda x: (x - ma) * (x - ma)))
    vb = add(F.transform(b, lambda y: (y - mb) * (y - mb)))
    return F.when(n >= 2, F.try_divide(cross, F.sqrt(va * vb)))


def early_warning_signals(
    df: DataFrame, keys: Sequence[str], order: str, value: str, window: int = 24, detrend_window: int = 12
) -> DataFrame:
    """Rolling variance, lag-1 autocorrelation and skewness of the detrended series."""
    series = detrend(df, keys, order, value, detrend_window)
    frame = Window.partitionBy(*keys).orderBy(order).rowsBetween(-(window - 1), 0)
    r = "residual"
    n = F.count(r).over(frame)
    enough = n >= window // 2
    correction = F.sqrt((n * (n - 1)).cast("double")) / (n - 2)
    return series.select(
        *keys,
        order,
        F.col(value).cast("double").alias("value"),
        r,
        F.when(enough & (n >= 2), F.var_samp(r).over(frame)).alias("variance"),
        F.when(enough, _lag1_correlation(F.collect_list(r).over(frame))).alias("autocorr1"),
        F.when(enough & (n >= 3), F.skewness(r).over(frame) * correction).alias("skewness"),
    )


def kendall_tau_trend(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Kendall tau-b of the series against time with a normal-approximation p-value.

    One array per series and period-by-period comparison inside the row: the
    work is quadratic in the length of one calendar series and nothing is
    emitted per pair.  Null under five points.
    """
    series = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(F.array_sort(F.collect_list(F.struct(F.col(order), F.col(value).alias("v")))).alias("_s"))
        .select(*keys, F.transform("_s", lambda s: s["v"].cast("double")).alias("_y"))
    )
    y = F.col("_y")
    n = F.size(y)
    score = F.aggregate(
        F.transform(
            y,
            lambda x, i: F.aggregate(
                F.slice(y, i + 2, n), F.lit(0.0), lambda s, later: s + F.signum(later - x)
            ),
        ),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    ties = F.transform(F.array_distinct(y), lambda d: F.size(F.filter(y, lambda x: x == d)).cast("double"))

    def over_ties(f) -> Column:
        return F.aggregate(ties, F.lit(0.0), lambda s, t: s + f(t))

    scored = series.select(
        *keys,
        n.cast("double").alias("_n"),
        score.alias("_score"),
        over_ties(lambda t: t * (t - 1) / 2).alias("_t0"),
        over_ties(lambda t: t * (t - 1) * (2 * t + 5)).alias("_t1"),
    )
    size = F.col("_n")
    pairs = size * (size - 1) / 2
    spread = (size * (size - 1) * (2 * size + 5) - F.col("_t1")) / 18
    enough = size >= 5
    return scored.select(
        *keys,
        F.when(enough, F.try_divide(F.col("_score"), F.sqrt(pairs * (pairs - F.col("_t0"))))).alias("tau"),
        F.when(enough, normal_two_sided(F.try_divide(F.col("_score"), F.sqrt(spread)))).alias("pvalue"),
        size.cast("bigint").alias("n"),
    )


def quantile_bins(df: DataFrame, keys: Sequence[str], value: str, bins: int, out: str) -> DataFrame:
    """Right-closed bins at linear quantiles of the group; repeated edges merge."""
    points = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    edges = df.groupBy(*keys).agg(F.array_distinct(F.percentile(value, points)).alias("_edges"))
    below = F.size(F.filter("_edges", lambda e: e < F.col(value)))
    return (
        df.join(edges, list(keys), "left")
        .withColumn(out, F.when(F.col(value).isNotNull(), F.greatest(below - 1, F.lit(0))))
        .drop("_edges")
    )


def volatility_regimes(
    df: DataFrame, keys: Sequence[str], order: str, value: str, window: int = 12, n_regimes: int = 2
) -> DataFrame:
    """Rolling deviation of growth, cut at its own quantiles."""
    w = Window.partitionBy(*keys).orderBy(order)
    grown = df.select(*keys, order, (ratio(value, F.lag(value).over(w)) - 1).alias("_g"))
    vol = rolling(
        grown, keys, order, "_g", "volatility", F.stddev_samp("_g"), -(window - 1), 0, window // 2
    ).drop("_g")
    return quantile_bins(vol, keys, "volatility", n_regimes, "vol_regime")


def smooth(
    df: DataFrame, keys: Sequence[str], order: str, value: str, windows: Sequence[int]
) -> DataFrame:
    """Centred rolling means (at least one value), one column per window."""
    out = df
    for window in windows:
        first, last = centred(window)
        out = rolling(out, keys, order, value, f"smooth_{window}", F.avg(value), first, last)
    return out


def recent_acceleration_summary(
    df: DataFrame, share: str, entity: str = "state_code", order: str = "year", noise_pp: float = 0.1
) -> DataFrame:
    """Latest first and second difference of a share in points, with a verdict."""
    w = Window.partitionBy(entity).orderBy(order)
    moved = (
        df.where(F.col(share).isNotNull())
        .select(entity, order, F.col(share).alias("share"))
        .withColumn("change_pp", (F.col("share") - F.lag("share").over(w)) * 100)
        .withColumn("acceleration_pp", F.col("change_pp") - F.lag("change_pp").over(w))
        .where(F.col("acceleration_pp").isNotNull())
    )
    latest = moved.groupBy(entity).agg(
        F.max_by(F.struct(order, "share", "change_pp", "acceleration_pp"), order).alias("_last")
    )
    verdict = (
        F.when(F.col("change_pp") < -noise_pp, "contracting")
        .when(F.col("acceleration_pp") > noise_pp, "accelerating")
        .when(F.col("acceleration_pp") < -noise_pp, "decelerating")
        .otherwise("steady")
    )
    return latest.select(entity, "_last.*").withColumn("momentum_verdict", verdict)


REGIMES = ["fossil_dominant", "cng_transitioned", "ev_emerging", "multi_fuel"]


def classify_regimes(
    panel_year: DataFrame, ev: float = 0.05, cng: float = 0.15, entropy: float = 1.0
) -> DataFrame:
    """Ordered rule per row: EV, then CNG, then fuel entropy, else fossil."""
    shares = ["petrol_share", "diesel_share", "cng_share", "ev_share", "hybrid_share"]
    return panel_year.withColumn("fuel_entropy", row_entropy(shares)).select(
        "state_code",
        "state_name",
        "year",
        F.when(F.col("ev_share") >= ev, "ev_emerging")
        .when(F.col("cng_share") >= cng, "cng_transitioned")
        .when(F.col("fuel_entropy") >= entropy, "multi_fuel")
        .otherwise("fossil_dominant")
        .alias("regime"),
        "fuel_entropy",
    )


def regime_transitions(regimes: DataFrame) -> DataFrame:
    """Long transition table (regime, next_regime, pairs, probability) of observed pairs."""
    w = Window.partitionBy("state_code").orderBy("year")
    pairs = (
        regimes.withColumn("next_regime", F.lead("regime").over(w))
        .where(F.col("next_regime").isNotNull())
        .groupBy("regime", "next_regime")
        .agg(F.count(F.lit(1)).alias("pairs"))
    )
    whole = Window.partitionBy("regime")
    return pairs.withColumn("probability", ratio("pairs", F.sum("pairs").over(whole)))


def regime_transition_matrix(regimes: DataFrame, names: Sequence[str] = tuple(REGIMES)) -> DataFrame:
    """Fixed square matrix; observed rows fill with zero, unobserved rows stay null."""
    wide = (
        regime_transitions(regimes)
        .groupBy("regime")
        .pivot("next_regime", list(names))
        .agg(F.first("probability"))
        .fillna(0.0)
    )
    rows = regimes.sparkSession.createDataFrame([(n,) for n in names], "regime string")
    return rows.join(wide, "regime", "left")


def absorbing_regimes(transitions: DataFrame, threshold: float = 0.95) -> DataFrame:
    return transitions.where(
        (F.col("regime") == F.col("next_regime")) & (F.col("probability") >= threshold)
    ).select("regime", "probability")


def transition_years(calendar: DataFrame, regime: str = "regime", label: str = "regime_label") -> DataFrame:
    """Rows whose regime differs from the previous year of the state."""
    w = Window.partitionBy("state_code").orderBy("year")
    return (
        calendar.withColumn("_prev", F.lag(regime).over(w))
        .withColumn("from_regime", F.lag(label).over(w))
        .where(F.col("_prev").isNotNull() & (F.col("_prev") != F.col(regime)))
        .select("state_code", "year", "from_regime", F.col(label).alias("to_regime"))
    )


def observed_adoption_years(
    panel_year: DataFrame, share: str = "ev_share", threshold: float = 0.02
) -> DataFrame:
    return (
        panel_year.where(F.col(share) >= threshold)
        .groupBy("state_code")
        .agg(F.min("year").alias("adoption_year"))
    )


def prepare_adoption_series(
    df: DataFrame, keys: Sequence[str], order: str, counts: str, drop_last: int = 2, onset_units: float = 50.0
) -> DataFrame:
    """Cumulative adoption from onset, re-indexed from 0, without the last lagging rows."""
    forward = Window.partitionBy(*keys).orderBy(order)
    backward = Window.partitionBy(*keys).orderBy(F.desc(order))
    whole = Window.partitionBy(*keys)
    kept = (
        df.withColumn("_back", F.row_number().over(backward))
        .withColumn("_rows", F.count(F.lit(1)).over(whole))
        .where((F.col("_back") > drop_last) | (F.col("_rows") <= drop_last))
    )
    running = forward.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cumulative = F.sum(F.coalesce(F.col(counts).cast("double"), F.lit(0.0))).over(running)
    started = kept.select(*keys, order, cumulative.alias("cum")).where(F.col("cum") >= onset_units)
    return started.select(
        *keys, (F.row_number().over(forward) - 1).cast("bigint").alias("t"), order, "cum"
    )


def lagged(df: DataFrame, keys: Sequence[str], order: str, value: str, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(f"{value}_lag{k}", F.lag(value, k).over(w))


def build_risk_set(
    calendar: DataFrame, panel_year: DataFrame, covariates: Sequence[str], origin: str | int | None = None
) -> DataFrame:
    """Rows of each state up to and including its first switch away from its first regime."""
    first = calendar.groupBy("state_code").agg(F.min_by("regime", "year").alias("origin_regime"))
    marked = calendar.join(first, "state_code").withColumn(
        "switched", (F.col("regime") != F.col("origin_regime")).cast("int")
    )
    if origin is not None:
        marked = marked.where(F.col("origin_regime") == F.lit(origin))
    switch = marked.groupBy("state_code").agg(
        F.min(F.when(F.col("switched") == 1, F.col("year"))).alias("_switch")
    )
    risk = (
        marked.join(switch, "state_code")
        .where(F.col("_switch").isNull() | (F.col("year") <= F.col("_switch")))
        .select("state_code", "year", "switched", "origin_regime")
    )
    return risk.join(
        panel_year.select("state_code", "year", *covariates), ["state_code", "year"], "left"
    )


def kaplan_meier(risk_set: DataFrame) -> DataFrame:
    """At risk, switched, hazard and survival per year (one row per calendar year)."""
    yearly = risk_set.groupBy("year").agg(
        F.count(F.lit(1)).alias("n_at_risk"), F.sum("switched").alias("n_switched")
    )
    hazard = F.col("n_switched") / F.greatest(F.col("n_at_risk"), F.lit(1))
    upto = (
        Window.partitionBy(F.lit(0)).orderBy("year")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    survivors = F.sum(F.when(F.col("hazard") < 1, F.ln(1 - F.col("hazard")))).over(upto)
    ended = F.max((F.col("hazard") >= 1).cast("int")).over(upto)
    return yearly.withColumn("hazard", hazard).withColumn(
        "survival", F.when(ended == 1, 0.0).otherwise(F.exp(F.coalesce(survivors, F.lit(0.0))))
    )


def regime_calendar(regimes: DataFrame, years: Sequence[int], label: str = "regime") -> DataFrame:
    """State x year labels, one column per year, with the last label for ordering."""
    wide = (
        regimes.groupBy("state_code")
        .pivot("year", list(years))
        .agg(F.first(label))
        .withColumnsRenamed({str(y): f"y{y}" for y in years})
    )
    last = regimes.groupBy("state_code").agg(F.max_by(label, "year").alias("last_label"))
    return wide.join(last, "state_code")
