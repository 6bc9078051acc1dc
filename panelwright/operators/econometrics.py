"""Correlation, panel regression, causality, difference-in-differences, threshold scans."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.columns import ratio
from panelwright.functions.linalg import cross_products, f_sf, fit2, moments2, norm_sf2, unpack
from panelwright.functions.ordered import average_ranks
from panelwright.operators.series import smooth
from panelwright.session import cut_lineage, drop_table


def correlation_matrix(df: DataFrame, columns: Sequence[str], method: str = "spearman") -> DataFrame:
    """Pairwise-complete correlations, long form with both orders and the diagonal."""
    pairs = [
        F.struct(
            F.lit(a).alias("a"), F.lit(b).alias("b"),
            F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y"),
        )
        for a, b in combinations(columns, 2)
    ]
    long = (
        df.select(F.explode(F.array(*pairs)).alias("p"))
        .select("p.*")
        .where(F.col("x").isNotNull() & F.col("y").isNotNull())
    )
    x, y = "x", "y"
    if method == "spearman":
        long = cut_lineage(long)
        both = long.unpivot(["a", "b"], ["x", "y"], "side", "v")
        ranks = cut_lineage(average_ranks(both, ["a", "b", "side"], "v"))
        for c in ("x", "y"):
            own = ranks.where(F.col("side") == c)
            long = long.join(
                own.select("a", "b", F.col("v").alias(c), F.col("rank").alias(f"r{c}")), ["a", "b", c]
            )
        x, y = "rx", "ry"
    elif method != "pearson":
        raise ValueError(f"unknown method {method}")
    upper = long.groupBy("a", "b").agg(F.corr(x, y).alias("corr"), F.count(F.lit(1)).alias("n"))
    lower = upper.select(F.col("b").alias("a"), F.col("a").alias("b"), "corr", "n")
    same = df.select(
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("a"), F.col(c).cast("double").alias("x")) for c in columns])
        ).alias("p")
    ).select("p.*")
    diagonal = same.groupBy("a").agg(
        F.when(F.var_pop("x") > 0, 1.0).alias("corr"), F.count("x").alias("n")
    )
    return upper.unionByName(lower).unionByName(
        diagonal.select("a", F.col("a").alias("b"), "corr", "n")
    )


def absorbed(rows: DataFrame, columns: Sequence[str], by: Sequence[str], tolerance: float = 1e-10) -> DataFrame:
    """The columns less their effects of each key in ``by`` (one key or two).

    With two keys the effects of one are found from what the other leaves, in
    turn, until no effect moves by more than ``tolerance`` standard deviations.
    Only the effects are kept between the turns, one array per key; the rows
    stay as they are until the end.
    """
    rows = cut_lineage(rows)
    scale = rows.agg(*[F.stddev_pop(c) for c in columns]).first()
    size = [float(d) if d else 1.0 for d in scale]
    values = F.array(*[F.col(c) / F.lit(d) for c, d in zip(columns, size, strict=True)])
    narrow = cut_lineage(rows.select(*by, values.alias("_v")))

    def less(left: Column, right: Column) -> Column:
        return F.zip_with(left, right, lambda a, b: a - b)

    def effects(key: str, other: str | None, known: DataFrame | None) -> DataFrame:
        source, own = narrow, F.col("_v")
        if known is not None:
            source = narrow.join(known.withColumnRenamed("_effect", "_known"), other)
            own = less(own, F.col("_known"))
        means = source.select(key, own.alias("_own")).groupBy(key).agg(F.array(*[F.avg(F.get("_own", F.lit(i))) for i in range(len(columns))]).alias("_effect"))
        return cut_lineage(means)

    found = {by[0]: effects(by[0], None, None)}
    if len(by) == 2:
        found[by[1]] = effects(by[1], by[0], found[by[0]])
        while True:
            first = effects(by[0], by[1], found[by[1]])
            second = effects(by[1], by[0], first)
            met = second.join(found[by[1]].withColumnRenamed("_effect", "_old"), by[1])
            moved = met.agg(F.max(F.array_max(F.transform(less(F.col("_effect"), F.col("_old")), F.abs)))).first()[0]
            drop_table(found[by[0]])
            drop_table(found[by[1]])
            found = {by[0]: first, by[1]: second}
            if moved is None or moved <= tolerance:
                break
    out = rows
    for k, key in enumerate(by):
        out = out.join(found[key].withColumnRenamed("_effect", f"_effect{k}"), key)
    left = {c: F.col(c) - sum((F.get(f"_effect{k}", F.lit(i)) for k in range(len(by))), F.lit(0.0)) * F.lit(size[i]) for i, c in enumerate(columns)}
    return out.withColumns(left).drop(*[f"_effect{k}" for k in range(len(by))])


def panel_ols(
    df: DataFrame,
    y: str,
    x: Sequence[str],
    entity: str = "state_code",
    time: str = "year",
    entity_effects: bool = True,
    time_effects: bool = False,
) -> DataFrame:
    """Fixed-effects OLS with entity-clustered errors, equal to the dummy-variable fit.

    Effects are absorbed, not estimated as dummies, so calendars and entities of
    any length do; their number enters the degrees of freedom.  The constant is
    a term only without effects.  Spark reduces the rows to cross-product sums
    and, per entity, to scores; only the system of the regressors is solved on
    the driver.  Where entities or degrees of freedom do not suffice, errors are
    not numbers.
    """
    rows = cut_lineage(
        df.select(entity, time, *[F.col(c).cast("double").alias(c) for c in [y, *x]]).dropna()
    )
    size = rows.agg(
        F.count(F.lit(1)), F.count_distinct(entity), F.count_distinct(time), F.var_pop(y), *[F.stddev_samp(c) for c in x]
    ).first()
    n, groups, periods, var_y, deviations = size[0], size[1], size[2], size[3], list(size[4:])
    by = [entity] * entity_effects + [time] * time_effects
    if by:
        design = cut_lineage(absorbed(rows, [y, *x], by))
        regressors = list(x)
        k = len(x) + groups * entity_effects + periods * time_effects - (len(by) - 1)
    else:
        design = rows.withColumn("const", F.lit(1.0))
        regressors = ["const", *x]
        k = len(regressors)
    columns = [*regressors, y]
    sums = cross_products(design.withColumn("_all", F.lit(1)), ["_all"], columns).first()
    schema = "term string, coef double, se double, p double, ci_low double, ci_high double, effect_per_1sd double, n bigint, r2 double"
    if sums is None:
        return df.sparkSession.createDataFrame([], schema)
    moments = unpack(sums["xp"], len(columns))
    bread = np.linalg.pinv(moments[:-1, :-1])
    beta = bread @ moments[:-1, -1]
    sse = moments[-1, -1] - beta @ moments[:-1, -1]
    fitted: Column = F.lit(0.0)
    for b, c in zip(beta, regressors, strict=True):
        fitted = fitted + F.lit(float(b)) * F.col(c)
    scores = design.withColumn("_e", F.col(y) - fitted).groupBy(entity).agg(
        *[F.sum(F.col(c) * F.col("_e")).alias(c) for c in regressors]
    )
    meat_sums = cross_products(scores.withColumn("_all", F.lit(1)), ["_all"], regressors).first()
    meat = unpack(meat_sums["xp"], len(regressors))
    factor = groups / (groups - 1) * (n - 1) / (n - k) if groups > 1 and n > k else float("nan")
    se = np.sqrt(np.maximum(np.diag(bread @ meat @ bread), 0) * factor)
    r2 = 1 - sse / (var_y * n) if var_y else float("nan")
    out = []
    for i, c in enumerate(regressors):
        sd = (deviations[x.index(c)] or 0.0) if c in x else 1.0
        z = beta[i] / se[i] if se[i] > 0 else float("nan")
        out.append(
            (c, float(beta[i]), float(se[i]), norm_sf2(z), float(beta[i] - 1.959963984540054 * se[i]),
             float(beta[i] + 1.959963984540054 * se[i]), float(beta[i] * sd), int(n), float(r2))
        )
    return df.sparkSession.createDataFrame(out, schema)


def granger(
    df: DataFrame, keys: Sequence[str], order: str, cause: str, effect: str, maxlag: int = 4
) -> DataFrame:
    """SSR F test per key and lag: does the cause's past add to the effect's own past?

    All lags run in one job; each (key, lag) becomes one row of cross-product
    sums and is solved where that row lives.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    centre = Window.partitionBy(*keys)
    both = df.where(F.col(cause).isNotNull() & F.col(effect).isNotNull())
    scaled = both.select(
        *keys,
        order,
        F.coalesce(ratio(F.col(effect) - F.avg(effect).over(centre), F.stddev_pop(effect).over(centre)), F.lit(0.0)).alias("_y"),
        F.coalesce(ratio(F.col(cause) - F.avg(cause).over(centre), F.stddev_pop(cause).over(centre)), F.lit(0.0)).alias("_x"),
    )
    lags = range(1, maxlag + 1)
    columns = ["_1", "_y", *[f"_y{i}" for i in lags], *[f"_x{i}" for i in lags]]
    lagged = scaled.select(
        *keys,
        F.row_number().over(w).alias("_i"),
        F.lit(1.0).alias("_1"),
        "_y",
        *[F.coalesce(F.lag("_y", i).over(w), F.lit(0.0)).alias(f"_y{i}") for i in lags],
        *[F.coalesce(F.lag("_x", i).over(w), F.lit(0.0)).alias(f"_x{i}") for i in lags],
    )
    # The lag grid follows the windows: inside the same select it would run first.
    lagged = lagged.withColumn("lag", F.explode(F.array(*[F.lit(i) for i in lags]))).where(
        F.col("_i") > F.col("lag")
    )
    sums = cross_products(lagged, [*keys, "lag"], columns)

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            stats = []
            for xp, lag, n in zip(batch["xp"], batch["lag"], batch["n"], strict=True):
                m = unpack(xp, len(columns))

                def ssr(index: list[int], m: np.ndarray = m) -> float:
                    b = np.linalg.pinv(m[np.ix_(index, index)]) @ m[index, 1]
                    return float(m[1, 1] - b @ m[index, 1])

                own = [0, *range(2, 2 + lag)]
                full = [*own, *range(2 + maxlag, 2 + maxlag + lag)]
                freedom = n - 2 * lag - 1
                if freedom <= 0:
                    stats.append((None, None))
                    continue
                restricted, unrestricted = ssr(own), ssr(full)
                if unrestricted <= 1e-10 * m[1, 1]:
                    stats.append((None, None))
                    continue
                f = max((restricted - unrestricted) / lag / (unrestricted / freedom), 0.0)
                stats.append((f, f_sf(f, lag, freedom)))
            out = batch.drop(columns=["xp"])
            out["f_stat"] = [s[0] for s in stats]
            out["f_pvalue"] = [s[1] for s in stats]
            yield out

    kinds = dict(sums.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return sums.mapInPandas(
        solve, f"{schema + ', ' if schema else ''}lag int, n bigint, f_stat double, f_pvalue double"
    )


def _did_sides(
    df: DataFrame, entities: Sequence[str], event: str, value: str, entity: str, date: str, pre: int, post: int
) -> DataFrame:
    at = F.lit(event).cast("date")
    rows = df.where(
        F.col(entity).isin(list(entities))
        & F.col(value).isNotNull()
        & (F.col(date) >= F.add_months(at, -pre))
        & (F.col(date) < F.add_months(at, post))
    )
    after = F.col(date) >= at
    return rows.groupBy(F.col(entity).alias("entity")).agg(
        F.sum(F.when(~after, F.col(value))).alias("s0"),
        F.count(F.when(~after, F.col(value))).alias("n0"),
        F.sum(F.when(after, F.col(value))).alias("s1"),
        F.count(F.when(after, F.col(value))).alias("n1"),
    )


def did_placebos(
    df: DataFrame, controls: Sequence[str], event: str, value: str,
    entity: str = "state_code", date: str = "date", pre_months: int = 6, post_months: int = 6,
) -> DataFrame:
    """Each control as if treated, against the other controls (totals minus its own rows)."""
    sides = _did_sides(df, controls, event, value, entity, date, pre_months, post_months)
    sums = ["s0", "n0", "s1", "n1"]
    totals = sides.agg(*[F.sum(c).alias(f"t_{c}") for c in sums]).withColumn("_one", F.lit(1))

    def rest(c: str) -> Column:
        return F.col(f"t_{c}") - F.coalesce(F.col(c), F.lit(0))

    own = ratio("s1", "n1") - ratio("s0", "n0")
    others = ratio(rest("s1"), rest("n1")) - ratio(rest("s0"), rest("n0"))
    return sides.withColumn("_one", F.lit(1)).join(totals, "_one").select(
        "entity", (own - others).alias("placebo")
    )


def did(
    df: DataFrame, treated: Sequence[str], controls: Sequence[str], event: str, value: str,
    entity: str = "state_code", date: str = "date", pre_months: int = 6, post_months: int = 6,
) -> DataFrame:
    """Difference in differences over [event - pre, event + post); means are over rows."""
    both = _did_sides(df, [*treated, *controls], event, value, entity, date, pre_months, post_months)
    is_treated = F.col("entity").isin(list(treated))
    is_control = F.col("entity").isin(list(controls))

    def change(flag: Column) -> Column:
        s0, n0, s1, n1 = (F.sum(F.when(flag, F.col(c))) for c in ("s0", "n0", "s1", "n1"))
        return ratio(s1, n1) - ratio(s0, n0)

    effect = both.agg(
        change(is_treated).alias("treated_change"), change(is_control).alias("control_change")
    ).withColumn("att", F.col("treated_change") - F.col("control_change"))
    placebos = did_placebos(df, controls, event, value, entity, date, pre_months, post_months)
    one = F.lit(1).alias("_one")
    ranked = (
        placebos.where(F.col("placebo").isNotNull())
        .select(one, "placebo")
        .join(effect.select(one, "att"), "_one")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.count_if(F.abs("placebo") >= F.abs("att")).alias("_over"),
        )
    )
    at = F.lit(event).cast("date")
    return (
        effect.withColumn("_one", F.lit(1))
        .join(ranked.withColumn("_one", F.lit(1)), "_one")
        .select(
            "att",
            "treated_change",
            "control_change",
            F.when(F.col("_n") > 0, (F.col("_over") + 1) / (F.col("_n") + 1)).alias("placebo_rank_p"),
            F.lit(len(treated)).alias("n_treated"),
            F.lit(len(controls)).alias("n_controls"),
            F.add_months(at, -pre_months).alias("window_start"),
            F.add_months(at, post_months).alias("window_end"),
        )
    )


def _rbf_costs(y: np.ndarray):
    """Segment cost of one series under an rbf kernel, from 2-D prefix sums."""
    d = (y[:, None] - y[None, :]) ** 2
    median = np.median(d[np.triu_indices(len(y), 1)]) if len(y) > 1 else 0.0
    scaled = np.clip(d * (1 / median if median else 1.0), 1e-2, 1e2)
    np.fill_diagonal(scaled, 0.0)
    prefix = np.zeros((len(y) + 1, len(y) + 1))
    prefix[1:, 1:] = np.exp(-scaled).cumsum(0).cumsum(1)

    def cost(a: int, b: int) -> float:
        inside = prefix[b, b] - prefix[a, b] - prefix[b, a] + prefix[a, a]
        return (b - a) - inside / (b - a)

    return cost


def changepoints(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    value: str,
    n_bkps: int | None = None,
    penalty: float | None = None,
    min_size: int = 2,
    step: int = 5,
) -> DataFrame:
    """Breaks of each calendar series: binary segmentation with a fixed number of
    breaks, or the optimal partition under a penalty (default 3 ln n).

    Splits lie on multiples of ``step``.  Output: one row (keys, position) per break.
    """
    kinds = dict(df.dtypes)

    def breaks(y: np.ndarray) -> list[int]:
        n = len(y)
        cost = _rbf_costs(y)

        def splits(a: int, b: int) -> list[int]:
            return [s for s in range(a, b, step) if s - a >= min_size and b - s >= min_size]

        if n_bkps is not None:
            bounds = [0, n]
            for _ in range(n_bkps):
                options = [
                    (cost(a, b) - cost(a, s) - cost(s, b), -s)
                    for a, b in zip(bounds, bounds[1:], strict=False)
                    for s in splits(a, b)
                ]
                if not options:
                    break
                bounds = sorted([*bounds, -max(options)[1]])
            return bounds[1:-1]
        pen = 3 * np.log(n) if penalty is None else penalty
        ends = [e for e in range(step, n, step) if e >= min_size] + [n]
        best: dict[int, tuple[float, int]] = {0: (0.0, 0)}
        for e in ends:
            best[e] = min(
                (best[s][0] + cost(s, e) + pen, s) for s in list(best) if e - s >= min_size
            )
        path, at = [], n
        while best[at][1] > 0:
            at = best[at][1]
            path.append(at)
        return path[::-1]

    def per_series(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values(order)[value].dropna().to_numpy(dtype=float)
        found = breaks(y) if len(y) >= 2 * min_size else []
        out = pd.DataFrame({"position": found}, dtype="int64")
        for name, part in zip(keys, key, strict=True):
            out[name] = part
        return out[[*keys, "position"]]

    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return (
        df.select(*keys, order, F.col(value).cast("double").alias(value))
        .groupBy(*keys)
        .applyInPandas(per_series, f"{schema}, position bigint")
    )


def threshold_scan(
    df: DataFrame, keys: Sequence[str], order: str, share: str, min_side: int = 5, candidates: int = 25
) -> DataFrame:
    """Hinge regression of the change on the lagged share over candidate thresholds.

    The candidates (quantiles 20% to 80% of the lagged share) become a key, so
    every entity and threshold is fitted in one aggregate; the smallest SSE wins.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    moves = (
        df.where(F.col(share).isNotNull())
        .select(
            *keys,
            (F.col(share) - F.lag(share).over(w)).alias("_y"),
            F.lag(share).over(w).cast("double").alias("_x"),
        )
        .where(F.col("_y").isNotNull())
    )
    points = F.array(*[F.lit(float(q)) for q in np.linspace(0.2, 0.8, candidates)])
    linear = moves.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (
            F.count(F.lit(1)) * (F.var_pop("_y") - F.try_divide(F.covar_pop("_x", "_y") * F.covar_pop("_x", "_y"), F.var_pop("_x")))
        ).alias("_sse0"),
        F.array_distinct(F.percentile("_x", points)).alias("_taus"),
    )
    hinge = F.greatest(F.col("_x") - F.col("tau"), F.lit(0.0))
    expanded = (
        moves.join(linear, list(keys))
        .where(F.col("n") >= 2 * min_side + 2)
        .select(*keys, "_x", "_y", "_sse0", F.explode("_taus").alias("tau"))
        .withColumn("_h", hinge)
    )
    fits = (
        expanded.groupBy(*keys, "_sse0", "tau")
        .agg(*moments2("_x", "_h", "_y"), F.count_if(F.col("_h") > 0).alias("_above"))
        .where((F.col("_above") >= min_side) & (F.col("_n") - F.col("_above") >= min_side))
    )
    c = fit2()
    # Errors that differ by rounding noise count as equal; the smaller threshold wins.
    error = F.round(ratio("sse", "_sse0"), 10)
    best = (
        fits.select(*keys, "tau", "_sse0", c["bx"].alias("bx"), c["bh"].alias("bh"), c["sse"].alias("sse"))
        .where(F.col("sse").isNotNull())
        .groupBy(*keys)
        .agg(F.min_by(F.struct("tau", "bx", "bh", "sse"), F.struct(error, F.col("tau"))).alias("_b"))
    )
    return linear.join(best, list(keys), "left").select(
        *keys,
        F.col("_b.tau").alias("tau"),
        F.col("_b.bx").alias("slope_below"),
        (F.col("_b.bx") + F.col("_b.bh")).alias("slope_above"),
        F.col("_b.bh").alias("hinge_coef"),
        F.when(F.col("_sse0") > 0, 1 - F.col("_b.sse") / F.col("_sse0")).alias("sse_gain"),
        "n",
    )


def tipping_summary(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    share: str,
    min_share_reached: float = 0.01,
    windows: Sequence[int] = (3,),
) -> DataFrame:
    """Threshold scan of the smoothed share, for every smoothing window at once.

    Entities whose smoothed share never reaches the minimum drop out.
    """
    names = [f"smooth_{w}" for w in windows]
    smoothed = smooth(df, keys, order, share, windows).unpivot(
        [*keys, order], names, "_name", "_s"
    ).withColumn("smooth_window", F.regexp_replace("_name", "smooth_", "").cast("int"))
    by = [*keys, "smooth_window"]
    peaks = smoothed.groupBy(*by).agg(F.max("_s").alias("max_share")).where(
        F.col("max_share") >= min_share_reached
    )
    scanned = threshold_scan(smoothed.join(peaks.select(*by), by, "left_semi"), by, order, "_s")
    return scanned.join(peaks, by)


def with_verdict(tips: DataFrame, gain: float = 0.1) -> DataFrame:
    verdict = (
        F.when(F.col("sse_gain") < gain, "no clear threshold")
        .when(F.col("hinge_coef") > 0, "feedback threshold")
        .otherwise("saturation threshold")
    )
    return tips.where(F.col("sse_gain").isNotNull()).withColumn("verdict", verdict)


def in_eras(df: DataFrame, date: str, eras: dict[str, tuple[str | None, str | None]]) -> DataFrame:
    """Repeats each row for every era (label -> first and last date) that holds it."""
    labels = []
    for label, (lo, hi) in eras.items():
        inside = F.lit(True)
        if lo is not None:
            inside = inside & (F.col(date) >= F.lit(lo).cast("date"))
        if hi is not None:
            inside = inside & (F.col(date) <= F.lit(hi).cast("date"))
        labels.append(F.when(inside, F.lit(label)))
    return df.withColumn("era", F.explode(F.array_compact(F.array(*labels))))


def era_verdicts(tips: DataFrame, gain: float = 0.1) -> DataFrame:
    """Entities scanned and thresholds of each sign per era."""
    known = tips.where(F.col("sse_gain").isNotNull())
    robust = F.col("sse_gain") >= gain
    return known.groupBy("era").agg(
        F.count(F.lit(1)).alias("states_scanned"),
        F.count_if(robust & (F.col("hinge_coef") > 0)).alias("feedback_thresholds"),
        F.count_if(robust & (F.col("hinge_coef") < 0)).alias("saturation_thresholds"),
    )


def threshold_stability(
    tips: DataFrame, keys: Sequence[str], base_window: int = 3, gain: float = 0.1, spread: float = 0.03
) -> DataFrame:
    """Deviation of the threshold across smoothing windows and the resulting verdict."""
    base = F.col("smooth_window") == base_window
    by_entity = tips.groupBy(*keys).agg(
        F.stddev_samp("tau").alias("tau_sd"),
        F.max(F.when(base, F.col("sse_gain"))).alias("sse_gain"),
        F.max(F.when(base, F.col("hinge_coef"))).alias("hinge_coef"),
    )
    verdict = (
        F.when((F.col("sse_gain") < gain) | (F.col("tau_sd") > spread), "no credible transition")
        .when(F.col("hinge_coef") > 0, "stable feedback threshold")
        .otherwise("stable saturation transition")
    )
    return by_entity.withColumn("verdict", verdict)


def _independent(gram: np.ndarray) -> list[int]:
    """Columns, the first always, that the ones kept before them do not already give."""
    kept = [0]
    for j in range(1, len(gram)):
        inner, cross = gram[np.ix_(kept, kept)], gram[kept, j]
        if gram[j, j] - cross @ np.linalg.solve(inner, cross) > 1e-8 * gram[j, j]:
            kept.append(j)
    return kept


def _logit_sums(design: DataFrame, columns: Sequence[str], beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log likelihood, score and information of ``label`` at ``beta``, in one aggregation."""
    k = len(columns)
    eta = sum((F.lit(float(b)) * F.col(c) for b, c in zip(beta, columns, strict=True)), F.lit(0.0))
    mu = 1 / (1 + F.exp(-F.col("_eta")))
    rows = design.withColumn("_eta", eta).withColumn("_left", F.col("label") - mu).withColumn("_w", mu * (1 - mu))
    fit = F.col("label") * F.col("_eta") - F.greatest("_eta", F.lit(0.0)) - F.log1p(F.exp(-F.abs("_eta")))
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    values = rows.agg(
        F.sum(fit), *[F.sum(F.col("_left") * F.col(c)) for c in columns],
        *[F.sum(F.col("_w") * F.col(a) * F.col(b)) for a, b in pairs],
    ).first()
    return float(values[0]), np.array(values[1 : k + 1], dtype=float), unpack(values[k + 1 :], k)


def _logit(design: DataFrame, columns: Sequence[str], gram: np.ndarray, beta: np.ndarray, max_rounds: int = 100):
    """Log likelihood, coefficients and their variances by Newton's steps.

    Both are None where the rows are separated: the steps then go on for ever
    and the information vanishes beside the ``gram`` of the columns.
    """
    scale = np.sqrt(np.outer(gram.diagonal(), gram.diagonal()))
    llf, score, information = _logit_sums(design, columns, beta)
    for _ in range(max_rounds):
        if np.linalg.eigvalsh(information / scale)[0] < 1e-13:
            break
        step = np.linalg.solve(information, score)
        if np.abs(step).max() < 1e-9:
            return llf, beta, np.linalg.inv(information).diagonal()
        sums = _logit_sums(design, columns, beta + step)
        while sums[0] < llf - 1e-9 * abs(llf):
            step = step / 2
            sums = _logit_sums(design, columns, beta + step)
        beta, (llf, score, information) = beta + step, sums
    return llf, None, None


def discrete_hazard_model(
    risk_set: DataFrame, covariates: Sequence[str], add_time_trend: bool = True
) -> DataFrame:
    """Logit hazard on z-scored covariates and centred year, one row per term.

    The fit is distributed, each step one aggregation; fit statistics repeat on
    every row.  A term that the ones before it already give has no estimate.
    No term has one where no finite estimate exists, because no row switched,
    all did, or the terms tell them apart: ``llf`` is its limit then.
    """
    # The fit passes over the rows once per iteration.
    known = cut_lineage(risk_set.dropna(subset=list(covariates)))
    spread = known.agg(
        *[F.avg(c).alias(f"m_{c}") for c in covariates],
        *[F.stddev_pop(c).alias(f"s_{c}") for c in covariates],
        F.avg("year").alias("m_year"),
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum("switched"), F.lit(0)).alias("events"),
    ).first()
    n, events = int(spread["rows"]), int(spread["events"])
    names = [*covariates, "year_c"] if add_time_trend else list(covariates)
    estimates: dict[str, tuple[float, float, float]] = {}
    llf = 0.0 if n else None
    pseudo = None
    if 0 < events < n:
        terms = []
        for c in covariates:
            mean, sd = spread[f"m_{c}"], spread[f"s_{c}"]
            # The spread of equal values is rounding noise.
            scaled = (F.col(c) - F.lit(mean)) / F.lit(sd) if sd > 1e-12 * abs(mean) else F.lit(0.0)
            terms.append(scaled.alias(c))
        if add_time_trend:
            terms.append((F.col("year") - F.lit(spread["m_year"])).alias("year_c"))
        design = known.select(F.col("switched").cast("double").alias("label"), F.lit(1.0).alias("_one"), *terms)
        columns = ["_one", *names]
        gram = unpack(cross_products(design, [], columns).first()["xp"], len(columns))
        kept = _independent(gram)
        columns, gram = [columns[i] for i in kept], gram[np.ix_(kept, kept)]
        start = np.zeros(len(kept))
        start[0] = np.log(events / (n - events))
        llf, beta, variance = _logit(design, columns, gram, start)
        alone = events * np.log(events / n) + (n - events) * np.log(1 - events / n)
        pseudo = float(1 - llf / alone)
        if beta is not None:
            for name, b, v in list(zip(columns, beta, variance, strict=True))[1:]:
                estimates[name] = (float(b), float(np.exp(b)), norm_sf2(b / v**0.5))
    rows = [(name, *estimates.get(name, (None, None, None)), n, events, llf, pseudo) for name in names]
    return risk_set.sparkSession.createDataFrame(
        rows,
        "term string, coef double, odds_ratio_per_sd double, p_value double, n_obs bigint, "
        "n_events bigint, llf double, pseudo_r2 double",
    )
