"""Descriptive statistics, inequality, rank-size structure and specialisation."""

from __future__ import annotations

from collections.abc import Sequence
from math import erfc, exp, pi, sqrt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from panelwright.functions.columns import UNIT_COLUMNS, normal_two_sided, ratio, total, xlnx
from panelwright.functions.ordered import prefix_sums, same_keys_join
from panelwright.session import cut_lineage


def hhi(df: DataFrame, keys: Sequence[str], share: str = "share") -> DataFrame:
    """Sum of squared shares times 10000; null shares drop out."""
    s = F.col(share)
    return df.groupBy(*keys).agg((F.coalesce(F.sum(s * s), F.lit(0.0)) * 10000).alias("hhi"))


def entropy_columns(share: str | Column) -> dict[str, Column]:
    """Aggregates for entropy in nats and entropy over ln(number of positive shares)."""
    s = F.col(share) if isinstance(share, str) else share
    h = -F.sum(xlnx(s))
    n = F.count_if(s > 0)
    return {"entropy": h, "entropy_norm": F.when(n > 1, h / F.ln(n.cast("double"))).otherwise(h), "n": n}


def shannon_entropy(df: DataFrame, keys: Sequence[str], share: str = "share") -> DataFrame:
    c = entropy_columns(share)
    return df.groupBy(*keys).agg(c["entropy"].alias("entropy"), c["entropy_norm"].alias("entropy_norm"))


def cagr(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Compound growth from first to last non-null value over (rows - 1) periods."""
    return (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys)
        .agg(
            F.min_by(value, order).alias("_first"),
            F.max_by(value, order).alias("_last"),
            F.count(F.lit(1)).alias("_n"),
        )
        .select(
            *keys,
            F.when(
                (F.col("_n") >= 2) & (F.col("_first") > 0),
                F.pow(ratio("_last", "_first"), 1.0 / (F.col("_n") - 1)) - 1,
            ).alias("cagr"),
        )
    )


def yoy_growth(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Growth against the previous row of the group."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("growth", ratio(value, F.lag(value).over(w)) - 1)


def seasonality_profile(df: DataFrame, keys: Sequence[str], value: str = "total_regs") -> DataFrame:
    """Mean month index (1 = average month of its year), its deviation and count."""
    in_year = Window.partitionBy(*keys, "year")
    indexed = df.withColumn("_index", ratio(value, F.avg(value).over(in_year)))
    return indexed.groupBy(*keys, "month").agg(
        F.avg("_index").alias("seasonal_index"),
        F.stddev_samp("_index").alias("std"),
        F.count("_index").alias("count"),
    )


def market_shares(df: DataFrame, keys: Sequence[str], entity: str, value: str) -> DataFrame:
    """Total and share per entity within the group."""
    grouped = df.groupBy(*keys, entity).agg(F.sum(value).alias("total"))
    whole = grouped.groupBy(*keys).agg(F.sum("total").alias("_whole"))
    return grouped.join(whole, list(keys)).withColumn("share", ratio("total", "_whole")).drop("_whole")


def concentration_series(df: DataFrame, time: str, entity: str, value: str) -> DataFrame:
    """HHI, entropy, normalised entropy and positive entities per period."""
    c = entropy_columns("share")
    return (
        market_shares(df, [time], entity, value)
        .groupBy(time)
        .agg(
            (F.sum(F.col("share") * F.col("share")) * 10000).alias("hhi"),
            c["entropy"].alias("entropy"),
            c["entropy_norm"].alias("entropy_norm"),
            c["n"].alias("n_entities"),
        )
    )


def summary_table(panel_year: DataFrame) -> DataFrame:
    """Latest full year (last year minus one) per state, with growth over the last six rows."""
    last = panel_year.where(F.col("total_regs").isNotNull()).agg(
        (F.max("year") - 1).alias("_full_year")
    )
    keep = ["state_name", "year", "total_regs", "ev_share", "cng_share", "hhi_oem"]
    recent = Window.partitionBy("state_code").orderBy(F.desc("year"))
    full = (
        panel_year.select("state_code", *keep)
        .withColumn("_one", F.lit(1))
        .join(last.withColumn("_one", F.lit(1)), "_one")
        .where(F.col("year") <= F.col("_full_year"))
        .withColumn("_back", F.row_number().over(recent))
        .where(F.col("_back") <= 6)
    )
    growth = cagr(full, ["state_code"], "year", "total_regs").withColumnRenamed("cagr", "cagr_5y")
    return (
        full.where(F.col("_back") == 1)
        .select("state_code", "state_name", F.col("year").alias("latest_year"), *keep[2:])
        .join(growth, "state_code")
    )


def gini(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Gini coefficient per group, from exact positions of the distinct values."""
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    placed = prefix_sums(counted, keys, value, {"_upto": "_c"})
    c = F.col("_c")
    before = F.col("_upto") - c
    positions = c * before + c * (c + 1) / 2.0
    x = F.col(value).cast("double")
    sums = placed.groupBy(*keys).agg(
        F.sum("_c").alias("_n"), F.sum(x * c).alias("_t"), F.sum(x * positions).alias("_w")
    )
    n, t, w = F.col("_n"), F.col("_t"), F.col("_w")
    return sums.select(
        *keys, F.try_divide(n + 1 - 2 * F.try_divide((n + 1) * t - w, t), n).alias("gini")
    )


def rank_size(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Descending rank and size with logs; sizes <= 0 leave after ranking."""
    counted = (
        df.where(F.col(value).isNotNull())
        .select(*keys, (-F.col(value)).alias("_neg"))
        .groupBy(*keys, "_neg")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    placed = prefix_sums(counted, keys, "_neg", {"_upto": "_c"}).where(F.col("_neg") < 0)
    # Ties are laid out in blocks, so one value never becomes one huge array.
    block = 10_000
    first = F.col("_upto") - F.col("_c")
    blocks = placed.select(
        *keys, "_neg", "_upto", F.explode(F.sequence(first, F.col("_upto") - 1, F.lit(block))).alias("_b")
    )
    ranked = blocks.select(
        *keys,
        F.explode(
            F.sequence(F.col("_b") + 1, F.least(F.col("_b") + block, F.col("_upto")))
        ).alias("rank"),
        (-F.col("_neg")).alias("size"),
    )
    return ranked.withColumn("log_rank", F.ln(F.col("rank").cast("double"))).withColumn(
        "log_size", F.ln(F.col("size").cast("double"))
    )


def zipf_exponent(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Slope, intercept and R2 of log size on log rank; null under three points."""
    enough = F.count(F.lit(1)) >= 3
    return rank_size(df, keys, value).groupBy(*keys).agg(
        F.when(enough, F.regr_slope("log_size", "log_rank")).alias("slope"),
        F.when(enough, F.regr_intercept("log_size", "log_rank")).alias("intercept"),
        F.when(enough, F.regr_r2("log_size", "log_rank")).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


def powerlaw_tail(df: DataFrame, keys: Sequence[str], value: str, most_ranges: int = 1024) -> DataFrame:
    """(keys, xmin, alpha, n_tail, ks): the power-law tail whose Kolmogorov-Smirnov distance is smallest.

    Every distinct value with a tail above it is a candidate, equal distances
    give the smallest.  Tail sums come from running sums.  The distinct values
    of a group lie in about as many ranges as each range has values; empirical
    and model distribution both rise, so a range's two ends bound every gap
    inside it.  A candidate whose gap at some end is beyond another's bound is
    out; the others look only into the ranges that can hold their largest gap.
    """
    keys = list(keys)
    x = F.col("_x")
    counted = (
        df.where(F.col(value) > 0)
        .groupBy(*keys, F.col(value).cast("double").alias("_x"))
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumns({"_cl": F.col("_c") * F.ln(x), "_u": F.lit(1).cast("long")})
    )
    running = prefix_sums(counted, keys, "_x", {"_upto": "_c", "_lupto": "_cl", "_place": "_u"})
    totals = running.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.sum("_cl").alias("_l"), F.sum("_u").alias("_v"))
    ranges = F.least(F.ceil(F.sqrt("_v")), F.lit(most_ranges))
    placed = same_keys_join(running, totals, keys).where(F.col("_n") >= 10)
    placed = cut_lineage(placed.withColumn("_range", F.floor((F.col("_place") - 1) * ranges / F.col("_v"))))
    candidates = (
        placed.withColumn("n_tail", F.col("_n") - F.col("_upto") + F.col("_c"))
        .withColumn("_sum", F.col("_l") - F.col("_lupto") + F.col("_cl") - F.col("n_tail") * F.ln(x))
        .where((F.col("_sum") > 1e-12) & (F.col("_upto") < F.col("_n")))
        .select(*keys, x.alias("xmin"), (1 + F.col("n_tail") / F.col("_sum")).alias("alpha"), "n_tail", (F.col("_upto") - F.col("_c")).alias("_below"))
    )

    def model(at: Column) -> Column:
        return 1 - F.pow(at / F.col("xmin"), 1 - F.col("alpha"))

    def seen(upto: Column) -> Column:
        return (upto - F.col("_below")) / F.col("n_tail")

    ends = placed.groupBy(*keys, "_range").agg(F.min("_x").alias("low"), F.max("_x").alias("high"), F.min(F.col("_upto") - F.col("_c")).alias("before"), F.max("_upto").alias("after"))
    per_key = ends.groupBy(*keys).agg(F.collect_list(F.struct("_range", "low", "high", "before", "after")).alias("_ends"))

    def bounds(r: Column) -> Column:
        low, before = F.greatest(r["low"], F.col("xmin")), F.greatest(r["before"], F.col("_below"))
        least = F.greatest(F.abs(seen(r["after"]) - model(r["high"])), F.abs(seen(before) - model(low)))
        most = F.greatest(seen(r["after"]) - model(low), model(r["high"]) - seen(before))
        return F.struct(r["_range"].alias("_range"), least.alias("least"), most.alias("most"))

    own = F.transform(F.filter("_ends", lambda r: r["high"] >= F.col("xmin")), bounds)
    bounded = same_keys_join(candidates, per_key, keys).withColumn("_bounds", own).drop("_ends")
    bounded = cut_lineage(
        bounded.withColumns({"_least": F.array_max(F.transform("_bounds", lambda r: r["least"])), "_most": F.array_max(F.transform("_bounds", lambda r: r["most"]))})
        .withColumn("_open", F.transform(F.filter("_bounds", lambda r: r["most"] > F.col("_least")), lambda r: r["_range"]))
        .drop("_bounds")
    )
    limit = bounded.groupBy(*keys).agg(F.min("_most").alias("_limit"))
    left = same_keys_join(bounded, limit, keys).where(F.col("_least") <= F.col("_limit") + 1e-12)
    named = ["xmin", "alpha", "n_tail", "_below", "_least"]
    opened = left.select(*keys, *named, F.explode_outer("_open").alias("_range"))
    values = placed.groupBy(*keys, "_range").agg(F.collect_list(F.struct("_x", "_upto", "_c")).alias("_values"))

    def gap(v: Column) -> Column:
        at = model(v["_x"])
        return F.greatest(F.abs(seen(v["_upto"]) - at), F.abs(seen(v["_upto"] - v["_c"]) - at))

    inside = F.array_max(F.transform(F.filter("_values", lambda v: v["_x"] >= F.col("xmin")), gap))
    exact = same_keys_join(opened, values, [*keys, "_range"], "left").withColumn("_gap", F.greatest("_least", F.coalesce(inside, F.lit(0.0))))
    gaps = exact.groupBy(*keys, "xmin", "alpha", "n_tail").agg(F.max("_gap").alias("ks"))
    best = gaps.groupBy(*keys).agg(F.min_by(F.struct("xmin", "alpha", "n_tail", "ks"), F.struct("ks", "xmin")).alias("_best"))
    return best.select(*keys, "_best.*")


def _mills(c: float) -> tuple[float, float]:
    """Hazard of the standard normal at c, and how far it lies above c."""
    if c < 3:
        hazard = exp(-c * c / 2) / sqrt(2 * pi) / (erfc(c / sqrt(2)) / 2)
        return hazard, hazard - c
    rest = 0.0
    for k in range(80, 1, -1):
        rest = k / (c + rest)
    over = 1 / (c + rest)
    return c + over, over


def tail_normal(mean: float, variance: float) -> tuple[float, float, float]:
    """(c, sigma, hazard) of the normal cut off below 0 whose mean and variance are given.

    The cut lies c standard deviations above the centre.  The two moments fix
    the likeliest fit.  A spread of the mean or more is that of an exponential
    tail, to which the cut normal only tends; it is met at c = 1000.
    """
    wanted = min(variance / mean**2, 1.0)
    low, high = -40.0, 1000.0
    for _ in range(200):
        c = (low + high) / 2
        hazard, over = _mills(c)
        if (1 - hazard * over) / over**2 < wanted:
            low = c
        else:
            high = c
    hazard, over = _mills(c)
    return c, mean / over, hazard


def _fitted_tails(moments: DataFrame) -> DataFrame:
    """Adds _cut, _sd, _hazard of the lognormal on each tail; a row per group."""

    def run(batches):
        for frame in batches:
            made = [tail_normal(m, max(q - m * m, 1e-300)) for m, q in zip(frame["_mean"], frame["_square"], strict=True)]
            yield frame.assign(**{name: [float(f[i]) for f in made] for i, name in enumerate(("_cut", "_sd", "_hazard"))})

    schema = T.StructType([*moments.schema.fields, *[T.StructField(n, T.DoubleType()) for n in ("_cut", "_sd", "_hazard")]])
    return moments.mapInPandas(run, schema)


def powerlaw_fit(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Power-law tail by smallest KS distance, with its likelihood ratio against a lognormal.

    Both densities are those of the tail: the lognormal is the likeliest one cut
    off at xmin, found from the tail's sums of log and squared log.  The ratio
    is divided by its standard error, positive for the power law; the p-value
    is two-sided.
    """
    keys = list(keys)
    fit = cut_lineage(powerlaw_tail(df, keys, value))
    over = F.ln(F.col("_x") / F.col("xmin"))
    sizes = df.where(F.col(value) > 0).groupBy(*keys, F.col(value).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    tail = same_keys_join(sizes, fit, keys).where(F.col("_x") >= F.col("xmin")).withColumn("_t", over)
    found = [*keys, "xmin", "alpha", "n_tail", "ks"]
    weighted = lambda c: F.sum(F.col("_c") * c)
    t = F.col("_t")
    moments = tail.groupBy(*found).agg((weighted(t) / F.sum("_c")).alias("_mean"), (weighted(t * t) / F.sum("_c")).alias("_square"))
    both = same_keys_join(tail.select(*keys, "_c", "_t"), cut_lineage(_fitted_tails(moments)), keys)
    power = F.ln(F.col("alpha") - 1) - (F.col("alpha") - 1) * t
    u = t / F.col("_sd")
    lognormal = F.ln(F.col("_hazard") / F.col("_sd")) - F.col("_cut") * u - u * u / 2
    d = F.col("_d")
    ratio_stats = both.withColumn("_d", power - lognormal).groupBy(*found).agg(weighted(d).alias("_lr"), weighted(d * d).alias("_d2"))
    n = F.col("n_tail")
    spread = F.sqrt(F.greatest(F.col("_d2") - F.col("_lr") * F.col("_lr") / n, F.lit(0.0)))
    return (
        ratio_stats.withColumn("lr_powerlaw_vs_lognormal", F.try_divide(F.col("_lr"), spread))
        .withColumn("lr_pvalue", normal_two_sided("lr_powerlaw_vs_lognormal"))
        .withColumn("sigma", (F.col("alpha") - 1) / F.sqrt(n))
        .drop("_lr", "_d2")
    )


def fuel_mix_entropy(df: DataFrame, units: Sequence[str] = tuple(UNIT_COLUMNS)) -> DataFrame:
    """Entropy of the unit columns in each row; an empty row gives 0."""
    whole = total([F.col(c).cast("double") for c in units])
    terms = [F.coalesce(xlnx(F.try_divide(F.col(c).cast("double"), whole)), F.lit(0.0)) for c in units]
    return df.withColumn("fuel_entropy", -total(terms))


def with_grand_total(df: DataFrame, value: str, out: str) -> DataFrame:
    """Adds the sum over all rows: a one-row aggregate joined on a constant key."""
    grand = df.agg(F.sum(value).alias(out)).withColumn("_one", F.lit(1))
    return df.withColumn("_one", F.lit(1)).join(grand, "_one").drop("_one")


def rca(df: DataFrame, region: str, product: str, value: str) -> DataFrame:
    """Balassa index (region, product, rca) of the pairs that occur; absent pairs are zero."""
    cell = df.groupBy(region, product).agg(F.sum(value).cast("double").alias("_v"))
    rows = cell.groupBy(region).agg(F.sum("_v").alias("_row"))
    cols = cell.groupBy(product).agg(F.sum("_v").alias("_col"))
    share = with_grand_total(cols, "_col", "_all").select(product, ratio("_col", "_all").alias("_share"))
    return (
        cell.join(rows, region)
        .join(share, product)
        .select(region, product, ratio(ratio("_v", "_row"), "_share").alias("rca"))
    )


def rca_matrix(indices: DataFrame, region: str, product: str, products: Sequence[str]) -> DataFrame:
    """Wide output of :func:`rca` with zeros for absent pairs."""
    return indices.groupBy(region).pivot(product, list(products)).agg(F.first("rca")).fillna(0.0)


def complexity_indices(
    indices: DataFrame, region: str, product: str, threshold: float = 1.0, rounds: int = 18
) -> DataFrame:
    """Method of reflections on the binary table rca >= threshold.

    Both sides live in one node table, so a round is one join and one average;
    the loop cuts its lineage every six rounds.  Scores are z-scored per side
    with the population deviation.
    """
    kept = indices.where(F.col("rca") >= threshold)
    a = kept.select(
        F.concat(F.lit("r:"), region).alias("src"), F.concat(F.lit("p:"), product).alias("dst")
    )
    links = cut_lineage(a.unionByName(a.select(F.col("dst").alias("src"), F.col("src").alias("dst"))))
    degree = links.groupBy("src").agg(F.count(F.lit(1)).cast("double").alias("degree"))
    # The rounds preserve each side's degree-weighted mean, which the z-score drops:
    # taking it out first keeps full precision as the values draw together.
    side_of = F.substring("src", 1, 1)
    centre = degree.groupBy(side_of.alias("_side")).agg(
        (F.sum(F.col("degree") * F.col("degree")) / F.sum("degree")).alias("_c")
    )
    state = degree.withColumn("_side", side_of).join(centre, "_side").select(
        F.col("src").alias("dst"), (F.col("degree") - F.col("_c")).alias("v")
    )
    for i in range(1, rounds + 1):
        state = links.join(state, "dst").groupBy("src").agg(F.avg("v").alias("v"))
        state = state.withColumnRenamed("src", "dst")
        if i % 6 == 0:
            state = cut_lineage(state)
    kind = F.when(F.substring("node", 1, 1) == "r", region).otherwise(product)
    scored = (
        state.withColumnRenamed("dst", "node")
        .join(degree.withColumnRenamed("src", "node"), "node")
        .withColumn("kind", kind)
    )
    # one row per side
    side = scored.groupBy("kind").agg(F.avg("v").alias("_mean"), F.stddev_pop("v").alias("_spread"))
    z = F.when(F.col("_spread") > 0, (F.col("v") - F.col("_mean")) / F.col("_spread")).otherwise(0.0)
    return scored.join(side, "kind").select(F.expr("substring(node, 3)").alias("node"), "kind", z.alias("complexity"), "degree")


def variable_availability(
    df: DataFrame, entity: str, variables: Sequence[str], tolerance: float = 1e-9
) -> DataFrame:
    """Presence of each variable and the median of its within-entity deviation."""
    long = df.select(entity, *[F.col(v).cast("double").alias(v) for v in variables]).unpivot(
        [entity], list(variables), "variable", "_v"
    )
    per_entity = long.groupBy("variable", entity).agg(
        F.count("_v").alias("_present"),
        F.count(F.lit(1)).alias("_rows"),
        F.stddev_samp("_v").alias("_sd"),
    )
    within = F.percentile("_sd", F.lit(0.5))
    return per_entity.groupBy("variable").agg(
        F.sum("_present").alias("non_missing"),
        (1 - F.sum("_present") / F.sum("_rows")).alias("missing_pct"),
        within.alias("within_state_sd"),
        F.coalesce(within < tolerance, F.lit(False)).alias("near_invariant"),
    )


def time_to_level(
    df: DataFrame, keys: Sequence[str], step: str, level: str, marks: dict[str, float]
) -> DataFrame:
    """Final level per entity and the first step at or above each mark."""
    return df.groupBy(*keys).agg(
        F.max_by(level, step).alias("final_level"),
        *[F.min(F.when(F.col(level) >= mark, F.col(step))).alias(out) for out, mark in marks.items()],
    )


def channel_stress(
    run: DataFrame, baseline: DataFrame, keys: Sequence[str], period: str, recovered: float = 0.98
) -> DataFrame:
    """Trough, recovery, cover range and bullwhip of an observed channel against a baseline.

    ``run`` has (keys, period, retail, production, cover); ``baseline`` (keys, period, retail).
    """
    base = baseline.select(*keys, period, F.col("retail").alias("_base"))
    joined = run.join(base, [*keys, period])
    trough = joined.groupBy(*keys).agg(
        F.min_by(F.struct(F.col(period).alias("at"), ratio("retail", "_base").alias("level")),
                 F.struct("retail", period)).alias("_trough"),
        F.sum(F.col("_base") - F.col("retail")).alias("retail_vs_baseline_gap"),
    )
    after = joined.join(trough, list(keys)).where(F.col(period) > F.col("_trough.at"))
    recovery = after.groupBy(*keys).agg(
        F.min(F.when(F.col("retail") >= recovered * F.col("_base"), F.col(period))).alias("recovery_month")
    )
    w = Window.partitionBy(*keys).orderBy(period)
    moves = run.select(
        *keys,
        "cover",
        (ratio("production", F.lag("production").over(w)) - 1).alias("_dp"),
        (ratio("retail", F.lag("retail").over(w)) - 1).alias("_dr"),
    )
    spread = moves.groupBy(*keys).agg(
        F.max("cover").alias("peak_inventory_cover"),
        F.min("cover").alias("min_inventory_cover"),
        (F.var_samp("_dp") / F.greatest(F.var_samp("_dr"), F.lit(1e-12))).alias("bullwhip_ratio"),
    )
    return (
        trough.join(recovery, list(keys), "left")
        .join(spread, list(keys))
        .select(
            *keys,
            F.col("_trough.at").alias("trough_month"),
            F.col("_trough.level").alias("trough_retail_vs_baseline"),
            "retail_vs_baseline_gap",
            "recovery_month",
            "peak_inventory_cover",
            "min_inventory_cover",
            "bullwhip_ratio",
        )
    )
