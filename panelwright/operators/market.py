"""Parameterised market queries on the panels: filters, moves, leaders, comparisons."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelwright.functions.columns import FUEL_COLUMNS, month_start, ratio, total
from panelwright.functions.ordered import RANGE_ROWS, average_ranks, numbered
from panelwright.operators.stats import with_grand_total
from panelwright.plans.panels import period_status
from panelwright.session import cut_lineage


def stored_or_recomputed_status(spark: SparkSession, table: str, panel_month: DataFrame) -> DataFrame:
    """The stored period status when the table exists, else the same rows from the panel."""
    if spark.catalog.tableExists(table):
        return spark.table(table).where(F.col("source") == "vahan")
    return period_status(panel_month)


def cutoff(panel_month: DataFrame) -> DataFrame:
    """One row: first and last period, latest complete year, months seen in the last year."""
    status = period_status(panel_month)
    year = F.col("period").cast("int")
    last = F.struct("observed_month_count", "completeness_status", "warning_text")
    ends = (
        panel_month.where(F.col("state_code") == "ALL")
        .agg(
            F.date_format(F.min("date"), "MMMM yyyy").alias("first_period"),
            F.date_format(F.max("date"), "MMMM yyyy").alias("latest_period"),
        )
        .withColumn("_one", F.lit(1))
    )
    years = status.agg(
        F.max(F.when(F.col("completeness_status") == "complete", year)).alias("latest_complete_year"),
        F.max_by(last, year).alias("_last"),
    ).withColumn("_one", F.lit(1))
    return ends.join(years, "_one").select(
        F.lit("Vahan registrations").alias("source"),
        "first_period",
        "latest_period",
        "latest_complete_year",
        F.col("_last.observed_month_count").alias("observed_months_latest_year"),
        F.col("_last.completeness_status").alias("status"),
        F.col("_last.warning_text").alias("warning"),
    )


def state_dimension(dim_state: DataFrame) -> DataFrame:
    return (
        dim_state.where(F.col("state_code") != "ALL")
        .select("state_code", "state_name", "zone")
        .orderBy("state_name")
    )


def maker_options(facts: DataFrame) -> DataFrame:
    return facts.where(F.col("maker").isNotNull()).select("maker").distinct().orderBy("maker")


def market_monthly(
    facts: DataFrame,
    panel_month: DataFrame,
    years: tuple[int, int],
    states: Sequence[str] = (),
    oems: Sequence[str] = (),
    fuels: Sequence[str] = (),
) -> DataFrame:
    """Monthly market in a filter context; the total covers the selected fuels only.

    Several states are summed and no state means ``ALL``.  A maker filter needs
    the facts; everything else reads the month panel.
    """
    chosen = [f for f in fuels if f in FUEL_COLUMNS]
    wanted = F.col("state_code").isin(list(states) or ["ALL"]) & F.col("year").between(*years)
    if oems:
        rows = facts.where(wanted & F.col("maker").isin(list(oems)))
        if chosen:
            rows = rows.where(F.col("fuel").isin(chosen))
        units = [
            F.sum(F.when(F.col("fuel") == f, F.col("count")).otherwise(0)).alias(FUEL_COLUMNS[f])
            for f in (chosen or FUEL_COLUMNS)
        ]
        grouped = rows.groupBy("year", "month").agg(F.sum("count").alias("total_regs"), *units)
    else:
        columns = [FUEL_COLUMNS[f] for f in chosen] or list(FUEL_COLUMNS.values())
        whole = total([F.sum(c) for c in columns]) if chosen else F.sum("total_regs")
        grouped = (
            panel_month.where(wanted)
            .groupBy("year", "month")
            .agg(whole.alias("total_regs"), *[F.sum(c).alias(c) for c in columns])
        )
    return grouped.withColumn("date", month_start())


def market_annual(monthly: DataFrame) -> DataFrame:
    """Annual sums, fuel shares of the scoped total, growth to the previous year."""
    units = [c for c in FUEL_COLUMNS.values() if c in monthly.columns]
    annual = monthly.groupBy("year").agg(*[F.sum(c).alias(c) for c in ["total_regs", *units]])
    shares = [
        ratio(c, "total_regs").alias(f"{f.lower().replace(' ', '_')}_share")
        for f, c in FUEL_COLUMNS.items()
        if c in units
    ]
    # One row per calendar year by now, so a single ordered window is enough.
    w = Window.partitionBy(F.lit(0)).orderBy("year")
    growth = (ratio("total_regs", F.lag("total_regs").over(w)) - 1).alias("yoy_growth")
    return annual.select("*", *shares, growth)


def state_snapshot(
    panel_year: DataFrame, dim_state: DataFrame, year: int, states: Sequence[str] = ()
) -> DataFrame:
    rows = panel_year.where((F.col("year") == year) & (F.col("state_code") != "ALL"))
    if states:
        rows = rows.where(F.col("state_code").isin(list(states)))
    return (
        rows.select(
            "state_code", "state_name", "total_regs", "yoy_growth", "ev_share", "ev_share_chg_pp",
            "cng_share", "cng_share_chg_pp",
        )
        .join(dim_state.select("state_code", "zone", "geojson_name"), "state_code")
        .orderBy(F.desc("total_regs"), "state_code")
    )


def state_profile(
    state: str,
    through_year: int,
    panel_year: DataFrame,
    panel_month: DataFrame,
    maker_share: DataFrame,
    context: DataFrame,
    events: DataFrame,
) -> dict[str, DataFrame]:
    """The frames of one state's profile up to a year."""
    here = F.col("state_code") == state
    upto = here & (F.col("year") <= through_year)
    return {
        "annual": panel_year.where(upto).orderBy("year"),
        "monthly": panel_month.where(upto).orderBy("date"),
        "oems": maker_share.where(upto)
        .select("year", "maker", "regs", "share", "share_chg_pp", "rnk")
        .orderBy("year", "rnk"),
        "context": context.where(here),
        "peers": peer_states(context, state),
        "events": events.where(F.col("state_code").isin(state, "ALL")).orderBy("date", "event_id"),
    }


def peer_states(context: DataFrame, state: str, limit: int = 6) -> DataFrame:
    """Nearest states by income ratio, urban gap and zone.

    Null urban shares count as 0 and a null income leaves the distance null.
    The single target row meets the others on a constant key.
    """
    target = context.where(F.col("state_code") == state).select(
        F.lit(1).alias("_one"),
        F.col("zone").alias("_zone"),
        F.col("real_pc_income_inr").alias("_income"),
        F.col("urban_pct").alias("_urban"),
    )
    quotient = F.try_divide(
        F.expr("nullif(real_pc_income_inr, 0)"), F.expr("nullif(_income, 0)")
    )
    distance = (
        F.abs(F.ln(quotient))
        + F.abs(F.coalesce("urban_pct", F.lit(0.0)) - F.coalesce("_urban", F.lit(0.0))) / 100
        + F.when(F.col("zone") == F.col("_zone"), 0.0).otherwise(0.25)
    )
    return (
        context.where(F.col("state_code") != state)
        .withColumn("_one", F.lit(1))
        .join(target, "_one")
        .withColumn("peer_distance", distance)
        .drop("_one", "_zone", "_income", "_urban")
        .orderBy(F.asc_nulls_last("peer_distance"), "state_code")
        .limit(limit)
    )


def oem_profile(
    facts: DataFrame, maker_share: DataFrame, maker: str, through_year: int
) -> dict[str, DataFrame]:
    """National history, fuel split and state strengths of one maker."""
    national = facts.where((F.col("state_code") == "ALL") & (F.col("year") <= through_year))
    own = national.where(F.col("maker") == maker)
    market = national.groupBy("year").agg(F.sum("count").alias("_market"))
    annual = (
        own.groupBy("year")
        .agg(F.sum("count").alias("regs"))
        .join(market, "year")
        .select("year", "regs", ratio("regs", "_market").alias("share"))
    )
    states = maker_share.where(
        (F.col("maker") == maker) & (F.col("state_code") != "ALL") & (F.col("year") <= through_year)
    ).select("state_code", "state_name", "year", "regs", "share", "rnk")
    return {
        "annual": annual.orderBy("year"),
        "fuels": own.groupBy("year", "fuel").agg(F.sum("count").alias("regs")).orderBy("year", "fuel"),
        "states": states.orderBy("year", F.desc("share"), "state_code"),
    }


def top_absolute(df: DataFrame, value: str, tie: Sequence[str], limit: int) -> DataFrame:
    """Largest absolute values first, ties by key."""
    return df.orderBy(F.desc_nulls_last(F.abs(F.col(value))), *tie).limit(limit)


def largest_moves(
    panel_year: DataFrame, maker_share: DataFrame, year: int, limit: int = 8
) -> dict[str, DataFrame]:
    states = panel_year.where((F.col("state_code") != "ALL") & (F.col("year") == year)).select(
        "state_code", "state_name", "total_regs", "yoy_growth", "ev_share_chg_pp", "cng_share_chg_pp"
    )
    oems = maker_share.where((F.col("state_code") == "ALL") & (F.col("year") == year)).select(
        "maker", "regs", "share", "share_chg_pp", "rank_chg"
    )
    return {
        "states": top_absolute(states, "yoy_growth", ["state_code"], limit),
        "oems": top_absolute(oems, "share_chg_pp", ["maker"], limit),
    }


def data_health(spark: SparkSession, status: DataFrame, availability: DataFrame) -> dict[str, DataFrame]:
    """Period status, reference status and the tables of the catalogue."""
    names = [t.name for t in spark.catalog.listTables()]
    tables = spark.createDataFrame([(n,) for n in sorted(names)], "table_name string")
    return {
        "periods": status.orderBy("period"),
        "references": availability.orderBy("status", "dataset"),
        "tables": tables,
    }


def market_leader(facts: DataFrame, states: Sequence[str], year: int) -> DataFrame:
    return (
        facts.where(F.col("state_code").isin(list(states)) & (F.col("year") == year))
        .groupBy("maker")
        .agg(F.sum("count").alias("regs"))
        .orderBy(F.desc("regs"), "maker")
        .limit(1)
    )


def latest_ratio(retail_wholesale: DataFrame) -> DataFrame:
    known = retail_wholesale.where(F.col("ws_retail_ratio").isNotNull())
    return known.agg(
        F.max("date").alias("date"), F.max_by("ws_retail_ratio", "date").alias("ws_retail_ratio")
    )


def leading_fuel(annual: DataFrame) -> DataFrame:
    """Largest fuel share per row; ties go to the first fuel in fixed order."""
    best = F.greatest(*[F.col(c) for c in FUEL_COLUMNS.values()])
    name: Column = F.lit(None).cast("string")
    for fuel, c in reversed(FUEL_COLUMNS.items()):
        name = F.when(F.col(c) == best, fuel).otherwise(name)
    return annual.select("year", name.alias("leading_fuel"), ratio(best, "total_regs").alias("share"))


def fuel_moves(annual: DataFrame, year: int) -> DataFrame:
    """Share of each fuel in a year and its change in points, largest change first."""
    now, before = F.col("year") == year, F.col("year") == year - 1
    long = annual.where(F.col("year").isin(year, year - 1)).unpivot(
        ["year", "total_regs"], list(FUEL_COLUMNS.values()), "fuel", "units"
    )
    share = ratio("units", "total_regs")
    moved = long.groupBy("fuel").agg(
        F.max(F.when(now, share)).alias("share"),
        ((F.max(F.when(now, share)) - F.max(F.when(before, share))) * 100).alias("change_pp"),
    )
    return top_absolute(moved, "change_pp", ["fuel"], len(FUEL_COLUMNS))


def model_moves(wholesale: DataFrame, year: int, limit: int = 15) -> DataFrame:
    """Unit change per model between two years; a missing prior year counts as 0."""
    full = wholesale.where((F.col("coverage") == "full") & F.col("year").isin(year, year - 1))
    pivoted = full.groupBy("model").agg(
        F.sum(F.when(F.col("year") == year, F.col("qty"))).alias("current_units"),
        F.sum(F.when(F.col("year") == year - 1, F.col("qty"))).alias("prior_units"),
    )
    change = F.col("current_units") - F.coalesce("prior_units", F.lit(0))
    return top_absolute(pivoted.withColumn("unit_change", change), "unit_change", ["model"], limit)


def recent_events(events: DataFrame, limit: int = 8) -> DataFrame:
    return (
        events.select("event_id", "date", "category", "label", "state_code")
        .orderBy(F.desc("date"), "event_id")
        .limit(limit)
    )


def period_mode(national_month: DataFrame, mode: str, as_share: bool = False) -> DataFrame:
    """National trend by month, rolling 3 or 12, year to date, calendar or fiscal year."""
    units = list(FUEL_COLUMNS.values())
    columns = [*units, "total_regs"]
    calendar = Window.partitionBy(F.lit(0)).orderBy("date")
    if mode in ("rolling_3", "rolling_12"):
        size = int(mode.split("_")[1])
        frame = calendar.rowsBetween(-(size - 1), 0)
        out = national_month.select(
            "date",
            *[F.when(F.count(c).over(frame) >= size, F.sum(c).over(frame)).alias(c) for c in columns],
        )
    elif mode == "ytd":
        frame = (
            Window.partitionBy("year").orderBy("date")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow)
        )
        out = national_month.select("date", *[F.sum(c).over(frame).alias(c) for c in columns])
    elif mode == "calendar_year":
        out = national_month.groupBy("year").agg(*[F.sum(c).alias(c) for c in columns])
        out = out.withColumn("date", F.make_date("year", F.lit(12), F.lit(1))).drop("year")
    elif mode == "fiscal_year":
        out = national_month.groupBy("fy").agg(*[F.sum(c).alias(c) for c in columns])
        out = out.withColumn(
            "date", F.make_date(F.substring("fy", 1, 4).cast("int"), F.lit(4), F.lit(1))
        ).drop("fy")
    elif mode == "month":
        out = national_month.select("date", *columns)
    else:
        raise ValueError(f"unknown period mode {mode}")
    out = out.withColumn("other_unclassified", F.col("total_regs") - total([F.col(c) for c in units]))
    if as_share:
        for c in [*units, "other_unclassified"]:
            out = out.withColumn(c, ratio(c, "total_regs"))
    return out


def seasonally_adjusted(df: DataFrame, keys: Sequence[str], value: str = "total_regs") -> DataFrame:
    """Value over its month mean times the overall mean."""
    month = Window.partitionBy(*keys, "month")
    whole = Window.partitionBy(*keys)
    return df.withColumn("month_factor", F.avg(value).over(month)).withColumn(
        "seasonally_adjusted", ratio(value, "month_factor") * F.avg(value).over(whole)
    )


def top_maker_history(maker_share: DataFrame, year: int, k: int = 6) -> DataFrame:
    """National share history of the makers that lead in one year."""
    national = maker_share.where(F.col("state_code") == "ALL")
    leaders = (
        national.where(F.col("year") == year)
        .orderBy(F.desc("share"), "maker")
        .limit(k)
        .select("maker")
    )
    return (
        national.where(F.col("year") <= year)
        .join(leaders, "maker", "left_semi")
        .select("year", "maker", "share")
    )


def contribution(
    df: DataFrame, entity: Sequence[str], value: str, year: int, limit: int = 15
) -> DataFrame:
    """Difference between a year and the one before per entity, largest first."""
    grouped = (
        df.where(F.col("year").isin(year, year - 1))
        .groupBy(*entity)
        .agg(
            (
                F.sum(F.when(F.col("year") == year, F.col(value)))
                - F.sum(F.when(F.col("year") == year - 1, F.col(value)))
            ).alias("contribution")
        )
    )
    return top_absolute(grouped, "contribution", list(entity), limit)


def fuel_contribution(panel_year: DataFrame, year: int) -> DataFrame:
    long = panel_year.where(F.col("state_code") == "ALL").unpivot(
        ["year"], list(FUEL_COLUMNS.values()), "fuel", "units"
    )
    return contribution(long, ["fuel"], "units", year)


def share_heatmap(
    panel_year: DataFrame, dim_state: DataFrame, share: str, years: Sequence[int]
) -> DataFrame:
    """State x year matrix of a share, rows ordered by zone."""
    wide = (
        panel_year.where(F.col("state_code") != "ALL")
        .groupBy("state_code")
        .pivot("year", list(years))
        .agg(F.first(share))
        .withColumnsRenamed({str(y): f"y{y}" for y in years})
    )
    return wide.join(dim_state.select("state_code", "zone"), "state_code").orderBy("zone", "state_code")


def channel_episodes(retail_wholesale: DataFrame, build: float = 1.08, depletion: float = 0.92) -> DataFrame:
    """Gap, episode label and six-month rolling gap."""
    r = F.col("ws_retail_ratio")
    frame = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-5, 0)
    gap = F.col("wholesale") - F.col("retail")
    return (
        retail_wholesale.withColumn("gap", gap)
        .withColumn(
            "episode", F.when(r > build, "build").when(r < depletion, "depletion").otherwise("balanced")
        )
        .withColumn("gap_6m", F.sum("gap").over(frame))
    )


def index_to_100(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    first = F.first(value, ignorenulls=True).over(
        Window.partitionBy(*keys).orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    return df.withColumn("index_100", ratio(100 * F.col(value), first))


def percentile_rank(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """Average rank over the number of non-null values of the group."""
    ranks = average_ranks(df, keys, value)
    sizes = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return (
        df.join(ranks, [*keys, value], "left")
        .join(sizes, list(keys), "left")
        .withColumn(out, F.col("rank") / F.col("_n"))
        .drop("rank", "_n")
    )


def share_of_selected(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    whole = df.groupBy(*keys).agg(F.sum(value).alias("_whole"))
    return df.join(whole, list(keys)).withColumn(out, ratio(value, "_whole")).drop("_whole")


def comparison_table(panel: DataFrame, metric: str, snapshot_year: int) -> DataFrame:
    """Per state: latest, rank, percentile, growth, volatility, contribution, rank change.

    Growth runs over calendar years between the first and last known value (at
    least one) and is null when the start is not positive.
    """
    known = panel.where(F.col(metric).isNotNull()).select("state_name", "year", F.col(metric).alias("_v"))
    w = Window.partitionBy("state_name").orderBy("year")
    moved = known.withColumn("_g", ratio("_v", F.lag("_v").over(w)) - 1)
    ends = moved.groupBy("state_name").agg(
        F.max("year").alias("_end"),
        F.min("year").alias("_start"),
        F.max_by("_v", "year").alias("latest"),
        F.min_by("_v", "year").alias("_first"),
        F.stddev_samp("_g").alias("volatility"),
    )
    span = F.greatest(F.col("_end") - F.col("_start"), F.lit(1))
    growth = F.when(
        (F.col("_first") > 0) & (F.col("latest") >= 0),
        F.pow(ratio("latest", "_first"), 1.0 / span) - 1,
    )
    totals = known.groupBy(F.col("year").alias("_end")).agg(F.sum("_v").alias("_total"))
    table = ends.join(totals, "_end").select(
        "state_name",
        "latest",
        growth.alias("cagr"),
        "volatility",
        ratio("latest", "_total").alias("contribution"),
        F.lit(0).alias("_g"),
    )
    ascending = average_ranks(table, ["_g"], "latest")
    counts = table.groupBy("latest").agg(F.count(F.lit(1)).alias("_ties"))
    size = table.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    ranked = (
        table.join(ascending.select("latest", F.col("rank").alias("_asc")), "latest")
        .join(counts, "latest")
        .join(size, "_g")
        .withColumn("percentile", F.col("_asc") / F.col("_n"))
        .withColumn(
            "rank", F.col("_n") + 1 - F.col("_asc") - (F.col("_ties") - 1) / 2
        )
    )
    years = known.where(F.col("year").isin(snapshot_year, snapshot_year - 1))
    positions = years.join(average_ranks(years, ["year"], "_v"), ["year", "_v"]).join(
        years.groupBy("year").agg(F.count(F.lit(1)).alias("_n")), "year"
    )
    descending = F.col("_n") + 1 - F.col("rank")
    change = positions.groupBy("state_name").agg(
        (
            F.max(F.when(F.col("year") == snapshot_year - 1, descending))
            - F.max(F.when(F.col("year") == snapshot_year, descending))
        ).alias("rank_change")
    )
    return ranked.join(change, "state_name", "left").select(
        "state_name", "latest", "rank", "percentile", "cagr", "volatility", "contribution", "rank_change"
    )


def trend_line(df: DataFrame, keys: Sequence[str], x: str, y: str) -> DataFrame:
    """OLS of y on x per group."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    return rows.groupBy(*keys).agg(
        F.regr_slope(y, x).alias("slope"),
        F.regr_intercept(y, x).alias("intercept"),
        F.regr_r2(y, x).alias("r2"),
        F.count(F.lit(1)).alias("n"),
    )


def share_matrix(edges: DataFrame, makers: int = 18) -> DataFrame:
    """State rows x leading makers (by summed within-state share), long form with row maxima.

    The long form keeps one row per pair; pivot it on ``maker`` for display.
    """
    cell = edges.groupBy("state_code", "maker").agg(F.sum("regs").alias("regs"))
    shares = cell.withColumn(
        "share", ratio("regs", F.sum("regs").over(Window.partitionBy("state_code")))
    )
    leaders = (
        shares.groupBy("maker")
        .agg(F.sum("share").alias("_s"))
        .orderBy(F.desc("_s"), "maker")
        .limit(makers)
    )
    kept = shares.join(leaders.select("maker"), "maker", "left_semi")
    top = kept.groupBy("state_code").agg(F.max("share").alias("row_max"))
    return kept.join(top, "state_code").select("state_code", "maker", "share", "row_max")


def mapping_coverage(wholesale: DataFrame) -> DataFrame:
    """Mapped units and their percentage, overall and per coverage era."""
    mapped = F.sum(F.when(F.col("state_code").isNotNull(), F.col("qty")))
    out = wholesale.rollup("coverage").agg(
        F.sum("qty").alias("units"),
        mapped.alias("mapped_units"),
        (ratio(mapped, F.sum("qty")) * 100).alias("mapped_pct"),
    )
    return out.withColumn("coverage", F.coalesce("coverage", F.lit("overall")))


def top_groups(
    wholesale: DataFrame, keys: Sequence[str], limit: int, where: Column | None = None
) -> DataFrame:
    rows = wholesale if where is None else wholesale.where(where)
    return (
        rows.groupBy(*keys)
        .agg(F.sum("qty").alias("units"))
        .orderBy(F.desc("units"), *keys)
        .limit(limit)
    )


def model_trajectory(wholesale: DataFrame, model: str) -> DataFrame:
    return (
        wholesale.where(F.col("model") == model)
        .groupBy("model", "date")
        .agg(F.sum("qty").alias("units"))
    )


def lifecycle_peak(wholesale: DataFrame, keys: Sequence[str] = ("model",)) -> DataFrame:
    """Peak month (earliest on ties) and units per model, for all models in one pass."""
    monthly = wholesale.groupBy(*keys, "date").agg(F.sum("qty").alias("units"))
    return (
        monthly.groupBy(*keys)
        .agg(F.max_by(F.struct("date", "units"), F.struct("units", -F.unix_date("date"))).alias("_p"))
        .select(*keys, F.col("_p.date").alias("peak_date"), F.col("_p.units").alias("peak_units"))
    )


def metadata_tier(wholesale: DataFrame) -> DataFrame:
    """Three tiers of nameplate knowledge with distinct models and units."""
    tier = (
        F.when(F.col("ev_only") == 1, "EV-only nameplate")
        .when(F.col("fuel_variants").isNull(), "unclassified")
        .otherwise("mixed-fuel / quantity unknown")
    )
    return wholesale.groupBy(tier.alias("metadata_tier")).agg(
        F.count_distinct("model").alias("models"), F.sum("qty").alias("units")
    )


def ramp_curves(wholesale: DataFrame, maker: str, k: int = 8) -> DataFrame:
    """Monthly units of a maker's k largest models."""
    own = wholesale.where(F.col("maker") == maker)
    largest = top_groups(own, ["model"], k).select("model")
    return (
        own.join(largest, "model", "left_semi")
        .groupBy("model", "date")
        .agg(F.sum("qty").alias("units"))
    )


def top3_states(maker_share: DataFrame, year: int) -> DataFrame:
    """Number of states per maker with rank three or better."""
    return (
        maker_share.where((F.col("state_code") != "ALL") & (F.col("year") == year))
        .groupBy("maker")
        .agg(F.count_if(F.col("rnk") <= 3).alias("top3_states"))
    )


def monthly_series(facts: DataFrame, keys: Sequence[str], through_year: int) -> DataFrame:
    """Series per key up to December of a year on a complete calendar, gaps as null."""
    counted = (
        facts.where(F.col("year") <= through_year)
        .groupBy(*keys, month_start().alias("date"))
        .agg(F.sum("count").alias("value"))
    )
    spans = counted.groupBy(*keys).agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    calendar = spans.select(
        *keys, F.explode(F.sequence("_a", "_b", F.expr("interval 1 month"))).alias("date")
    )
    return calendar.join(counted, [*keys, "date"], "left")


def event_counts(events: DataFrame, date_text: str = "date_text") -> DataFrame:
    """Events per year and category; dates that do not parse as YYYY-MM drop out."""
    parsed = F.try_to_timestamp(F.substring(date_text, 1, 7), F.lit("yyyy-MM"))
    return (
        events.withColumn("_d", parsed)
        .where(F.col("_d").isNotNull())
        .groupBy(F.year("_d").alias("year"), "category")
        .agg(F.count(F.lit(1)).alias("events"))
    )


def load_events(events: DataFrame, tiers: Sequence[int] = (1,)) -> DataFrame:
    """Events of the given tiers with a parseable date."""
    return events.where(F.col("tier").isin(list(tiers)) & F.col("date").isNotNull())


def thin_evenly(events: DataFrame, order: Sequence[str], labels: int) -> DataFrame:
    """``labels`` rows at evenly spaced positions of the whole order; all rows if there are no more than that.

    The positions follow from the number of rows; only the ranges of the order
    that hold one of them are sorted, however many events a day has.
    """
    events = cut_lineage(events)
    size = events.count()
    if size <= labels:
        return events
    step = (size - 1) / max(labels - 1, 1)
    chosen = sorted({round(i * step) for i in range(labels)})  # halves go to the even position
    return numbered(events, order, "_pos", chosen, rows=max(1000, min(RANGE_ROWS, size // 128))).drop("_pos")


def channel_baseline(retail_wholesale: DataFrame) -> DataFrame:
    """Monthly growth implied by the last year, average ratio, months of history."""
    w = Window.partitionBy(F.lit(0)).orderBy("date")
    grown = (
        retail_wholesale.withColumn("_g", ratio("retail", F.lag("retail", 12).over(w)) - 1)
        .withColumn("_back", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("date"))))
    )
    return grown.agg(
        (F.avg(F.when(F.col("_back") <= 12, F.col("_g"))) / 12).alias("monthly_growth"),
        F.avg("ws_retail_ratio").alias("average_ratio"),
        F.count(F.lit(1)).alias("months"),
    )


def monthly_shares_since(panel_month: DataFrame, since: str) -> DataFrame:
    return panel_month.where(
        (F.col("state_code") == "ALL") & (F.col("date") >= F.lit(since).cast("date"))
    ).select("date", "ev_share", "cng_share", "petrol_share", "diesel_share", "hybrid_share")


def policy_mentions(events: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """Events whose label or detail matches each pattern (case-insensitive)."""
    text = F.concat_ws(" ", "label", "detail")
    counts = events.agg(
        *[F.count_if(text.rlike(f"(?i){p}")).alias(name) for name, p in patterns.items()]
    )
    return counts.unpivot([], list(patterns), "pattern", "mentions")


def yearly_profile(wholesale: DataFrame) -> DataFrame:
    return wholesale.groupBy("year").agg(
        F.count_distinct("city").alias("cities"),
        F.count_distinct("maker").alias("makers"),
        F.count_distinct("model").alias("models"),
        F.sum("qty").alias("units"),
    )


def cumulative_city_share(wholesale: DataFrame, top: int) -> DataFrame:
    """Leading cities with the running share of all units."""
    cities = wholesale.groupBy("city").agg(F.sum("qty").alias("units"))
    leading = with_grand_total(cities, "units", "_all").orderBy(F.desc("units"), "city").limit(top)
    running = (
        Window.partitionBy(F.lit(0)).orderBy(F.desc("units"), "city")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return leading.select(
        "city", "units", ratio(F.sum("units").over(running), "_all").alias("cumulative_share")
    )
