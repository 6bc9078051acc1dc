"""The canonical panels: state-month, state-year, maker shares, edges, dispatch rollups.

Each panel first collapses the facts to its own grain, so later windows only
see one row per entity and period.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.columns import (
    FUEL_COLUMNS,
    SHARE_COLUMNS,
    UNIT_COLUMNS,
    fiscal_year_starting,
    month_start,
    ratio,
    xlnx,
)


def fuel_pivot(facts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Total and one unit column per fuel, by conditional sums in one pass."""
    units = [
        F.sum(F.when(F.col("fuel") == fuel, F.col("count")).otherwise(0)).alias(name)
        for fuel, name in FUEL_COLUMNS.items()
    ]
    return facts.groupBy(*keys).agg(F.sum("count").alias("total_regs"), *units)


def group_shares(
    df: DataFrame, keys: Sequence[str], entity: str, value: str, total: str = "regs"
) -> DataFrame:
    """Entity totals and their share of the group; a zero group total gives a null share."""
    grouped = df.groupBy(*keys, entity).agg(F.sum(value).alias(total))
    whole = F.sum(total).over(Window.partitionBy(*keys))
    return grouped.withColumn("share", ratio(total, whole))


def concentration(shares: DataFrame, keys: Sequence[str], share: str = "share") -> DataFrame:
    """HHI (0-10000), entropy in nats and the number of makers with a positive share."""
    s = F.col(share)
    return shares.groupBy(*keys).agg(
        (F.sum(s * s) * 10000).alias("hhi_oem"),
        (-F.sum(xlnx(s))).alias("entropy_oem"),
        F.count_if(s > 0).alias("n_oems"),
    )


def _panel(facts: DataFrame, carried: Sequence[str], keys: Sequence[str]) -> DataFrame:
    base = fuel_pivot(facts, carried)
    shares = [
        ratio(units, "total_regs").alias(share)
        for units, share in zip(UNIT_COLUMNS, SHARE_COLUMNS, strict=True)
    ]
    makers = concentration(group_shares(facts, keys, "maker", "count"), keys)
    return base.select("*", *shares).join(makers, list(keys), "left")


def state_month(facts: DataFrame) -> DataFrame:
    """``panel_state_month``: units, shares and maker concentration per state and month."""
    panel = _panel(
        facts,
        ["state_code", "state_name", "year", "month", "fy"],
        ["state_code", "year", "month"],
    )
    return panel.withColumn("date", month_start())


def state_year_base(facts: DataFrame) -> DataFrame:
    return _panel(facts, ["state_code", "state_name", "year"], ["state_code", "year"]).withColumn(
        "fy_starting", fiscal_year_starting("year")
    )


def with_changes(panel: DataFrame) -> DataFrame:
    """Growth of the total and change of each share in points, to the previous row."""
    w = Window.partitionBy("state_code").orderBy("year")
    changes = [
        ((F.col(s) - F.lag(s).over(w)) * 100).alias(f"{s}_chg_pp") for s in SHARE_COLUMNS
    ]
    growth = (ratio("total_regs", F.lag("total_regs").over(w)) - 1).alias("yoy_growth")
    return panel.select("*", growth, *changes)


def with_population(panel: DataFrame, population: DataFrame, fixed_year: int = 2024) -> DataFrame:
    """Annual denominators and rates per 1000, plus the rate on one fixed year."""
    annual = population.select(
        "state_code",
        "year",
        "population_mn",
        "urban_population_mn",
        "rural_population_mn",
        F.col("method").alias("population_method"),
        F.col("source").alias("population_source"),
        F.col("quality").alias("population_quality"),
        F.col("urban_pct_basis").alias("urban_pct"),
        F.col("urban_share_year").alias("urbanization_census_year"),
        F.col("source").alias("urbanization_source"),
        F.col("quality").alias("urbanization_quality"),
    )
    fixed = population.where(F.col("year") == fixed_year).select(
        "state_code", F.col("population_mn").alias("_fixed_mn")
    )
    rate = ratio("total_regs", F.col("population_mn") * 1000)
    return (
        panel.join(annual, ["state_code", "year"], "left")
        .join(fixed, "state_code", "left")
        .withColumn("regs_per_1000_population", rate)
        .withColumn(
            "regs_per_1000_population_2024", ratio("total_regs", F.col("_fixed_mn") * 1000)
        )
        .withColumn("regs_per_1000_capita", rate)
        .drop("_fixed_mn")
    )


def with_covariates(
    panel: DataFrame,
    income: DataFrame,
    gsdp: DataFrame,
    credit: DataFrame,
    cng: DataFrame,
    ev: DataFrame,
) -> DataFrame:
    """Left joins of the slow covariates; income and GSDP join the fiscal year starting here."""
    by_fy = ["state_code", "fy_starting"]
    by_year = ["state_code", "year"]
    income = income.select(
        "state_code",
        F.col("fy").alias("fy_starting"),
        F.col("pc_nsdp_constant_2011_12_inr").alias("pc_income_constant_2011_12_inr"),
        F.col("fy").alias("income_constant_fy"),
        F.col("source").alias("income_constant_source"),
        F.col("quality").alias("income_constant_quality"),
    )
    gsdp = gsdp.select(
        "state_code",
        F.col("fy").alias("fy_starting"),
        "gsdp_constant_2011_12_lakh",
        "gsdp_real_growth_pct",
        F.col("source").alias("gsdp_source"),
        F.col("quality").alias("gsdp_quality"),
    )
    credit = credit.select(
        "state_code",
        "year",
        "personal_loans_outstanding_crore",
        "personal_loans_per_capita_inr",
        "personal_loans_yoy_growth_pct",
        F.lit("loans over population").alias("credit_depth_source"),
        F.lit("estimate").alias("credit_depth_quality"),
    )

    def snapshot(df: DataFrame, value: str, out: str, prefix: str) -> DataFrame:
        return df.select(
            "state_code",
            "year",
            F.col(value).alias(out),
            F.col("source").alias(f"{out}_source"),
            F.col("quality").alias(f"{out}_quality"),
            F.col("snapshot_date").alias(f"{prefix}_snapshot_date"),
            F.col("coverage_scope").alias(f"{prefix}_coverage_scope"),
            F.col("state_allocation_coverage_pct").alias(f"{prefix}_state_allocation_coverage_pct"),
        )

    return (
        panel.join(income, by_fy, "left")
        .join(gsdp, by_fy, "left")
        .join(credit, by_year, "left")
        .join(snapshot(cng, "stations", "cng_stations", "cng"), by_year, "left")
        .join(snapshot(ev, "public_chargers", "ev_chargers", "ev"), by_year, "left")
    )


def with_prices(
    panel: DataFrame, prices: DataFrame, fuels: Sequence[str] = ("Petrol", "Diesel", "CNG")
) -> DataFrame:
    """State price with the ``ALL`` row as fallback.

    Value, source and quality fall back one by one; the basis label follows the
    presence of the state row.  The price table is pivoted once, so two joins
    serve all fuels.
    """

    def wide(rows: DataFrame, keys: Sequence[str], tag: str) -> DataFrame:
        out: list[Column] = []
        for fuel in fuels:
            is_fuel = F.col("fuel") == fuel
            name = fuel.lower()
            for c in ("price_avg_inr", "source", "quality"):
                out.append(F.max(F.when(is_fuel, F.col(c))).alias(f"_{tag}_{name}_{c}"))
            out.append(F.max(is_fuel).alias(f"_{tag}_{name}_present"))
        return rows.groupBy(*keys).agg(*out)

    own = wide(prices.where(F.col("state_code") != "ALL"), ["state_code", "year"], "s")
    national = wide(prices.where(F.col("state_code") == "ALL"), ["year"], "n")
    joined = panel.join(own, ["state_code", "year"], "left").join(national, "year", "left")
    out: list[Column] = []
    for fuel in fuels:
        name = fuel.lower()
        is_all = F.col("state_code") == "ALL"

        def pick(c: str, name: str = name) -> Column:
            return F.coalesce(f"_s_{name}_{c}", f"_n_{name}_{c}")

        out += [
            pick("price_avg_inr").alias(f"{name}_price_inr"),
            pick("source").alias(f"{name}_price_source"),
            pick("quality").alias(f"{name}_price_quality"),
            F.when(F.col(f"_s_{name}_present") | (is_all & F.col(f"_n_{name}_present")), "state")
            .when(F.col(f"_n_{name}_present"), "ALL/Delhi fallback")
            .alias(f"{name}_price_basis"),
        ]
    return joined.select(*panel.columns, *out)


# Panel column -> column of the experiment view.
EXPERIMENT_RENAMES = {
    "pc_income_constant_2011_12_inr": "real_pc_income_inr",
    "gsdp_constant_2011_12_lakh": "real_gsdp_lakh",
    "gsdp_real_growth_pct": "real_gsdp_growth_pct",
    "personal_loans_per_capita_inr": "broad_credit_per_capita_inr",
    "personal_loans_yoy_growth_pct": "broad_credit_growth_pct",
}

EXPERIMENT_COLUMNS = [
    "state_code", "state_name", "year", "total_regs", *UNIT_COLUMNS, *SHARE_COLUMNS,
    "yoy_growth", "hhi_oem", "entropy_oem", "n_oems", "regs_per_1000_population",
    "population_mn", "urban_population_mn", "rural_population_mn", "urban_pct",
    *EXPERIMENT_RENAMES, "petrol_price_inr", "diesel_price_inr", "cng_price_inr",
]


def experiment_state_year(panel_year: DataFrame) -> DataFrame:
    """Cross-state view of the year panel: no ``ALL`` row, experiment names."""
    return (
        panel_year.where(F.col("state_code") != "ALL")
        .select(*EXPERIMENT_COLUMNS)
        .withColumnsRenamed(EXPERIMENT_RENAMES)
    )


def experiment_state_context(
    panel_year: DataFrame,
    dim_state: DataFrame,
    tax: DataFrame,
    cng: DataFrame,
    ev: DataFrame,
    population_year: int,
    cng_year: int,
    ev_year: int,
) -> DataFrame:
    """Latest known covariates per state with dated snapshots and tax rates."""

    def latest(c: str) -> Column:
        return F.max_by(c, F.when(F.col(c).isNotNull(), F.col("year")))

    values = (
        panel_year.where(F.col("state_code") != "ALL")
        .groupBy("state_code")
        .agg(
            latest("pc_income_constant_2011_12_inr").alias("real_pc_income_inr"),
            latest("gsdp_constant_2011_12_lakh").alias("real_gsdp_lakh"),
            latest("gsdp_real_growth_pct").alias("latest_real_gsdp_growth_pct"),
            latest("personal_loans_per_capita_inr").alias("broad_credit_per_capita_inr"),
            F.max(F.when(F.col("year") == population_year, F.col("population_mn"))).alias(
                "population_2025_mn"
            ),
            F.max("urban_pct").alias("urban_pct"),
        )
    )
    rates = tax.groupBy("state_code").agg(
        *[
            F.max(F.when(F.col("fuel") == fuel, F.col("lifetime_tax_rate_pct"))).alias(out)
            for fuel, out in {
                "EV": "ev_tax_rate_pct",
                "Strong Hybrid": "hybrid_tax_rate_pct",
                "Petrol": "ice_tax_rate_pct",
            }.items()
        ],
        F.max("as_of").alias("tax_as_of"),
    )
    stations = cng.where(F.col("year") == cng_year).select(
        "state_code",
        F.col("stations").alias("cng_stations_2024"),
        F.col("snapshot_date").alias("cng_snapshot_date"),
        F.col("quality").alias("cng_quality"),
    )
    chargers = ev.where(F.col("year") == ev_year).select(
        "state_code",
        F.col("public_chargers").alias("ev_chargers_2025"),
        F.col("snapshot_date").alias("ev_snapshot_date"),
        F.col("quality").alias("ev_quality"),
        F.col("state_allocation_coverage_pct").alias("ev_allocation_coverage_pct"),
    )
    out = dim_state.where(F.col("state_code") != "ALL").select("state_code", "state_name", "zone")
    for right in (values, stations, chargers, rates):
        out = out.join(right, "state_code", "left")
    return out


def period_status(panel_month: DataFrame) -> DataFrame:
    """Completeness of each calendar year, from the months counted in the national rows."""
    months = F.count_distinct("month")
    return (
        panel_month.where(F.col("state_code") == "ALL")
        .groupBy("year")
        .agg(months.cast("int").alias("observed_month_count"), F.max("date").alias("freshness_date"))
        .select(
            F.lit("vahan").alias("source"),
            F.lit("calendar_year").alias("grain"),
            F.col("year").cast("string").alias("period"),
            "observed_month_count",
            F.lit(12).alias("expected_month_count"),
            F.when(F.col("observed_month_count") == 12, "complete")
            .otherwise("partial")
            .alias("completeness_status"),
            "freshness_date",
            F.lit("national registration coverage").alias("coverage_regime"),
            F.when(F.col("observed_month_count") == 12, "")
            .otherwise("Partial calendar year; do not compare with full years.")
            .alias("warning_text"),
        )
    )


def oem_state_edges(facts: DataFrame) -> DataFrame:
    return (
        facts.where(F.col("state_code") != "ALL")
        .groupBy("state_code", "state_name", "maker", "year", "fy")
        .agg(F.sum("count").alias("regs"))
    )


def maker_state_share(facts: DataFrame) -> DataFrame:
    """Share and rank of each maker per state-year, with changes to the maker's previous row."""
    base = facts.groupBy("state_code", "state_name", "maker", "year").agg(
        F.sum("count").alias("regs")
    )
    market = Window.partitionBy("state_code", "year")
    history = Window.partitionBy("state_code", "maker").orderBy("year")
    ranked = base.withColumn("share", ratio("regs", F.sum("regs").over(market))).withColumn(
        "rnk", F.rank().over(market.orderBy(F.desc("regs")))
    )
    return ranked.withColumn(
        "share_chg_pp", (F.col("share") - F.lag("share").over(history)) * 100
    ).withColumn("rank_chg", F.lag("rnk").over(history) - F.col("rnk"))


# ------------------------------------------------------------------ dispatch rollups

ROLLUPS = {
    "ws_maker_month": [("maker_vahan", "maker")],
    "ws_model_month": [("model", "model"), ("maker", "maker"), ("segment5", "segment5")],
    "ws_state_month": [("state_code", "state_code")],
    "ws_segment_month": [("segment5", "segment5")],
}


def dispatch_rollup(wholesale: DataFrame, name: str) -> DataFrame:
    """One of the four monthly rollups of the dispatch facts."""
    keys = [F.col(source).alias(out) for source, out in ROLLUPS[name]]
    rows = wholesale
    if name == "ws_state_month":
        rows = rows.where(F.col("state_code").isNotNull())
    return rows.groupBy(*keys, "year", "month").agg(
        F.min("date").alias("date"), F.sum("qty").alias("wholesale")
    )


def ev_only_month(wholesale: DataFrame) -> DataFrame:
    return (
        wholesale.where(F.col("ev_only") == 1)
        .groupBy("state_code", "maker", "model", "year", "month")
        .agg(F.min("date").alias("date"), F.sum("qty").alias("wholesale"))
    )


def retail_wholesale_month(facts: DataFrame, wholesale: DataFrame) -> DataFrame:
    """National retail against full-coverage dispatch, month by month."""
    retail = (
        facts.where(F.col("state_code") == "ALL")
        .groupBy("year", "month")
        .agg(F.sum("count").alias("retail"))
    )
    sent = (
        wholesale.where(F.col("coverage") == "full")
        .groupBy("year", "month")
        .agg(F.sum("qty").alias("wholesale"))
    )
    return retail.join(sent, ["year", "month"]).select(
        "year",
        "month",
        month_start().alias("date"),
        "retail",
        "wholesale",
        ratio("wholesale", "retail").alias("ws_retail_ratio"),
    )


def state_year_dispatch(panel_year: DataFrame, wholesale: DataFrame) -> DataFrame:
    """Full-coverage dispatch per state-year as a covariate of the year panel."""
    sent = (
        wholesale.where((F.col("coverage") == "full") & F.col("state_code").isNotNull())
        .groupBy("state_code", "year")
        .agg(F.sum("qty").alias("wholesale_units"))
    )
    return (
        panel_year.select("state_code", "year", "total_regs")
        .join(sent, ["state_code", "year"], "left")
        .withColumn("wholesale_retail_ratio", ratio("wholesale_units", "total_regs"))
    )


def row_counts(named: dict[str, DataFrame]) -> DataFrame:
    """One row per panel with its row count."""
    out: DataFrame | None = None
    for name, frame in named.items():
        one = frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("panel"), "rows")
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no panel given")
    return out


def save_panels(named: dict[str, DataFrame], folder: str) -> None:
    """Writes panels as parquet, by year where they have one, for later readers to prune."""
    for name, frame in named.items():
        writer = frame.write.mode("overwrite")
        if "year" in frame.columns:
            writer = writer.partitionBy("year")
        writer.parquet(f"{folder}/{name}")
