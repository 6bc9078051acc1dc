"""Queries of the market group: contexts, moves, leaders, comparisons, profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.catalog.panels_queries import PERIOD_STATUS_SQL
from panelwright.catalog.registry import Market, query
from panelwright.functions.columns import FUEL_COLUMNS
from panelwright.operators import market
from panelwright.sources.tables import FULL_COVERAGE_FROM

YEAR = 2000
STATES = ("S01", "S05", "S09")
OEMS = ("Brand#1", "Brand#2", "Brand#3")
FUELS = ("EV", "CNG")
_IN_STATES = "('S01', 'S05', 'S09')"
_IN_OEMS = "('Brand#1', 'Brand#2', 'Brand#3')"
_UNITS = list(FUEL_COLUMNS.values())


def national(m: Market) -> DataFrame:
    return m.panel_month.where(F.col("state_code") == "ALL")


def annual(m: Market) -> DataFrame:
    return market.market_annual(market.market_monthly(m.facts, m.panel_month, (1995, YEAR)))


def full_dispatch(m: Market) -> DataFrame:
    return m.dispatch.where(F.col("coverage") == "full")


def stack(parts: dict[str, DataFrame]) -> DataFrame:
    """Tagged union of frames that share their columns."""
    tagged = [df.withColumn("part", F.lit(name)) for name, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


@query("qry_01_period_status", PERIOD_STATUS_SQL, "panel_month", texts="freshness_date")
def stored_status(m: Market) -> DataFrame:
    return market.stored_or_recomputed_status(m.spark, "data_period_status", m.panel_month)


@query(
    "qry_02_cutoff",
    """SELECT 'Vahan registrations' AS source, strftime((SELECT MIN(date) FROM panel_month), '%B %Y') AS first_period,
 strftime((SELECT MAX(date) FROM panel_month), '%B %Y') AS latest_period, MAX(year) FILTER (n = 12) AS latest_complete_year,
 max_by(n, year) AS observed_months_latest_year, CASE WHEN max_by(n, year) = 12 THEN 'complete' ELSE 'partial' END AS status,
 CASE WHEN max_by(n, year) = 12 THEN '' ELSE 'Partial calendar year; do not compare with full years.' END AS warning
 FROM (SELECT year, COUNT(DISTINCT month) AS n FROM panel_month WHERE state_code = 'ALL' GROUP BY year)""",
    "panel_month",
)
def cutoff(m: Market) -> DataFrame:
    return market.cutoff(m.panel_month)


@query("qry_03_state_dimension", "SELECT state_code, state_name, zone FROM dim_state", "dim_state")
def state_dimension(m: Market) -> DataFrame:
    return market.state_dimension(m.dim_state)


@query("qry_03_maker_options", "SELECT DISTINCT maker FROM facts", "facts")
def maker_options(m: Market) -> DataFrame:
    return market.maker_options(m.facts)


@query(
    "qry_04_market_monthly",
    f"""SELECT year, month, make_date(year, month, 1) AS date, CAST(SUM(ev_regs + cng_regs) AS BIGINT) AS total_regs,
 CAST(SUM(ev_regs) AS BIGINT) AS ev_regs, CAST(SUM(cng_regs) AS BIGINT) AS cng_regs
 FROM panel_month WHERE state_code IN {_IN_STATES} AND year BETWEEN 1996 AND 2000 GROUP BY year, month""",
    "panel_month",
    texts="date",
)
def market_monthly(m: Market) -> DataFrame:
    return market.market_monthly(m.facts, m.panel_month, (1996, YEAR), STATES, (), FUELS)


@query(
    "qry_04_market_monthly_oem",
    f"""SELECT year, month, make_date(year, month, 1) AS date, CAST(SUM("count") AS BIGINT) AS total_regs,
 CAST(SUM(CASE WHEN fuel = 'EV' THEN "count" ELSE 0 END) AS BIGINT) AS ev_regs,
 CAST(SUM(CASE WHEN fuel = 'CNG' THEN "count" ELSE 0 END) AS BIGINT) AS cng_regs
 FROM facts WHERE state_code = 'ALL' AND maker IN {_IN_OEMS} AND fuel IN ('EV', 'CNG') AND year BETWEEN 1996 AND 2000 GROUP BY year, month""",
    "facts",
    texts="date",
)
def market_monthly_oem(m: Market) -> DataFrame:
    return market.market_monthly(m.facts, m.panel_month, (1996, YEAR), (), OEMS, FUELS)


_ANNUAL = """SELECT year, total_regs, ev_regs, cng_regs, petrol_regs, diesel_regs, hybrid_regs, ev_share, cng_share, petrol_share, diesel_share,
 hybrid_share AS strong_hybrid_share, CAST(total_regs AS DOUBLE) / NULLIF(LAG(total_regs) OVER (ORDER BY year), 0) - 1 AS yoy_growth
 FROM panel_year WHERE state_code = 'ALL' AND year <= 2000"""


@query(
    "qry_05_market_annual",
    _ANNUAL,
    "panel_year",
    "ev_share cng_share petrol_share diesel_share strong_hybrid_share yoy_growth",
)
def market_annual(m: Market) -> DataFrame:
    return annual(m)


@query(
    "qry_06_state_snapshot",
    """SELECT p.state_code, p.state_name, total_regs, yoy_growth, ev_share, ev_share_chg_pp, cng_share, cng_share_chg_pp, zone, geojson_name
 FROM panel_year p JOIN dim_state d USING (state_code) WHERE year = 2000""",
    "panel_year dim_state",
    "yoy_growth ev_share ev_share_chg_pp cng_share cng_share_chg_pp",
)
def state_snapshot(m: Market) -> DataFrame:
    return market.state_snapshot(m.panel_year, m.dim_state, YEAR)


@query(
    "qry_07_state_profile",
    """SELECT 'annual' AS part, CAST(year AS VARCHAR) AS at, total_regs AS units, ev_share AS level FROM panel_year WHERE state_code = 'S05' AND year <= 2000
 UNION ALL SELECT 'monthly', CAST(date AS VARCHAR), total_regs, ev_share FROM panel_month WHERE state_code = 'S05' AND year <= 2000
 UNION ALL SELECT 'oems', CAST(year AS VARCHAR) || ' ' || maker, regs, share FROM maker_share WHERE state_code = 'S05' AND year <= 2000
 UNION ALL SELECT 'context', zone, NULL, urban_pct FROM context WHERE state_code = 'S05'
 UNION ALL SELECT 'events', event_id, tier, NULL FROM ref_events WHERE state_code IN ('S05', 'ALL')""",
    "panel_year panel_month maker_share context ref_events",
    "level",
)
def state_profile(m: Market) -> DataFrame:
    parts = market.state_profile(
        "S05", YEAR, m.panel_year, m.panel_month, m.maker_share, m.context, m.ref("ref_events")
    )
    shapes = {
        "annual": (F.col("year").cast("string"), F.col("total_regs"), F.col("ev_share")),
        "monthly": (F.col("date").cast("string"), F.col("total_regs"), F.col("ev_share")),
        "oems": (F.concat_ws(" ", "year", "maker"), F.col("regs"), F.col("share")),
        "context": (F.col("zone"), F.lit(None).cast("bigint"), F.col("urban_pct")),
        "events": (F.col("event_id"), F.col("tier").cast("bigint"), F.lit(None).cast("double")),
    }
    return stack(
        {
            name: parts[name].select(at.alias("at"), units.alias("units"), level.alias("level"))
            for name, (at, units, level) in shapes.items()
        }
    )


@query(
    "qry_08_peer_states",
    """SELECT c.state_code, c.state_name, c.zone, ABS(LN(NULLIF(c.real_pc_income_inr, 0) / NULLIF(t.real_pc_income_inr, 0)))
 + ABS(COALESCE(c.urban_pct, 0) - COALESCE(t.urban_pct, 0)) / 100 + CASE WHEN c.zone = t.zone THEN 0 ELSE 0.25 END AS peer_distance
 FROM context c, (SELECT * FROM context WHERE state_code = 'S05') t WHERE c.state_code <> 'S05'
 ORDER BY peer_distance NULLS LAST, c.state_code LIMIT 6""",
    "context",
    "peer_distance",
)
def peer_states(m: Market) -> DataFrame:
    return market.peer_states(m.context, "S05").select("state_code", "state_name", "zone", "peer_distance")


@query(
    "qry_09_oem_profile",
    """SELECT 'annual' AS part, CAST(year AS VARCHAR) AS at, regs, share FROM maker_share WHERE state_code = 'ALL' AND maker = 'Brand#7' AND year <= 2000
 UNION ALL SELECT 'fuels', CAST(year AS VARCHAR) || ' ' || fuel, CAST(SUM("count") AS BIGINT), NULL FROM facts WHERE state_code = 'ALL' AND maker = 'Brand#7' AND year <= 2000 GROUP BY year, fuel
 UNION ALL SELECT 'states', CAST(year AS VARCHAR) || ' ' || state_code, regs, share FROM maker_share WHERE state_code <> 'ALL' AND maker = 'Brand#7' AND year <= 2000""",
    "facts maker_share",
    "share",
)
def oem_profile(m: Market) -> DataFrame:
    parts = market.oem_profile(m.facts, m.maker_share, "Brand#7", YEAR)
    none = F.lit(None).cast("double")
    return stack(
        {
            "annual": parts["annual"].select(F.col("year").cast("string").alias("at"), "regs", "share"),
            "fuels": parts["fuels"].select(
                F.concat_ws(" ", "year", "fuel").alias("at"), "regs", none.alias("share")
            ),
            "states": parts["states"].select(
                F.concat_ws(" ", "year", "state_code").alias("at"), "regs", "share"
            ),
        }
    )


@query(
    "qry_10_largest_moves",
    """(SELECT 'states' AS part, state_code AS name, total_regs AS units, yoy_growth AS move FROM panel_year
   WHERE state_code <> 'ALL' AND year = 2000 ORDER BY ABS(yoy_growth) DESC, state_code LIMIT 8)
 UNION ALL (SELECT 'oems', maker, regs, share_chg_pp FROM maker_share WHERE state_code = 'ALL' AND year = 2000 ORDER BY ABS(share_chg_pp) DESC, maker LIMIT 8)""",
    "panel_year maker_share",
    "move",
)
def largest_moves(m: Market) -> DataFrame:
    parts = market.largest_moves(m.panel_year, m.maker_share, YEAR)
    return stack(
        {
            "states": parts["states"].select(
                F.col("state_code").alias("name"), F.col("total_regs").alias("units"), F.col("yoy_growth").alias("move")
            ),
            "oems": parts["oems"].select(
                F.col("maker").alias("name"), F.col("regs").alias("units"), F.col("share_chg_pp").alias("move")
            ),
        }
    )


@query(
    "qry_12_market_leader",
    f"""SELECT maker, CAST(SUM("count") AS BIGINT) AS regs FROM facts WHERE state_code IN {_IN_STATES} AND year = 2000
 GROUP BY maker ORDER BY regs DESC, maker LIMIT 1""",
    "facts",
)
def market_leader(m: Market) -> DataFrame:
    return market.market_leader(m.facts, STATES, YEAR)


@query(
    "qry_12_latest_ratio",
    "SELECT date, ws_retail_ratio FROM rw WHERE ws_retail_ratio IS NOT NULL ORDER BY date DESC LIMIT 1",
    "rw",
    "ws_retail_ratio",
    "date",
)
def latest_ratio(m: Market) -> DataFrame:
    return market.latest_ratio(m.retail_wholesale)


@query(
    "qry_13_leading_fuel",
    """SELECT year, CASE GREATEST(ev_regs, cng_regs, petrol_regs, diesel_regs, hybrid_regs) WHEN ev_regs THEN 'EV' WHEN cng_regs THEN 'CNG'
 WHEN petrol_regs THEN 'Petrol' WHEN diesel_regs THEN 'Diesel' ELSE 'Strong Hybrid' END AS leading_fuel,
 GREATEST(ev_regs, cng_regs, petrol_regs, diesel_regs, hybrid_regs)::DOUBLE / total_regs AS share FROM panel_year WHERE state_code = 'ALL' AND year <= 2000""",
    "panel_year",
    "share",
)
def leading_fuel(m: Market) -> DataFrame:
    return market.leading_fuel(annual(m))


@query(
    "qry_13_rolling_12",
    """SELECT state_code, date, CAST(SUM(total_regs) OVER (PARTITION BY state_code ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS BIGINT) AS rolling_12 FROM panel_month""",
    "panel_month",
    texts="date",
)
def rolling_12(m: Market) -> DataFrame:
    from panelwright.operators.series import rolling

    out = rolling(
        m.panel_month, ["state_code"], "date", "total_regs", "rolling_12", F.sum("total_regs"), -11, 0
    )
    return out.select("state_code", "date", "rolling_12")


@query(
    "qry_14_fuel_moves",
    "SELECT fuel, a.s AS share, (a.s - b.s) * 100 AS change_pp FROM "
    + "(SELECT unnest(['"
    + "', '".join(_UNITS)
    + "']) AS fuel, unnest([ev_share, cng_share, petrol_share, diesel_share, hybrid_share]) AS s FROM panel_year WHERE state_code = 'ALL' AND year = 2000) a JOIN (SELECT unnest(['"
    + "', '".join(_UNITS)
    + "']) AS fuel, unnest([ev_share, cng_share, petrol_share, diesel_share, hybrid_share]) AS s FROM panel_year WHERE state_code = 'ALL' AND year = 1999) b USING (fuel)",
    "panel_year",
    "share change_pp",
)
def fuel_moves(m: Market) -> DataFrame:
    return market.fuel_moves(annual(m), YEAR)


@query(
    "qry_15_model_moves",
    """SELECT *, current_units - COALESCE(prior_units, 0) AS unit_change FROM (
 SELECT model, CAST(SUM(qty) FILTER (year = 2000) AS BIGINT) AS current_units, CAST(SUM(qty) FILTER (year = 1999) AS BIGINT) AS prior_units
 FROM wholesale WHERE coverage = 'full' AND year IN (1999, 2000) GROUP BY model) ORDER BY ABS(unit_change) DESC NULLS LAST, model LIMIT 15""",
    "wholesale",
)
def model_moves(m: Market) -> DataFrame:
    return market.model_moves(m.dispatch, YEAR)


@query(
    "qry_16_recent_events",
    "SELECT event_id, date, category, label, state_code FROM ref_events ORDER BY date DESC, event_id LIMIT 8",
    "ref_events",
    texts="date",
)
def recent_events(m: Market) -> DataFrame:
    return market.recent_events(m.ref("ref_events"))


_MODES = ("month", "rolling_3", "rolling_12", "ytd", "calendar_year", "fiscal_year")


def _mode_sql(mode: str) -> str:
    cols = ["total_regs", *_UNITS]
    if mode == "month":
        body = "SELECT date, " + ", ".join(cols) + " FROM n"
    elif mode.startswith("rolling"):
        k = int(mode.split("_")[1])
        body = (
            "SELECT date, "
            + ", ".join(f"CASE WHEN COUNT(*) OVER w >= {k} THEN SUM({c}) OVER w END AS {c}" for c in cols)
            + f" FROM n WINDOW w AS (ORDER BY date ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"
        )
    elif mode == "ytd":
        body = (
            "SELECT date, "
            + ", ".join(f"SUM({c}) OVER w AS {c}" for c in cols)
            + " FROM n WINDOW w AS (PARTITION BY year ORDER BY date)"
        )
    elif mode == "calendar_year":
        body = "SELECT make_date(year, 12, 1) AS date, " + ", ".join(f"SUM({c}) AS {c}" for c in cols) + " FROM n GROUP BY year"
    else:
        body = (
            "SELECT make_date(CAST(fy[1:4] AS BIGINT), 4, 1) AS date, "
            + ", ".join(f"SUM({c}) AS {c}" for c in cols)
            + " FROM n GROUP BY fy"
        )
    shares = ", ".join(f"CAST({c} AS DOUBLE) / NULLIF(total_regs, 0) AS {c}" for c in [*_UNITS])
    return (
        f"SELECT '{mode}' AS part, date, CAST(total_regs AS BIGINT) AS total_regs, {shares}, "
        f"(total_regs - {' - '.join(_UNITS)})::DOUBLE / NULLIF(total_regs, 0) AS other_unclassified FROM ({body})"
    )


@query(
    "qry_17_period_modes",
    "WITH n AS (SELECT * FROM panel_month WHERE state_code = 'ALL')\n"
    + "\nUNION ALL ".join(f"({_mode_sql(mode)})" for mode in _MODES),
    "panel_month",
    " ".join([*_UNITS, "other_unclassified"]),
    "date",
)
def period_modes(m: Market) -> DataFrame:
    return stack({mode: market.period_mode(national(m), mode, as_share=True) for mode in _MODES})


@query(
    "qry_18_seasonally_adjusted",
    """SELECT state_code, date, AVG(total_regs) OVER (PARTITION BY state_code, month) AS month_factor,
 total_regs / AVG(total_regs) OVER (PARTITION BY state_code, month) * AVG(total_regs) OVER (PARTITION BY state_code) AS seasonally_adjusted FROM panel_month""",
    "panel_month",
    "month_factor seasonally_adjusted",
    "date",
)
def seasonally_adjusted(m: Market) -> DataFrame:
    return market.seasonally_adjusted(m.panel_month, ["state_code"]).select(
        "state_code", "date", "month_factor", "seasonally_adjusted"
    )


@query(
    "qry_19_top_maker_history",
    """SELECT year, maker, share FROM maker_share WHERE state_code = 'ALL' AND year <= 2000 AND maker IN (
 SELECT maker FROM maker_share WHERE state_code = 'ALL' AND year = 2000 ORDER BY share DESC, maker LIMIT 6)""",
    "maker_share",
    "share",
)
def top_maker_history(m: Market) -> DataFrame:
    return market.top_maker_history(m.maker_share, YEAR)


@query(
    "qry_20_contribution",
    """(SELECT 'state' AS part, state_code AS name, CAST(SUM(CASE year WHEN 2000 THEN total_regs ELSE -total_regs END) AS BIGINT) AS contribution
   FROM panel_year WHERE state_code <> 'ALL' AND year IN (1999, 2000) GROUP BY state_code ORDER BY ABS(contribution) DESC, name LIMIT 15)
 UNION ALL (SELECT 'maker', maker, CAST(SUM(CASE year WHEN 2000 THEN "count" ELSE -"count" END) AS BIGINT) AS contribution
   FROM facts WHERE state_code = 'ALL' AND year IN (1999, 2000) GROUP BY maker ORDER BY ABS(contribution) DESC, maker LIMIT 15)
 UNION ALL (SELECT 'fuel', fuel, CAST(SUM(CASE year WHEN 2000 THEN u ELSE -u END) AS BIGINT) FROM (
   SELECT year, unnest(['ev_regs', 'cng_regs', 'petrol_regs', 'diesel_regs', 'hybrid_regs']) AS fuel, unnest([ev_regs, cng_regs, petrol_regs, diesel_regs, hybrid_regs]) AS u
   FROM panel_year WHERE state_code = 'ALL' AND year IN (1999, 2000)) GROUP BY fuel)""",
    "panel_year facts",
)
def contribution(m: Market) -> DataFrame:
    states = m.panel_year.where(F.col("state_code") != "ALL")
    makers = m.facts.where(F.col("state_code") == "ALL")
    return stack(
        {
            "state": market.contribution(states, ["state_code"], "total_regs", YEAR).withColumnRenamed("state_code", "name"),
            "maker": market.contribution(makers, ["maker"], "count", YEAR).withColumnRenamed("maker", "name"),
            "fuel": market.fuel_contribution(m.panel_year, YEAR).withColumnRenamed("fuel", "name"),
        }
    )


_HEAT_YEARS = list(range(1996, 2001))


@query(
    "qry_21_share_heatmap",
    "SELECT state_code, zone, "
    + ", ".join(f"MAX(ev_share) FILTER (year = {y}) AS y{y}" for y in _HEAT_YEARS)
    + " FROM panel_year JOIN dim_state USING (state_code) GROUP BY state_code, zone",
    "panel_year dim_state",
    " ".join(f"y{y}" for y in _HEAT_YEARS),
)
def share_heatmap(m: Market) -> DataFrame:
    return market.share_heatmap(m.panel_year, m.dim_state, "ev_share", _HEAT_YEARS)


@query(
    "qry_22_channel_episodes",
    """SELECT *, wholesale - retail AS gap, CASE WHEN ws_retail_ratio > 1.08 THEN 'build' WHEN ws_retail_ratio < 0.92 THEN 'depletion' ELSE 'balanced' END AS episode,
 CAST(SUM(wholesale - retail) OVER (ORDER BY date ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS BIGINT) AS gap_6m FROM rw""",
    "rw",
    "ws_retail_ratio",
    "date",
)
def channel_episodes(m: Market) -> DataFrame:
    return market.channel_episodes(m.retail_wholesale)


_QUARTILE = """SELECT state_code, v, CASE WHEN v IS NULL THEN NULL WHEN v <= e[2] THEN 0 WHEN v <= e[3] THEN 1 WHEN v <= e[4] THEN 2 ELSE 3 END AS {out}
 FROM (SELECT state_code, {c} AS v FROM context), (SELECT quantile_cont({c}, [0, 0.25, 0.5, 0.75, 1]) AS e FROM context)"""


@query(
    "qry_23_quartile_groups",
    f"""SELECT i.state_code, i.v AS real_pc_income_inr, i.income_quartile, u.urban_quartile FROM ({_QUARTILE.format(c='real_pc_income_inr', out='income_quartile')}) i
 JOIN ({_QUARTILE.format(c='urban_pct', out='urban_quartile')}) u USING (state_code)""",
    "context",
    "real_pc_income_inr",
)
def quartile_groups(m: Market) -> DataFrame:
    from panelwright.operators.series import quantile_bins

    rows = m.context.select("state_code", "real_pc_income_inr", "urban_pct").withColumn("_g", F.lit(0))
    income = quantile_bins(rows, ["_g"], "real_pc_income_inr", 4, "income_quartile")
    return quantile_bins(income, ["_g"], "urban_pct", 4, "urban_quartile").select(
        "state_code", "real_pc_income_inr", "income_quartile", "urban_quartile"
    )


@query(
    "qry_24_normalisations",
    """SELECT state_code, year, 100 * yoy_growth / FIRST_VALUE(yoy_growth IGNORE NULLS) OVER (PARTITION BY state_code ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS index_100,
 CASE WHEN yoy_growth IS NOT NULL THEN (RANK() OVER (PARTITION BY year ORDER BY yoy_growth NULLS LAST) + (COUNT(*) OVER (PARTITION BY year, yoy_growth) - 1) / 2.0) / COUNT(yoy_growth) OVER (PARTITION BY year) END AS percentile,
 total_regs / SUM(total_regs) OVER (PARTITION BY year)::DOUBLE AS share_of_selected FROM panel_year WHERE state_code <> 'ALL'""",
    "panel_year",
    "index_100 percentile share_of_selected",
)
def normalisations(m: Market) -> DataFrame:
    rows = m.panel_year.where(F.col("state_code") != "ALL").select("state_code", "year", "yoy_growth", "total_regs")
    indexed = market.index_to_100(rows, ["state_code"], "year", "yoy_growth")
    ranked = market.percentile_rank(indexed, ["year"], "yoy_growth", "percentile")
    return market.share_of_selected(ranked, ["year"], "total_regs", "share_of_selected").select(
        "state_code", "year", "index_100", "percentile", "share_of_selected"
    )


@query(
    "qry_25_comparison_table",
    """WITH p AS (SELECT state_name, year, total_regs AS v FROM panel_year WHERE state_code <> 'ALL' AND year <= 2000),
 g AS (SELECT *, v / NULLIF(LAG(v) OVER (PARTITION BY state_name ORDER BY year), 0)::DOUBLE - 1 AS g FROM p),
 e AS (SELECT state_name, max_by(v, year) AS latest, min_by(v, year) AS first, MAX(year) AS y1, MIN(year) AS y0, STDDEV_SAMP(g) AS volatility FROM g GROUP BY state_name),
 r AS (SELECT state_name, MAX(rk) FILTER (year = 1999) - MAX(rk) FILTER (year = 2000) AS rank_change FROM (
   SELECT state_name, year, RANK() OVER (PARTITION BY year ORDER BY v DESC) + (COUNT(*) OVER (PARTITION BY year, v) - 1) / 2.0 AS rk FROM p) GROUP BY state_name)
 SELECT e.state_name, latest, RANK() OVER (ORDER BY latest DESC)::DOUBLE AS rank,
  (RANK() OVER (ORDER BY latest) + (COUNT(*) OVER (PARTITION BY latest) - 1) / 2.0) / COUNT(*) OVER () AS percentile,
  CASE WHEN first > 0 THEN POWER(latest::DOUBLE / first, 1.0 / GREATEST(y1 - y0, 1)) - 1 END AS cagr, volatility,
  latest / (SELECT SUM(v) FROM p WHERE year = y1)::DOUBLE AS contribution, rank_change FROM e JOIN r USING (state_name)""",
    "panel_year",
    "rank percentile cagr volatility contribution rank_change",
)
def comparison_table(m: Market) -> DataFrame:
    rows = m.panel_year.where((F.col("state_code") != "ALL") & (F.col("year") <= YEAR))
    return market.comparison_table(rows, "total_regs", YEAR)


@query(
    "qry_26_trend_line",
    """SELECT zone, regr_slope(ev_share, urban_pct) AS slope, regr_intercept(ev_share, urban_pct) AS intercept, regr_r2(ev_share, urban_pct) AS r2, COUNT(*) AS n
 FROM full_year JOIN dim_state USING (state_code) WHERE year = 2000 AND ev_share IS NOT NULL AND urban_pct IS NOT NULL GROUP BY zone""",
    "full_year dim_state",
    "slope intercept r2",
)
def trend_line(m: Market) -> DataFrame:
    rows = m.full_year.where(F.col("year") == YEAR).join(
        m.dim_state.select("state_code", "zone"), "state_code"
    )
    return market.trend_line(rows, ["zone"], "urban_pct", "ev_share")


@query(
    "qry_27_share_matrix",
    """WITH s AS (SELECT state_code, maker, SUM(regs) / SUM(SUM(regs)) OVER (PARTITION BY state_code)::DOUBLE AS share FROM edges WHERE year = 2000 GROUP BY state_code, maker),
 k AS (SELECT maker FROM s GROUP BY maker ORDER BY SUM(share) DESC, maker LIMIT 18)
 SELECT state_code, maker, share, MAX(share) OVER (PARTITION BY state_code) AS row_max FROM s WHERE maker IN (SELECT maker FROM k)""",
    "edges",
    "share row_max",
)
def share_matrix(m: Market) -> DataFrame:
    return market.share_matrix(m.edges.where(F.col("year") == YEAR))


@query(
    "qry_28_mapping_coverage",
    """SELECT COALESCE(coverage, 'overall') AS coverage, CAST(SUM(qty) AS BIGINT) AS units, CAST(SUM(qty) FILTER (state_code IS NOT NULL) AS BIGINT) AS mapped_units,
 100 * SUM(qty) FILTER (state_code IS NOT NULL) / SUM(qty)::DOUBLE AS mapped_pct FROM wholesale GROUP BY ROLLUP (coverage)""",
    "wholesale",
    "mapped_pct",
)
def mapping_coverage(m: Market) -> DataFrame:
    return market.mapping_coverage(m.dispatch)


def _top_sql(select: str, where: str, limit: int) -> str:
    return f"SELECT {select}, CAST(SUM(qty) AS BIGINT) AS units FROM wholesale WHERE coverage = 'full' AND {where} GROUP BY ALL ORDER BY units DESC, ALL_KEYS LIMIT {limit}".replace(
        "ALL_KEYS", select
    )


@query(
    "qry_29_top_models",
    _top_sql("model, maker, segment5", "year = 2000", 25),
    "wholesale",
)
def top_models(m: Market) -> DataFrame:
    return market.top_groups(full_dispatch(m), ["model", "maker", "segment5"], 25, F.col("year") == YEAR)


@query("qry_29_top_cities", _top_sql("city, state_code", "year = 2000", 30), "wholesale")
def top_cities(m: Market) -> DataFrame:
    return market.top_groups(full_dispatch(m), ["city", "state_code"], 30, F.col("year") == YEAR)


@query("qry_29_unmapped_cities", _top_sql("city", "year = 2000 AND state_code IS NULL", 20), "wholesale")
def unmapped_cities(m: Market) -> DataFrame:
    here = (F.col("year") == YEAR) & F.col("state_code").isNull()
    return market.top_groups(full_dispatch(m), ["city"], 20, here)


@query(
    "qry_30_model_trajectory",
    "SELECT model, date, CAST(SUM(qty) AS BIGINT) AS units FROM wholesale WHERE model = 'RED WIDGET' GROUP BY ALL",
    "wholesale",
    texts="date",
)
def model_trajectory(m: Market) -> DataFrame:
    return market.model_trajectory(m.dispatch, "RED WIDGET")


@query(
    "qry_30_lifecycle_peak",
    """SELECT model, date AS peak_date, units AS peak_units FROM (SELECT model, date, CAST(SUM(qty) AS BIGINT) AS units FROM wholesale GROUP BY ALL)
 QUALIFY ROW_NUMBER() OVER (PARTITION BY model ORDER BY units DESC, date) = 1""",
    "wholesale",
    texts="peak_date",
)
def lifecycle_peak(m: Market) -> DataFrame:
    return market.lifecycle_peak(m.dispatch)


@query(
    "qry_31_segment_and_ev_only",
    """SELECT 'segment' AS part, segment5 AS name, date, CAST(SUM(qty) AS BIGINT) AS units FROM wholesale WHERE date >= DATE '1998-01-01' GROUP BY ALL
 UNION ALL SELECT 'ev_only_oem', maker, date, CAST(SUM(qty) AS BIGINT) FROM wholesale WHERE ev_only = 1 AND date >= DATE '1998-01-01' GROUP BY ALL
 UNION ALL (SELECT 'ev_only_state', state_code, NULL, CAST(SUM(qty) AS BIGINT) AS u FROM wholesale WHERE ev_only = 1 AND state_code IS NOT NULL AND date >= DATE '2000-01-01'
   GROUP BY state_code ORDER BY u DESC, state_code LIMIT 15)""",
    "wholesale",
    texts="date",
)
def segment_and_ev_only(m: Market) -> DataFrame:
    since = m.dispatch.where(F.col("date") >= F.lit(FULL_COVERAGE_FROM).cast("date"))
    ev = since.where(F.col("ev_only") == 1)
    units = F.sum("qty").alias("units")
    states = market.top_groups(
        ev, ["state_code"], 15,
        F.col("state_code").isNotNull() & (F.col("date") >= F.lit("2000-01-01").cast("date")),
    )
    return stack(
        {
            "segment": since.groupBy(F.col("segment5").alias("name"), "date").agg(units),
            "ev_only_oem": ev.groupBy(F.col("maker").alias("name"), "date").agg(units),
            "ev_only_state": states.select(
                F.col("state_code").alias("name"), F.lit(None).cast("date").alias("date"), "units"
            ),
        }
    )


@query(
    "qry_32_metadata_tier",
    """SELECT CASE WHEN ev_only = 1 THEN 'EV-only nameplate' WHEN fuel_variants IS NULL THEN 'unclassified' ELSE 'mixed-fuel / quantity unknown' END AS metadata_tier,
 COUNT(DISTINCT model) AS models, CAST(SUM(qty) AS BIGINT) AS units FROM wholesale WHERE coverage = 'full' GROUP BY 1""",
    "wholesale",
)
def metadata_tier(m: Market) -> DataFrame:
    return market.metadata_tier(full_dispatch(m))


@query(
    "qry_33_ramp_curves",
    """SELECT model, date, CAST(SUM(qty) AS BIGINT) AS units FROM wholesale WHERE maker = 'Maruti Suzuki' AND model IN (
 SELECT model FROM wholesale WHERE maker = 'Maruti Suzuki' GROUP BY model ORDER BY SUM(qty) DESC, model LIMIT 8) GROUP BY ALL""",
    "wholesale",
    texts="date",
)
def ramp_curves(m: Market) -> DataFrame:
    return market.ramp_curves(m.dispatch, "Maruti Suzuki")


@query(
    "qry_33_portfolio",
    """SELECT maker, model, segment5, ev_only, CAST(SUM(qty) AS BIGINT) AS units FROM wholesale WHERE coverage = 'full' AND year = 2000 GROUP BY ALL""",
    "wholesale",
)
def portfolio(m: Market) -> DataFrame:
    return (
        full_dispatch(m).where(F.col("year") == YEAR)
        .groupBy("maker", "model", "segment5", "ev_only")
        .agg(F.sum("qty").alias("units"))
    )


@query(
    "qry_34_top3_states",
    "SELECT maker, COUNT(*) FILTER (rnk <= 3) AS top3_states FROM maker_share WHERE state_code <> 'ALL' AND year = 2000 GROUP BY maker",
    "maker_share",
)
def top3_states(m: Market) -> DataFrame:
    return market.top3_states(m.maker_share, YEAR)


@query(
    "qry_35_series_extraction",
    """WITH s AS (SELECT state_code, maker, make_date(year, month, 1) AS date, CAST(SUM("count") AS BIGINT) AS value FROM facts WHERE year <= 2000 AND state_code <> 'ALL' GROUP BY ALL)
 SELECT c.state_code, c.maker, c.date, s.value FROM (SELECT state_code, maker, CAST(unnest(generate_series(a, b, INTERVAL 1 MONTH)) AS DATE) AS date
  FROM (SELECT state_code, maker, MIN(date)::TIMESTAMP AS a, MAX(date)::TIMESTAMP AS b FROM s GROUP BY state_code, maker)) c
 LEFT JOIN s USING (state_code, maker, date)""",
    "facts",
    texts="date",
)
def series_extraction(m: Market) -> DataFrame:
    local = m.facts.where(F.col("state_code") != "ALL")
    return market.monthly_series(local, ["state_code", "maker"], YEAR)


@query(
    "qry_36_reference_views",
    """SELECT 'population' AS part, state_name, CAST(year AS VARCHAR) AS at, population_mn AS value FROM ref_population JOIN dim_state USING (state_code)
 UNION ALL SELECT 'growth', d.state_name, CAST(year AS VARCHAR), gsdp_real_growth_pct FROM full_year JOIN dim_state d USING (state_code)
 UNION ALL SELECT 'cng', state_name, CAST(year AS VARCHAR), stations FROM cng JOIN dim_state USING (state_code)
 UNION ALL SELECT 'ev', state_name, CAST(year AS VARCHAR), public_chargers FROM ev JOIN dim_state USING (state_code)
 UNION ALL SELECT 'tax', state_name, fuel, lifetime_tax_rate_pct FROM tax JOIN dim_state USING (state_code)""",
    "ref_population dim_state full_year cng ev tax",
    "value",
)
def reference_views(m: Market) -> DataFrame:
    names = m.dim_state.select("state_code", "state_name")

    def view(df: DataFrame, at: str, value: str) -> DataFrame:
        return df.drop("state_name").join(names, "state_code").select(
            "state_name", F.col(at).cast("string").alias("at"), F.col(value).cast("double").alias("value")
        )

    return stack(
        {
            "population": view(m.population, "year", "population_mn"),
            "growth": view(m.full_year, "year", "gsdp_real_growth_pct"),
            "cng": view(m.cng, "year", "stations"),
            "ev": view(m.ev, "year", "public_chargers"),
            "tax": view(m.tax, "fuel", "lifetime_tax_rate_pct"),
        }
    )


@query(
    "qry_37_event_counts",
    """SELECT CAST(year(date) AS BIGINT) AS year, category, COUNT(*) AS events FROM ref_events WHERE CAST(substr(event_id, 9) AS BIGINT) % 10 <> 0 GROUP BY ALL""",
    "ref_events",
)
def event_counts(m: Market) -> DataFrame:
    untidy = m.ref("ref_events").withColumn(
        "date_text",
        F.when(F.col("event_id").rlike("0$"), "unknown").otherwise(F.col("date").cast("string")),
    )
    return market.event_counts(untidy)


@query(
    "qry_38_load_events",
    "SELECT event_id, date, tier, label FROM ref_events WHERE tier = 1",
    "ref_events",
    texts="date",
)
def load_events(m: Market) -> DataFrame:
    return market.load_events(m.ref("ref_events")).select("event_id", "date", "tier", "label")


@query(
    "qry_38_thinned_events",
    """SELECT event_id, date FROM (SELECT event_id, date, ROW_NUMBER() OVER (ORDER BY date, event_id) - 1 AS i, COUNT(*) OVER () AS n FROM ref_events WHERE tier = 1)
 WHERE i IN (SELECT CAST(round_even(k * (SELECT COUNT(*) - 1 FROM ref_events WHERE tier = 1) / 11.0, 0) AS BIGINT) FROM range(12) t(k))""",
    "ref_events",
    texts="date",
)
def thinned_events(m: Market) -> DataFrame:
    events = market.load_events(m.ref("ref_events")).select("event_id", "date")
    return market.thin_evenly(events, ["date", "event_id"], 12)


@query(
    "qry_39_channel_baseline",
    """SELECT AVG(g) FILTER (back <= 12) / 12 AS monthly_growth, AVG(ws_retail_ratio) AS average_ratio, COUNT(*) AS months FROM (
 SELECT *, retail / NULLIF(LAG(retail, 12) OVER (ORDER BY date), 0)::DOUBLE - 1 AS g, ROW_NUMBER() OVER (ORDER BY date DESC) AS back FROM rw)""",
    "rw",
    "monthly_growth average_ratio",
)
def channel_baseline(m: Market) -> DataFrame:
    return market.channel_baseline(m.retail_wholesale)


@query(
    "qry_40_shares_since",
    "SELECT date, ev_share, cng_share, petrol_share, diesel_share, hybrid_share FROM panel_month WHERE state_code = 'ALL' AND year >= 1998",
    "panel_month",
    "ev_share cng_share petrol_share diesel_share hybrid_share",
    "date",
)
def shares_since(m: Market) -> DataFrame:
    return market.monthly_shares_since(m.panel_month, "1998-01-01")


_PATTERNS = {"purchase": "purchase", "entry": "signup|view", "seven": "7"}


@query(
    "qry_40_policy_mentions",
    "\nUNION ALL ".join(
        f"SELECT '{name}' AS pattern, COUNT(*) FILTER (regexp_matches(lower(label || ' ' || detail), '{p}')) AS mentions FROM ref_events"
        for name, p in _PATTERNS.items()
    ),
    "ref_events",
)
def policy_mentions(m: Market) -> DataFrame:
    return market.policy_mentions(m.ref("ref_events"), _PATTERNS)


@query(
    "qry_41_yearly_profile",
    """SELECT year, COUNT(DISTINCT city) AS cities, COUNT(DISTINCT maker) AS makers, COUNT(DISTINCT model) AS models, CAST(SUM(qty) AS BIGINT) AS units FROM wholesale GROUP BY year""",
    "wholesale",
)
def yearly_profile(m: Market) -> DataFrame:
    return market.yearly_profile(m.dispatch)


@query(
    "qry_41_cumulative_city_share",
    """SELECT city, units, SUM(units) OVER (ORDER BY units DESC, city) / (SELECT SUM(qty) FROM wholesale)::DOUBLE AS cumulative_share FROM (
 SELECT city, CAST(SUM(qty) AS BIGINT) AS units FROM wholesale GROUP BY city ORDER BY units DESC, city LIMIT 50)""",
    "wholesale",
    "cumulative_share",
)
def cumulative_city_share(m: Market) -> DataFrame:
    return market.cumulative_city_share(m.dispatch, 50)
