"""Queries of descriptive statistics, inequality and specialisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelwright.catalog.registry import Market, query
from panelwright.functions.columns import month_start, ratio
from panelwright.operators import stats
from panelwright.plans import panels

SHARE_SQL = """SELECT state_code, year, maker, CAST(SUM("count") AS DOUBLE) / NULLIF(SUM(SUM("count")) OVER (PARTITION BY state_code, year), 0) AS share
 FROM facts GROUP BY state_code, year, maker"""


def _local(m: Market) -> DataFrame:
    return m.facts.where(F.col("state_code") != "ALL")


def _shares(m: Market) -> DataFrame:
    return panels.group_shares(m.facts, ["state_code", "year"], "maker", "count")


@query(
    "agg_01_hhi",
    f"SELECT state_code, year, SUM(share * share) * 10000 AS hhi FROM ({SHARE_SQL}) GROUP BY ALL",
    "facts",
    "hhi",
)
def hhi(m: Market) -> DataFrame:
    return stats.hhi(_shares(m), ["state_code", "year"])


@query(
    "agg_02_shannon_entropy",
    f"""SELECT state_code, year, entropy, CASE WHEN n > 1 THEN entropy / LN(n) ELSE entropy END AS entropy_norm FROM (
 SELECT state_code, year, -SUM(CASE WHEN share > 0 THEN share * LN(share) ELSE 0 END) AS entropy, COUNT(*) FILTER (share > 0) AS n
 FROM ({SHARE_SQL}) GROUP BY ALL)""",
    "facts",
    "entropy entropy_norm",
)
def shannon_entropy(m: Market) -> DataFrame:
    return stats.shannon_entropy(_shares(m), ["state_code", "year"])


@query(
    "agg_03_cagr",
    """SELECT state_code, CASE WHEN n >= 2 AND f > 0 THEN POWER(CAST(l AS DOUBLE) / f, 1.0 / (n - 1)) - 1 END AS cagr FROM (
 SELECT state_code, min_by(total_regs, year) AS f, max_by(total_regs, year) AS l, COUNT(total_regs) AS n FROM panel_year GROUP BY state_code)""",
    "panel_year",
    "cagr",
)
def cagr(m: Market) -> DataFrame:
    return stats.cagr(m.panel_year, ["state_code"], "year", "total_regs")


@query(
    "agg_04_yoy_growth",
    """SELECT maker, year, regs, CAST(regs AS DOUBLE) / NULLIF(LAG(regs) OVER (PARTITION BY maker ORDER BY year), 0) - 1 AS growth
 FROM (SELECT maker, year, CAST(SUM("count") AS BIGINT) AS regs FROM facts WHERE state_code <> 'ALL' GROUP BY ALL)""",
    "facts",
    "growth",
)
def yoy_growth(m: Market) -> DataFrame:
    yearly = _local(m).groupBy("maker", "year").agg(F.sum("count").alias("regs"))
    return stats.yoy_growth(yearly, ["maker"], "year", "regs")


@query(
    "agg_05_seasonality",
    """SELECT state_code, month, AVG(i) AS seasonal_index, STDDEV_SAMP(i) AS std, COUNT(i) AS "count" FROM (
 SELECT state_code, month, total_regs / NULLIF(AVG(total_regs) OVER (PARTITION BY state_code, year), 0) AS i FROM panel_month) GROUP BY ALL""",
    "panel_month",
    "seasonal_index std",
)
def seasonality(m: Market) -> DataFrame:
    return stats.seasonality_profile(m.panel_month, ["state_code"])


@query(
    "agg_06_market_shares",
    """SELECT fuel, maker, CAST(SUM("count") AS BIGINT) AS total, CAST(SUM("count") AS DOUBLE) / SUM(SUM("count")) OVER (PARTITION BY fuel) AS share
 FROM facts WHERE state_code <> 'ALL' GROUP BY fuel, maker""",
    "facts",
    "share",
)
def market_shares(m: Market) -> DataFrame:
    return stats.market_shares(_local(m), ["fuel"], "maker", "count")


@query(
    "agg_07_concentration_series",
    """SELECT year, SUM(s * s) * 10000 AS hhi, -SUM(CASE WHEN s > 0 THEN s * LN(s) ELSE 0 END) AS entropy,
 -SUM(CASE WHEN s > 0 THEN s * LN(s) ELSE 0 END) / CASE WHEN COUNT(*) FILTER (s > 0) > 1 THEN LN(COUNT(*) FILTER (s > 0)) ELSE 1 END AS entropy_norm,
 COUNT(*) FILTER (s > 0) AS n_entities FROM (
 SELECT year, maker, CAST(SUM(regs) AS DOUBLE) / SUM(SUM(regs)) OVER (PARTITION BY year) AS s FROM edges GROUP BY year, maker) GROUP BY year""",
    "edges",
    "hhi entropy entropy_norm",
)
def concentration_series(m: Market) -> DataFrame:
    return stats.concentration_series(m.edges, "year", "maker", "regs")


@query(
    "agg_08_summary_table",
    """WITH f AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY state_code ORDER BY year DESC) AS back FROM panel_year
   WHERE state_code <> 'ALL' AND year <= (SELECT MAX(year) - 1 FROM panel_year WHERE total_regs IS NOT NULL)),
 g AS (SELECT state_code, CASE WHEN COUNT(*) >= 2 AND min_by(total_regs, year) > 0
   THEN POWER(CAST(max_by(total_regs, year) AS DOUBLE) / min_by(total_regs, year), 1.0 / (COUNT(*) - 1)) - 1 END AS cagr_5y
   FROM f WHERE back <= 6 GROUP BY state_code)
 SELECT f.state_code, f.state_name, f.year AS latest_year, f.total_regs, f.ev_share, f.cng_share, f.hhi_oem, g.cagr_5y
 FROM f JOIN g USING (state_code) WHERE back = 1""",
    "panel_year",
    "ev_share cng_share hhi_oem cagr_5y",
)
def summary_table(m: Market) -> DataFrame:
    return stats.summary_table(m.panel_year.where(F.col("state_code") != "ALL"))


@query(
    "agg_09_gini",
    """SELECT year, (n + 1 - 2 * w) / n AS gini FROM (
 SELECT year, COUNT(*) AS n, SUM(cum / t) AS w FROM (
  SELECT year, CAST(SUM(total_regs) OVER (PARTITION BY year ORDER BY total_regs, state_code ROWS UNBOUNDED PRECEDING) AS DOUBLE) AS cum,
   CAST(SUM(total_regs) OVER (PARTITION BY year) AS DOUBLE) AS t FROM panel_year WHERE state_code <> 'ALL') GROUP BY year)""",
    "panel_year",
    "gini",
)
def gini(m: Market) -> DataFrame:
    return stats.gini(m.panel_year.where(F.col("state_code") != "ALL"), ["year"], "total_regs")


@query(
    "agg_09_gini_order_values",
    """SELECT o_orderpriority, (n + 1 - 2 * w) / n AS gini FROM (
 SELECT o_orderpriority, COUNT(*) AS n, SUM(cum / t) AS w FROM (
  SELECT o_orderpriority, SUM(o_totalprice) OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey ROWS UNBOUNDED PRECEDING) AS cum,
   SUM(o_totalprice) OVER (PARTITION BY o_orderpriority) AS t FROM orders) GROUP BY o_orderpriority)""",
    "",
    "gini",
)
def gini_order_values(m: Market) -> DataFrame:
    return stats.gini(m.table("orders"), ["o_orderpriority"], "o_totalprice")


@query(
    "agg_10_rank_size",
    """SELECT maker, rank, size, LN(rank) AS log_rank, LN(size) AS log_size FROM (
 SELECT maker, model, SUM(qty) AS s, ROW_NUMBER() OVER (PARTITION BY maker ORDER BY SUM(qty) DESC, model) AS rank, CAST(SUM(qty) AS BIGINT) AS size
 FROM wholesale GROUP BY maker, model) WHERE size > 0""",
    "wholesale",
    "log_rank log_size",
)
def rank_size(m: Market) -> DataFrame:
    sizes = m.dispatch.groupBy("maker", "model").agg(F.sum("qty").alias("units"))
    return stats.rank_size(sizes, ["maker"], "units")


@query(
    "agg_11_zipf_exponent",
    """SELECT year, regr_slope(LN(s), LN(r)) AS slope, regr_intercept(LN(s), LN(r)) AS intercept, regr_r2(LN(s), LN(r)) AS r2, COUNT(*) AS n
 FROM (SELECT year, total_regs AS s, ROW_NUMBER() OVER (PARTITION BY year ORDER BY total_regs DESC) AS r FROM panel_year WHERE state_code <> 'ALL') GROUP BY year""",
    "panel_year",
    "slope intercept r2",
)
def zipf_exponent(m: Market) -> DataFrame:
    return stats.zipf_exponent(m.panel_year.where(F.col("state_code") != "ALL"), ["year"], "total_regs")


@query("agg_12_powerlaw_fit")
def powerlaw_fit(m: Market) -> DataFrame:
    sizes = m.dispatch.groupBy("year", "city").agg(F.sum("qty").alias("units"))
    return stats.powerlaw_fit(sizes, ["year"], "units")


@query(
    "agg_12_powerlaw_tail",
    """WITH s AS (SELECT year, city, SUM(qty)::DOUBLE AS x FROM wholesale GROUP BY ALL HAVING SUM(qty) > 0),
 v AS (SELECT year, x, COUNT(*) AS c FROM s GROUP BY year, x QUALIFY SUM(COUNT(*)) OVER (PARTITION BY year) >= 10),
 cand AS (SELECT a.year, a.x AS xmin, SUM(b.c) AS n_tail, 1 + SUM(b.c) / SUM(b.c * LN(b.x / a.x)) AS alpha
  FROM v a JOIN v b ON b.year = a.year AND b.x >= a.x GROUP BY a.year, a.x HAVING COUNT(*) > 1),
 cum AS (SELECT c.*, v.x, v.c, SUM(v.c) OVER (PARTITION BY c.year, c.xmin ORDER BY v.x) AS upto FROM cand c JOIN v ON v.year = c.year AND v.x >= c.xmin),
 gap AS (SELECT year, xmin, alpha, n_tail, MAX(GREATEST(ABS(upto / n_tail - 1 + (x / xmin) ** (1 - alpha)), ABS((upto - c) / n_tail - 1 + (x / xmin) ** (1 - alpha)))) AS ks FROM cum GROUP BY ALL)
 SELECT year, xmin, alpha, CAST(n_tail AS BIGINT) AS n_tail, ks FROM gap QUALIFY ROW_NUMBER() OVER (PARTITION BY year ORDER BY ks, xmin) = 1""",
    "wholesale",
    "xmin alpha ks",
)
def powerlaw_tail(m: Market) -> DataFrame:
    sizes = m.dispatch.groupBy("year", "city").agg(F.sum("qty").alias("units"))
    return stats.powerlaw_tail(sizes, ["year"], "units")


@query(
    "agg_13_fuel_mix_entropy",
    """SELECT state_code, year, month, -(SELECT SUM(CASE WHEN u > 0 THEN (u / t) * LN(u / t) ELSE 0 END)
 FROM (SELECT unnest([ev_regs, cng_regs, petrol_regs, diesel_regs, hybrid_regs])::DOUBLE AS u, total_regs::DOUBLE AS t)) AS fuel_entropy
 FROM panel_month""",
    "panel_month",
    "fuel_entropy",
)
def fuel_mix_entropy(m: Market) -> DataFrame:
    return stats.fuel_mix_entropy(m.panel_month).select("state_code", "year", "month", "fuel_entropy")


_RCA = """SELECT state_code, maker, (v / SUM(v) OVER (PARTITION BY state_code)) / (SUM(v) OVER (PARTITION BY maker) / SUM(v) OVER ()) AS rca
 FROM (SELECT state_code, maker, CAST(SUM(regs) AS DOUBLE) AS v FROM edges GROUP BY ALL)"""


@query("agg_14_rca", _RCA, "edges", "rca")
def rca(m: Market) -> DataFrame:
    return stats.rca(m.edges, "state_code", "maker", "regs")


def _reflections(rounds: int) -> str:
    steps = ["b AS (SELECT state_code AS s, maker AS p FROM rca WHERE rca >= 1)"]
    steps.append("l AS (SELECT 'state_code' AS kind, s AS src, p AS dst FROM b UNION ALL SELECT 'maker', p, s FROM b)")
    steps.append("k0 AS MATERIALIZED (SELECT kind, src, CAST(COUNT(*) AS DOUBLE) AS v FROM l GROUP BY kind, src)")
    steps.append("c0 AS MATERIALIZED (SELECT kind, src, v - SUM(v * v) OVER (PARTITION BY kind) / SUM(v) OVER (PARTITION BY kind) AS v FROM k0)")
    for i in range(1, rounds + 1):
        steps.append(
            f"c{i} AS MATERIALIZED (SELECT l.kind, l.src, AVG(k.v) AS v FROM l JOIN c{i - 1} k ON k.src = l.dst GROUP BY l.kind, l.src)"
        )
    return f"""WITH rca AS ({_RCA}), {', '.join(steps)}
 SELECT k.src AS node, k.kind, (k.v - AVG(k.v) OVER (PARTITION BY k.kind)) / STDDEV_POP(k.v) OVER (PARTITION BY k.kind) AS complexity, d.v AS degree
 FROM c{rounds} k JOIN k0 d USING (kind, src)"""


@query("agg_15_complexity_indices", _reflections(18), "edges", "complexity degree", digits=4)
def complexity_indices(m: Market) -> DataFrame:
    return stats.complexity_indices(stats.rca(m.edges, "state_code", "maker", "regs"), "state_code", "maker")


_VARIABLES = [
    "total_regs", "ev_share", "yoy_growth", "pc_income_constant_2011_12_inr", "urban_pct", "cng_stations",
]


@query(
    "agg_16_variable_availability",
    """WITH long AS (UNPIVOT (SELECT state_code, total_regs::DOUBLE AS total_regs, ev_share, yoy_growth, pc_income_constant_2011_12_inr,
   urban_pct, cng_stations::DOUBLE AS cng_stations FROM full_year WHERE state_code <> 'ALL')
   ON COLUMNS(* EXCLUDE (state_code)) INTO NAME variable VALUE v),
 rows AS (SELECT COUNT(*) AS n FROM full_year WHERE state_code <> 'ALL'),
 sd AS (SELECT variable, state_code, STDDEV_SAMP(v) AS sd FROM long GROUP BY ALL)
 SELECT variable, COUNT(v) AS non_missing, 1 - COUNT(v) / (SELECT n FROM rows)::DOUBLE AS missing_pct,
  (SELECT quantile_cont(sd, 0.5) FROM sd WHERE sd.variable = long.variable) AS within_state_sd,
  COALESCE((SELECT quantile_cont(sd, 0.5) FROM sd WHERE sd.variable = long.variable) < 1e-9, false) AS near_invariant
 FROM long GROUP BY variable""",
    "full_year",
    "missing_pct within_state_sd",
)
def variable_availability(m: Market) -> DataFrame:
    return stats.variable_availability(
        m.full_year.where(F.col("state_code") != "ALL"), "state_code", _VARIABLES
    )


@query(
    "agg_17_time_to_level",
    """SELECT state_code, maker, max_by(level, year) AS final_level, MIN(year) FILTER (level >= 0.04) AS t_low, MIN(year) FILTER (level >= 0.06) AS t_high
 FROM (SELECT state_code, maker, year, share AS level FROM maker_share) GROUP BY ALL""",
    "maker_share",
    "final_level",
)
def time_to_level(m: Market) -> DataFrame:
    return stats.time_to_level(
        m.maker_share, ["state_code", "maker"], "year", "share", {"t_low": 0.04, "t_high": 0.06}
    )


@query(
    "agg_18_channel_stress",
    """WITH r AS (SELECT state_code, make_date(year, month, 1) AS date, month, CAST(SUM("count") AS BIGINT) AS retail FROM facts WHERE state_code <> 'ALL' GROUP BY ALL),
 w AS (SELECT state_code, date, CAST(SUM(qty) AS BIGINT) AS production FROM wholesale WHERE state_code IS NOT NULL GROUP BY ALL),
 run AS (SELECT state_code, date, retail, production, production / NULLIF(retail, 0)::DOUBLE AS cover FROM r JOIN w USING (state_code, date)),
 j AS (SELECT run.*, b.base FROM run JOIN (SELECT state_code, month(date) AS mo, AVG(retail) AS base FROM r GROUP BY ALL) b ON b.state_code = run.state_code AND b.mo = month(run.date)),
 t AS (SELECT state_code, arg_min(date, (retail, date)) AS d, arg_min(retail / base, (retail, date)) AS lvl, SUM(base - retail) AS gap FROM j GROUP BY state_code),
 g AS (SELECT state_code, production / NULLIF(LAG(production) OVER w, 0)::DOUBLE - 1 AS dp, retail / NULLIF(LAG(retail) OVER w, 0)::DOUBLE - 1 AS dr, cover FROM run WINDOW w AS (PARTITION BY state_code ORDER BY date)),
 s AS (SELECT state_code, MAX(cover) AS mx, MIN(cover) AS mn, VAR_SAMP(dp) / GREATEST(VAR_SAMP(dr), 1e-12) AS bw FROM g GROUP BY state_code)
 SELECT t.state_code, t.d AS trough_month, t.lvl AS trough_retail_vs_baseline, t.gap AS retail_vs_baseline_gap,
 (SELECT MIN(date) FROM j WHERE j.state_code = t.state_code AND j.date > t.d AND j.retail >= 0.98 * j.base) AS recovery_month,
 s.mx AS peak_inventory_cover, s.mn AS min_inventory_cover, s.bw AS bullwhip_ratio FROM t JOIN s USING (state_code)""",
    "facts wholesale",
    "trough_retail_vs_baseline retail_vs_baseline_gap peak_inventory_cover min_inventory_cover bullwhip_ratio",
    "trough_month recovery_month",
)
def channel_stress(m: Market) -> DataFrame:
    retail = (
        _local(m).groupBy("state_code", "year", "month").agg(F.sum("count").alias("retail"))
    ).withColumn("date", month_start())
    sent = (
        m.dispatch.where(F.col("state_code").isNotNull())
        .groupBy("state_code", "date")
        .agg(F.sum("qty").alias("production"))
    )
    run = retail.join(sent, ["state_code", "date"]).withColumn("cover", ratio("production", "retail"))
    by_month = Window.partitionBy("state_code", "month")
    baseline = retail.withColumn("retail", F.avg("retail").over(by_month))
    return stats.channel_stress(run, baseline, ["state_code"], "date")
