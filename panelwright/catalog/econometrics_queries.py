"""Queries of correlation, regression, causality and threshold operators."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.catalog.registry import Market, query
from panelwright.catalog.series_queries import local_year, regimes
from panelwright.operators import econometrics, series
from panelwright.sources.tables import FULL_COVERAGE_FROM

_COLS = ["ev_share", "yoy_growth", "pc_income_constant_2011_12_inr", "urban_pct"]


def _pair_sql(a: str, b: str) -> str:
    rank = "RANK() OVER (ORDER BY {c}) + (COUNT(*) OVER (PARTITION BY {c}) - 1) / 2.0"
    return (
        f"SELECT '{a}' AS a, '{b}' AS b, corr(x, y) AS corr, COUNT(*) AS n FROM (SELECT {rank.format(c=a)} AS x, {rank.format(c=b)} AS y "
        f"FROM full_year WHERE state_code <> 'ALL' AND {a} IS NOT NULL AND {b} IS NOT NULL)"
    )


@query(
    "eco_01_spearman",
    "WITH u AS ("
    + " UNION ALL ".join(_pair_sql(a, b) for a, b in combinations(_COLS, 2))
    + ") SELECT * FROM u UNION ALL SELECT b, a, corr, n FROM u UNION ALL "
    + " UNION ALL ".join(
        f"SELECT '{c}', '{c}', 1.0, COUNT({c}) FROM full_year WHERE state_code <> 'ALL'" for c in _COLS
    ),
    "full_year",
    "corr",
)
def spearman(m: Market) -> DataFrame:
    rows = m.full_year.where(F.col("state_code") != "ALL").select(*_COLS)
    return econometrics.correlation_matrix(rows, _COLS)


@query(
    "eco_01_pearson_orders",
    """SELECT 'o_totalprice' AS a, 'o_custkey' AS b, corr(o_totalprice, o_custkey) AS corr, COUNT(*) AS n FROM orders
 UNION ALL SELECT 'o_custkey', 'o_totalprice', corr(o_totalprice, o_custkey), COUNT(*) FROM orders
 UNION ALL SELECT 'o_totalprice', 'o_totalprice', 1.0, COUNT(*) FROM orders UNION ALL SELECT 'o_custkey', 'o_custkey', 1.0, COUNT(*) FROM orders""",
    "",
    "corr",
)
def pearson_orders(m: Market) -> DataFrame:
    return econometrics.correlation_matrix(m.table("orders"), ["o_totalprice", "o_custkey"], "pearson")


@query(
    "eco_02_panel_ols",
    """WITH d AS (SELECT state_code, cng_share - AVG(cng_share) OVER w AS x, ev_share - AVG(ev_share) OVER w AS y FROM panel_year WHERE state_code <> 'ALL' WINDOW w AS (PARTITION BY state_code)),
 b AS (SELECT SUM(x * y) / SUM(x * x) AS b, SUM(x * x) AS sxx, COUNT(*) AS n, COUNT(DISTINCT state_code) AS g FROM d),
 s AS (SELECT SUM(u * u) AS meat FROM (SELECT SUM(x * (y - b * x)) AS u FROM d, b GROUP BY state_code))
 SELECT 'cng_share' AS term, b AS coef, SQRT(meat) / sxx * SQRT(g / (g - 1.0) * (n - 1.0) / (n - g - 1.0)) AS se, n FROM b, s""",
    "panel_year",
    "coef se",
)
def panel_ols(m: Market) -> DataFrame:
    return econometrics.panel_ols(local_year(m), "ev_share", ["cng_share"]).select("term", "coef", "se", "n")


_TWO_WAY = """WITH o AS (SELECT state_code, year, cng_share::DOUBLE AS x, ev_share::DOUBLE AS y FROM panel_year WHERE state_code <> 'ALL'),
 d AS (SELECT state_code, x - AVG(x) OVER e - AVG(x) OVER t + AVG(x) OVER () AS x, y - AVG(y) OVER e - AVG(y) OVER t + AVG(y) OVER () AS y, y AS raw
  FROM o WINDOW e AS (PARTITION BY state_code), t AS (PARTITION BY year)),
 b AS (SELECT SUM(x * y) / SUM(x * x) AS b, SUM(x * x) AS sxx, COUNT(*) AS n, COUNT(DISTINCT state_code) AS g, (SELECT COUNT(DISTINCT year) FROM o) AS t, VAR_POP(raw) * COUNT(*) AS syy FROM d),
 s AS (SELECT SUM(u * u) AS meat FROM (SELECT SUM(x * (y - b * x)) AS u FROM d, b GROUP BY state_code)),
 r AS (SELECT SUM((y - b * x) ** 2) AS sse FROM d, b)
 SELECT 'cng_share' AS term, b AS coef, SQRT(meat) / sxx * SQRT(g / (g - 1.0) * (n - 1.0) / (n - g - t)) AS se, n, 1 - sse / syy AS r2 FROM b, s, r"""


@query("eco_02_panel_ols_two_way", _TWO_WAY, "panel_year", "coef se r2")
def panel_ols_two_way(m: Market) -> DataFrame:
    """State and year effects; every state reports every year, so the oracle may subtract both means at once."""
    return econometrics.panel_ols(local_year(m), "ev_share", ["cng_share"], time_effects=True).select("term", "coef", "se", "n", "r2")


@query("eco_03_coefficient_table")
def coefficient_table(m: Market) -> DataFrame:
    return econometrics.panel_ols(
        m.full_year.where(F.col("state_code") != "ALL"),
        "ev_share",
        ["cng_share", "pc_income_constant_2011_12_inr", "personal_loans_yoy_growth_pct"],
        time_effects=True,
    )


@query("eco_04_granger")
def granger(m: Market) -> DataFrame:
    return econometrics.granger(
        m.panel_month, ["state_code"], "date", "petrol_regs", "ev_regs", 4
    )


_TREATED, _CONTROLS, _EVENT = ["S05"], ["S01", "S02", "S03", "S04", "S06"], "1998-07-01"
_DID_WINDOW = """SELECT state_code, hybrid_share AS v, date >= DATE '1998-07-01' AS post FROM panel_month
 WHERE state_code IN ('S01', 'S02', 'S03', 'S04', 'S05', 'S06') AND date >= DATE '1998-01-01' AND date < DATE '1999-03-01'"""
_PLACEBO = """SELECT c.state_code AS entity, (AVG(v) FILTER (d.state_code = c.state_code AND post) - AVG(v) FILTER (d.state_code = c.state_code AND NOT post))
 - (AVG(v) FILTER (d.state_code <> c.state_code AND post) - AVG(v) FILTER (d.state_code <> c.state_code AND NOT post)) AS placebo
 FROM d, (SELECT DISTINCT state_code FROM d WHERE state_code <> 'S05') c WHERE d.state_code <> 'S05' GROUP BY c.state_code"""


@query(
    "eco_05_did",
    f"""WITH d AS ({_DID_WINDOW}), p AS ({_PLACEBO}),
 e AS (SELECT AVG(v) FILTER (state_code = 'S05' AND post) - AVG(v) FILTER (state_code = 'S05' AND NOT post) AS t,
  AVG(v) FILTER (state_code <> 'S05' AND post) - AVG(v) FILTER (state_code <> 'S05' AND NOT post) AS c FROM d)
 SELECT t - c AS att, t AS treated_change, c AS control_change, ((SELECT COUNT(*) FROM p WHERE ABS(placebo) >= ABS(t - c)) + 1) / ((SELECT COUNT(*) FROM p) + 1)::DOUBLE AS placebo_rank_p,
 1 AS n_treated, 5 AS n_controls, '1998-01-01' AS window_start, '1999-03-01' AS window_end FROM e""",
    "panel_month",
    "att treated_change control_change placebo_rank_p",
)
def did(m: Market) -> DataFrame:
    return econometrics.did(m.panel_month, _TREATED, _CONTROLS, _EVENT, "hybrid_share", post_months=8)


@query("eco_05_did_placebos", f"WITH d AS ({_DID_WINDOW}) {_PLACEBO}", "panel_month", "placebo")
def did_placebos(m: Market) -> DataFrame:
    return econometrics.did_placebos(m.panel_month, _CONTROLS, _EVENT, "hybrid_share", post_months=8)


@query("eco_06_changepoints")
def changepoints(m: Market) -> DataFrame:
    return econometrics.changepoints(m.panel_month, ["state_code"], "date", "total_regs", n_bkps=3)


@query("eco_06_changepoints_penalty")
def changepoints_penalty(m: Market) -> DataFrame:
    """The running total has long flat slopes, so the penalised partition finds breaks."""
    from pyspark.sql import Window

    upto = Window.partitionBy("state_code").orderBy("date")
    rising = m.panel_month.withColumn("level", F.sum("total_regs").over(upto))
    return econometrics.changepoints(rising, ["state_code"], "date", "level", penalty=3.0)


def scan_sql(ser: str) -> str:
    """Threshold scan over ``ser`` (k, ord, s), as a WITH body ending in table ``scan``."""
    grid = ", ".join(f"{0.2 + 0.6 * i / 24!r}" for i in range(25))
    return f"""ser AS ({ser}),
 dd AS (SELECT * FROM (SELECT k, s - LAG(s) OVER w AS y, LAG(s) OVER w AS x FROM ser WHERE s IS NOT NULL WINDOW w AS (PARTITION BY k ORDER BY ord)) WHERE y IS NOT NULL),
 n0 AS (SELECT k, COUNT(*) AS n, COUNT(*) * (VAR_POP(y) - COVAR_POP(x, y) ** 2 / NULLIF(VAR_POP(x), 0)) AS sse0, quantile_cont(x, [{grid}]) AS q FROM dd GROUP BY k),
 g AS (SELECT DISTINCT k, n, sse0, unnest(q) AS tau FROM n0 WHERE n >= 12),
 mo AS (SELECT k, tau, sse0, COUNT(*) AS c, VAR_POP(x) AS sxx, VAR_POP(h) AS shh, VAR_POP(y) AS syy, COVAR_POP(x, h) AS sxh, COVAR_POP(x, y) AS sxy, COVAR_POP(h, y) AS shy,
   COUNT(*) FILTER (h > 0) AS above FROM (SELECT dd.k, tau, sse0, x, y, GREATEST(x - tau, 0) AS h FROM dd JOIN g USING (k)) GROUP BY k, tau, sse0),
 ft AS (SELECT *, (sxy * shh - shy * sxh) / NULLIF(sxx * shh - sxh * sxh, 0) AS bx, (shy * sxx - sxy * sxh) / NULLIF(sxx * shh - sxh * sxh, 0) AS bh FROM mo WHERE above >= 5 AND c - above >= 5 AND sxx * shh - sxh * sxh > 1e-12 * sxx * shh),
 fb AS (SELECT *, c * (syy - bx * sxy - bh * shy) AS sse FROM ft WHERE bx IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY k ORDER BY round(sse / NULLIF(sse0, 0), 10) NULLS FIRST, tau) = 1),
 scan AS (SELECT n0.k, tau, bx AS slope_below, bx + bh AS slope_above, bh AS hinge_coef, CASE WHEN n0.sse0 > 0 THEN 1 - sse / n0.sse0 END AS sse_gain, n0.n FROM n0 LEFT JOIN fb USING (k))"""


_SCAN_COLS = "tau slope_below slope_above hinge_coef sse_gain"


@query(
    "eco_07_threshold_scan",
    f"WITH {scan_sql('SELECT state_code AS k, date AS ord, ev_share AS s FROM panel_month')} SELECT k AS state_code, * EXCLUDE (k) FROM scan",
    "panel_month",
    _SCAN_COLS,
    digits=5,
)
def threshold_scan(m: Market) -> DataFrame:
    return econometrics.threshold_scan(m.panel_month, ["state_code"], "date", "ev_share")


def _smoothed(windows: tuple[int, ...], where: str = "state_code <> 'ALL'") -> str:
    return " UNION ALL ".join(
        f"SELECT state_code || '|{w}' AS k, date AS ord, AVG(ev_share) OVER (PARTITION BY state_code ORDER BY date ROWS BETWEEN {w // 2} PRECEDING AND {w - w // 2 - 1} FOLLOWING) AS s FROM panel_month WHERE {where}"
        for w in windows
    )


_TIPS = """SELECT split_part(k, '|', 1) AS state_code, CAST(split_part(k, '|', 2) AS BIGINT) AS smooth_window, scan.* EXCLUDE (k), max_share
 FROM scan JOIN (SELECT k, MAX(s) AS max_share FROM ser GROUP BY k) p USING (k) WHERE max_share >= {floor}"""


def local_month(m: Market) -> DataFrame:
    return m.panel_month.where(F.col("state_code") != "ALL")


@query(
    "eco_08_tipping_summary",
    f"WITH {scan_sql(_smoothed((3,)))} {_TIPS.format(floor=0.30)}",
    "panel_month",
    _SCAN_COLS + " max_share",
    digits=5,
)
def tipping_summary(m: Market) -> DataFrame:
    return econometrics.tipping_summary(local_month(m), ["state_code"], "date", "ev_share", 0.30)


@query(
    "eco_09_stability",
    f"""WITH {scan_sql(_smoothed((1, 3, 5, 7, 9)))}, t AS ({_TIPS.format(floor=0.01)}),
 a AS (SELECT state_code, STDDEV_SAMP(tau) AS tau_sd, MAX(sse_gain) FILTER (smooth_window = 3) AS sse_gain, MAX(hinge_coef) FILTER (smooth_window = 3) AS hinge_coef FROM t GROUP BY state_code)
 SELECT *, CASE WHEN sse_gain < 0.1 OR tau_sd > 0.03 THEN 'no credible transition' WHEN hinge_coef > 0 THEN 'stable feedback threshold' ELSE 'stable saturation transition' END AS verdict FROM a""",
    "panel_month",
    "tau_sd sse_gain hinge_coef",
    digits=5,
)
def stability(m: Market) -> DataFrame:
    tips = econometrics.tipping_summary(
        local_month(m), ["state_code"], "date", "ev_share", windows=(1, 3, 5, 7, 9)
    )
    return econometrics.threshold_stability(tips, ["state_code"])


ERAS = {
    "full": (None, None),
    "policy era": (None, "1999-03-31"),
    "recent": (FULL_COVERAGE_FROM, None),
}
_ERA_SER = " UNION ALL ".join(
    _smoothed((3,), f"state_code <> 'ALL' AND {cond}").replace("'|3'", f"'|{label}'")
    for label, cond in (
        ("full", "true"), ("policy era", "date <= DATE '1999-03-31'"), ("recent", "date >= DATE '1998-01-01'")
    )
)


@query(
    "eco_09_era_verdicts",
    f"""WITH {scan_sql(_ERA_SER)} SELECT split_part(k, '|', 2) AS era, COUNT(*) AS states_scanned, COUNT(*) FILTER (sse_gain >= 0.1 AND hinge_coef > 0) AS feedback_thresholds,
 COUNT(*) FILTER (sse_gain >= 0.1 AND hinge_coef < 0) AS saturation_thresholds FROM scan WHERE sse_gain IS NOT NULL GROUP BY ALL""",
    "panel_month",
)
def era_verdicts(m: Market) -> DataFrame:
    keyed = econometrics.in_eras(local_month(m), "date", ERAS)
    tips = econometrics.tipping_summary(keyed, ["state_code", "era"], "date", "ev_share")
    return econometrics.era_verdicts(tips)


@query("eco_10_hazard_model")
def hazard_model(m: Market) -> DataFrame:
    covariates = ["pc_income_constant_2011_12_inr", "personal_loans_per_capita_inr"]
    risk = series.build_risk_set(regimes(m), m.full_year, covariates)
    return econometrics.discrete_hazard_model(risk, covariates)


@query(
    "eco_11_era_experiment",
    f"""WITH {scan_sql(_smoothed((3,)))}, t AS ({_TIPS.format(floor=0.01)})
 SELECT t.state_code, tau, hinge_coef, sse_gain, real_pc_income_inr, ev_chargers_2025, broad_credit_per_capita_inr, latest_real_gsdp_growth_pct, mo.momentum_verdict
 FROM t LEFT JOIN context USING (state_code) LEFT JOIN (
  SELECT state_code, CASE WHEN c < -0.1 THEN 'contracting' WHEN acc > 0.1 THEN 'accelerating' WHEN acc < -0.1 THEN 'decelerating' ELSE 'steady' END AS momentum_verdict FROM (
   SELECT state_code, year, c, c - LAG(c) OVER (PARTITION BY state_code ORDER BY year) AS acc FROM (
    SELECT state_code, year, (ev_share - LAG(ev_share) OVER (PARTITION BY state_code ORDER BY year)) * 100 AS c FROM panel_year WHERE state_code <> 'ALL' AND year <= 2000)) WHERE year = 2000) mo USING (state_code)""",
    "panel_month panel_year context",
    "tau hinge_coef sse_gain real_pc_income_inr broad_credit_per_capita_inr latest_real_gsdp_growth_pct",
    digits=5,
)
def era_experiment(m: Market) -> DataFrame:
    tips = econometrics.tipping_summary(local_month(m), ["state_code"], "date", "ev_share")
    momentum = series.recent_acceleration_summary(
        local_year(m).where(F.col("year") <= 2000), "ev_share"
    ).select("state_code", "momentum_verdict")
    covariates = m.context.select(
        "state_code", "real_pc_income_inr", "ev_chargers_2025", "broad_credit_per_capita_inr",
        "latest_real_gsdp_growth_pct",
    )
    return (
        tips.select("state_code", "tau", "hinge_coef", "sse_gain")
        .join(covariates, "state_code", "left")
        .join(momentum, "state_code", "left")
    )


@query(
    "eco_11_three_eras",
    f"""WITH {scan_sql(_ERA_SER)} SELECT split_part(k, '|', 1) AS state_code, split_part(k, '|', 2) AS era, scan.* EXCLUDE (k), max_share
 FROM scan JOIN (SELECT k, MAX(s) AS max_share FROM ser GROUP BY k) p USING (k) WHERE max_share >= 0.01""",
    "panel_month",
    _SCAN_COLS + " max_share",
    digits=5,
)
def three_eras(m: Market) -> DataFrame:
    """The scans of the full series, the policy era and the recent years, in one run with the era as a key."""
    keyed = econometrics.in_eras(local_month(m), "date", ERAS)
    return econometrics.tipping_summary(keyed, ["state_code", "era"], "date", "ev_share", 0.01).drop("smooth_window")
