"""Queries of window, rank and time-series operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.catalog.registry import Market, query
from panelwright.operators import series
from panelwright.sources import tables

EV, CNG, ENTROPY = 0.21, 0.21, 1.6


def local_year(m: Market) -> DataFrame:
    return m.panel_year.where(F.col("state_code") != "ALL")


def regimes(m: Market) -> DataFrame:
    return series.classify_regimes(local_year(m), EV, CNG, ENTROPY)


def daily(m: Market) -> DataFrame:
    return tables.daily_purchases(m.spark, m.sf_dir)


@query("win_01_detrend", "SELECT state_code, date, residual FROM residuals", "residuals", "residual", "date")
def detrend(m: Market) -> DataFrame:
    return series.detrend(m.panel_month, ["state_code"], "date", "total_regs").select(
        "state_code", "date", "residual"
    )


@query(
    "win_02_early_warning_signals",
    """SELECT state_code, date, value, residual, CASE WHEN n >= 12 THEN variance END AS variance,
 CASE WHEN n >= 12 THEN ac END AS autocorr1, CASE WHEN n >= 12 THEN skew END AS skewness FROM (
 SELECT *, COUNT(residual) OVER w AS n, VAR_SAMP(residual) OVER w AS variance, skewness(residual) OVER w AS skew,
  corr(residual, prev) OVER (PARTITION BY state_code ORDER BY date ROWS BETWEEN 22 PRECEDING AND CURRENT ROW) AS ac
 FROM (SELECT *, LAG(residual) OVER (PARTITION BY state_code ORDER BY date) AS prev FROM residuals)
 WINDOW w AS (PARTITION BY state_code ORDER BY date ROWS BETWEEN 23 PRECEDING AND CURRENT ROW))""",
    "residuals",
    "value residual variance autocorr1 skewness",
    "date",
    digits=4,
)
def early_warning_signals(m: Market) -> DataFrame:
    return series.early_warning_signals(m.panel_month, ["state_code"], "date", "total_regs")


@query(
    "win_03_kendall_tau",
    """WITH y AS (SELECT state_code, date, total_regs AS v FROM panel_month),
 s AS (SELECT a.state_code, SUM(sign(b.v - a.v)) AS s FROM y a JOIN y b ON a.state_code = b.state_code AND a.date < b.date GROUP BY a.state_code),
 t AS (SELECT state_code, SUM(c * (c - 1) / 2) AS t0, SUM(c * (c - 1) * (2 * c + 5)) AS t1, SUM(c) AS n FROM (SELECT state_code, v, COUNT(*)::DOUBLE AS c FROM y GROUP BY ALL) GROUP BY state_code),
 z AS (SELECT state_code, n, s / SQRT((n * (n - 1) / 2) * (n * (n - 1) / 2 - t0)) AS tau, ABS(s / SQRT((n * (n - 1) * (2 * n + 5) - t1) / 18)) AS z FROM s JOIN t USING (state_code)),
 k AS (SELECT *, 1 / (1 + 0.2316419e0 * z) AS u FROM z)
 SELECT state_code, tau, LEAST(1.0, 2 * exp(-z * z / 2) / SQRT(2 * pi()) * (0.319381530e0 * u - 0.356563782e0 * u**2 + 1.781477937e0 * u**3 - 1.821255978e0 * u**4 + 1.330274429e0 * u**5)) AS pvalue,
 CAST(n AS BIGINT) AS n FROM k""",
    "panel_month",
    "tau pvalue",
)
def kendall_tau(m: Market) -> DataFrame:
    return series.kendall_tau_trend(m.panel_month, ["state_code"], "date", "total_regs")


@query(
    "win_04_volatility_regimes",
    """WITH g AS (SELECT state_code, date, total_regs / NULLIF(LAG(total_regs) OVER (PARTITION BY state_code ORDER BY date), 0)::DOUBLE - 1 AS g FROM panel_month),
 v AS (SELECT state_code, date, CASE WHEN COUNT(g) OVER w >= 6 THEN STDDEV_SAMP(g) OVER w END AS volatility FROM g
   WINDOW w AS (PARTITION BY state_code ORDER BY date ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)),
 e AS (SELECT state_code, quantile_cont(volatility, 0.5) AS mid FROM v GROUP BY state_code)
 SELECT v.*, CASE WHEN volatility IS NULL THEN NULL WHEN volatility > mid THEN 1 ELSE 0 END AS vol_regime FROM v JOIN e USING (state_code)""",
    "panel_month",
    "volatility",
    "date",
)
def volatility_regimes(m: Market) -> DataFrame:
    return series.volatility_regimes(m.panel_month, ["state_code"], "date", "total_regs")


@query(
    "win_05_smoothing",
    "SELECT state_code, date, "
    + ", ".join(
        f"AVG(ev_share) OVER (PARTITION BY state_code ORDER BY date ROWS BETWEEN {w // 2} PRECEDING AND {w - w // 2 - 1} FOLLOWING) AS smooth_{w}"
        for w in (1, 3, 5, 7, 9)
    )
    + " FROM panel_month",
    "panel_month",
    "smooth_1 smooth_3 smooth_5 smooth_7 smooth_9",
    "date",
)
def smoothing(m: Market) -> DataFrame:
    windows = [1, 3, 5, 7, 9]
    return series.smooth(m.panel_month, ["state_code"], "date", "ev_share", windows).select(
        "state_code", "date", *[f"smooth_{w}" for w in windows]
    )


MOMENTUM_SQL = """WITH d AS (SELECT state_code, year, ev_share, (ev_share - LAG(ev_share) OVER w) * 100 AS c FROM panel_year
   WHERE state_code <> 'ALL' AND year <= 2000 WINDOW w AS (PARTITION BY state_code ORDER BY year)),
 a AS (SELECT *, c - LAG(c) OVER (PARTITION BY state_code ORDER BY year) AS acc FROM d)
 SELECT state_code, year, ev_share AS share, c AS change_pp, acc AS acceleration_pp,
 CASE WHEN c < -0.1 THEN 'contracting' WHEN acc > 0.1 THEN 'accelerating' WHEN acc < -0.1 THEN 'decelerating' ELSE 'steady' END AS momentum_verdict
 FROM a WHERE acc IS NOT NULL QUALIFY ROW_NUMBER() OVER (PARTITION BY state_code ORDER BY year DESC) = 1"""


@query("win_06_momentum", MOMENTUM_SQL, "panel_year", "share change_pp acceleration_pp")
def momentum(m: Market) -> DataFrame:
    return series.recent_acceleration_summary(local_year(m).where(F.col("year") <= 2000), "ev_share")


@query("win_07_classify_regimes", "SELECT * FROM regimes", "regimes", "fuel_entropy")
def classify_regimes(m: Market) -> DataFrame:
    return regimes(m)


@query(
    "win_08_regime_transition_matrix",
    "SELECT r.regime, "
    + ", ".join(
        f"CASE WHEN COUNT(t.regime) > 0 THEN COALESCE(MAX(probability) FILTER (next_regime = '{n}'), 0) END AS {n}"
        for n in series.REGIMES
    )
    + " FROM (VALUES "
    + ", ".join(f"('{n}')" for n in series.REGIMES)
    + ") r(regime) LEFT JOIN transitions t USING (regime) GROUP BY r.regime",
    "transitions",
    " ".join(series.REGIMES),
)
def regime_transition_matrix(m: Market) -> DataFrame:
    return series.regime_transition_matrix(regimes(m))


@query(
    "win_09_absorbing_regimes",
    "SELECT regime, probability FROM transitions WHERE regime = next_regime AND probability >= 0.2",
    "transitions",
    "probability",
)
def absorbing_regimes(m: Market) -> DataFrame:
    return series.absorbing_regimes(series.regime_transitions(regimes(m)), 0.2)


@query(
    "win_10_transition_years",
    """SELECT state_code, year, prev AS from_regime, regime AS to_regime FROM (
 SELECT *, LAG(regime) OVER (PARTITION BY state_code ORDER BY year) AS prev FROM regimes) WHERE prev <> regime""",
    "regimes",
)
def transition_years(m: Market) -> DataFrame:
    return series.transition_years(regimes(m), "regime", "regime")


@query(
    "win_11_adoption_years",
    "SELECT state_code, MIN(year) AS adoption_year FROM panel_year WHERE ev_share >= 0.21 AND state_code <> 'ALL' GROUP BY state_code",
    "panel_year",
)
def adoption_years(m: Market) -> DataFrame:
    return series.observed_adoption_years(local_year(m), "ev_share", 0.21)


@query("win_12_prepare_adoption", "SELECT * FROM adoption_series", "adoption_series", "cum", "date")
def prepare_adoption(m: Market) -> DataFrame:
    return series.prepare_adoption_series(daily(m), ["entity"], "date", "n")


@query(
    "win_13_lagged_driver",
    "SELECT state_code, year, ev_share, LAG(ev_share, 2) OVER (PARTITION BY state_code ORDER BY year) AS ev_share_lag2 FROM panel_year",
    "panel_year",
    "ev_share ev_share_lag2",
)
def lagged_driver(m: Market) -> DataFrame:
    return series.lagged(
        m.panel_year.select("state_code", "year", "ev_share"), ["state_code"], "year", "ev_share", 2
    )


@query(
    "win_14_risk_set",
    "SELECT r.*, p.ev_share, p.yoy_growth FROM risk r LEFT JOIN panel_year p USING (state_code, year)",
    "risk panel_year",
    "ev_share yoy_growth",
)
def risk_set(m: Market) -> DataFrame:
    return series.build_risk_set(regimes(m), m.panel_year, ["ev_share", "yoy_growth"])


@query(
    "win_15_kaplan_meier",
    """SELECT year, n_at_risk, n_switched, hazard, product(1 - hazard) OVER (ORDER BY year) AS survival FROM (
 SELECT year, COUNT(*) AS n_at_risk, CAST(SUM(switched) AS BIGINT) AS n_switched, SUM(switched)::DOUBLE / COUNT(*) AS hazard FROM risk GROUP BY year)""",
    "risk",
    "hazard survival",
)
def kaplan_meier(m: Market) -> DataFrame:
    return series.kaplan_meier(series.build_risk_set(regimes(m), m.panel_year, []))


_YEARS = list(range(1995, 2002))


@query(
    "win_16_regime_calendar",
    "SELECT state_code, "
    + ", ".join(f"MAX(regime) FILTER (year = {y}) AS y{y}" for y in _YEARS)
    + ", max_by(regime, year) AS last_label FROM regimes GROUP BY state_code",
    "regimes",
)
def regime_calendar(m: Market) -> DataFrame:
    return series.regime_calendar(regimes(m), _YEARS)
