"""Queries of forecasting, nowcasting and diffusion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.catalog.econometrics_queries import local_month
from panelwright.catalog.registry import Market, query
from panelwright.catalog.series_queries import daily
from panelwright.operators import diffusion, econometrics, forecast, segments, series


def naive_sql(train: str, horizon: int) -> str:
    """Seasonal naive forecast over ``train`` (k, i, v) as a WITH body ending in table ``fc``."""
    return f"""tr AS ({train}),
 l AS (SELECT *, LAG(v, 12) OVER (PARTITION BY k ORDER BY i) AS l, ROW_NUMBER() OVER (PARTITION BY k ORDER BY i DESC) AS back, COUNT(*) OVER (PARTITION BY k) AS n FROM tr),
 r AS (SELECT k, v / l AS r, ROW_NUMBER() OVER (PARTITION BY k ORDER BY i DESC) AS rn FROM l WHERE l IS NOT NULL AND l <> 0),
 d AS (SELECT k, CASE WHEN COUNT(*) >= 3 THEN AVG(r) FILTER (rn <= 3) ELSE 1 END AS d FROM r GROUP BY k),
 sd AS (SELECT k, d, STDDEV_SAMP(v - d * l) AS sd FROM l JOIN d USING (k) GROUP BY k, d),
 fc AS (SELECT k, h, GREATEST(v * d, 0) AS mean, GREATEST(v * d - 1.96 * sd, 0) AS lo, GREATEST(v * d + 1.96 * sd, 0) AS hi
  FROM (SELECT k, v, unnest(range(12 - back, {horizon}, 12)) AS h FROM l WHERE back <= 12 AND n >= 12) b JOIN sd USING (k))"""


_SER = "SELECT state_code AS k, ROW_NUMBER() OVER (PARTITION BY state_code ORDER BY date) - 1 AS i, total_regs::DOUBLE AS v FROM panel_month"


@query(
    "fct_01_seasonal_naive",
    f"WITH {naive_sql(_SER, 18)} SELECT k AS state_code, * EXCLUDE (k) FROM fc",
    "panel_month",
    "mean lo hi",
)
def seasonal_naive(m: Market) -> DataFrame:
    return forecast.seasonal_naive(m.panel_month, ["state_code"], "date", "total_regs", 18)


@query("fct_02_holt_winters")
def holt_winters(m: Market) -> DataFrame:
    return forecast.holt_winters(m.panel_month, ["state_code"], "date", "total_regs", 12)


@query("fct_03_sarima")
def sarima(m: Market) -> DataFrame:
    return forecast.sarima(m.panel_month, ["state_code"], "date", "total_regs", 12)


_BACKTEST = f"""WITH s AS ({_SER}), o AS (SELECT s.k || '|' || o AS k, i, v, n - 3 - (o - 1) AS cut FROM (SELECT *, COUNT(*) OVER (PARTITION BY k) AS n FROM s) s, range(1, 9) t(o) WHERE n - 3 - (o - 1) >= 28),
 {naive_sql('SELECT k, i, v FROM o WHERE i < cut', 3)},
 e AS (SELECT o.k, mean - v AS err, v, v >= lo AND v <= hi AS cov FROM o JOIN fc ON fc.k = o.k AND fc.h = o.i - o.cut WHERE i >= cut AND i < cut + 3),
 p AS (SELECT split_part(k, '|', 1) AS state_code, k, AVG(ABS(err) / GREATEST(ABS(v), 1)) AS mape, SUM(ABS(err)) AS ae, SUM(ABS(v)) AS au, SUM(err) AS se, COUNT(*) AS n, COUNT(*) FILTER (cov) AS c FROM e GROUP BY ALL)
 SELECT state_code, AVG(mape) AS mape, SUM(ae) / SUM(au) AS wape, SUM(ae) / SUM(n) AS mae, SUM(se) / SUM(n) AS bias, SUM(c) / SUM(n)::DOUBLE AS interval_coverage, COUNT(*) AS n_origins, 'seasonal_naive' AS model FROM p GROUP BY state_code"""


@query("fct_04_backtest", _BACKTEST, "panel_month", "mape wape mae bias interval_coverage")
def backtest(m: Market) -> DataFrame:
    return forecast.backtest(m.panel_month, ["state_code"], "date", "total_regs", "seasonal_naive")


@query("fct_05_benchmark")
def benchmark(m: Market) -> DataFrame:
    return forecast.benchmark(m.panel_month, ["state_code"], "date", "total_regs")


_XCORR = """WITH g AS (SELECT ROW_NUMBER() OVER (ORDER BY date) AS i, retail / LAG(retail) OVER (ORDER BY date)::DOUBLE - 1 AS a, wholesale / LAG(wholesale) OVER (ORDER BY date)::DOUBLE - 1 AS b FROM rw)
 SELECT CAST(l.lag AS BIGINT) AS lag, corr(x.a, y.b) AS corr FROM range(-6, 7) l(lag) JOIN g x ON true JOIN g y ON y.i + l.lag = x.i GROUP BY l.lag"""


@query("fct_06_cross_correlation", _XCORR, "rw", "corr")
def cross_correlation(m: Market) -> DataFrame:
    rows = m.retail_wholesale.withColumn("scope", F.lit("ALL"))
    return forecast.cross_correlation(rows, ["scope"], "date", "retail", "wholesale").drop("scope")


_NOWCAST = """WITH b AS (SELECT date, retail::DOUBLE AS actual, wholesale::DOUBLE AS ws, LAG(retail::DOUBLE, 12) OVER (ORDER BY date) AS l12, ROW_NUMBER() OVER (ORDER BY date) AS i,
   ROW_NUMBER() OVER (ORDER BY date DESC) AS back FROM rw),
 t AS (SELECT a.date, a.actual, a.ws, a.l12, COUNT(*) AS n, AVG(b.ws) AS mx, AVG(b.l12) AS mh, AVG(b.actual) AS my, VAR_POP(b.ws) AS sxx, VAR_POP(b.l12) AS shh, COVAR_POP(b.ws, b.l12) AS sxh,
   COVAR_POP(b.ws, b.actual) AS sxy, COVAR_POP(b.l12, b.actual) AS shy, AVG(b.actual / b.l12) FILTER (b.i >= a.i - 3) AS drift
   FROM b a JOIN b ON b.i < a.i AND b.l12 IS NOT NULL WHERE a.back <= 12 AND a.l12 IS NOT NULL GROUP BY ALL HAVING COUNT(*) >= 18),
 f AS (SELECT *, (sxy * shh - shy * sxh) / (sxx * shh - sxh * sxh) AS bx, (shy * sxx - sxy * sxh) / (sxx * shh - sxh * sxh) AS bh FROM t),
 p AS (SELECT date, actual, my - bx * mx - bh * mh + bx * ws + bh * l12 AS nowcast, l12 * COALESCE(drift, 1) AS baseline FROM f)"""


def _nowcast(m: Market) -> DataFrame:
    rows = m.retail_wholesale.withColumn("scope", F.lit("ALL"))
    return forecast.nowcast_predictions(rows, ["scope"])


@query("fct_07_nowcast", f"{_NOWCAST} SELECT * FROM p", "rw", "actual nowcast baseline", "date", digits=5)
def nowcast(m: Market) -> DataFrame:
    return _nowcast(m).drop("scope")


@query(
    "fct_08_nowcast_experiment",
    f"""{_NOWCAST}, x AS ({_XCORR.replace('WITH g AS', 'SELECT * FROM (WITH g AS')})),
 best AS (SELECT lag, corr FROM x ORDER BY corr DESC, lag LIMIT 1)
 SELECT (SELECT COUNT(*) FROM rw) AS months_joined, (SELECT AVG(ws_retail_ratio) FROM rw) AS mean_ws_retail_ratio, best.lag AS best_corr_lag, best.corr AS best_corr,
 (SELECT AVG(ABS(nowcast - actual) / actual) FROM p) AS mape_nowcast, (SELECT AVG(ABS(baseline - actual) / actual) FROM p) AS mape_baseline, (SELECT COUNT(*) FROM p) AS n_oos FROM best""",
    "rw",
    "mean_ws_retail_ratio best_corr mape_nowcast mape_baseline",
)
def nowcast_experiment(m: Market) -> DataFrame:
    rows = m.retail_wholesale.withColumn("scope", F.lit("ALL"))
    facts = rows.groupBy("scope").agg(
        F.count(F.lit(1)).alias("months_joined"), F.avg("ws_retail_ratio").alias("mean_ws_retail_ratio")
    )
    lags = forecast.cross_correlation(rows, ["scope"], "date", "retail", "wholesale")
    best = lags.groupBy("scope").agg(
        F.max_by("lag", F.struct("corr", -F.col("lag"))).alias("best_corr_lag"),
        F.max("corr").alias("best_corr"),
    )
    scores = forecast.nowcast_scores(_nowcast(m), ["scope"])
    return facts.join(best, "scope").join(scores, "scope").drop("scope")


@query(
    "fct_08_segment_mix",
    """SELECT segment5, year, CAST(SUM(qty) AS BIGINT) AS units, SUM(qty)::DOUBLE / SUM(SUM(qty)) OVER (PARTITION BY year) AS share
 FROM wholesale WHERE coverage = 'full' GROUP BY segment5, year""",
    "wholesale",
    "share",
)
def segment_mix(m: Market) -> DataFrame:
    """Units of each segment by year, the third result of the nowcast experiment."""
    return segments.segment_mix(m.dispatch, "year").select("segment5", "year", "units", "share")


# ------------------------------------------------------------------------ diffusion

_FIXED_FIT = "SELECT entity, 0.01e0 + entity * 0.001e0 AS p, 0.1e0 + entity * 0.02e0 AS q, SUM(n)::DOUBLE * 3 AS m FROM daily GROUP BY entity"


def fixed_fits(m: Market) -> DataFrame:
    """Parameters tied to each entity's own volume, for the closed-form rows."""
    return (
        daily(m).groupBy("entity").agg((F.sum("n") * 3).cast("double").alias("m"))
        .withColumn("p", F.lit(0.01) + F.col("entity") * 0.001)
        .withColumn("q", F.lit(0.1) + F.col("entity") * 0.02)
    )


_PATH = "m * (1 - exp(-(p + q) * t)) / (1 + q / p * exp(-(p + q) * t))"


@query(
    "dif_01_bass_cumulative",
    f"SELECT a.entity, t, m * (1 - exp(-(p + q) * t)) / (1 + q / p * exp(-(p + q) * t)) AS cumulative FROM adoption_series a JOIN ({_FIXED_FIT}) f USING (entity)",
    "adoption_series",
    "cumulative",
)
def bass_cumulative(m: Market) -> DataFrame:
    observed = series.prepare_adoption_series(daily(m), ["entity"], "date", "n")
    path = diffusion.bass_cumulative(F.col("t").cast("double"), "p", "q", "m")
    return observed.join(fixed_fits(m), "entity").select("entity", "t", path.alias("cumulative"))


@query("dif_02_fit_bass")
def fit_bass(m: Market) -> DataFrame:
    prepared = series.prepare_adoption_series(daily(m), ["entity"], "date", "n", 0, 0.0)
    return diffusion.fit_bass(prepared, ["entity"], "t", "cum")


def _fits_by_state(m: Market) -> DataFrame:
    return diffusion.fit_bass_by_entity(local_month(m), ["state_code"], "date", "ev_regs")


@query("dif_03_fit_bass_by_state")
def fit_bass_by_state(m: Market) -> DataFrame:
    return _fits_by_state(m)


@query(
    "dif_04_project_bass",
    f"""SELECT entity, t, path AS cumulative, CASE WHEN t = 0 THEN 0 ELSE path - LAG(path) OVER (PARTITION BY entity ORDER BY t) END AS incremental FROM (
 SELECT entity, t, {_PATH} AS path FROM (SELECT entity, p, q * 1.2 AS q, m * 1.1 AS m, unnest(range(0, 48)) AS t FROM ({_FIXED_FIT})))""",
    "daily",
    "cumulative incremental",
)
def project_bass(m: Market) -> DataFrame:
    return diffusion.project_bass(fixed_fits(m), ["entity"], 48, q_mult=1.2, m_mult=1.1)


@query("dif_05_curve_comparison")
def curve_comparison(m: Market) -> DataFrame:
    prepared = series.prepare_adoption_series(local_month(m), ["state_code"], "date", "ev_regs")
    return diffusion.curve_comparison(prepared, ["state_code"], "t", "cum")


@query("dif_06_bootstrap_interval")
def bootstrap_interval(m: Market) -> DataFrame:
    prepared = series.prepare_adoption_series(daily(m), ["entity"], "date", "n", 0, 0.0)
    return diffusion.bootstrap_interval(prepared, ["entity"], "t", "cum")


@query(
    "dif_07_milestones",
    f"""SELECT entity, d AS start, share, MIN(t) FILTER ({_PATH} >= m * share) AS month_from_onset,
 CAST(date_trunc('month', d) + MIN(t) FILTER ({_PATH} >= m * share) * INTERVAL 1 MONTH AS DATE) AS calendar_date FROM (
 SELECT f.*, d, unnest(range(0, n + 360)) AS t FROM ({_FIXED_FIT}) f JOIN (SELECT entity, MIN(date) AS d, COUNT(*) AS n FROM daily GROUP BY entity) USING (entity)),
 (VALUES (0.05e0), (0.1e0), (0.2e0)) s(share) GROUP BY entity, d, share""",
    "daily",
    "share",
    "start calendar_date",
)
def milestones(m: Market) -> DataFrame:
    begun = daily(m).groupBy("entity").agg(F.min("date").alias("start"), F.count(F.lit(1)).alias("n"))
    return diffusion.milestones(fixed_fits(m).join(begun, "entity"), ["entity"], "start")


@query("dif_08_start_scan")
def start_scan(m: Market) -> DataFrame:
    return diffusion.start_scan(
        local_month(m).withColumn("at", F.col("year") * 100 + F.col("month")),
        ["state_code"],
        "at",
        "ev_regs",
        [199501, 199601, 199701, 199801, 199901],
    )


@query("dif_09_fits_vs_covariates")
def fits_vs_covariates(m: Market) -> DataFrame:
    """Spearman correlation of the imitation rate with the state's covariates."""
    joined = _fits_by_state(m).join(m.context, "state_code", "left").select(
        "q", "real_pc_income_inr", "urban_pct", F.col("cng_stations_2024").cast("double").alias("cng_stations_2024")
    )
    return econometrics.correlation_matrix(joined, ["q", "real_pc_income_inr", "urban_pct"])


@query("dif_10_tax_parity")
def tax_parity(m: Market) -> DataFrame:
    national = m.panel_month.where((F.col("state_code") == "ALL") & (F.col("year") >= 1998))
    fits = diffusion.fit_bass_by_entity(national, ["state_code"], "date", "hybrid_regs", 1.0, 1, 0.0)
    return diffusion.tax_parity_scenarios(fits, ["state_code"])
