"""Queries of latent regimes and the regime experiments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.catalog.graph_queries import THRESHOLDS, shares
from panelwright.catalog.registry import Market, query
from panelwright.catalog.series_queries import local_year
from panelwright.catalog.series_queries import regimes as rule_regimes
from panelwright.operators import econometrics, graph, regimes, series

YEAR = 2000


_FITTED: dict[tuple[str, str], dict[str, DataFrame]] = {}


def fitted(m: Market) -> dict[str, DataFrame]:
    """The full search, once per application and folder: six queries read it.

    The tables hold seven years, so sequences of six are long enough here; the operator's default is eight.
    """
    key = (m.spark.sparkContext.applicationId, m.sf_dir)
    if key not in _FITTED:
        rows = local_year(m).where(F.col("year") <= YEAR)
        _FITTED[key] = regimes.fit_fuel_regimes(rows, (2, 3, 4), min_years=6, restarts=4, max_rounds=200)
    return _FITTED[key]


@query("reg_01_hmm_transitions")
def hmm_transitions(m: Market) -> DataFrame:
    return fitted(m)["transition_matrix"]


@query("reg_02_viterbi_calendar")
def viterbi_calendar(m: Market) -> DataFrame:
    return fitted(m)["calendar"]


@query("reg_03_model_scores")
def model_scores(m: Market) -> DataFrame:
    return fitted(m)["selection"]


@query("reg_04_regime_means")
def regime_means(m: Market) -> DataFrame:
    return fitted(m)["regime_means"]


_SHARES = regimes.FUEL_COLUMNS


@query(
    "reg_05_regime_labels",
    "WITH z AS (SELECT zone AS regime, "
    + ", ".join(f"AVG({c}) AS {c}" for c in _SHARES)
    + " FROM panel_year JOIN dim_state USING (state_code) GROUP BY zone), c AS (SELECT *, "
    + ", ".join(f"{c} - AVG({c}) OVER () AS d_{c}" for c in _SHARES)
    + " FROM z), l AS (SELECT *, CASE GREATEST("
    + ", ".join(f"d_{c}" for c in _SHARES)
    + ") "
    + " ".join(f"WHEN d_{c} THEN '{c.replace('_share', '')}-heavy'" for c in _SHARES)
    + " END AS lab FROM c), n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lab ORDER BY regime) AS i FROM l) SELECT regime, "
    + ", ".join(_SHARES)
    + ", CASE WHEN i = 1 THEN lab ELSE lab || '-' || i END AS regime_label FROM n",
    "panel_year dim_state",
    " ".join(_SHARES),
)
def regime_labels(m: Market) -> DataFrame:
    zones = (
        local_year(m).join(m.dim_state.select("state_code", "zone"), "state_code")
        .groupBy(F.col("zone").alias("regime")).agg(*[F.avg(c).alias(c) for c in _SHARES])
    )
    return regimes.label_regimes(zones, _SHARES)


@query("reg_07_phase_experiment")
def phase_experiment(m: Market) -> DataFrame:
    """Percolation point, absorbing regimes and emerging states of the latest full year."""
    point = graph.critical_threshold(graph.percolation_curve(shares(m), THRESHOLDS)).select(
        F.lit("critical_threshold").alias("metric"), F.col("critical_threshold").alias("value")
    )
    rules = rule_regimes(m)
    kept = series.absorbing_regimes(series.regime_transitions(rules), 0.2).select(
        F.concat(F.lit("persistent: "), "regime").alias("metric"), F.col("probability").alias("value")
    )
    emerging = rules.where((F.col("year") == YEAR) & (F.col("regime") == "ev_emerging")).agg(
        F.count(F.lit(1)).cast("double").alias("value")
    ).select(F.lit("ev_emerging_states").alias("metric"), "value")
    return point.unionByName(kept).unionByName(emerging)


@query("reg_07_survival_experiment")
def survival_experiment(m: Market) -> DataFrame:
    """Survival in the first latent regime, from the fitted calendar."""
    return series.kaplan_meier(series.build_risk_set(fitted(m)["calendar"], m.panel_year, []))


_SURVIVAL_COVARIATES = ["pc_income_constant_2011_12_inr", "personal_loans_per_capita_inr", "personal_loans_yoy_growth_pct"]


@query("reg_07_hazard_table")
def hazard_table(m: Market) -> DataFrame:
    """What hastens leaving a latent regime: odds ratios per standard deviation of each covariate."""
    risk = series.build_risk_set(fitted(m)["calendar"], m.full_year, _SURVIVAL_COVARIATES)
    return econometrics.discrete_hazard_model(risk, _SURVIVAL_COVARIATES)
