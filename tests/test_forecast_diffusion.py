import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import diffusion, forecast


def seasonal(seed=0, months=72):
    rng = np.random.default_rng(seed)
    t = np.arange(months)
    return 1000 * 1.004**t * (1 + 0.25 * np.sin(2 * np.pi * t / 12)) * (1 + rng.normal(0, 0.03, months))


@pytest.fixture
def monthly(frame):
    return frame([("a", i, float(v)) for i, v in enumerate(seasonal())], "k string, t int, y double")


@pytest.mark.parametrize("model", ["seasonal_naive", "holt_winters", "sarima"])
def test_bands_are_ordered(monthly, model):
    rows = forecast.MODELS[model](monthly, ["k"], "t", "y", 15, 12).collect()
    assert sorted(r.h for r in rows) == list(range(15))
    assert all(0 <= r.lo <= r.mean <= r.hi for r in rows)


def test_benchmark_ranks_models(monthly):
    rows = forecast.benchmark(monthly, ["k"], "t", "y").collect()
    assert len(rows) == 3 and all(r.mape < 0.25 and r.n_origins == 8 for r in rows)
    naive = next(r for r in rows if r.model == "seasonal_naive")
    assert naive.naive_relative_skill == pytest.approx(0.0)
    assert [r["rank"] for r in sorted(rows, key=lambda r: r.mape)] == [1, 2, 3]


def test_lead_of_two_is_found(frame):
    rng = np.random.default_rng(0)
    b = np.exp(np.cumsum(rng.normal(0, 0.1, 122)))
    df = frame([("k", t, float(b[t]), float(b[t + 2])) for t in range(120)], "k string, t int, a double, b double")
    best = max(forecast.cross_correlation(df, ["k"], "t", "a", "b").collect(), key=lambda r: r["corr"])
    assert best.lag == 2


def test_nowcast_beats_baseline(frame):
    rng = np.random.default_rng(1)
    wholesale = seasonal(1, 60) * (1 + rng.normal(0, 0.08, 60))
    retail = 0.9 * wholesale * (1 + rng.normal(0, 0.02, 60))
    df = frame([("k", t, float(retail[t]), float(wholesale[t])) for t in range(60)], "k string, date int, retail double, wholesale double")
    out = forecast.nowcast_scores(forecast.nowcast_predictions(df, ["k"]), ["k"]).first()
    assert out.n_oos == 12 and out.mape_nowcast < 0.10 and out.mape_nowcast < out.mape_baseline


def bass(t, p, q, m):
    e = np.exp(-(p + q) * t)
    return m * (1 - e) / (1 + q / p * e)


def test_bass_truth_is_recovered(frame):
    y = bass(np.arange(60.0), 0.01, 0.4, 10000)
    df = frame([("a", i, float(v)) for i, v in enumerate(y)], "k string, t int, cum double")
    fit = diffusion.fit_bass(df, ["k"], "t", "cum").first()
    assert fit.p == pytest.approx(0.01, rel=0.05) and fit.q == pytest.approx(0.4, rel=0.05)
    assert fit.m == pytest.approx(10000, rel=0.05) and fit.r2 > 0.999
    assert fit.peak_time == pytest.approx(np.log(40) / 0.41, rel=0.05)
    path = diffusion.project_bass(diffusion.fit_bass(df, ["k"], "t", "cum"), ["k"], 30, m_mult=2.0).collect()
    assert path[0].incremental == 0.0 and max(r.cumulative for r in path) > 15000
    marks = diffusion.milestones(
        diffusion.fit_bass(df, ["k"], "t", "cum").withColumn("start", F.to_date(F.lit("2020-01-15"))), ["k"], "start").collect()
    assert {r.share for r in marks} == {0.05, 0.1, 0.2} and all(r.month_from_onset > 0 for r in marks)


def test_short_series_has_no_fit(frame):
    df = frame([("a", i, float(i)) for i in range(4)], "k string, t int, cum double")
    assert diffusion.fit_bass(df, ["k"], "t", "cum").first().p is None


def test_bootstrap_and_curves(frame):
    rng = np.random.default_rng(3)
    y = bass(np.arange(40.0), 0.01, 0.25, 5000) + np.cumsum(rng.random(40))
    df = frame([("a", i, float(v)) for i, v in enumerate(y)], "k string, t int, cum double")
    out = diffusion.bootstrap_interval(df, ["k"], "t", "cum", replicates=20).first()
    assert out.replicates == 20 and out.m_p05 <= out.m_p50 <= out.m_p95
    scores = {r.model: r for r in diffusion.curve_comparison(df, ["k"], "t", "cum").collect()}
    assert set(scores) == {"bass", "logistic", "gompertz", "naive_trend"} and scores["bass"].mape < 0.2
    uplift = diffusion.tax_parity_scenarios(diffusion.fit_bass(df, ["k"], "t", "cum"), ["k"]).collect()
    assert {r.scenario: r.uplift for r in uplift}["elasticity_2"] > 1.2


def simulated(params, n, season, seed):
    """Levels of a (1,1,1)(1,1,1) product model."""
    rng = np.random.default_rng(seed)
    phi, far_phi, theta, far_theta = params
    e, w = rng.normal(size=n), np.zeros(n)
    for t in range(season + 1, n):
        w[t] = phi * w[t - 1] + far_phi * w[t - season] - phi * far_phi * w[t - season - 1]
        w[t] += e[t] + theta * e[t - 1] + far_theta * e[t - season] + theta * far_theta * e[t - season - 1]
    return w


@pytest.mark.parametrize("params", [(0.6, 0.3, 0.3, -0.6), (-0.5, 0.6, -0.4, 0.3), (0.8, -0.5, 0.4, -0.4)])
def test_seasonal_product_model_recovers_planted_coefficients(params):
    w = simulated(params, 3000, 12, 11)
    fit, variance = forecast.fit_seasonal(w, 12)
    assert fit == pytest.approx(params, abs=0.08) and variance == pytest.approx(1.0, abs=0.08)
    errors = forecast.innovations(w, np.array(params), 12)[200:]
    assert abs(np.corrcoef(errors[13:], errors[:-13])[0, 1]) < 0.06 and errors.std() == pytest.approx(1.0, abs=0.05)


def test_psi_weights_are_the_response_to_one_error():
    params, season, n = (0.5, 0.3, -0.4, -0.6), 4, 30
    w = np.zeros(n + season + 1)
    e = np.zeros(len(w))
    e[season + 1] = 1.0
    for t in range(season + 1, len(w)):
        w[t] = 0.5 * w[t - 1] + 0.3 * w[t - season] - 0.15 * w[t - season - 1] + e[t] - 0.4 * e[t - 1] - 0.6 * e[t - season] + 0.24 * e[t - season - 1]
    y = np.zeros(len(w))
    for t in range(season + 1, len(w)):
        y[t] = w[t] + y[t - 1] + y[t - season] - y[t - season - 1]
    assert forecast.psi_weights(np.array(params), season, n) == pytest.approx(y[season + 1 :][:n])
