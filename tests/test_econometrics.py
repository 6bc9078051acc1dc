import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.operators import econometrics, series


def test_did_effect_and_null(frame):
    rng = np.random.default_rng(0)
    for effect, limit in ((0.02, 0.005), (0.0, 0.002)):
        rows = []
        for s in ("T", "C1", "C2", "C3"):
            for i in range(18):
                v = 0.05 + 0.001 * i + rng.normal(0, 0.0005) + (effect if s == "T" and i >= 9 else 0)
                rows.append((s, f"{2023 + i // 12}-{i % 12 + 1:02d}-01", float(v)))
        df = frame(rows, "state_code string, d string, share double").withColumn("date", F.to_date("d"))
        out = econometrics.did(df, ["T"], ["C1", "C2", "C3"], "2023-10-01", "share").first()
        assert out.att == pytest.approx(effect, abs=limit) and out.n_controls == 3


def tipping_rows(kind):
    s, out = 0.02, []
    for t in range(80):
        out.append((kind, t, float(s)))
        if kind == "tip":
            s = s + 0.002 if s < 0.10 else min(s * 1.04, 0.9)
        else:
            s = s + 0.08 * s * (1 - s / 0.4)
    return out


def test_threshold_scan_finds_tipping_and_saturation(frame):
    df = frame(tipping_rows("tip") + tipping_rows("sat"), "k string, t int, share double")
    out = {r.k: r for r in econometrics.threshold_scan(df, ["k"], "t", "share").collect()}
    assert 0.05 < out["tip"].tau < 0.20 and out["tip"].hinge_coef > 0
    assert out["sat"].hinge_coef < 0


def test_threshold_scan_needs_enough_rows(frame):
    df = frame([("a", i, 0.01 * i) for i in range(8)], "k string, t int, share double")
    assert econometrics.threshold_scan(df, ["k"], "t", "share").first().tau is None


def test_panel_ols_equals_dummy_regression(frame):
    rng = np.random.default_rng(3)
    rows = []
    for e in range(8):
        for t in range(6):
            if (e + t) % 7 == 0:
                continue
            x1, x2 = rng.normal(size=2)
            rows.append((f"e{e}", t, float(1.5 * x1 - 0.7 * x2 + e + 0.3 * t + rng.normal(0, 0.1)), float(x1), float(x2)))
    out = {r.term: r for r in econometrics.panel_ols(
        frame(rows, "state_code string, year int, y double, x1 double, x2 double"), "y", ["x1", "x2"], time_effects=True).collect()}
    n = len(rows)
    ents, times = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    X = np.column_stack([np.ones(n), [r[3] for r in rows], [r[4] for r in rows]]
                        + [[float(r[0] == e) for r in rows] for e in ents[1:]]
                        + [[float(r[1] == t) for r in rows] for t in times[1:]])
    y = np.array([r[2] for r in rows])
    bread = np.linalg.inv(X.T @ X)
    beta = bread @ X.T @ y
    u = y - X @ beta
    meat = sum(np.outer(s, s) for s in (X[[i for i, r in enumerate(rows) if r[0] == e]].T @ u[[i for i, r in enumerate(rows) if r[0] == e]] for e in ents))
    g, k = len(ents), X.shape[1]
    se = np.sqrt(np.diag(bread @ meat @ bread) * g / (g - 1) * (n - 1) / (n - k))
    for i, term in ((1, "x1"), (2, "x2")):
        assert out[term].coef == pytest.approx(beta[i], rel=1e-8)
        assert out[term].se == pytest.approx(se[i], rel=1e-6)
    assert out["x1"].r2 == pytest.approx(1 - u @ u / ((y - y.mean()) ** 2).sum(), rel=1e-8)


def test_granger_matches_least_squares(frame):
    rng = np.random.default_rng(5)
    x = rng.normal(size=120)
    y = np.zeros(120)
    for t in range(1, 120):
        y[t] = 0.4 * y[t - 1] + 0.8 * x[t - 1] + rng.normal(0, 0.3)
    df = frame([("a", i, float(x[i]), float(y[i])) for i in range(120)], "k string, t int, x double, y double")
    out = {r.lag: r for r in econometrics.granger(df, ["k"], "t", "x", "y", 3).collect()}
    for lag in (1, 2, 3):
        rows = range(lag, 120)
        own = np.array([[1, *y[t - lag : t]] for t in rows])
        full = np.array([[1, *y[t - lag : t], *x[t - lag : t]] for t in rows])
        ssr = [((y[lag:] - m @ np.linalg.lstsq(m, y[lag:], rcond=None)[0]) ** 2).sum() for m in (own, full)]
        f = (ssr[0] - ssr[1]) / lag / (ssr[1] / (len(own) - 2 * lag - 1))
        assert out[lag].f_stat == pytest.approx(f, rel=1e-6) and out[lag].n == 120 - lag
        assert out[lag].f_pvalue < 1e-6


def test_changepoint_in_mean(frame):
    rng = np.random.default_rng(2)
    y = np.r_[rng.normal(0, 0.3, 40), rng.normal(5, 0.3, 40)]
    df = frame([("a", i, float(v)) for i, v in enumerate(y)], "k string, t int, v double")
    assert [r.position for r in econometrics.changepoints(df, ["k"], "t", "v", n_bkps=1).collect()] == [40]
    assert 40 in [r.position for r in econometrics.changepoints(df, ["k"], "t", "v").collect()]


def test_spearman_removes_nulls_per_pair(frame):
    rows = [(1.0, 1.0, None), (2.0, 4.0, 3.0), (3.0, 9.0, 2.0), (4.0, 16.0, 1.0), (5.0, None, 0.0)]
    out = {(r.a, r.b): (r["corr"], r.n) for r in econometrics.correlation_matrix(
        frame(rows, "x double, y double, z double"), ["x", "y", "z"]).collect()}
    assert out[("x", "y")] == (pytest.approx(1.0), 4) and out[("x", "z")] == (pytest.approx(-1.0), 4)
    assert out[("y", "z")][1] == 3 and out[("x", "x")][0] == 1.0


def test_hazard_rises_with_income(frame):
    rng = np.random.default_rng(4)
    cal, cov = [], []
    for s in range(24):
        income = 1.0 + s / 4
        switch = 2024 - int(s / 2.5) + int(rng.integers(-2, 3))
        switch = min(max(switch, 2014), 2025)
        for y in range(2012, 2026):
            cal.append((f"s{s}", y, int(y >= switch)))
            cov.append((f"s{s}", y, float(income)))
    calendar = frame(cal, "state_code string, year int, regime int")
    risk = series.build_risk_set(calendar, frame(cov, "state_code string, year int, income double"), ["income"])
    assert risk.agg(F.sum("switched")).first()[0] == 24
    out = {r.term: r for r in econometrics.discrete_hazard_model(risk, ["income"]).collect()}
    assert out["income"].odds_ratio_per_sd > 1.5
    last = max(series.kaplan_meier(risk).collect(), key=lambda r: r.year)
    assert last.survival < 0.2


def test_hazard_without_a_finite_estimate(frame):
    schema = "year int, switched int, x double, twice double, flat double"

    def terms(rows):
        risk = frame([(y, s, x, 2 * x, 0.1) for y, s, x in rows], schema)
        return {r.term: r for r in econometrics.discrete_hazard_model(risk, ["x", "twice", "flat"]).collect()}

    cells = [(2000 + i % 5, float(i * 7 % 11)) for i in range(60)]
    for label in (0, 1):
        out = terms([(y, label, x) for y, x in cells])
        assert set(out) == {"x", "twice", "flat", "year_c"}
        for r in out.values():
            assert (r.coef, r.odds_ratio_per_sd, r.p_value, r.pseudo_r2) == (None,) * 4
            assert (r.n_obs, r.n_events, r.llf) == (60, 60 * label, 0.0)
    apart = terms([(y, int(x > 5), x) for y, x in cells])["x"]
    assert apart.coef is None and apart.llf == pytest.approx(0, abs=1e-6) and apart.pseudo_r2 == pytest.approx(1)
    assert terms([])["x"].n_obs == 0
    mixed = terms([(y, int(i % 3 == 0), x) for i, (y, x) in enumerate(cells)])
    assert mixed["twice"].coef is None and mixed["flat"].coef is None and 0 < mixed["x"].p_value < 1
    z = np.array([x for _, x in cells])
    z = np.column_stack([np.ones(60), (z - z.mean()) / z.std(), [y - 2002 for y, _ in cells]])
    left = np.array([float(i % 3 == 0) for i in range(60)])
    slopes = np.array([mixed["x"].coef, mixed["year_c"].coef])
    low, high = -20.0, 20.0
    for _ in range(80):
        middle = (low + high) / 2
        miss = left - 1 / (1 + np.exp(-z @ [middle, *slopes]))
        low, high = (middle, high) if miss.sum() > 0 else (low, middle)
    assert np.abs(z.T @ miss).max() < 1e-5


def dummies(rows, x):
    """Dummy-variable fit with errors clustered by entity."""
    entities, times = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    y = np.array([r[2] for r in rows])
    d = [[*r[3 : 3 + x], *[r[0] == e for e in entities], *[r[1] == t for t in times[1:]]] for r in rows]
    d = np.array(d, float)
    bread = np.linalg.pinv(d.T @ d)
    beta = bread @ d.T @ y
    e = y - d @ beta
    meat = sum(np.outer(s, s) for s in (d[[r[0] == g for r in rows]].T @ e[[r[0] == g for r in rows]] for g in entities))
    n, k, g = len(rows), d.shape[1], len(entities)
    se = np.sqrt(np.diag(bread @ meat @ bread) * g / (g - 1) * (n - 1) / (n - k))
    return beta[:x], se[:x], 1 - e @ e / ((y - y.mean()) ** 2).sum()


def test_two_way_effects_equal_dummies_on_an_unbalanced_calendar(frame):
    rng = np.random.default_rng(8)
    rows = []
    for s in range(12):
        for t in range(360):
            if rng.random() < 0.25 + 0.5 * (t % 12 == s):
                a, b = rng.normal() + 0.01 * t + s, rng.normal() - s * np.sin(t / 40)
                rows.append((f"s{s}", t, 2 * a - 0.5 * b + 0.3 * s + np.cos(t / 9) + rng.normal() * (1 + s / 6), a, b))
    want, se, r2 = dummies(rows, 2)
    df = frame([tuple(map(lambda v: v.item() if hasattr(v, "item") else v, r)) for r in rows] + [("s1", 3, None, 1.0, 1.0)], "state_code string, year int, y double, a double, b double")
    got = {r.term: r for r in econometrics.panel_ols(df, "y", ["a", "b"], time_effects=True).collect()}
    assert set(got) == {"a", "b"} and got["a"].n == len(rows)
    assert [got["a"].coef, got["b"].coef] == pytest.approx(want.tolist(), rel=1e-7)
    assert [got["a"].se, got["b"].se] == pytest.approx(se.tolist(), rel=1e-6)
    assert got["a"].r2 == pytest.approx(r2)


def test_panel_without_enough_entities_or_rows(frame):
    schema = "state_code string, year int, y double, a double"
    lone = econometrics.panel_ols(frame([("s", t, float(t), float(t % 3)) for t in range(9)], schema), "y", ["a"]).first()
    assert lone.n == 9 and math.isnan(lone.se)
    assert econometrics.panel_ols(frame([], schema), "y", ["a"], time_effects=True).collect() == []
