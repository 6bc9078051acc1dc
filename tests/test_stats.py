from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelwright.functions.ordered import average_ranks, prefix_sums, ranged
from panelwright.operators import market, series, stats


def one(df):
    return df.first().asDict()


def test_concentration_and_entropy(frame):
    shares = frame([("a", 0.25)] * 4 + [("b", 1.0)], "k string, share double")
    hhi = {r.k: r.hhi for r in stats.hhi(shares, ["k"]).collect()}
    assert hhi == {"a": 2500.0, "b": 10000.0}
    ent = {r.k: (r.entropy, r.entropy_norm) for r in stats.shannon_entropy(shares, ["k"]).collect()}
    assert ent["a"] == pytest.approx((log(4), 1.0))
    assert ent["b"][0] == pytest.approx(0.0)


def test_cagr_guards(frame):
    df = frame([("a", 1, 100), ("a", 2, 200), ("b", 1, 0), ("b", 2, 5), ("c", 1, 4)], "k string, y int, v int")
    out = {r.k: r.cagr for r in stats.cagr(df, ["k"], "y", "v").collect()}
    assert out["a"] == pytest.approx(1.0)
    assert out["b"] is None and out["c"] is None


def test_flat_seasonality(frame):
    df = frame([("A", y, m, 100) for y in (2020, 2021) for m in range(1, 13)], "k string, year int, month int, total_regs int")
    rows = stats.seasonality_profile(df, ["k"]).collect()
    assert len(rows) == 12 and all(r.seasonal_index == pytest.approx(1.0) for r in rows)


def test_concentration_series(frame):
    df = frame([(1, "A", 50), (1, "B", 50), (2, "A", 90), (2, "B", 10)], "year int, maker string, regs int")
    out = {r.year: r.hhi for r in stats.concentration_series(df, "year", "maker", "regs").collect()}
    assert out[1] == pytest.approx(5000) and out[2] == pytest.approx(8200)


def test_gini_with_ties_and_a_hot_group(spark, frame):
    df = frame([("eq", 5.0)] * 4 + [("one", 0.0)] * 3 + [("one", 8.0)], "k string, v double")
    out = {r.k: r.gini for r in stats.gini(df, ["k"], "v").collect()}
    assert out["eq"] == pytest.approx(0.0) and out["one"] == pytest.approx(0.75)
    hot = spark.range(20000).select(F.lit("hot").alias("k"), (F.col("id") % 997).cast("double").alias("v"))
    x = np.sort(np.arange(20000) % 997).astype(float)
    want = (20001 - 2 * (np.cumsum(x) / x.sum()).sum()) / 20000
    assert one(stats.gini(hot, ["k"], "v"))["gini"] == pytest.approx(want)


def test_prefix_sums_equal_plain_running_sums(spark):
    df = spark.range(5000).select((F.col("id") % 2).alias("k"), F.col("id").alias("o"), (F.col("id") % 7).alias("v"))
    got = {(r.k, r.o): r.s for r in prefix_sums(df, ["k"], "o", {"s": "v"}, 16).collect()}
    for k in (0, 1):
        run = 0
        for o in range(k, 5000, 2):
            run += o % 7
            assert got[(k, o)] == run


def test_ranges_of_a_hot_group_are_bounded(spark):
    hot = spark.range(200_000).select(F.lit("hot").alias("k"), F.col("id").alias("o"))
    small = spark.range(500).select(F.concat(F.lit("k"), (F.col("id") % 100).cast("string")).alias("k"), F.col("id").alias("o"))
    cut = ranged(hot.unionByName(small), ["k"], "o", 5_000)
    sizes = cut.groupBy("_bucket").agg(F.count("*").alias("n"), F.count_if(F.col("k") != "hot").alias("small")).collect()
    assert max(r.n for r in sizes) < 15_000 and len(sizes) >= 30
    assert sum(r.small > 0 for r in sizes) <= 3
    last = prefix_sums(hot, ["k"], "o", {"s": "o"}, 5_000).agg(F.max("s")).first()[0]
    assert last == 200_000 * 199_999 // 2


def test_thinning_a_day_of_many_events(spark):
    n = 300_000
    events = spark.range(n).select(F.lit("2024-01-01").alias("date"), F.col("id"), (F.col("id") * 7919 % n).alias("event"))
    kept = sorted(r.event for r in market.thin_evenly(events, ["date", "event"], 7).collect())
    assert kept == [round(i * (n - 1) / 6) for i in range(7)]
    cut = ranged(events, ["date"], "event", n // 128)
    assert max(r["count"] for r in cut.groupBy("_bucket").count().collect()) < n / 64
    few = events.limit(5)
    assert market.thin_evenly(few, ["date", "event"], 7).count() == 5 and market.thin_evenly(few, ["date", "event"], 1).count() == 1


def test_average_ranks(frame):
    df = frame([("a", v) for v in (3.0, 1.0, 3.0, 2.0)], "k string, v double")
    out = {r.v: r["rank"] for r in average_ranks(df, ["k"], "v").collect()}
    assert out == {1.0: 1.0, 2.0: 2.0, 3.0: 3.5}


def test_zipf(frame):
    df = frame([("a", 1000.0 / r) for r in range(1, 51)], "k string, size double")
    fit = one(stats.zipf_exponent(df, ["k"], "size"))
    assert fit["slope"] == pytest.approx(-1.0) and fit["r2"] > 0.999 and fit["n"] == 50


def test_powerlaw_recovers_exponent(frame):
    rng = np.random.default_rng(1)
    x = 2.0 * (1 - rng.random(2000)) ** (-1 / 1.5)
    df = frame([("a", float(v)) for v in x], "k string, v double")
    fit = one(stats.powerlaw_fit(df, ["k"], "v"))
    assert fit["alpha"] == pytest.approx(2.5, abs=0.2) and fit["n_tail"] > 100


def brute_tail(x):
    x = np.sort(np.asarray(x, float))
    best = None
    for xmin in np.unique(x)[:-1]:
        tail = x[x >= xmin]
        alpha = 1 + len(tail) / np.log(tail / xmin).sum()
        values, counts = np.unique(tail, return_counts=True)
        upto, model = np.cumsum(counts), 1 - (values / xmin) ** (1 - alpha)
        ks = max(abs(upto / len(tail) - model).max(), abs((upto - counts) / len(tail) - model).max())
        if best is None or ks < best[3] - 1e-12:
            best = (xmin, alpha, len(tail), ks)
    return best


@pytest.mark.parametrize("ranges", [1024, 3])
def test_powerlaw_tail_equals_the_full_search(frame, ranges):
    rng = np.random.default_rng(4)
    groups = {
        "pareto": 1 + rng.pareto(1.8, 600), "whole": rng.integers(1, 40, 500).astype(float), "log": np.exp(rng.normal(size=400)),
        "few": np.array([1.0] * 9), "ten": np.r_[np.ones(9), 5.0], None: rng.random(50),
    }
    df = frame([(k, float(v)) for k, x in groups.items() for v in x] + [("ten", 0.0), ("ten", None)], "k string, v double")
    got = {r.k: (r.xmin, r.alpha, r.n_tail, r.ks) for r in stats.powerlaw_tail(df, ["k"], "v", ranges).collect()}
    assert set(got) == {"pareto", "whole", "log", "ten", None}
    for k, fit in got.items():
        assert fit == pytest.approx(brute_tail(groups[k]))


@pytest.mark.parametrize(("centre", "sd"), [(-1.0, 1.0), (0.5, 0.7), (3.0, 1.0), (-6.0, 2.0)])
def test_cut_normal_has_the_moments_it_was_given(centre, sd):
    t = np.linspace(0, centre + 14 * sd if centre > 0 else 14 * sd, 2_000_001)
    p = np.exp(-(((t - centre) / sd) ** 2) / 2)
    p /= p.sum()
    mean = (p * t).sum()
    c, sigma, hazard = stats.tail_normal(mean, (p * t * t).sum() - mean**2)
    assert (c, sigma) == pytest.approx((-centre / sd, sd), rel=1e-3)
    assert p[0] / (t[1] - t[0]) == pytest.approx(hazard / sigma, rel=1e-3)


def test_likelihood_ratio_tells_planted_tails_apart(frame):
    rng = np.random.default_rng(2)
    # the lognormal's values start at its middle, so its whole upper half is the tail
    bent = np.exp(np.abs(rng.normal(0, 0.6, 4000)))
    straight = 1 + rng.pareto(1.5, 4000)
    df = frame([("log", float(v)) for v in bent] + [("pareto", float(v)) for v in straight], "k string, v double")
    fit = {r.k: r for r in stats.powerlaw_fit(df, ["k"], "v").collect()}
    assert fit["log"].lr_powerlaw_vs_lognormal < -2 and fit["log"].lr_pvalue < 0.05
    assert fit["pareto"].lr_pvalue > 0.05 and fit["pareto"].alpha == pytest.approx(2.5, abs=0.15)


def test_fuel_entropy_and_rca(frame):
    df = frame([(1, 9, 0, 0, 0, 0), (2, 5, 5, 5, 5, 5), (3, 0, 0, 0, 0, 0)],
               "i int, ev_regs int, cng_regs int, petrol_regs int, diesel_regs int, hybrid_regs int")
    out = {r.i: r.fuel_entropy for r in stats.fuel_mix_entropy(df).collect()}
    assert out[1] == pytest.approx(0) and out[2] == pytest.approx(log(5)) and out[3] == 0
    edges = frame([("S1", "A", 10), ("S1", "B", 10), ("S2", "B", 20), ("S2", "C", 20), ("S3", "A", 30)],
                  "state_code string, maker string, regs int")
    rca = {(r.state_code, r.maker): r.rca for r in stats.rca(edges, "state_code", "maker", "regs").collect()}
    assert rca[("S3", "A")] > 1 and len(rca) == 5
    wide = stats.rca_matrix(stats.rca(edges, "state_code", "maker", "regs"), "state_code", "maker", ["A", "B", "C"])
    assert wide.count() == 3 and wide.where("state_code = 'S3'").first()["C"] == 0


def test_channel_stress(frame):
    retail = [100, 100, 60, 80, 99, 101]
    made = [100, 110, 30, 90, 120, 100]
    run = frame([("x", i, float(r), float(p), 1.0 + i) for i, (r, p) in enumerate(zip(retail, made))],
                "k string, t int, retail double, production double, cover double")
    base = frame([("x", i, 100.0) for i in range(6)], "k string, t int, retail double")
    out = one(stats.channel_stress(run, base, ["k"], "t"))
    assert (out["trough_month"], out["recovery_month"]) == (2, 4)
    assert out["trough_retail_vs_baseline"] == pytest.approx(0.6) and out["bullwhip_ratio"] > 1


def test_momentum_and_regime_rules(frame):
    df = frame([("A", y, s) for y, s in zip(range(2022, 2026), (0.01, 0.02, 0.03, 0.06))]
               + [("B", y, s) for y, s in zip(range(2022, 2026), (0.01, 0.03, 0.06, 0.08))],
               "state_code string, year int, ev_share double")
    out = {r.state_code: r for r in series.recent_acceleration_summary(df, "ev_share").collect()}
    assert out["A"].momentum_verdict == "accelerating" and out["A"].acceleration_pp == pytest.approx(2.0)
    assert out["B"].momentum_verdict == "decelerating" and out["B"].acceleration_pp == pytest.approx(-1.0)


def test_risk_set_and_survival(frame):
    cal = frame([("A", 1, "x"), ("A", 2, "y"), ("A", 3, "y"), ("B", 1, "x"), ("B", 2, "x"), ("B", 3, "x")],
                "state_code string, year int, regime string")
    risk = series.build_risk_set(cal, cal.select("state_code", "year"), [])
    assert risk.count() == 5
    km = {r.year: r.survival for r in series.kaplan_meier(risk).collect()}
    assert km[1] == 1.0 and km[2] == pytest.approx(0.5) and km[3] == pytest.approx(0.5)


def test_adoption_series_starts_at_onset(frame):
    counts = [0] * 24 + [10, 30, 60, 100, 150, 200, 3, 1]
    df = frame([("a", i, float(c)) for i, c in enumerate(counts)], "k string, i int, n double")
    rows = sorted(series.prepare_adoption_series(df, ["k"], "i", "n").collect(), key=lambda r: r.t)
    assert [r.cum for r in rows] == [100.0, 200.0, 350.0, 550.0] and rows[0].t == 0


def test_market_context_scopes_total(frame):
    rows = [("ALL", m, y, 100, 20, 100, 30, 40, 10) for y, ms in ((2024, 12), (2025, 4)) for m in range(1, ms + 1)]
    panel = frame(rows, "state_code string, month int, year int, total_regs int, ev_regs int, cng_regs int, petrol_regs int, diesel_regs int, hybrid_regs int"
                  ).withColumn("date", F.make_date("year", "month", F.lit(1)))
    cut = one(market.cutoff(panel))
    assert cut["latest_complete_year"] == 2024 and cut["observed_months_latest_year"] == 4
    monthly = market.market_monthly(None, panel, (2024, 2024), fuels=("EV", "CNG"))
    assert monthly.count() == 12 and monthly.first()["total_regs"] == 120
    single = market.market_annual(market.market_monthly(None, panel, (2024, 2024), fuels=("EV",)))
    assert single.first()["ev_share"] == 1.0


def test_price_fallback_keeps_state_basis(frame):
    from panelwright.plans import panels

    panel = frame([("S1", 2020), ("S2", 2020), ("ALL", 2020)], "state_code string, year int")
    prices = frame([("S1", 2020, "Petrol", None, "s", "q1"), ("ALL", 2020, "Petrol", 90.0, "n", "q2")],
                   "state_code string, year int, fuel string, price_avg_inr double, source string, quality string")
    out = {r.state_code: r for r in panels.with_prices(panel, prices).collect()}
    assert out["S1"].petrol_price_inr == 90.0 and out["S1"].petrol_price_basis == "state" and out["S1"].petrol_price_source == "s"
    assert out["S2"].petrol_price_basis == "ALL/Delhi fallback" and out["S2"].diesel_price_basis is None
