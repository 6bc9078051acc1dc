"""A cross-section of registered queries against their oracle on the smallest tables."""

import importlib
import sys
from pathlib import Path

import duckdb
import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT / "tools"))
DATA = Path("/root/testdata/sf0.001")

CHOSEN = [
    "pan_02_state_month", "pan_09_price_fallback", "pan_11_experiment_state_context", "pan_14_maker_state_share",
    "agg_08_summary_table", "agg_10_rank_size", "win_02_early_warning_signals", "win_03_kendall_tau",
    "qry_04_market_monthly", "qry_17_period_modes", "qry_25_comparison_table", "eco_02_panel_ols", "eco_05_did",
    "eco_08_tipping_summary", "fct_04_backtest", "grf_05_state_similarity", "grf_23_percolation", "cln_06_dispatch_clean",
    "src_02_decode_registrations", "dq_09_refresh_audit",
]


@pytest.fixture(scope="module")
def oracle():
    if not DATA.exists():
        pytest.skip("driver tables are not here")
    con = duckdb.connect()
    for path in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", CHOSEN)
def test_query_matches_oracle(spark, oracle, name):
    check = importlib.import_module("check_oracle")
    entry = importlib.import_module("__spark_entry__")
    got = entry.queries()[name](spark, str(DATA)).toPandas()
    want = oracle.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert check.canonical(got) == check.canonical(want)


def test_entry_and_registry(spark):
    entry = importlib.import_module("__spark_entry__")
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and len(names) > 200
    if DATA.exists():
        assert entry.entry(spark).limit(1).count() == 1
