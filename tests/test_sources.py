import json
import re

import pytest
from pyspark.sql import functions as F

from panelwright.operators import regimes, segments
from panelwright.sources import bundle, cleaning, reference, tables

STATES = [("ALL", "All", "", "ALL", False), ("S1", "One", "One", "N", False), ("S2", "Two", "Two", "S", True)]
STATE_SCHEMA = "state_code string, state_name string, geojson_name string, zone string, is_ut boolean"


def test_maker_labels(frame):
    want = {
        "ARENA": ("Maruti Suzuki", "Arena", "Maruti Suzuki"),
        " Nexa ": ("Maruti Suzuki", "Nexa", "Maruti Suzuki"),
        "skoda": ("Skoda", None, "Volkswagen Group"),
        "PCA": ("Citroen", None, "Stellantis"),
        "gm": ("Chevy", None, "Chevy"),
        "unheard of": ("Others", None, "Others"),
    }
    rows = cleaning.normalize_makers(frame([(k,) for k in want], "maker_raw string")).collect()
    assert {r.maker_raw: (r.maker, r.channel, r.maker_vahan) for r in rows} == want


def test_serial_dates(frame):
    rows = frame([(42826,), (46113,)], "s int").select(cleaning.serial_to_date("s").cast("string").alias("d")).collect()
    assert [r.d for r in rows] == ["2017-04-01", "2026-04-01"]


def test_labels_and_fiscal_years(frame):
    row = frame([(" Andhra Pradesh *1.2# ", "2011–12 (base)", "none")], "a string, b string, c string").select(
        cleaning.clean_label("a").alias("a"), cleaning.clean_fiscal_label("b").alias("b"), cleaning.clean_fiscal_label("c").alias("c")).first()
    assert (row.a, row.b, row.c) == ("andhra pradesh", "2011-12", None)


def test_csv_comments_and_checks(spark, frame, tmp_path):
    path = tmp_path / "income.csv"
    path.write_text("# note\nstate_code,fy,v\nS1,2020-21,5\n# more\nS2,2020-21,6\n")
    df = reference.read_reference_csv(spark, str(path), "state_code string, fy string, v int")
    states = frame(STATES, STATE_SCHEMA)
    counts = {r.table: r.rows for r in reference.load_reference_tables(states, {"income": df}).collect()}
    assert counts == {"dim_state": 3, "ref_income": 2}
    with pytest.raises(ValueError, match="unknown state codes"):
        reference.check_codes("x", frame([("ZZ",)], "state_code string"), states)
    with pytest.raises(ValueError, match="duplicate"):
        reference.check_states(frame([*STATES, STATES[1]], STATE_SCHEMA))


def test_catalog_must_match_files(frame):
    columns = ", ".join(f"{c} string" for c in reference.CATALOG_COLUMNS)
    row = ("d", "a.csv", "usable", "", "", "", "", "", "", "show", "")
    files = frame([("a.csv",), ("reference_catalog.csv",)], "file string")
    assert reference.validate_reference_catalog(frame([row], columns), files).count() == 1
    with pytest.raises(ValueError, match="missing entry"):
        reference.validate_reference_catalog(frame([row], columns), frame([("a.csv",), ("b.csv",)], "file string"))
    with pytest.raises(ValueError, match="invalid status"):
        reference.validate_reference_catalog(frame([(*row[:2], "odd", *row[3:])], columns), files)


def test_bundle_file_with_mixed_types(spark, frame, tmp_path):
    doc = {"regions": ["All", "One"], "makers": ["M"], "fuels": ["EV", "CNG"], "meta": {"v": "1"},
           "data": [[1, 2024, 4, "2024-25", 0, 1, 7], [0, 2024, 4, "2024-25", 0, 0, 9]],
           "events": [{"id": "e1", "date": "2024-04", "label": "x", "params": {"k": 3}}]}
    path = tmp_path / "bundle.json"
    path.write_text(json.dumps(doc, indent=1))
    loaded = bundle.load_master(spark, str(path), one_per_file=True)
    rows = {(r.state_name, r.fuel): r["count"] for r in bundle.decode_registrations(loaded).collect()}
    assert rows == {("One", "CNG"): 7, ("All", "EV"): 9}
    assert bundle.decode_events(loaded).first().params == '{"k":3}'
    coded = bundle.resolve_states(bundle.decode_registrations(loaded), frame(STATES, STATE_SCHEMA))
    assert {r.state_code for r in coded.collect()} == {"ALL", "S1"}
    with pytest.raises(ValueError, match="missing from the dimension"):
        bundle.resolve_states(bundle.decode_registrations(loaded), frame(STATES[:1], STATE_SCHEMA))
    broken = tmp_path / "broken.json"
    broken.write_text(json.dumps({k: v for k, v in doc.items() if k != "meta"}))
    with pytest.raises(ValueError, match="meta"):
        bundle.load_master(spark, str(broken), one_per_file=True)


def test_movers(frame):
    rows = [("Early", y, s, 30000) for y, s in zip(range(2022, 2026), (0.55, 0.6, 0.7, 0.8))]
    rows += [("Follower", y, s, 30000) for y, s in zip(range(2022, 2026), (0.2, 0.4, 0.55, 0.6))]
    rows += [("Locked", y, 0.1, 30000) for y in range(2022, 2026)]
    out = {r.maker: r["class"] for r in segments.classify_movers(frame(rows, "maker string, year int, suv_share double, units int")).collect()}
    assert out == {"Early": "early mover", "Follower": "fast follower", "Locked": "segment-locked"}


def test_hmm_recovers_planted_regimes(frame):
    import numpy as np

    rng = np.random.default_rng(0)
    means = {0: [0.7, 0.2, 0.05, 0.03, 0.02], 1: [0.3, 0.1, 0.3, 0.2, 0.1]}
    rows, truth = [], {}
    for s in range(12):
        switch = int(rng.integers(6, 15))
        for t in range(20):
            z = int(t >= switch)
            truth[(f"s{s}", 2000 + t)] = z
            rows.append((f"s{s}", 2000 + t, *[float(v) for v in np.array(means[z]) + rng.normal(0, 0.02, 5)]))
    df = frame(rows, "state_code string, year int, " + ", ".join(f"{c} double" for c in regimes.FUEL_COLUMNS))
    fit = regimes.fit_fuel_regimes(df, (2, 3), restarts=2, max_rounds=40)
    chosen = min(fit["selection"].collect(), key=lambda r: r.bic)
    assert chosen.k == 2
    found = {(r.state_code, r.year): r.regime for r in fit["calendar"].collect()}
    hits = np.mean([found[k] == v for k, v in truth.items()])
    assert max(hits, 1 - hits) > 0.9
    stay = {(r.regime, r.next_regime): r.probability for r in fit["transition_matrix"].collect()}
    assert stay[(0, 0)] > 0.8 and stay[(1, 1)] > 0.8
    assert fit["regime_means"].where(F.col("regime_label").isNull()).count() == 0


def test_dispatch_cells_are_dealt_by_the_number_of_lines(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)

    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")

    save("nation", [(1, "N", 0)], "n_nationkey int, n_name string, n_regionkey int")
    save("region", [(0, "R")], "r_regionkey int, r_name string")
    save("customer", [(5, 1)], "c_custkey long, c_nationkey int")
    save("orders", [(i, 5, "5-LOW", "1997-01-02") for i in range(50)],
         "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate string")
    parts = [(0, "Brand#1", "red", None), (1, "Brand#1", "red", None), (2, "Brand#1", "red", "SMALL"), (3, "Brand#1", None, "SMALL")]
    save("part", parts, "p_partkey long, p_brand string, p_name string, p_type string")
    save("lineitem", [(i, i % 4, 1.0, "1997-02-01") for i in range(50)],
         "l_orderkey long, l_partkey long, l_quantity double, l_shipdate string")
    monkeypatch.setattr(tables, "LINES_PER_TASK", 1)
    raw = tables.dispatch_raw(spark, folder)
    assert raw.rdd.getNumPartitions() == 51
    cells = sorted((r.mdl or "", r["Seg-5"] or "", int(r.SumOfQty)) for r in raw.collect())
    assert cells == [("", "SMALL", 12), ("red ", "", 26), ("red ", "SMALL", 12)]


def test_registrations_are_dealt_by_the_number_of_lines_where_the_session_has_fewer_tasks(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)

    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")

    save("nation", [(1, "N")], "n_nationkey int, n_name string")
    save("customer", [(5, 1)], "c_custkey long, c_nationkey int")
    save("orders", [(i, 5, "5-LOW") for i in range(50)], "o_orderkey long, o_custkey long, o_orderpriority string")
    save("part", [(0, "Brand#1"), (1, "Brand#2")], "p_partkey long, p_brand string")
    save("lineitem", [(i, i % 2, 1.0, "1997-02-01") for i in range(50)],
         "l_orderkey long, l_partkey long, l_quantity double, l_shipdate string")
    found = []
    for lines, dealt in ((1, True), (1000, False)):
        monkeypatch.setattr(tables, "FACT_LINES_PER_TASK", lines)
        facts = tables.facts(spark, folder)
        plan = facts._jdf.queryExecution().optimizedPlan().toString()
        assert ("RepartitionByExpression" in plan and ", 51" in plan) == dealt
        found.append(sorted(map(tuple, facts.collect())))
    assert found[0] == found[1] and sum(r[-1] for r in found[0]) == 100


def test_every_join_of_the_lines_is_dealt_by_their_number(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)

    def save(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")

    save("nation", [(1, "N", 0)], "n_nationkey int, n_name string, n_regionkey int")
    save("region", [(0, "R")], "r_regionkey int, r_name string")
    save("customer", [(5, 1)], "c_custkey long, c_nationkey int")
    save("orders", [(i, 5, "5-LOW", "1997-01-02") for i in range(50)],
         "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate string")
    save("part", [(0, "Brand#1", "red", "SMALL"), (1, "Brand#2", "red", "SMALL")],
         "p_partkey long, p_brand string, p_name string, p_type string")
    save("lineitem", [(i, i % 2, 1.0, "1997-02-01") for i in range(50)],
         "l_orderkey long, l_partkey long, l_quantity double, l_shipdate string")
    monkeypatch.setattr(tables, "LINES_PER_TASK", 1)
    monkeypatch.setattr(tables, "FACT_LINES_PER_TASK", 1)
    joins = {"l_orderkey", "o_orderkey", "o_custkey", "c_custkey", "l_partkey", "p_partkey"}
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for make, more in ((tables.facts, set()), (tables.dispatch_raw, {"kind"})):
        for limit in ("-1", threshold):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
            try:
                made = make(spark, folder)
                plan = made._jdf.queryExecution().executedPlan().toString()
                units = sum(int(r.SumOfQty if more else r["count"]) for r in made.collect())
            finally:
                spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            assert units == (50 if more else 100)
            found = set(re.findall(r"hashpartitioning\((\w+)#\d+L?, (\d+)\)", plan))
            if limit == "-1":
                assert {(k, "51") for k in joins | more} <= found
            assert not {k for k, n in found if n != "51"} & (joins | more)
            # Parts that are sent whole leave the lines where they are.
            assert limit == "-1" or "l_partkey" not in {k for k, _ in found}
