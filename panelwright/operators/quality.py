"""Data-quality checks; each returns rows (check, value, ok)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.columns import SHARE_COLUMNS, ratio, total
from panelwright.operators.market import cutoff
from panelwright.plans import panels


def check_row(df: DataFrame, name: str, value: Column, ok: Column) -> DataFrame:
    """One aggregate as a check row; ``ok`` reads the column ``value``."""
    return df.agg(value.cast("double").alias("value")).select(
        F.lit(name).alias("check"), "value", ok.alias("ok")
    )


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), frames)


def near_zero(limit: float) -> Column:
    return F.coalesce(F.col("value"), F.lit(0.0)) < limit


def share_identities(panel_year: DataFrame, maker_share: DataFrame) -> DataFrame:
    """Fuel shares and maker shares each sum to one: the largest distance from it."""
    off = lambda c: F.max(F.abs(c - 1))
    fuels = panel_year.where(F.col("total_regs") > 0)
    makers = maker_share.groupBy("state_code", "year").agg(F.sum("share").alias("_s"))
    return union_all(
        [
            check_row(fuels, "fuel_share_total", off(total([F.col(c) for c in SHARE_COLUMNS])), near_zero(1e-9)),
            check_row(makers, "maker_share_total", off(F.col("_s")), near_zero(1e-9)),
        ]
    )


def hhi_bounds(panel_year: DataFrame) -> DataFrame:
    """Rows whose concentration is no index: outside 0 to 10000, or not 10000 for a single maker."""
    h = F.col("hhi_oem")
    alone = (F.col("n_oems") == 1) & (F.abs(h - 10000) > 1)
    return check_row(panel_year, "concentration_bounds", F.count_if(~h.between(0, 10000 + 1e-6) | alone), near_zero(0.5))


def reconciliation(panel_year: DataFrame, facts: DataFrame) -> DataFrame:
    """Panel totals equal the raw totals."""
    raw = facts.groupBy("state_code", "year").agg(F.sum("count").alias("_raw"))
    both = panel_year.select("state_code", "year", "total_regs").join(
        raw, ["state_code", "year"], "full_outer"
    )
    differs = ~F.col("total_regs").eqNullSafe(F.col("_raw"))
    return check_row(both, "panel totals match facts", F.count_if(differs), near_zero(0.5))


def recomputation(stored: DataFrame) -> DataFrame:
    """Stored growth and point changes against the stored levels: each row meets the latest row before it."""
    level = stored.select("state_code", F.col("year").alias("_y"), F.col("total_regs").alias("_t"), F.col("ev_share").alias("_e"))
    own = stored.select("state_code", "year", "total_regs", "ev_share", "yoy_growth", "ev_share_chg_pp")
    before = own.join(level, "state_code").where(F.col("_y") < F.col("year")).groupBy(*own.columns).agg(
        F.max_by(F.struct("_t", "_e"), "_y").alias("_p")
    )
    growth = F.col("yoy_growth") - (F.col("total_regs") - F.col("_p._t")) / F.nullif(F.col("_p._t"), F.lit(0))
    change = F.col("ev_share_chg_pp") - 100 * (F.col("ev_share") - F.col("_p._e"))
    return union_all(
        [
            check_row(before, "growth_again", F.max(F.abs(growth)), near_zero(1e-9)),
            check_row(before, "ev_change_again", F.max(F.abs(change)), near_zero(1e-9)),
        ]
    )


def anchor_ranges(metrics: DataFrame, rules: Sequence[tuple[str, float, float]]) -> DataFrame:
    """Metrics (metric, value) against stated bounds; a missing metric fails."""
    table = metrics.sparkSession.createDataFrame(list(rules), "metric string, lo double, hi double")
    return table.join(metrics, "metric", "left").select(
        "metric",
        F.col("value").cast("double").alias("value"),
        F.coalesce(F.col("value").between(F.col("lo"), F.col("hi")), F.lit(False)).alias("ok"),
    )


def in_top(df: DataFrame, entity: str, value: str, k: int, expected: Sequence[str]) -> DataFrame:
    """Whether each expected entity is among the k leading ones by value (ties by name)."""
    leaders = df.where(F.col(value).isNotNull()).orderBy(F.desc(value), entity).limit(k).select(entity)
    wanted = df.sparkSession.createDataFrame([(e,) for e in expected], f"{entity} string")
    found = leaders.withColumn("ok", F.lit(True))
    return wanted.join(found, entity, "left").select(entity, F.coalesce("ok", F.lit(False)).alias("ok"))


def cross_source_agreement(
    facts: DataFrame, wholesale: DataFrame, year: int, tolerance: float = 0.05
) -> DataFrame:
    """National retail and dispatch share of each maker differ by at most the tolerance."""
    retail = panels.group_shares(
        facts.where((F.col("state_code") == "ALL") & (F.col("year") == year)), ["year"], "maker", "count"
    ).select("maker", F.col("share").alias("retail_share"))
    sent = panels.group_shares(
        wholesale.where(F.col("year") == year), ["year"], "maker_vahan", "qty"
    ).select(F.col("maker_vahan").alias("maker"), F.col("share").alias("dispatch_share"))
    gap = F.abs(F.col("retail_share") - F.col("dispatch_share"))
    return retail.join(sent, "maker", "left").select(
        "maker", "retail_share", "dispatch_share", F.coalesce(gap < tolerance, F.lit(False)).alias("ok")
    )


def non_negative(facts: DataFrame, value: str = "count") -> DataFrame:
    return check_row(facts, f"no negative {value}", F.count_if(F.col(value) < 0), near_zero(0.5))


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > 1)


def data_contract(
    frames: dict[str, DataFrame | None], panel_month: DataFrame
) -> DataFrame:
    """Row count per dependency with cutoff and privacy; a missing dependency is an error."""
    missing = sorted(name for name, frame in frames.items() if frame is None)
    if missing:
        raise ValueError(f"missing dependencies: {missing}")
    counts = panels.row_counts({n: f for n, f in frames.items() if f is not None})
    last = cutoff(panel_month).select(
        F.lit(1).alias("_one"), F.col("latest_period").alias("cutoff"), "latest_complete_year"
    )
    name = F.col("dependency")
    return (
        counts.withColumnRenamed("panel", "dependency")
        .withColumn("_one", F.lit(1))
        .join(last, "_one")
        .drop("_one")
        .withColumn("private", name.contains("wholesale") | name.startswith("ws_"))
    )


def table_contract(spark: SparkSession, names: Sequence[str]) -> dict[str, DataFrame | None]:
    """Catalogue tables by name, None where absent."""
    return {n: spark.table(n) if spark.catalog.tableExists(n) else None for n in names}


def refresh_audit(
    status: DataFrame,
    panel_month: DataFrame,
    labels: DataFrame,
    previous_labels: DataFrame,
    wholesale: DataFrame,
    full_output: DataFrame,
    mapped_floor: float = 93.0,
    metadata_floor: float = 99.5,
    split_states: Sequence[str] = ("AP", "TS"),
) -> DataFrame:
    """Rules run after every refresh, on the stored outputs.

    ``status`` is the stored completeness table, held against the months counted
    anew; ``full_output`` the stored monthly totals of full coverage, held
    against the dispatch rows of full coverage.
    """
    counted = panel_month.where(F.col("state_code") == "ALL").groupBy(F.col("year").cast("string").alias("period")).agg(
        F.count_distinct("month").alias("_months")
    )
    called = status.where(F.col("completeness_status") == "complete").select("period").join(counted, "period", "left")
    partial = F.coalesce(F.col("_months"), F.lit(0)) < 12
    new = labels.join(previous_labels, labels.columns, "left_anti")
    full = wholesale.where(F.col("coverage") == "full")
    monthly = full.groupBy("year", "month").agg(F.sum("qty").alias("_full"))
    stored = full_output.select("year", "month", "wholesale").join(monthly, ["year", "month"], "left")
    mapped = ratio(F.sum(F.when(F.col("state_code").isNotNull(), F.col("qty"))), F.sum("qty")) * 100
    described = ratio(F.sum(F.when(F.col("fuel_variants").isNotNull(), F.col("qty"))), F.sum("qty")) * 100
    split = F.count_if(F.col("state_code").isin(list(split_states)))
    return union_all(
        [
            check_row(called, "partial year marked complete", F.count_if(partial), near_zero(0.5)),
            check_row(new, "new labels", F.count(F.lit(1)), near_zero(0.5)),
            check_row(full, "mapped volume pct", mapped, F.col("value") >= mapped_floor),
            check_row(full, "metadata volume pct", described, F.col("value") >= metadata_floor),
            check_row(full, "split states in state joins", split, near_zero(0.5)),
            check_row(
                stored, "sample rows in full outputs", F.count_if(~F.col("wholesale").eqNullSafe(F.col("_full"))), near_zero(0.5)
            ),
        ]
    )
