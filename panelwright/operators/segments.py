"""Segment transition on dispatch facts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.columns import ratio, total
from panelwright.session import cut_lineage

# Segment names.
SUV_SEGMENTS = ("Entry Suv", "Mid Suv", "Premium Suv", "Suv")
HATCH_SEGMENTS = ("Entry Hatch", "Mid Hatch", "Premium Hatch")
ARCHETYPES = ("Entry market", "Transitioning", "Aspiration majority", "Premium/SUV-first")


def panel_cities(wholesale: DataFrame, min_months: int = 36) -> DataFrame:
    """Cities with enough distinct months in the sample era."""
    return (
        wholesale.where(F.col("coverage") == "sample")
        .groupBy("city")
        .agg(F.count_distinct("date").alias("months"))
        .where(F.col("months") >= min_months)
    )


def suv_share(segments: Sequence[str]) -> Column:
    """Aggregate share of the given segments; null without any such row, as the source has it."""
    return ratio(F.sum(F.when(F.col("segment5").isin(list(segments)), F.col("qty"))), F.sum("qty"))


def suv_share_series(
    wholesale: DataFrame,
    grain: str = "state",
    cities: DataFrame | None = None,
    segments: Sequence[str] = SUV_SEGMENTS,
) -> DataFrame:
    """Monthly SUV share per state (full era) or per panel city (whole span)."""
    if grain == "state":
        rows = wholesale.where((F.col("coverage") == "full") & F.col("state_code").isNotNull())
        entity = F.col("state_code")
    else:
        if cities is None:
            raise ValueError("city grain needs the panel cities")
        rows = wholesale.join(cities.select("city"), "city", "left_semi")
        entity = F.col("city")
    return rows.groupBy(entity.alias("entity"), "date", "year", "month").agg(
        suv_share(segments).alias("suv_share")
    )


def segment_mix(
    wholesale: DataFrame,
    by: str = "year",
    suv: Sequence[str] = SUV_SEGMENTS,
    hatch: Sequence[str] = HATCH_SEGMENTS,
) -> DataFrame:
    """Units and share per segment and period, with the body grouping."""
    s = F.col("segment5")
    grouping = F.when(s.isin(list(suv)), "SUV").when(s.isin(list(hatch)), "Hatch").otherwise("Other")
    units = (
        wholesale.where(F.col("coverage") == "full")
        .groupBy(by, "segment5")
        .agg(F.sum("qty").alias("units"))
    )
    whole = F.sum("units").over(Window.partitionBy(by))
    return units.withColumn("share", ratio("units", whole)).withColumn("body", grouping)


def oem_suv_trajectories(
    wholesale: DataFrame, segments: Sequence[str] = SUV_SEGMENTS, min_units: int = 20000
) -> DataFrame:
    return (
        wholesale.where(F.col("coverage") == "full")
        .groupBy("maker", "year")
        .agg(suv_share(segments).alias("suv_share"), F.sum("qty").alias("units"))
        .where(F.col("units") > min_units)
    )


def classify_movers(trajectories: DataFrame, threshold: float = 0.5, locked: float = 0.35) -> DataFrame:
    """Early mover, fast follower, approaching or segment-locked per maker."""
    per_maker = trajectories.groupBy("maker").agg(
        F.min(F.when(F.col("suv_share") >= threshold, F.col("year"))).alias("crossed_year"),
        F.max_by("suv_share", "year").alias("latest_suv_share"),
        F.max_by("units", "year").alias("latest_units"),
    )
    median = per_maker.agg(F.percentile("crossed_year", F.lit(0.5)).alias("_median"))
    crossed = F.col("crossed_year")
    label = (
        F.when(crossed.isNull() & (F.col("latest_suv_share") < locked), "segment-locked")
        .when(crossed.isNull(), "approaching")
        .when(crossed <= F.col("_median"), "early mover")
        .otherwise("fast follower")
    )
    return (
        per_maker.withColumn("_one", F.lit(1))
        .join(median.withColumn("_one", F.lit(1)), "_one")
        .select("maker", "crossed_year", "latest_suv_share", "latest_units", label.alias("class"))
    )


def state_archetypes(
    wholesale: DataFrame,
    year: int,
    segment_names: Sequence[str],
    suv: Sequence[str] = SUV_SEGMENTS,
    k: int = 4,
    seed: int = 42,
) -> DataFrame:
    """k-means on segment-share vectors; clusters are named by their summed SUV share."""
    names = list(segment_names)
    wide = (
        wholesale.where(
            (F.col("coverage") == "full") & (F.col("year") == year) & F.col("state_code").isNotNull()
        )
        .groupBy("state_code")
        .pivot("segment5", names)
        .agg(F.sum("qty"))
        .fillna(0, names)
    )
    whole = total([F.col(f"`{n}`") for n in names])
    shares = wide.where(whole > 0).select(
        "state_code", *[ratio(F.col(f"`{n}`"), whole).alias(n) for n in names]
    )
    vectors = VectorAssembler(inputCols=names, outputCol="_features").transform(
        cut_lineage(shares)
    )
    clustered = KMeans(k=k, seed=seed, featuresCol="_features", predictionCol="cluster").fit(
        vectors
    ).transform(vectors)
    leaning = [F.sum(F.col(f"`{n}`")) for n in names if n in suv]
    order = clustered.groupBy("cluster").agg(total(leaning).alias("_suv"))
    # One row per cluster: k rows are ranked here.
    ranked = order.withColumn(
        "_rank", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_suv", "cluster")) - 1
    )
    label: Column = F.lit(ARCHETYPES[-1])
    for i, name in reversed(list(enumerate(ARCHETYPES[:-1]))):
        label = F.when(F.col("_rank") == i, name).otherwise(label)
    return clustered.join(ranked, "cluster").select(
        "state_code", *[F.col(f"`{n}`") for n in names], label.alias("archetype")
    )
