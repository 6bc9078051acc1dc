"""Dictionary-coded registration bundles: reading, decoding, name resolution."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.sources.reference import named_offenders

REQUIRED_KEYS = ("regions", "makers", "fuels", "data", "meta")

BUNDLE_SCHEMA = (
    "regions array<string>, makers array<string>, fuels array<string>, "
    "data array<array<string>>, meta map<string,string>, "
    "events array<struct<id:string,date:string,label:string,params:struct<k:bigint>>>"
)


def load_master(spark: SparkSession, path: str, one_per_file: bool = False) -> DataFrame:
    """Bundles from JSON files (plain or gzip), one row per bundle.

    A feed of many bundles is read in parallel; a missing required key is an error.
    """
    bundles = spark.read.schema(BUNDLE_SCHEMA).option("multiLine", one_per_file).json(path)
    absent = bundles.agg(*[F.count_if(F.col(k).isNull()).alias(k) for k in REQUIRED_KEYS]).first()
    missing = [k for k in REQUIRED_KEYS if absent[k]]
    if missing:
        raise ValueError(f"bundle misses keys: {missing}")
    return bundles


def encode_bundles(facts: DataFrame, events: DataFrame, per: str) -> DataFrame:
    """Facts and events as coded bundles with shared dictionaries.

    One bundle per value of ``per`` (a month, so its size is bounded by the
    dimensions) and one per day of events.
    """
    names = facts.agg(
        F.array_sort(F.collect_set("state_name")).alias("regions"),
        F.array_sort(F.collect_set("maker")).alias("makers"),
        F.array_sort(F.collect_set("fuel")).alias("fuels"),
    ).withColumn("_one", F.lit(1))

    def index(c: str, out: str) -> DataFrame:
        return names.select(F.posexplode(c).alias(f"{out}_idx", out))

    coded = (
        facts.join(index("regions", "state_name"), "state_name")
        .join(index("makers", "maker"), "maker")
        .join(index("fuels", "fuel"), "fuel")
        .select(
            per,
            F.array(
                *[
                    F.col(c).cast("string")
                    for c in ("state_name_idx", "year", "month", "fy", "maker_idx", "fuel_idx", "count")
                ]
            ).alias("row"),
        )
        .groupBy(per)
        .agg(F.collect_list("row").alias("data"))
    )
    shards = coded.select(F.col(per).cast("string").alias("period"), "data")
    none = F.array().cast("array<array<string>>")
    happened = events.groupBy(F.col("date").cast("string").alias("period")).agg(
        F.collect_list(
            F.struct(
                F.col("event_id").alias("id"),
                F.col("date").cast("string").alias("date"),
                "label",
                F.from_json("detail", "k bigint").alias("params"),
            )
        ).alias("events")
    ).withColumn("data", none)
    return (
        shards.unionByName(happened, allowMissingColumns=True)
        .withColumn("_one", F.lit(1)).join(names, "_one").drop("_one")
        .withColumn("meta", F.create_map(F.lit("period"), F.col("period"), F.lit("coding"), F.lit("index")))
        .drop("period")
    )


def decode_registrations(bundles: DataFrame) -> DataFrame:
    """Coded rows to long facts by joins with the exploded dictionaries."""
    keyed = bundles.withColumn("_bundle", F.xxhash64(F.to_json("meta")))

    def names(c: str, out: str) -> DataFrame:
        return keyed.select("_bundle", F.posexplode(c).alias(f"{out}_idx", out)).distinct()

    rows = keyed.select("_bundle", F.explode("data").alias("r")).select(
        "_bundle",
        F.col("r")[0].cast("int").alias("state_name_idx"),
        F.col("r")[1].cast("int").alias("year"),
        F.col("r")[2].cast("int").alias("month"),
        F.col("r")[3].alias("fy"),
        F.col("r")[4].cast("int").alias("maker_idx"),
        F.col("r")[5].cast("int").alias("fuel_idx"),
        F.col("r")[6].cast("bigint").alias("count"),
    )
    return (
        rows.join(names("regions", "state_name"), ["_bundle", "state_name_idx"], "left")
        .join(names("makers", "maker"), ["_bundle", "maker_idx"], "left")
        .join(names("fuels", "fuel"), ["_bundle", "fuel_idx"], "left")
        .select("state_name", "year", "month", "fy", "maker", "fuel", "count")
    )


def decode_events(bundles: DataFrame) -> DataFrame:
    """Flat event rows; nested values become JSON text."""
    return bundles.select(F.explode("events").alias("e")).select(
        "e.id", "e.date", "e.label", F.to_json("e.params").alias("params")
    )


def meta_table(bundles: DataFrame) -> DataFrame:
    """(key, value) rows with the value as JSON text."""
    return bundles.select(F.explode("meta").alias("key", "value")).select(
        "key", F.to_json(F.struct("value")).alias("value")
    )


def resolve_states(facts: DataFrame, dim_state: DataFrame) -> DataFrame:
    """Adds the state code by name; any unknown name stops the load."""
    names = dim_state.select("state_name", "state_code")
    unknown = facts.join(names, "state_name", "left_anti").select("state_name").distinct()
    if offenders := named_offenders(unknown):
        raise ValueError(f"states missing from the dimension: {offenders}")
    return facts.join(names, "state_name", "left").select("state_code", *facts.columns)


def ingest_summary(facts: DataFrame, events: DataFrame) -> DataFrame:
    counts = facts.agg(
        F.count(F.lit(1)).alias("registrations"),
        F.count_distinct(F.when(F.col("state_code") != "ALL", F.col("state_code"))).alias("states"),
    ).withColumn("_one", F.lit(1))
    happened = events.agg(F.count(F.lit(1)).alias("events")).withColumn("_one", F.lit(1))
    return counts.join(happened, "_one").drop("_one")


def dispatch_summary(wholesale: DataFrame) -> DataFrame:
    """Rows, units, distinct models and makers, span and unmapped volume in percent."""
    unmapped = F.sum(F.when(F.col("state_code").isNull(), F.col("qty")))
    return wholesale.agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum("qty").alias("total_units"),
        F.count_distinct("model").alias("models"),
        F.count_distinct("maker").alias("makers"),
        F.date_format(F.min("date"), "yyyy-MM").alias("first_month"),
        F.date_format(F.max("date"), "yyyy-MM").alias("last_month"),
        F.round(100 * F.coalesce(F.try_divide(unmapped, F.sum("qty")), F.lit(0.0)), 1).alias(
            "unmapped_state_volume_pct"
        ),
    )


def union_items(parts: dict[str, DataFrame], columns: Sequence[str], order: str, tie: str) -> DataFrame:
    """Tagged union of log tables with aligned columns, newest first."""
    out: DataFrame | None = None
    for kind, frame in parts.items():
        one = frame.select(F.lit(kind).alias("kind"), *columns)
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no log table given")
    return out.orderBy(F.desc(order), "kind", tie)
