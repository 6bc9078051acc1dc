"""Retail and dispatch facts derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.functions.columns import fiscal_year_of
from panelwright.session import cut_lineage
from panelwright.sources.cleaning import MAKER_MAP, clean

# Order priority read as fuel.
PRIORITY_FUEL = {
    "1-URGENT": "Petrol",
    "2-HIGH": "Diesel",
    "3-MEDIUM": "CNG",
    "4-NOT SPECIFIED": "EV",
    "5-LOW": "Strong Hybrid",
}
FULL_COVERAGE_FROM = "1998-01-01"
SUV_SEGMENTS = ("Large", "Promo")
HATCH_SEGMENTS = ("Small", "Economy")
LINES_PER_TASK = 500_000
#: The same for the registrations, whose cells are few: more lines in a task leave fewer sums to move.
FACT_LINES_PER_TASK = 3_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def state_code(nationkey: str | Column) -> Column:
    key = F.col(nationkey) if isinstance(nationkey, str) else nationkey
    return F.concat(F.lit("S"), F.lpad(key.cast("string"), 2, "0"))


def dim_state(spark: SparkSession, sf_dir: str, with_all: bool = False) -> DataFrame:
    """State dimension: code, name, map name, zone, union-territory flag."""
    nation = table(spark, sf_dir, "nation")
    region = table(spark, sf_dir, "region")
    states = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(
        state_code("n_nationkey").alias("state_code"),
        F.col("n_name").alias("state_name"),
        F.initcap(F.regexp_replace("n_name", "_", " ")).alias("geojson_name"),
        F.col("r_name").alias("zone"),
        (F.col("n_nationkey") % 8 == 0).alias("is_ut"),
    )
    if not with_all:
        return states
    everything = spark.range(1).select(
        F.lit("ALL").alias("state_code"),
        F.lit("All").alias("state_name"),
        F.lit("").alias("geojson_name"),
        F.lit("ALL").alias("zone"),
        F.lit(False).alias("is_ut"),
    )
    return states.unionByName(everything)


def _tasks(lines: DataFrame) -> int:
    """Tasks for work over all order lines, so that one task's share does not grow with them."""
    return max(lines.count() // LINES_PER_TASK + 1, lines.sparkSession.sparkContext.defaultParallelism)


def _more_than_session(spark: SparkSession, tasks: int) -> bool:
    return tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))


def _fact_tasks(lines: DataFrame) -> int | None:
    """Tasks for the registrations where the session's own number leaves one task more lines than it should hold."""
    tasks = lines.count() // FACT_LINES_PER_TASK + 1
    return tasks if _more_than_session(lines.sparkSession, tasks) else None


def _dealt(names: DataFrame, tasks: int | None, key: str) -> DataFrame:
    """The smaller side of a join with the lines, in ``tasks`` pieces where the session makes fewer.

    The lines follow its pieces, and stay where they are if it is small enough to be sent whole.
    """
    return names.repartition(tasks, key) if tasks is not None and _more_than_session(names.sparkSession, tasks) else names


def sold_lines(spark: SparkSession, sf_dir: str, day: str, tasks: int | None = None) -> DataFrame:
    """Order lines with buyer and nation, part key and priority, dated by month number.

    ``day`` is ``ship`` or ``ordered``.  Orders find their buyer before their
    lines, both in ``tasks`` pieces where that is given.  Only keys are carried:
    names join after the aggregation.
    """
    line_columns = ["l_orderkey", "l_partkey", "l_quantity"]
    order_columns = ["o_orderkey", "o_custkey", "o_orderpriority"]
    stamp = "l_shipdate" if day == "ship" else "o_orderdate"
    (line_columns if day == "ship" else order_columns).append(stamp)
    line = table(spark, sf_dir, "lineitem").select(*line_columns)
    orders = table(spark, sf_dir, "orders").select(*order_columns)
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    bought = orders.join(_dealt(customer, tasks, "c_custkey"), F.col("o_custkey") == F.col("c_custkey"))
    if tasks is not None:
        line, bought = line.repartition(tasks, "l_orderkey"), bought.repartition(tasks, "o_orderkey")
    return (
        line.join(bought, F.col("l_orderkey") == F.col("o_orderkey"))
        .withColumn("month_number", F.year(stamp) * 12 + F.month(stamp) - 1)
    )


def month_of(number: str = "month_number") -> Column:
    """First day of a month number (year * 12 + month - 1)."""
    n = F.col(number)
    return F.make_date(F.floor(n / 12).cast("int"), n % 12 + 1, F.lit(1))


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registrations: state x month x maker x fuel, with the observed total as ``ALL``.

    Lines collapse to nation, month, brand and priority first; the national rows
    and all labels are made from that small result.
    """
    part = table(spark, sf_dir, "part").select("p_partkey", "p_brand")
    tasks = _fact_tasks(table(spark, sf_dir, "lineitem"))
    cells = (
        sold_lines(spark, sf_dir, "ship", tasks)
        .join(_dealt(part, tasks, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
        .groupBy("c_nationkey", "month_number", "p_brand", "o_orderpriority")
        .agg(F.sum("l_quantity").alias("units"))
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    fuel = F.lit("Others")
    for priority, name in PRIORITY_FUEL.items():
        fuel = F.when(F.col("o_orderpriority") == priority, name).otherwise(fuel)
    local = cells.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    national = F.struct(F.lit("ALL").alias("state_code"), F.lit("All").alias("state_name"))
    own = F.struct(state_code("n_nationkey").alias("state_code"), F.col("n_name").alias("state_name"))
    scoped = local.select(
        F.explode(F.array(own, national)).alias("scope"), "month_number", "p_brand", fuel.alias("fuel"), "units"
    ).select("scope.*", "month_number", "p_brand", "fuel", "units")
    date = month_of()
    return (
        scoped.groupBy("state_code", "state_name", "month_number", "p_brand", "fuel")
        .agg(F.sum("units").cast("bigint").alias("count"))
        .select(
            "state_code",
            "state_name",
            F.year(date).alias("year"),
            F.month(date).alias("month"),
            fiscal_year_of(date).alias("fy"),
            F.col("p_brand").alias("maker"),
            "fuel",
            "count",
        )
    )


def dispatch_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dispatch lines in the raw column layout, with untidy labels and text quantities.

    There are nearly as many cells as lines, so they are summed under numbers
    only: one per kind of part (brand, name and type), stored so that it stays.
    The cells, and the joins before them, are dealt to as many tasks as the lines ask for.
    """
    labels = F.array(*[F.lit(k) for k in MAKER_MAP])
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    city = F.concat(F.lit(" city "), F.col("n_nationkey"), F.lit("-"), F.col("bucket").cast("string"))
    named_by = ["p_brand", "p_name", "p_type"]
    part = table(spark, sf_dir, "part").select("p_partkey", *named_by)
    kinds = cut_lineage(part.select(*named_by).distinct().withColumn("kind", F.monotonically_increasing_id()))
    other = kinds.withColumnsRenamed({c: f"_{c}" for c in named_by})
    same = [part[c].eqNullSafe(other[f"_{c}"]) for c in named_by]
    part_kind = cut_lineage(part.join(other, same).select("p_partkey", "kind"))
    tasks = _tasks(table(spark, sf_dir, "lineitem"))
    keys = ["c_nationkey", "bucket", "month_number", "kind"]
    cells = (
        sold_lines(spark, sf_dir, "ordered", tasks)
        .join(_dealt(part_kind, tasks, "p_partkey"), F.col("l_partkey") == F.col("p_partkey"))
        .select("c_nationkey", (F.col("o_custkey") % 4).alias("bucket"), "month_number", "kind", "l_quantity")
        .repartition(tasks, *keys)
        .groupBy(*keys)
        .agg(F.sum("l_quantity").cast("bigint").alias("units"))
        .join(_dealt(kinds, tasks, "kind"), "kind")
    )
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    named = (
        cells.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("m", month_of())
    )
    stray = (F.month("m") == 6) & (F.col("bucket") == 2) & (F.col("p_type") == "PROMO")
    return named.select(
        fiscal_year_of("m").alias("Financial Year"),
        F.datediff("m", F.lit("1899-12-30")).cast("string").alias("Month"),
        F.col("r_name").alias("CBH"),
        F.concat(F.lit("RO "), F.col("n_nationkey")).alias("New RO"),
        city.alias("City"),
        F.col("bucket").cast("string").alias("city group"),
        F.concat(F.col("p_name"), F.lit(" ")).alias("mdl"),
        F.concat(F.lit(" "), F.lower(F.element_at(labels, brand))).alias("maker"),
        F.when(stray, "n/a").otherwise(F.col("units").cast("string")).alias("SumOfQty"),
        F.col("p_type").alias("Seg-3"),
        F.col("p_type").alias("Seg-5"),
    )


def city_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """City to state mapping; the last bucket of each nation stays unmapped."""
    nation = table(spark, sf_dir, "nation")
    return nation.select(
        F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("bucket"), "n_nationkey"
    ).select(
        F.concat(
            F.lit("CITY "), F.col("n_nationkey"), F.lit("-"), F.col("bucket").cast("string")
        ).alias("city"),
        state_code("n_nationkey").alias("state_code"),
    )


def model_fuel_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nameplate attributes per model; models that start with cold or hot have none."""
    name = F.upper(F.trim("p_name"))
    first = F.split(name, " ")[0]
    return (
        table(spark, sf_dir, "part")
        .select(name.alias("model"), first.alias("first"))
        .distinct()
        .where(~F.col("first").isin("COLD", "HOT"))
        .select(
            "model",
            F.when(F.col("first") == "RED", "EV")
            .when(F.col("first") == "BLUE", "Petrol|CNG")
            .otherwise("Petrol")
            .alias("fuel_variants"),
            F.when(F.col("first") == "RED", "EV").otherwise("Petrol").alias("primary_fuel"),
            F.when(F.col("first") == "RED", 1).otherwise(0).alias("ev_only"),
            F.lit("mapped").alias("quality"),
        )
    )


def dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned dispatch facts."""
    return clean(
        dispatch_raw(spark, sf_dir),
        city_state(spark, sf_dir),
        model_fuel_map(spark, sf_dir),
        full_from=FULL_COVERAGE_FROM,
    )


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State pairs whose keys differ by 1, or by 5 inside one zone (each pair once)."""
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    steps = nation.select(
        "n_nationkey", "n_regionkey", F.explode(F.array(F.lit(1), F.lit(5))).alias("step")
    ).withColumn("other", F.col("n_nationkey") + F.col("step"))
    other = nation.select(
        F.col("n_nationkey").alias("other"), F.col("n_regionkey").alias("other_region")
    )
    return (
        steps.join(other, "other")
        .where((F.col("step") == 1) | (F.col("n_regionkey") == F.col("other_region")))
        .select(state_code("n_nationkey").alias("state_a"), state_code("other").alias("state_b"))
    )


def daily_purchases(spark: SparkSession, sf_dir: str, buckets: int = 10) -> DataFrame:
    """Event counts per user bucket and day: an adoption series per entity."""
    return (
        table(spark, sf_dir, "events")
        .where(F.col("event_type") == "purchase")
        .groupBy((F.col("user_id") % buckets).alias("entity"), F.to_date("ts").alias("date"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
