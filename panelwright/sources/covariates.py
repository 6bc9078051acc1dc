"""Slow-moving reference tables derived from customers, suppliers, orders and events.

The texts use only what Spark SQL and ANSI engines share, so that the test
oracle reads exactly the same inputs; ``{years}`` is each engine's own way to
repeat a row per year.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from panelwright.sources import tables

FIRST_YEAR, LAST_YEAR = 1995, 2001
SPARK_YEARS = f"LATERAL VIEW explode(sequence({FIRST_YEAR}, {LAST_YEAR})) years AS year"

_CODE = "'S' || lpad(CAST({key} AS STRING), 2, '0')"
_FY = "CAST(year AS STRING) || '-' || lpad(CAST((year + 1) % 100 AS STRING), 2, '0')"


def _code(key: str) -> str:
    return _CODE.format(key=key)


TEXTS: dict[str, str] = {
    "ref_population": f"""
        SELECT state_code, year,
               round(n * (100 + 2 * (year - 1995)) / 1000, 4) AS population_mn,
               round(n * (100 + 2 * (year - 1995)) / 1000 * urban_pct / 100, 4) AS urban_population_mn,
               round(n * (100 + 2 * (year - 1995)) / 1000 * (100 - urban_pct) / 100, 4) AS rural_population_mn,
               urban_pct AS urban_pct_basis, 1991 AS urban_share_year,
               'linear' AS method, 'customers' AS source, 'estimate' AS quality
        FROM (SELECT {_code('c_nationkey')} AS state_code, CAST(count(*) AS DOUBLE) AS n,
                     round(CAST(100 * sum(CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 1 ELSE 0 END) AS DOUBLE)
                       / CAST(count(*) AS DOUBLE), 2) AS urban_pct
              FROM {{customer}} GROUP BY c_nationkey) base {{years}}""",
    "ref_income": f"""
        SELECT state_code, {_FY} AS fy, round(v * (100 + 3 * (year - 1995)), 0) AS pc_nsdp_constant_2011_12_inr,
               'customers' AS source, 'official' AS quality
        FROM (SELECT {_code('c_nationkey')} AS state_code, avg(c_acctbal) AS v
              FROM {{customer}} WHERE c_nationkey % 6 <> 0 GROUP BY c_nationkey) base {{years}}""",
    "ref_gsdp": f"""
        SELECT state_code, {_FY} AS fy, round(v * (100 + 5 * (year - 1995)), 0) AS gsdp_constant_2011_12_lakh,
               CASE WHEN year > 1995 THEN CAST(4 + year % 3 AS DOUBLE) END AS gsdp_real_growth_pct,
               'suppliers' AS source, 'official_derived' AS quality
        FROM (SELECT {_code('s_nationkey')} AS state_code, avg(s_acctbal) AS v
              FROM {{supplier}} GROUP BY s_nationkey) base {{years}}""",
    "ref_loans": f"""
        SELECT state_code, year, round(v * (100 + 7 * (year - 1995)) / 100, 2) AS personal_loans_outstanding_crore
        FROM (SELECT {_code('c_nationkey')} AS state_code, sum(CASE WHEN c_acctbal > 0 THEN c_acctbal ELSE 0 END) / 1000 AS v
              FROM {{customer}} GROUP BY c_nationkey) base {{years}}""",
    "ref_cng": f"""
        SELECT {_code('s_nationkey')} AS state_code, 1999 AS year, CAST(count(*) AS BIGINT) AS stations,
               'suppliers' AS source, 'official' AS quality FROM {{supplier}} GROUP BY s_nationkey
        UNION ALL SELECT 'ALL', 1999, CAST(count(*) AS BIGINT), 'suppliers', 'official' FROM {{supplier}}
        UNION ALL SELECT 'ALL', 2000, CAST(count(*) + 10 AS BIGINT), 'suppliers', 'official' FROM {{supplier}}""",
    "ref_ev": f"""
        SELECT {_code('s_nationkey')} AS state_code, 2001 AS year, CAST(count(*) * 2 AS BIGINT) AS public_chargers,
               'suppliers' AS source, 'approximate' AS quality FROM {{supplier}} WHERE s_nationkey % 3 = 0 GROUP BY s_nationkey
        UNION ALL SELECT 'ALL', 2001, CAST(count(*) * 2 AS BIGINT), 'suppliers', 'official' FROM {{supplier}}""",
    "ref_prices": f"""
        SELECT 'ALL' AS state_code, year, fuel, round(avg(unit) / 10, 2) AS price_avg_inr, 'lines' AS source, 'national' AS quality
        FROM {{priced}} GROUP BY year, fuel
        UNION ALL
        SELECT {_code('nationkey')}, year, fuel, CASE WHEN nationkey % 10 = 4 THEN NULL ELSE round(avg(unit) / 10, 2) END,
               'lines', 'approximate'
        FROM {{priced}} WHERE nationkey % 2 = 0 AND year >= 1997 GROUP BY nationkey, year, fuel""",
    "ref_tax": f"""
        SELECT {_code('n_nationkey')} AS state_code, CAST(6 + n_nationkey % 7 AS DOUBLE) AS rate_pct,
               CASE WHEN n_nationkey % 4 = 0 THEN 0e0 ELSE CAST(2 + n_nationkey % 3 AS DOUBLE) END AS ev_rate_pct,
               '2001-01-01' AS as_of FROM {{nation}}""",
    "ref_events": """
        SELECT 'curated:' || CAST(event_id AS STRING) AS event_id, CAST(ts AS DATE) AS date,
               CASE WHEN user_id % 26 = 25 THEN 'ALL' ELSE 'S' || lpad(CAST(user_id % 26 AS STRING), 2, '0') END AS state_code,
               event_type AS category, CAST(1 + event_id % 3 AS INT) AS tier,
               event_type || ' ' || CAST(event_id AS STRING) AS label, props AS detail
        FROM {events}""",
}

PRICED_SELECT = "SELECT nationkey, year, fuel, unit"


def covariate(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = TEXTS[name]
    needed = [
        t
        for t in ("customer", "supplier", "nation", "events", "priced")
        if "{" + t + "}" in text
    ]
    frames = {t: tables.table(spark, sf_dir, t) for t in needed if t != "priced"}
    if "priced" in needed:
        frames["priced"] = priced_lines(spark, sf_dir)
    return spark.sql(text.replace("{years}", SPARK_YEARS), **frames)


def priced_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unit prices of lines by buyer nation, ship year and the three priced fuels."""
    from pyspark.sql import functions as F

    fuel = F.create_map(
        *[F.lit(x) for pair in tables.PRIORITY_FUEL.items() for x in pair]
    )[F.col("o_orderpriority")]
    line = tables.table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        F.year("l_shipdate").alias("year"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit"),
    )
    orders = tables.table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", fuel.alias("fuel")
    )
    customer = tables.table(spark, sf_dir, "customer").select(
        "c_custkey", F.col("c_nationkey").alias("nationkey")
    )
    return (
        line.join(
            orders.where(F.col("fuel").isin("Petrol", "Diesel", "CNG")),
            F.col("l_orderkey") == F.col("o_orderkey"),
        )
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select("nationkey", "year", "fuel", "unit")
    )
