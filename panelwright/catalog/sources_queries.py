"""Queries of readers, writers, cleaning and reference building."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelwright.catalog.registry import Market, query
from panelwright.functions.columns import fiscal_year_starting
from panelwright.operators import market
from panelwright.plans import panels
from panelwright.session import shared_folder
from panelwright.sources import bundle, cleaning, reference, tables

_LABELS = "[" + ", ".join(f"'{k}'" for k in cleaning.MAKER_MAP) + "]"


def fresh(m: Market, name: str) -> str:
    return f"{shared_folder(m.spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bundles(m: Market) -> DataFrame:
    """The facts and events written as gzip JSON bundles and read back."""
    path = fresh(m, "bundles")
    monthly = m.facts.withColumn("period", F.col("year") * 100 + F.col("month"))
    bundle.encode_bundles(monthly, m.ref("ref_events"), "period").write.option("compression", "gzip").json(path)
    return bundle.load_master(m.spark, path)


@query("src_01_load_master")
def load_master(m: Market) -> DataFrame:
    return bundles(m).select(
        F.size("regions").alias("regions"), F.size("makers").alias("makers"), F.size("fuels").alias("fuels"),
        F.size("data").alias("rows"), F.col("meta")["period"].alias("period"),
    )


@query(
    "src_02_decode_registrations",
    'SELECT state_name, year, month, fy, maker, fuel, "count" FROM facts',
    "facts",
)
def decode_registrations(m: Market) -> DataFrame:
    return bundle.decode_registrations(bundles(m))


@query(
    "src_03_decode_events",
    "SELECT event_id AS id, CAST(date AS VARCHAR) AS date, label, replace(detail, ' ', '') AS params FROM ref_events",
    "ref_events",
)
def decode_events(m: Market) -> DataFrame:
    return bundle.decode_events(bundles(m))


@query("src_04_resolve_states", "SELECT * FROM facts", "facts")
def resolve_states(m: Market) -> DataFrame:
    coded = m.facts.drop("state_code")
    return bundle.resolve_states(coded, tables.dim_state(m.spark, m.sf_dir, with_all=True)).select(
        *m.facts.columns
    )


@query("src_05_meta_table")
def meta_table(m: Market) -> DataFrame:
    return bundle.meta_table(bundles(m))


@query(
    "src_06_ingest_summary",
    "SELECT COUNT(*) AS registrations, COUNT(DISTINCT state_code) FILTER (state_code <> 'ALL') AS states, (SELECT COUNT(*) FROM ref_events) AS events FROM facts",
    "facts ref_events",
)
def ingest_summary(m: Market) -> DataFrame:
    return bundle.ingest_summary(m.facts, m.ref("ref_events"))


@query(
    "src_07_reference_csv",
    "SELECT state_code, fy, pc_nsdp_constant_2011_12_inr, quality FROM ref_income",
    "ref_income",
    "pc_nsdp_constant_2011_12_inr",
)
def reference_csv(m: Market) -> DataFrame:
    """The income table written as CSV next to a file of comment lines, then read back."""
    path = fresh(m, "income")
    wanted = m.ref("ref_income").select("state_code", "fy", "pc_nsdp_constant_2011_12_inr", "quality")
    wanted.write.option("header", True).csv(path)
    notes = wanted.select(F.concat(F.lit("# provenance of "), "state_code").alias("value"))
    notes.write.mode("append").text(path)
    return reference.read_reference_csv(
        m.spark, path, "state_code string, fy string, pc_nsdp_constant_2011_12_inr double, quality string"
    )


def reference_frames(m: Market) -> dict[str, DataFrame]:
    return {
        "population": m.population,
        "income": m.ref("ref_income"),
        "gsdp": m.ref("ref_gsdp"),
        "cng": m.cng,
        "ev": m.ev,
        "tax": m.tax,
    }


@query(
    "src_08_reference_tables",
    "SELECT 'dim_state' AS \"table\", COUNT(*) + 1 AS rows FROM dim_state UNION ALL "
    + " UNION ALL ".join(
        f"SELECT 'ref_{n}', COUNT(*) FROM {t}"
        for n, t in {"population": "ref_population", "income": "ref_income", "gsdp": "ref_gsdp", "cng": "cng", "ev": "ev", "tax": "tax"}.items()
    ),
    "dim_state ref_population ref_income ref_gsdp cng ev tax",
)
def reference_tables(m: Market) -> DataFrame:
    states = tables.dim_state(m.spark, m.sf_dir, with_all=True)
    return reference.load_reference_tables(states, reference_frames(m))


def catalog(m: Market) -> DataFrame:
    """A catalogue row per reference dataset, described by its own contents."""
    facts = reference.availability(reference_frames(m))
    return facts.select(
        "dataset",
        F.concat("dataset", F.lit(".parquet")).alias("file"),
        F.when(F.col("quality_values").contains("approximate"), "constrained").otherwise("usable").alias("status"),
        F.lit("state").alias("geography"),
        F.lit("1995-2001").alias("time_coverage"),
        F.lit("annual").alias("temporal_type"),
        F.col("quality_values").alias("quality_summary"),
        F.lit("context").alias("approved_use"),
        F.lit("").alias("not_available"),
        F.lit("show").alias("app_behavior"),
        F.lit("").alias("source_url"),
        "row_count",
    )


def written_files(m: Market, frames: dict[str, DataFrame]) -> DataFrame:
    """The files of a folder to which the frames were written whole."""
    folder = fresh(m, "catalog")
    for name, frame in frames.items():
        frame.write.parquet(f"{folder}/{name}.parquet")
    found = m.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(folder)
    return found.select(F.regexp_extract("path", r"([^/]+\.parquet)/[^/]+$", 1).alias("file")).distinct()


_STATUS = " UNION ALL ".join(
    f"SELECT '{name}' AS dataset, '{name}.parquet' AS file, CASE WHEN COUNT(*) FILTER (quality LIKE '%approximate%') > 0 THEN 'constrained' ELSE 'usable' END AS status FROM {table}"
    for name, table in (("population", "ref_population"), ("income", "ref_income"), ("gsdp", "ref_gsdp"), ("cng", "cng"), ("ev", "ev"))
)


@query(
    "src_09_catalog_validation",
    f"{_STATUS} UNION ALL SELECT 'tax', 'tax.parquet', 'usable'",
    "ref_population ref_income ref_gsdp cng ev",
)
def catalog_validation(m: Market) -> DataFrame:
    """Catalogue against the files of a folder that holds every dataset."""
    files = written_files(m, reference_frames(m))
    return reference.validate_reference_catalog(catalog(m), files).select("dataset", "file", "status")


@query(
    "src_09_catalog_problems",
    """SELECT 'missing file' AS problem, 'income.parquet' AS item UNION ALL SELECT 'missing entry', 'income_revised.parquet'
 UNION ALL SELECT 'invalid status', 'cng' UNION ALL SELECT 'duplicate dataset', 'gsdp' UNION ALL SELECT 'duplicate file', 'gsdp.parquet'""",
)
def catalog_problems(m: Market) -> DataFrame:
    """What is named when a file was renamed, a status is unknown and an entry stands twice."""
    frames = reference_frames(m)
    files = written_files(m, {("income_revised" if name == "income" else name): frame for name, frame in frames.items()})
    entries = catalog(m).withColumn("status", F.when(F.col("dataset") == "cng", "unheard of").otherwise(F.col("status")))
    return reference.catalog_problems(entries.unionByName(entries.where(F.col("dataset") == "gsdp")), files)


@query(
    "src_10_availability",
    """SELECT 'population' AS dataset, COUNT(*) AS row_count, 10 AS column_count, COUNT(DISTINCT state_code) AS state_codes_present, STRING_AGG(DISTINCT quality, ', ' ORDER BY quality) AS quality_values FROM ref_population
 UNION ALL SELECT 'income', COUNT(*), 5, COUNT(DISTINCT state_code), STRING_AGG(DISTINCT quality, ', ' ORDER BY quality) FROM ref_income
 UNION ALL SELECT 'gsdp', COUNT(*), 6, COUNT(DISTINCT state_code), STRING_AGG(DISTINCT quality, ', ' ORDER BY quality) FROM ref_gsdp
 UNION ALL SELECT 'cng', COUNT(*), 8, COUNT(DISTINCT state_code), STRING_AGG(DISTINCT quality, ', ' ORDER BY quality) FROM cng
 UNION ALL SELECT 'ev', COUNT(*), 8, COUNT(DISTINCT state_code), STRING_AGG(DISTINCT quality, ', ' ORDER BY quality) FROM ev
 UNION ALL SELECT 'tax', COUNT(*), 5, COUNT(DISTINCT state_code), '' FROM tax""",
    "ref_population ref_income ref_gsdp cng ev tax",
)
def availability(m: Market) -> DataFrame:
    return reference.availability(reference_frames(m))


_DISPATCH_SUMMARY = """SELECT COUNT(*) AS rows, CAST(SUM(qty) AS BIGINT) AS total_units, COUNT(DISTINCT model) AS models, COUNT(DISTINCT maker) AS makers,
 strftime(MIN(date), '%Y-%m') AS first_month, strftime(MAX(date), '%Y-%m') AS last_month,
 round(100 * COALESCE(SUM(qty) FILTER (state_code IS NULL), 0) / SUM(qty)::DOUBLE, 1) AS unmapped_state_volume_pct FROM wholesale"""


@query("src_11_dispatch_cache", _DISPATCH_SUMMARY, "wholesale", "unmapped_state_volume_pct")
def dispatch_cache(m: Market) -> DataFrame:
    path = fresh(m, "dispatch")
    reference.cached_table(m.spark, path, lambda: m.dispatch)

    def refuse() -> DataFrame:
        raise RuntimeError("the stored table was not read")

    return bundle.dispatch_summary(reference.cached_table(m.spark, path, refuse))


@query("src_12_dispatch_summary", _DISPATCH_SUMMARY, "wholesale", "unmapped_state_volume_pct")
def dispatch_summary(m: Market) -> DataFrame:
    return bundle.dispatch_summary(m.dispatch)


def saved_runs(m: Market) -> DataFrame:
    """Two runs of a baseline experiment, one per year, saved and discovered."""
    folder = fresh(m, "runs")
    for year in (1999, 2000):
        rows = m.panel_year.where((F.col("year") == year) & (F.col("state_code") == "ALL"))
        metrics = {"total_regs": rows.select("total_regs"), "hhi": rows.select("hhi_oem")}
        if year == 2000:
            metrics["growth"] = rows.select("yoy_growth")
        reference.save_run(folder, "descriptive-baseline", f"{year}1231T000000", {"panel": rows}, metrics)
    return reference.discover_runs(m.spark, folder)


@query(
    "src_13_result_sink",
    "SELECT state_code, year, total_regs FROM panel_year",
    "panel_year",
)
def result_sink(m: Market) -> DataFrame:
    folder = fresh(m, "runs")
    rows = m.panel_year.select("state_code", "year", "total_regs")
    reference.save_run(folder, "sink", "r1", {"panel": rows}, {"rows": rows.agg(F.count(F.lit(1)))})
    return m.spark.read.parquet(f"{folder}/sink/r1/panel.parquet")


@query(
    "src_14_latest_runs",
    "SELECT 'descriptive-baseline' AS experiment, '20001231T000000' AS run_id, total_regs::DOUBLE AS total_regs FROM panel_year WHERE state_code = 'ALL' AND year = 2000",
    "panel_year",
    "total_regs",
)
def latest_runs(m: Market) -> DataFrame:
    return reference.latest_runs(saved_runs(m)).select(
        "experiment", "run_id", F.col("metrics")["total_regs"].alias("total_regs")
    )


@query(
    "src_15_run_comparison",
    """SELECT 'total_regs' AS metric, MAX(total_regs) FILTER (year = 1999)::DOUBLE AS run_a, MAX(total_regs) FILTER (year = 2000)::DOUBLE AS run_b FROM panel_year WHERE state_code = 'ALL'
 UNION ALL SELECT 'hhi', MAX(hhi_oem) FILTER (year = 1999), MAX(hhi_oem) FILTER (year = 2000) FROM panel_year WHERE state_code = 'ALL'
 UNION ALL SELECT 'growth', NULL, MAX(yoy_growth) FILTER (year = 2000) FROM panel_year WHERE state_code = 'ALL'""",
    "panel_year",
    "run_a run_b",
)
def run_comparison(m: Market) -> DataFrame:
    return reference.compare_runs(saved_runs(m), "19991231T000000", "20001231T000000")


@query(
    "src_16_research_items",
    """SELECT CASE category WHEN 'view' THEN 'saved_view' WHEN 'signup' THEN 'note' ELSE 'watchlist' END AS kind, event_id, date, label
 FROM ref_events WHERE category IN ('view', 'signup', 'purchase')""",
    "ref_events",
    texts="date",
)
def research_items(m: Market) -> DataFrame:
    log = m.ref("ref_events")
    parts = {
        kind: log.where(F.col("category") == category)
        for kind, category in {"saved_view": "view", "note": "signup", "watchlist": "purchase"}.items()
    }
    return bundle.union_items(parts, ["event_id", "date", "label"], "date", "event_id")


@query("qry_11_data_health")
def data_health(m: Market) -> DataFrame:
    """Period and reference status in one table, with the catalogue's table count."""
    status = panels.period_status(m.panel_month)
    parts = market.data_health(m.spark, status, catalog(m))
    periods = parts["periods"].select(
        F.lit("period").alias("kind"), F.col("period").alias("name"), F.col("completeness_status").alias("status")
    )
    references = parts["references"].select(F.lit("reference").alias("kind"), F.col("dataset").alias("name"), "status")
    names = parts["tables"].select(
        F.lit("table").alias("kind"), F.col("table_name").alias("name"), F.lit("present").alias("status")
    )
    return periods.unionByName(references).unionByName(names)


# ------------------------------------------------------------------------- cleaning

_RAW = f"""raw AS (SELECT nationkey, zone, bucket, date_trunc('month', ordered)::DATE AS m, maker AS brand, p_name, p_type, CAST(SUM(q) AS BIGINT) AS qty FROM lines GROUP BY ALL),
 named AS (SELECT *, ' ' || lower({_LABELS}[CAST(regexp_extract(brand, '([0-9]+)', 1) AS INTEGER)]) AS maker_raw FROM raw WHERE NOT (month(m) = 6 AND bucket = 2 AND p_type = 'PROMO'))"""


@query(
    "cln_01_rename_and_coerce",
    f"""WITH {_RAW} SELECT CAST(year(m) - CASE WHEN month(m) < 4 THEN 1 ELSE 0 END AS VARCHAR) || '-' || lpad(CAST((year(m) - CASE WHEN month(m) < 4 THEN 1 ELSE 0 END + 1) % 100 AS VARCHAR), 2, '0') AS fy,
 datediff('day', DATE '1899-12-30', m) AS month_serial, zone, 'RO ' || nationkey AS ro, ' city ' || nationkey || '-' || bucket AS city, CAST(bucket AS VARCHAR) AS city_group,
 p_name || ' ' AS model, maker_raw, qty, p_type AS segment3, p_type AS segment5 FROM named""",
    "lines",
)
def rename_and_coerce(m: Market) -> DataFrame:
    return cleaning.rename_and_coerce(tables.dispatch_raw(m.spark, m.sf_dir))


@query(
    "cln_02_serial_dates",
    f"WITH {_RAW} SELECT DISTINCT datediff('day', DATE '1899-12-30', m) AS month_serial, m AS date, CAST(year(m) AS BIGINT) AS year, CAST(month(m) AS BIGINT) AS month FROM named",
    "lines",
    texts="date",
)
def serial_dates(m: Market) -> DataFrame:
    rows = cleaning.rename_and_coerce(tables.dispatch_raw(m.spark, m.sf_dir)).select("month_serial").distinct()
    return cleaning.with_dates(rows)


@query(
    "cln_03_normalize_makers",
    f"""WITH p AS (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN p_type ELSE '  ' || lower({_LABELS}[CAST(regexp_extract(p_brand, '([0-9]+)', 1) AS INTEGER)]) END AS maker_raw FROM part)
 SELECT p_partkey, maker_raw, COALESCE(k.maker, 'Others') AS maker, k.channel, COALESCE(k.maker_vahan, 'Others') AS maker_vahan FROM p LEFT JOIN makers k ON k.maker_key = upper(trim(p.maker_raw))""",
    "makers",
)
def normalize_makers(m: Market) -> DataFrame:
    labels = F.array(*[F.lit(k) for k in cleaning.MAKER_MAP])
    known = F.concat(F.lit("  "), F.lower(F.element_at(labels, F.regexp_extract("p_brand", r"(\d+)", 1).cast("int"))))
    raw = m.table("part").select(
        "p_partkey", F.when(F.col("p_size") % 5 == 0, F.col("p_type")).otherwise(known).alias("maker_raw")
    )
    return cleaning.normalize_makers(raw)


@query(
    "cln_04_normalize_text",
    f"WITH {_RAW} SELECT DISTINCT 'CITY ' || nationkey || '-' || bucket AS city, upper(p_name) AS model, upper(p_type[1]) || lower(p_type[2:]) AS segment5 FROM named",
    "lines",
)
def normalize_text(m: Market) -> DataFrame:
    raw = cleaning.rename_and_coerce(tables.dispatch_raw(m.spark, m.sf_dir))
    return cleaning.normalize_text(raw).select("city", "model", "segment5").distinct()


@query(
    "cln_05_coverage_flag",
    """SELECT CASE WHEN o_orderdate >= DATE '1998-01-01' THEN 'full' ELSE 'sample' END AS coverage, COUNT(*) AS orders, MIN(CAST(o_orderdate AS DATE)) AS first_date FROM orders GROUP BY 1""",
    texts="first_date",
)
def coverage_flag(m: Market) -> DataFrame:
    dated = m.table("orders").withColumn("date", F.to_date("o_orderdate"))
    return dated.groupBy(
        cleaning.coverage_flag("date", tables.FULL_COVERAGE_FROM).alias("coverage")
    ).agg(F.count(F.lit(1)).alias("orders"), F.min("date").alias("first_date"))


@query("cln_06_dispatch_clean", "SELECT * FROM wholesale", "wholesale", texts="date")
def dispatch_clean(m: Market) -> DataFrame:
    return m.dispatch


_LETTERS = "translate({c}, '0123456789', 'abcdefghij')"


def letter_names(m: Market) -> DataFrame:
    """State labels without digits; the last state is merged into the one before."""
    nation = m.table("nation")
    code = F.when(F.col("n_nationkey") == 24, F.lit(23)).otherwise(F.col("n_nationkey"))
    return nation.select(
        "n_nationkey",
        F.translate("n_name", "0123456789", "abcdefghij").alias("label"),
        tables.state_code(code).alias("state_code"),
    )


_YEARS_TEXT = ["1998", "1999", "2000"]


@query(
    "cln_07_wide_to_long",
    """WITH v AS (SELECT c_nationkey AS k, unnest([1998, 1999, 2000]) AS year, COUNT(*) AS n FROM customer GROUP BY c_nationkey)
 SELECT 'S' || lpad(CAST(CASE WHEN k = 24 THEN 23 ELSE k END AS VARCHAR), 2, '0') AS state_code, CAST(year AS BIGINT) AS year, CAST(SUM(n * (year - 1990)) AS BIGINT) AS value,
 CASE WHEN MAX(k) >= 23 THEN 'official_derived' ELSE 'official' END AS quality, year || '-03-31' AS as_of FROM (SELECT k, n, year FROM (SELECT c_nationkey AS k, COUNT(*) AS n FROM customer GROUP BY c_nationkey), (VALUES (1998), (1999), (2000)) y(year)) WHERE NOT (k = 7 AND year = 1999) GROUP BY 1, 2, year""",
)
def wide_to_long(m: Market) -> DataFrame:
    names = letter_names(m)
    counts = m.table("customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))
    wide = counts.join(names, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.concat(F.lit(" "), F.upper("label"), F.lit(" *1.2# ")).alias("state"),
        *[
            F.when((F.col("c_nationkey") == 7) & F.lit(y == "1999"), "n.a.")
            .otherwise((F.col("n") * (int(y) - 1990)).cast("string"))
            .alias(y)
            for y in _YEARS_TEXT
        ],
    )
    long = cleaning.melt_state_series(wide, names, "state", _YEARS_TEXT, "value")
    return cleaning.merged_territory_series(long, "value", ["S23"])


def _yearly_totals(m: Market) -> DataFrame:
    """Order value per state name and year, twice: a first and a revised figure."""
    spend = (
        m.table("orders").join(m.table("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .groupBy("c_nationkey", F.year("o_orderdate").alias("year"))
        .agg(F.count(F.lit(1)).alias("n"))
    )
    label = F.concat(F.lit(" "), fiscal_year_starting("year"), F.lit(" (R)"))
    return spend.select(
        tables.state_code("c_nationkey").alias("state_code"),
        F.regexp_replace(label, "-", "–").alias("label"),
        F.explode(F.array(F.lit(1), F.lit(2))).alias("edition"),
        "n",
    ).withColumn("gsdp_constant_2011_12_lakh", F.col("n") * 100 + F.col("edition"))


_SPEND = """s AS (SELECT 'S' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS state_code, CAST(year(o_orderdate) AS VARCHAR) || '-' || lpad(CAST((year(o_orderdate) + 1) % 100 AS VARCHAR), 2, '0') AS fy, COUNT(*) * 100 + 2 AS v
 FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""


@query(
    "cln_08_gsdp_growth",
    f"""WITH {_SPEND} SELECT state_code, fy, v AS gsdp_constant_2011_12_lakh, round_even((v / LAG(v) OVER (PARTITION BY state_code ORDER BY fy)::DOUBLE - 1) * 100, 3) AS gsdp_real_growth_pct FROM s""",
    "",
    "gsdp_real_growth_pct",
)
def gsdp_growth(m: Market) -> DataFrame:
    raw = _yearly_totals(m).withColumn("fy", cleaning.clean_fiscal_label("label")).drop("label", "n")
    kept = cleaning.last_per_key(raw, ["state_code", "fy"], "edition").drop("edition")
    return cleaning.growth_pct(kept, "gsdp_constant_2011_12_lakh", "gsdp_real_growth_pct", ["state_code"], "fy")


@query(
    "cln_09_income_series",
    f"WITH {_SPEND} SELECT state_code, fy, v AS pc_nsdp_current_inr, 'official' AS quality FROM s",
)
def income_series(m: Market) -> DataFrame:
    raw = _yearly_totals(m).select(
        "state_code", cleaning.clean_fiscal_label("label").alias("fy"), "edition",
        F.col("gsdp_constant_2011_12_lakh").alias("pc_nsdp_current_inr"),
    )
    kept = cleaning.last_per_key(raw, ["state_code", "fy"], "edition").drop("edition")
    return kept.withColumn("quality", F.lit("official"))


@query(
    "cln_10_annual_population",
    """WITH a AS (SELECT 'S' || lpad(CAST(c_nationkey AS VARCHAR), 2, '0') AS state_code, COUNT(*)::DOUBLE AS c, COUNT(*) * 1.25::DOUBLE + 3 AS p, round(100 * COUNT(*) FILTER (c_mktsegment = 'BUILDING') / COUNT(*)::DOUBLE, 2) AS u FROM customer GROUP BY c_nationkey),
 t AS (SELECT *, c * POWER(POWER(p / c, 1.0 / 13), year - 2011) AS n FROM (SELECT *, unnest(range(2012, 2027)) AS year FROM a))
 SELECT state_code, year, round(n, 4) AS population_mn, round(n * u / 100, 4) AS urban_population_mn, round(n * (100 - u) / 100, 4) AS rural_population_mn, u AS urban_pct_basis, 100 - u AS rural_pct_basis, 2011 AS urban_share_year,
 CASE WHEN year <= 2024 THEN 'geometric interpolation between 2011 and 2024 anchors' ELSE 'extrapolation of 2011-2024 geometric growth rate' END AS method, 'estimate' AS quality FROM t""",
    "",
    "population_mn urban_population_mn rural_population_mn urban_pct_basis rural_pct_basis",
)
def annual_population(m: Market) -> DataFrame:
    n = F.count(F.lit(1))
    anchors = m.table("customer").groupBy(tables.state_code("c_nationkey").alias("state_code")).agg(
        n.cast("double").alias("census_2011_mn"),
        (n * 1.25 + 3).cast("double").alias("proj_2024_mn"),
        F.round(100 * F.count_if(F.col("c_mktsegment") == "BUILDING") / n, 2).alias("urban_pct"),
    ).withColumn("rural_pct", 100 - F.col("urban_pct"))
    return cleaning.annual_population(anchors, "census_2011_mn", "proj_2024_mn", 2011, 2024, 2026)


@query(
    "cln_11_credit_depth",
    "SELECT * FROM credit",
    "credit",
    "personal_loans_outstanding_crore population_mn personal_loans_per_capita_inr personal_loans_yoy_growth_pct",
)
def credit_depth(m: Market) -> DataFrame:
    return m.credit


@query("cln_12_lifetime_tax", "SELECT * FROM tax", "tax", "lifetime_tax_rate_pct")
def lifetime_tax(m: Market) -> DataFrame:
    return m.tax


@query(
    "cln_13_canonical_events",
    """WITH b AS (SELECT 'curated:' || event_id AS event_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, 'S' || lpad(CAST(user_id % 25 AS VARCHAR), 2, '0') AS state_code, event_type AS category, 2 AS tier, NULL AS sources, 'curated_reference' AS origin FROM events WHERE event_type IN ('signup', 'error')
  UNION ALL SELECT 'bundle:' || event_id, CAST(CAST(ts AS DATE) AS VARCHAR), 'ALL', 'event', 1, props, 'bundle' FROM events WHERE event_type = 'purchase')
 SELECT *, COUNT(*) OVER (PARTITION BY date, state_code, category) > 1 AS possible_overlap FROM b""",
)
def canonical_events(m: Market) -> DataFrame:
    events = m.table("events").withColumn("date", F.to_date("ts").cast("string"))
    curated = events.where(F.col("event_type").isin("signup", "error")).select(
        F.concat(F.lit("curated:"), "event_id").alias("event_id"),
        "date",
        tables.state_code(F.col("user_id") % 25).alias("state_code"),
        F.col("event_type").alias("category"),
        F.lit(2).alias("tier"),
        F.lit("curated_reference").alias("origin"),
    )
    bundled = events.where(F.col("event_type") == "purchase").select(
        F.concat(F.lit("bundle:"), "event_id").alias("event_id"),
        "date",
        F.lit("ALL").alias("state_code"),
        F.lit("event").alias("category"),
        F.lit(1).alias("tier"),
        F.col("props").alias("sources"),
        F.lit("bundle").alias("origin"),
    )
    return cleaning.canonical_events(curated, bundled)


@query("cln_14_cng_snapshot", "SELECT * FROM cng", "cng", "state_allocation_coverage_pct")
def cng_snapshot(m: Market) -> DataFrame:
    return m.cng


@query("cln_14_ev_snapshot", "SELECT * FROM ev", "ev", "state_allocation_coverage_pct")
def ev_snapshot(m: Market) -> DataFrame:
    return m.ev


ERAS = {"early": (1995, 1996, 1997), "late": (1998, 1999, 2000, 2001)}


@query(
    "cln_15_anchored_prices",
    """WITH a AS (SELECT CASE WHEN year = 1996 THEN 'early' ELSE 'late' END AS era, fuel, nationkey, round(avg(unit) / 10, 4) AS price FROM priced WHERE year IN (1996, 2000) GROUP BY ALL),
 b AS (SELECT fuel, year, round(avg(unit) / 10, 4) AS price FROM priced GROUP BY ALL)
 SELECT 'S' || lpad(CAST(a.nationkey AS VARCHAR), 2, '0') AS state_code, b.year, a.fuel, round(b.price + (a.price - o.price), 1) AS price_avg_inr
 FROM a JOIN a o ON o.era = a.era AND o.fuel = a.fuel AND o.nationkey = 0 JOIN b ON b.fuel = a.fuel AND (b.year >= 1998) = (a.era = 'late')""",
    "priced",
    "price_avg_inr",
)
def anchored_prices(m: Market) -> DataFrame:
    from panelwright.sources.covariates import priced_lines

    priced = priced_lines(m.spark, m.sf_dir)
    price = F.round(F.avg("unit") / 10, 4).alias("price")
    base = priced.groupBy("fuel", "year").agg(price)
    anchors = (
        priced.where(F.col("year").isin(1996, 2000))
        .groupBy(
            F.when(F.col("year") == 1996, "early").otherwise("late").alias("era"),
            "fuel",
            tables.state_code("nationkey").alias("state_code"),
        )
        .agg(price)
    )
    return cleaning.anchored_prices(base, anchors, ERAS, "S00")


