"""Cleaning of dispatch records and building of reference tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.functions.columns import ratio

# Source maker label -> (clean maker, channel).
MAKER_MAP: dict[str, tuple[str, str | None]] = {
    "ARENA": ("Maruti Suzuki", "Arena"),
    "NEXA": ("Maruti Suzuki", "Nexa"),
    "MARUTI": ("Maruti Suzuki", None),
    "TATA": ("Tata Motors", None),
    "HYUNDAI": ("Hyundai", None),
    "MAHINDRA": ("Mahindra", None),
    "KIA": ("Kia", None),
    "TOYOTA": ("Toyota", None),
    "HONDA": ("Honda Cars", None),
    "MG": ("MG Motor", None),
    "RENAULT": ("Renault", None),
    "VW": ("VW", None),
    "SKODA": ("Skoda", None),
    "NISSAN": ("Nissan", None),
    "DATSUN": ("Nissan", None),
    "CITROEN": ("Citroen", None),
    "PCA": ("Citroen", None),
    "FIAT": ("Fiat", None),
    "FORD": ("Ford", None),
    "FORCE": ("Force", None),
    "ISUZU": ("Isuzu", None),
    "GM": ("Chevy", None),
    "HM": ("Others", None),
    "MITSUBISHI": ("Others", None),
    "OTHER": ("Others", None),
}

# Clean makers whose registration label differs from the clean label.
REGISTRATION_MAKER = {"Skoda": "Volkswagen Group", "Citroen": "Stellantis", "Fiat": "Stellantis"}

# Raw column -> clean column.
RAW_COLUMNS = {
    "Financial Year": "fy",
    "Month": "month_serial",
    "CBH": "zone",
    "New RO": "ro",
    "City": "city",
    "city group": "city_group",
    "mdl": "model",
    "maker": "maker_raw",
    "SumOfQty": "qty",
    "Seg-3": "segment3",
    "Seg-5": "segment5",
}

CLEAN_COLUMNS = [
    "fy", "year", "month", "date", "zone", "ro", "city", "state_code", "maker", "maker_vahan",
    "channel", "model", "segment3", "segment5", "fuel_variants", "primary_fuel", "ev_only",
    "coverage", "qty",
]


def rename_and_coerce(raw: DataFrame) -> DataFrame:
    """Clean names; quantities that are not numbers and missing months drop the row."""
    named = raw.withColumnsRenamed(RAW_COLUMNS)
    return (
        named.withColumn("qty", F.col("qty").try_cast("double"))
        .withColumn("month_serial", F.col("month_serial").try_cast("int"))
        .dropna(subset=["qty", "month_serial"])
        .withColumn("qty", F.col("qty").cast("bigint"))
    )


def serial_to_date(serial: str | Column) -> Column:
    """Spreadsheet day number (epoch 1899-12-30) to date."""
    s = F.col(serial) if isinstance(serial, str) else serial
    return F.date_add(F.lit("1899-12-30").cast("date"), s.cast("int"))


def with_dates(df: DataFrame, serial: str = "month_serial") -> DataFrame:
    return (
        df.withColumn("date", serial_to_date(serial))
        .withColumn("year", F.year("date"))
        .withColumn("month", F.month("date"))
    )


def maker_entry(label: str | Column) -> Column:
    """(maker, channel, maker_vahan) of a raw label as one struct; null when unknown.

    The fixed table is a literal map, so labelling never shuffles the records.
    """
    c = F.col(label) if isinstance(label, str) else label
    entries: list[Column] = []
    for key, (maker, channel) in MAKER_MAP.items():
        entries += [
            F.lit(key),
            F.struct(
                F.lit(maker).alias("maker"),
                F.lit(channel).cast("string").alias("channel"),
                F.lit(REGISTRATION_MAKER.get(maker, maker)).alias("maker_vahan"),
            ),
        ]
    return F.try_element_at(F.create_map(*entries), F.upper(F.trim(c)))


def normalize_makers(df: DataFrame, raw: str = "maker_raw") -> DataFrame:
    """Adds maker, channel, maker_vahan; unknown labels become Others."""
    return (
        df.withColumn("_entry", maker_entry(raw))
        .withColumn("maker", F.coalesce("_entry.maker", F.lit("Others")))
        .withColumn("channel", F.col("_entry.channel"))
        .withColumn("maker_vahan", F.coalesce("_entry.maker_vahan", F.lit("Others")))
        .drop("_entry")
    )


def normalize_text(df: DataFrame) -> DataFrame:
    return (
        df.withColumn("city", F.upper(F.trim("city")))
        .withColumn("model", F.upper(F.trim("model")))
        .withColumn("segment5", F.initcap(F.trim("segment5")))
    )


def coverage_flag(date: str | Column = "date", full_from: str = "2022-04-01") -> Column:
    d = F.col(date) if isinstance(date, str) else date
    return F.when(d >= F.lit(full_from).cast("date"), "full").otherwise("sample")


def attach_maps(df: DataFrame, city_state: DataFrame, model_fuel: DataFrame) -> DataFrame:
    """State of the city and nameplate attributes of the model; unmapped rows stay."""
    attributes = model_fuel.select("model", "fuel_variants", "primary_fuel", "ev_only")
    return (
        df.join(city_state.select("city", "state_code"), "city", "left")
        .join(attributes, "model", "left")
        .withColumn("ev_only", F.coalesce("ev_only", F.lit(0)).cast("bigint"))
    )


def clean(
    raw: DataFrame, city_state: DataFrame, model_fuel: DataFrame, full_from: str = "2022-04-01"
) -> DataFrame:
    """Raw dispatch records to the 19-column dispatch fact table."""
    dated = with_dates(rename_and_coerce(raw))
    tidy = normalize_text(normalize_makers(dated)).withColumn(
        "coverage", coverage_flag("date", full_from)
    )
    return attach_maps(tidy, city_state, model_fuel).select(*CLEAN_COLUMNS)


# --------------------------------------------------------------- reference series


def clean_label(label: str | Column) -> Column:
    """Lower-case label without trailing footnote marks, digits and dots."""
    c = F.col(label) if isinstance(label, str) else label
    return F.trim(F.regexp_replace(F.lower(F.trim(c)), r"[@*#\d.\s]+$", ""))


def clean_fiscal_label(label: str | Column) -> Column:
    """YYYY-YY from labels like '2011-12 (base)'; null when absent."""
    c = F.col(label) if isinstance(label, str) else label
    text = F.regexp_extract(F.regexp_replace(F.trim(c), "–", "-"), r"^(\d{4}-\d{2})", 1)
    return F.when(text != "", text)


def melt_state_series(
    wide: DataFrame, names: DataFrame, label: str, years: Sequence[str], value: str
) -> DataFrame:
    """Wide year columns to (state_code, year, value), one row per source row and year.

    ``names`` maps a cleaned ``label`` to ``state_code``; unknown labels drop out.
    """
    long = wide.withColumn("_label", clean_label(label)).unpivot(
        ["_label"], list(years), "_year", "_value"
    )
    known = names.select(clean_label("label").alias("_label"), "state_code")
    return (
        long.join(known, "_label")
        .withColumn("year", F.col("_year").try_cast("int"))
        .withColumn(value, F.bround(F.col("_value").try_cast("double"), 0).cast("bigint"))
        .dropna(subset=[value, "year"])
        .select("state_code", "year", value)
    )


def merged_territory_series(long: DataFrame, value: str, merged: Sequence[str]) -> DataFrame:
    """Sum of source rows per state-year; merged territories carry a derived quality."""
    derived = F.col("state_code").isin(list(merged))
    return long.groupBy("state_code", "year").agg(
        F.sum(value).alias(value),
        F.max(
            F.when(derived, "official_derived").otherwise("official")
        ).alias("quality"),
        F.max(F.concat(F.col("year").cast("string"), F.lit("-03-31"))).alias("as_of"),
    )


def last_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Keeps the row with the largest ``order`` per key (partial aggregation, no sort)."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.col(order)).alias("_row"))
        .select(*keys, "_row.*")
    )


def growth_pct(df: DataFrame, value: str, out: str, keys: Sequence[str], order: str) -> DataFrame:
    """Percent change to the previous row, rounded to three digits."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn(out, F.bround((ratio(value, F.lag(value).over(w)) - 1) * 100, 3))


def annual_population(
    anchors: DataFrame,
    first: str,
    last: str,
    first_year: int,
    last_year: int,
    until: int,
) -> DataFrame:
    """Geometric interpolation between two anchors, extended at the same rate.

    ``anchors`` has state_code, the two anchor columns, urban_pct and rural_pct.
    """
    factor = F.pow(ratio(last, first), F.lit(1.0 / (last_year - first_year)))
    people = F.col(first) * F.pow(factor, F.col("year") - first_year)
    years = F.explode(F.sequence(F.lit(first_year + 1), F.lit(until))).alias("year")
    grown = anchors.select("*", years).withColumn("_people", people)
    return grown.select(
        "state_code",
        "year",
        F.round("_people", 4).alias("population_mn"),
        F.round(F.col("_people") * F.col("urban_pct") / 100, 4).alias("urban_population_mn"),
        F.round(F.col("_people") * F.col("rural_pct") / 100, 4).alias("rural_population_mn"),
        F.col("urban_pct").alias("urban_pct_basis"),
        F.col("rural_pct").alias("rural_pct_basis"),
        F.lit(first_year).alias("urban_share_year"),
        F.when(
            F.col("year") <= last_year,
            f"geometric interpolation between {first_year} and {last_year} anchors",
        )
        .otherwise(f"extrapolation of {first_year}-{last_year} geometric growth rate")
        .alias("method"),
        F.lit("estimate").alias("quality"),
    )


def credit_depth(loans: DataFrame, population: DataFrame) -> DataFrame:
    """Outstanding loans per head (crore x 10 / million) and yearly growth."""
    joined = loans.join(
        population.select("state_code", "year", "population_mn"), ["state_code", "year"]
    ).withColumn(
        "personal_loans_per_capita_inr",
        F.round(ratio(F.col("personal_loans_outstanding_crore") * 10, "population_mn"), 2),
    )
    w = Window.partitionBy("state_code").orderBy("year")
    level = F.col("personal_loans_outstanding_crore")
    return joined.withColumn(
        "personal_loans_yoy_growth_pct",
        F.round((ratio(level, F.lag(level).over(w)) - 1) * 100, 3),
    )


def lifetime_tax(rates: DataFrame, fuels: Sequence[str], ev_fuel: str = "EV") -> DataFrame:
    """One row per state and fuel; EVs use the state's EV rate."""
    is_ev = F.col("fuel") == ev_fuel
    return rates.select("*", F.explode(F.array(*[F.lit(f) for f in fuels])).alias("fuel")).select(
        "state_code",
        "fuel",
        F.when(is_ev, F.col("ev_rate_pct")).otherwise(F.col("rate_pct")).alias("lifetime_tax_rate_pct"),
        F.when(is_ev, "state EV rate").otherwise("general rate").alias("method"),
        "as_of",
    )


def canonical_events(curated: DataFrame, bundled: DataFrame) -> DataFrame:
    """Union of two event schemas with a flag for rows that share date, state and category."""
    both = curated.unionByName(bundled, allowMissingColumns=True)
    key = ["date", "state_code", "category"]
    repeated = both.groupBy(*key).agg((F.count(F.lit(1)) > 1).alias("possible_overlap"))
    return both.join(repeated, key, "left")


def sparse_snapshot(
    df: DataFrame,
    value: str,
    snapshot_dates: dict[int, str],
    scopes: dict[int, str],
    keep_scoped: bool = True,
) -> DataFrame:
    """Snapshot date and scope by year, and how much of the national row the states cover."""
    states = F.sum(F.when(F.col("state_code") != "ALL", F.col(value)))
    national = F.max(F.when(F.col("state_code") == "ALL", F.col(value)))
    coverage = df.groupBy("year").agg(
        F.round(ratio(states, national) * 100, 2).alias("state_allocation_coverage_pct")
    )

    def by_year(values: dict[int, str]) -> Column:
        out = F.lit(None).cast("string")
        for year, text in values.items():
            out = F.when(F.col("year") == year, text).otherwise(out)
        return out

    return df.join(coverage, "year", "left").select(
        *df.columns,
        by_year(snapshot_dates).alias("snapshot_date"),
        F.when(F.col("state_code") == "ALL", "national").otherwise(by_year(scopes)).alias(
            "coverage_scope"
        ),
        "state_allocation_coverage_pct",
    )


def anchored_prices(
    base: DataFrame, anchors: DataFrame, eras: dict[str, Sequence[int]], base_city: str
) -> DataFrame:
    """State prices = base-city annual series + the state's differential of the anchor era.

    ``base`` (fuel, year, price), ``anchors`` (era, fuel, state_code, price) with the
    base city as one of the codes.
    """
    own = anchors.where(F.col("state_code") == base_city).select(
        "era", "fuel", F.col("price").alias("_base_price")
    )
    years = F.lit(None).cast("array<int>")
    for era, span in eras.items():
        years = F.when(F.col("era") == era, F.array(*[F.lit(y) for y in span])).otherwise(years)
    differential = (
        anchors.join(own, ["era", "fuel"])
        .withColumn("differential", F.col("price") - F.col("_base_price"))
        .select("fuel", "state_code", "differential", F.explode(years).alias("year"))
    )
    return differential.join(base, ["fuel", "year"]).select(
        "state_code",
        "year",
        "fuel",
        F.round(F.col("price") + F.col("differential"), 1).alias("price_avg_inr"),
    )
