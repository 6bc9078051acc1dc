"""Reference tables: comment-aware CSV, validation, catalogue, availability, run results."""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Columns and enumerations of the reference catalogue.
CATALOG_COLUMNS = (
    "dataset", "file", "status", "geography", "time_coverage", "temporal_type", "quality_summary",
    "approved_use", "not_available", "app_behavior", "source_url",
)
VALID_STATUSES = ("usable", "constrained", "unavailable")
VALID_APP_BEHAVIORS = ("show", "warn", "hide")
STATE_COLUMNS = ("state_code", "state_name", "geojson_name", "zone", "is_ut")


def read_reference_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with a header and ``#`` comment lines; give a schema to skip inference."""
    reader = spark.read.option("header", True).option("comment", "#")
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return reader.csv(path)


def named_offenders(rows: DataFrame, shown: int = 20) -> str:
    """The first rows of a list of offenders and how many there are in all; empty without any."""
    first = rows.orderBy(*rows.columns).limit(shown).collect()
    if not first:
        return ""
    names = ", ".join(str(r[0] if len(r) == 1 else tuple(r)) for r in first)
    return names if len(first) < shown else f"{names} ({rows.count()} in all)"


def check_states(states: DataFrame) -> DataFrame:
    missing = sorted(set(STATE_COLUMNS) - set(states.columns))
    if missing:
        raise ValueError(f"state dimension misses columns: {missing}")
    doubled = states.groupBy("state_code").count().where("count > 1").select("state_code")
    if offenders := named_offenders(doubled):
        raise ValueError(f"duplicate state codes: {offenders}")
    return states


def check_codes(name: str, df: DataFrame, states: DataFrame) -> DataFrame:
    """Raises on state codes the dimension does not hold."""
    if "state_code" in df.columns:
        bad = (
            df.where(F.col("state_code").isNotNull())
            .join(states.select("state_code"), "state_code", "left_anti")
            .select("state_code").distinct()
        )
        if offenders := named_offenders(bad):
            raise ValueError(f"{name}: unknown state codes {offenders}")
    return df


def load_reference_tables(states: DataFrame, frames: dict[str, DataFrame], register: bool = False) -> DataFrame:
    """Checked reference tables with their row counts; optionally registered as views."""
    check_states(states)
    named = {"dim_state": states}
    for stem, frame in sorted(frames.items()):
        named[f"ref_{stem}"] = check_codes(stem, frame, states)
    counts = []
    for name, frame in named.items():
        if register:
            frame.createOrReplaceTempView(name)
        counts.append(frame.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows"))
    return reduce(lambda a, b: a.unionByName(b), counts)


def catalog_problems(catalog: DataFrame, files: DataFrame) -> DataFrame:
    """(problem, item) rows: bad enumerations, duplicates and files without a partner."""
    missing = sorted(set(CATALOG_COLUMNS) - set(catalog.columns))
    if missing:
        raise ValueError(f"catalogue misses columns: {missing}")

    def problem(text: str, rows: DataFrame, item: str) -> DataFrame:
        return rows.select(F.lit(text).alias("problem"), F.col(item).cast("string").alias("item"))

    def doubled(c: str) -> DataFrame:
        return catalog.groupBy(c).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1)

    declared = catalog.select("file", F.lit(True).alias("_declared"))
    actual = files.where(F.col("file") != "reference_catalog.csv").select("file", F.lit(True).alias("_actual"))
    sets = declared.join(actual, "file", "full_outer")
    return reduce(
        lambda a, b: a.unionByName(b),
        [
            problem("invalid status", catalog.where(~F.col("status").isin(*VALID_STATUSES)), "dataset"),
            problem("invalid behaviour", catalog.where(~F.col("app_behavior").isin(*VALID_APP_BEHAVIORS)), "dataset"),
            problem("duplicate dataset", doubled("dataset"), "dataset"),
            problem("duplicate file", doubled("file"), "file"),
            problem("missing entry", sets.where(F.col("_declared").isNull()), "file"),
            problem("missing file", sets.where(F.col("_actual").isNull()), "file"),
        ],
    )


def validate_reference_catalog(catalog: DataFrame, files: DataFrame) -> DataFrame:
    if offenders := named_offenders(catalog_problems(catalog, files)):
        raise ValueError(f"catalogue problems: {offenders}")
    return catalog


def availability(frames: dict[str, DataFrame]) -> DataFrame:
    """Rows, columns, state codes and quality labels of every dataset."""
    rows = []
    for name, frame in frames.items():
        codes = F.count_distinct("state_code") if "state_code" in frame.columns else F.lit(None).cast("bigint")
        quality = (
            F.array_join(F.array_sort(F.collect_set(F.col("quality").cast("string"))), ", ")
            if "quality" in frame.columns
            else F.lit("")
        )
        rows.append(
            frame.agg(
                F.count(F.lit(1)).alias("row_count"),
                codes.alias("state_codes_present"),
                quality.alias("quality_values"),
            ).select(
                F.lit(name).alias("dataset"),
                "row_count",
                F.lit(len(frame.columns)).alias("column_count"),
                "state_codes_present",
                "quality_values",
            )
        )
    return reduce(lambda a, b: a.unionByName(b), rows)


def folder_files(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """File names of a folder, from the file listing alone."""
    listed = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option(
        "recursiveFileLookup", True
    ).load(folder)
    return listed.select(F.element_at(F.split("path", "/"), -1).alias("file")).distinct()


def cached_table(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The parquet table at ``path``, built and written first when it is not there."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# ------------------------------------------------------------------------ run results


def save_run(
    folder: str, experiment: str, run_id: str, tables: dict[str, DataFrame], metrics: dict[str, DataFrame]
) -> None:
    """Result tables as parquet and one manifest with the metrics of a run."""
    base = f"{folder}/{experiment}/{run_id}"
    for name, frame in tables.items():
        frame.write.mode("overwrite").parquet(f"{base}/{name}.parquet")
    long = reduce(
        lambda a, b: a.unionByName(b),
        [df.select(F.lit(k).alias("k"), df[df.columns[0]].cast("double").alias("v")) for k, df in metrics.items()],
    )
    manifest = long.agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("metrics")).select(
        F.lit(experiment).alias("experiment"), F.lit(run_id).alias("run_id"), "metrics",
        F.lit(json.dumps(sorted(tables))).alias("artifacts"),
    )
    manifest.write.mode("overwrite").json(f"{base}/manifest")


def discover_runs(spark: SparkSession, folder: str) -> DataFrame:
    """All run manifests, newest first."""
    schema = "experiment string, run_id string, metrics map<string,double>, artifacts string"
    return spark.read.schema(schema).json(f"{folder}/*/*/manifest").orderBy(F.desc("run_id"), "experiment")


def latest_runs(runs: DataFrame) -> DataFrame:
    rest = [c for c in runs.columns if c != "experiment"]
    return runs.groupBy("experiment").agg(
        F.max_by(F.struct(*rest), F.col("run_id")).alias("_r")
    ).select("experiment", "_r.*")


def compare_runs(runs: DataFrame, a: str, b: str) -> DataFrame:
    """Two runs side by side on the union of their metrics."""
    long = runs.select("run_id", F.explode("metrics").alias("metric", "value"))

    def side(run: str, name: str) -> DataFrame:
        return long.where(F.col("run_id") == run).select("metric", F.col("value").alias(name))

    return side(a, "run_a").join(side(b, "run_b"), "metric", "full_outer")


