"""Ordered sums over groups of any size.

A plain ordered window puts a whole group into one task.  Here every group is
first collapsed to its distinct values (map-side combined).  All rows are cut
into ranges of the group and its order, as many as the counted rows ask for, so
a small group shares a range with others and a hot one is cut as finely as its
own size demands.  The window runs inside one range; the offset of a range is
the total of the group's ranges below it.  The result is exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelwright.session import cut_lineage

#: Rows of one range, about: Spark finds the ranges' ends from a sample of each partition.
RANGE_ROWS = 200_000


def same_keys_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on keys that may be null: null meets null, and the keys come from the left side."""
    renamed = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    on = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_right_{k}")) for k in keys])
    return left.join(renamed, on, how).drop(*[f"_right_{k}" for k in keys])


def ranged(df: DataFrame, keys: Sequence[str], order: str, rows: int = RANGE_ROWS) -> DataFrame:
    """The frame as a written table with the number of each row's range (``_bucket``), ascending with (keys, order)."""
    df = cut_lineage(df)
    parts = -(-df.count() // rows)
    if parts <= 1:
        return df.withColumn("_bucket", F.lit(0))
    return cut_lineage(df.repartitionByRange(parts, *keys, order).withColumn("_bucket", F.spark_partition_id()))


def numbered(df: DataFrame, order: Sequence[str], out: str, at: Sequence[int] | None = None, rows: int = RANGE_ROWS) -> DataFrame:
    """Position of each row (from 0) in the order of all rows; with ``at``, only the rows at those positions.

    Rows are cut into ranges of the whole order, which their first column alone
    need not tell apart; ranges are counted, and only those that hold a wanted
    position are sorted.  Rows that are equal in the order are numbered as they
    come.
    """
    cut = ranged(df, list(order[:-1]), order[-1], rows)
    counts = cut.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(1))
    below = Window.partitionBy("_all").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("_bucket", "_n", F.coalesce(F.sum("_n").over(below), F.lit(0)).alias("_before"))
    if at is not None:
        wanted = F.array(*[F.lit(int(p)) for p in at]) if at else F.array().cast("array<int>")
        offsets = offsets.where(F.exists(wanted, lambda p: (p >= F.col("_before")) & (p < F.col("_before") + F.col("_n"))))
    inside = Window.partitionBy("_bucket").orderBy(*order)
    placed = cut.join(offsets, "_bucket").withColumn(out, F.col("_before") + F.row_number().over(inside) - 1).drop("_bucket", "_n", "_before")
    return placed if at is None else placed.where(F.col(out).isin([int(p) for p in at]))


def prefix_sums(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    sums: dict[str, str],
    rows: int = RANGE_ROWS,
) -> DataFrame:
    """Running sums in ascending ``order`` (unique per group), inclusive.

    ``sums`` maps an output column to the summed input column; ``keys`` holds at
    least one column (a constant one for a single group).
    """
    keys = list(keys)
    cut = ranged(df, keys, order, rows)
    totals = cut.groupBy(*keys, "_bucket").agg(
        *[F.sum(source).alias(f"_t_{out}") for out, source in sums.items()]
    )
    below = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *keys,
        "_bucket",
        *[F.coalesce(F.sum(f"_t_{out}").over(below), F.lit(0)).alias(f"_o_{out}") for out in sums],
    )
    inside = (
        Window.partitionBy(*keys, "_bucket")
        .orderBy(order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    running = cut.select(
        "*", *[F.sum(source).over(inside).alias(f"_r_{out}") for out, source in sums.items()]
    )
    joined = same_keys_join(running, offsets, [*keys, "_bucket"])
    return joined.select(
        *df.columns, *[(F.col(f"_r_{out}") + F.col(f"_o_{out}")).alias(out) for out in sums]
    )


def average_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """(keys, value, rank): one row per distinct value with its tie-averaged rank."""
    counted = (
        df.where(F.col(value).isNotNull())
        .groupBy(*keys, value)
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    running = prefix_sums(counted, keys, value, {"_upto": "_n"})
    return running.select(
        *keys, value, (F.col("_upto") - (F.col("_n") - 1) / F.lit(2.0)).cast("double").alias("rank")
    )


def hash_positions(
    df: DataFrame, keys: Sequence[str], value: Column, tie: str, out: str, buckets: int
) -> DataFrame:
    """Position of each row in the order of a 64-bit hash, within its group, from 1.

    The hash is uniform, so equal hash ranges hold about equally many rows: rows
    are numbered inside a range and ranges are offset by their counts.
    """
    low = F.lit(float(2**63))
    part = F.least(
        F.floor((F.col("_h").cast("double") + low) / float(2**64) * buckets), F.lit(buckets - 1)
    )
    placed = df.withColumn("_h", value).withColumn("_part", part)
    counts = placed.groupBy(*keys, "_part").agg(F.count(F.lit(1)).alias("_c"))
    below = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(
        *keys, "_part", F.coalesce(F.sum("_c").over(below), F.lit(0)).alias("_before")
    )
    inside = Window.partitionBy(*keys, "_part").orderBy("_h", tie)
    return (
        same_keys_join(placed.withColumn("_k", F.row_number().over(inside)), offsets, [*keys, "_part"])
        .withColumn(out, F.col("_before") + F.col("_k"))
        .drop("_h", "_part", "_k", "_before")
    )
