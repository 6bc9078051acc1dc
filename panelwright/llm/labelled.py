"""Bounded samples of labelled rows, and fits that run in one task."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.text import release


def fold(id_col: str, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as an empty text."""
    return F.crc32(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))) % folds


def training_sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", held_out: int = 0) -> DataFrame:
    """(label, text) of at most ``per_class`` rows of each label 0 and 1 outside the held-out fold.

    The rows are those whose ids have the smallest hashes, so they do not depend
    on partitions.  Labels other than 0 and 1 and null ids are left out; of
    several labels of one id the largest counts.
    """
    known = (
        labels.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{label_col}`").cast("int").alias("_label"))
        .where(F.col("_label").isin(0, 1) & F.col("_id").isNotNull() & (fold("_id") != held_out))
        .groupBy("_id")
        .agg(F.max("_label").alias("_label"))
    )
    order = [F.xxhash64("_id"), F.col("_id")]
    chosen = [known.where(F.col("_label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    texts = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    return texts.join(chosen[0].union(chosen[1]), "_id").select(F.col("_label").alias("label"), "text")


def fit(sample: DataFrame, learn: Callable[[list[pa.RecordBatch]], object]) -> object:
    """Runs ``learn`` on a bounded sample in one task and brings its small result to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = pickle.dumps(learn([b for b in batches if b.num_rows]))
        release()
        yield pa.RecordBatch.from_pydict({"model": pa.array([made], pa.binary())})

    return pickle.loads(sample.repartition(1).mapInArrow(run, "model binary").first().model)
