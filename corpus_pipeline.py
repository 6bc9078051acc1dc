"""The corpus pipeline: five stages, each written as a table and read by the next.

1. toxicity: documents whose score reaches 0.5 go.
2. line_dedup: lines that are alike to an earlier line of the corpus go, and
   documents that lose all their lines with words.
3. ngram_join: of each group of near duplicates the smallest id stays.
4. decontamination: documents of which a twentieth or more stands in benchmark
   items go, and of the others the stretches as long as a window.
5. bpe_round_trip: number of tokens and digests of ids and decoded text.

All stages but the last return the columns of ``documents`` (n_chars follows the
text where lines or stretches went).  Rows with null ids or texts pass through; empty tables
give empty tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelwright.llm import bpe_stream, decontamination, line_dedup, ngram_join, toxicity
from panelwright.session import shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; it learns from the labelled rows among them."""
    return toxicity.reject_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that the corpus has before; those left without a line with words go."""
    out = line_dedup.dedup_lines(docs)
    out = out.where((F.size("removed") == 0) | (F.size("removed") < F.col("n_lines")))
    if "n_chars" in docs.columns:
        shorter = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.size("removed") > 0, shorter).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return ngram_join.keep_one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, without the benchmark spans that they hold."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    out = decontamination.remove_spans(decontamination.match(docs, items))
    if "n_chars" in docs.columns:
        cut = F.exists("hit_spans", lambda s: s["end"] - s["begin"] >= decontamination.WINDOW)
        shorter = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(cut, shorter).otherwise(F.col("n_chars")))
    return out.select(*[f"`{c}`" for c in docs.columns])


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of what is left, and the digest of their decoded text."""
    import public_tokenizers

    return bpe_stream.round_trip(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")).drop("text")


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("decontamination", decontamination_stage),
    ("bpe_round_trip", bpe_stage),
]

#: The first stage is a trained classifier, which SQL cannot state; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each stage's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{shared_folder(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
