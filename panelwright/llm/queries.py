"""The registered queries of this folder and their oracle texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every document."""
    from panelwright.llm.token_counts import token_counts

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts(docs, _tokenizer_file(), limit=1024).drop("text")


def op6_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    from panelwright.llm.bpe_stream import round_trip

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, _tokenizer_file()).drop("text")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines every document loses to earlier ones, and a digest of what it keeps."""
    from pyspark.sql import functions as F

    from panelwright.llm.line_dedup import dedup_lines

    out = dedup_lines(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        "n_lines",
        "n_equal",
        "n_near",
        F.concat_ws(",", F.col("removed").cast("array<string>")).alias("removed_lines"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op8_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probabilities of every document under the learned model and the additive unigram model."""
    from panelwright.llm.pitman_yor import score_documents

    return score_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and the current policy's verdict for every document."""
    from panelwright.llm import rule_ledger as rules

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    book = rules.ledger(docs).drop("text", "n_lines")
    judged = rules.apply_policy(book, rules.POLICIES["v2"], "kept").withColumn("base_failed", rules.fails(rules.POLICIES["base"]))
    first = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return judged.select(*first, *[c for c in judged.columns if c not in first])


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document by a line model learned outside the held-out fold."""
    from panelwright.llm import quality_crf

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_crf.train(docs, _read(spark, sf_dir, "labels"))
    return _judged(quality_crf.score(docs, model), 0.3)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate component of every document."""
    from panelwright.llm.ngram_join import near_duplicates

    return near_duplicates(_read(spark, sf_dir, "documents").select("doc_id", "text"))


#: The query's key; whoever replaces real data passes a secret one.
SURROGATE_KEY = "panelwright"


def op3_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entities replaced in every document, and a digest of the new text."""
    from pyspark.sql import functions as F

    from panelwright.llm.pii_surrogates import replace

    out = replace(_read(spark, sf_dir, "documents").select("doc_id", "text"), SURROGATE_KEY)
    return out.select("doc_id", "n_entities", F.concat_ws(",", "kinds").alias("kinds"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words and items found in every document."""
    from pyspark.sql import functions as F

    from panelwright.llm.decontamination import match, verdict

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    judged = verdict(match(docs, _read(spark, sf_dir, "benchmark")))
    return judged.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("item_ids")), 256).alias("items_sha256"),
        "contaminated",
    )


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document by a classifier learned outside the held-out fold."""
    from panelwright.llm import toxicity

    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    return _judged(toxicity.score(docs, model), 0.5)


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    from panelwright.llm.lexical_index import search

    return search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"), k=50)


def op12_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of 16 shards with equal texts together."""
    from panelwright.llm.balanced_shards import shard_documents

    return shard_documents(_read(spark, sf_dir, "documents"), shards=16, law="rows")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector, labels of every seventh moved on by one."""
    from pyspark.sql import functions as F

    from panelwright.llm.hard_negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(_read(spark, sf_dir, "embeddings"), F.col("id") % 100 == 0, label=label).drop("positive_rank")


def _judged(scored: DataFrame, threshold: float) -> DataFrame:
    from pyspark.sql import functions as F

    from panelwright.llm.labelled import fold

    return scored.select(
        "doc_id",
        (fold("doc_id") == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages of the corpus pipeline over all documents."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_crf": op1_quality_crf,
        "op2_ngram_join": op2_ngram_join,
        "op3_pii_surrogates": op3_pii_surrogates,
        "op4_decontamination": op4_decontamination,
        "op5_token_counts": op5_token_counts,
        "op6_bpe_round_trip": op6_bpe_round_trip,
        "op7_line_dedup": op7_line_dedup,
        "op8_pitman_yor": op8_pitman_yor,
        "op9_quality_rules": op9_quality_rules,
        "op10_toxicity": op10_toxicity,
        "op11_lexical_search": op11_lexical_search,
        "op12_balanced_shards": op12_balanced_shards,
        "op13_hard_negatives": op13_hard_negatives,
        "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    from panelwright.llm import sql

    return {
        "op4_decontamination": sql.DECONTAMINATION,
        "op7_line_dedup": sql.LINE_DEDUP,
        "op9_quality_rules": sql.QUALITY_RULES,
        "op11_lexical_search": sql.LEXICAL_SEARCH,
        "op13_hard_negatives": sql.HARD_NEGATIVES,
    }
