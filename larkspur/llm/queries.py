"""The registered queries of this folder and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import oracles
from .common import table
from .jaccard import jaccard_components
from .mixing import mix
from .ngrams import score_documents as language_model_scores
from .packing import pack
from .quality import quality_rules
from .separators import token_counts
from .sharding import shard_rows
from .suffixes import suffix_dedup
from .topk import top_k
from .toxicity import score_documents


def word_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_rules(table(spark, sf_dir, "documents"))
    return scored.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 20 = 0"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), word_tokenizer())


def op7_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), n=4, num=85, den=100)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), word_tokenizer())


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model_scores(table(spark, sf_dir, "documents"), order=3)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_suffix_dedup, op2_quality_rules, op3_exact_top_k, op4_toxicity, op5_sharding, op6_token_counts, op7_ngram_jaccard, op8_mixing, op9_best_fit_packing, op10_lm_scoring)}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_suffix_dedup": oracles.suffix_dedup(),
        "op2_quality_rules": oracles.quality_rules(),
        "op3_exact_top_k": oracles.exact_top_k(),
        "op7_ngram_jaccard": oracles.ngram_jaccard(),
    }
