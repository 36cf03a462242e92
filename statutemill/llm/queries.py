"""One query for each operator over its whole table, with production parameters; the pipeline is in corpus_pipeline.py."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import byte_bpe, divergence, fill_middle, match_language, mixing, pitman_yor, quality_rules, simhash, suffix_dedup, super_kmers, token_files, topk_search, url_filter, word_bpe
from .common import new_path
from .sql import ORACLES


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str) -> str:
    """Where a public tokenizer's file is; its package is installed wherever tasks run."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by")


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_table(spark, sf_dir, "pages"))


def op3_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_bpe.digests(_table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op4_pitman_yor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score(_table(spark, sf_dir, "documents"))


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = topk_search.quantised(_table(spark, sf_dir, "embeddings"), 256)
    return topk_search.top_k(rows.where("id % 50 = 0"), rows, 5)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op7_super_kmers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return super_kmers.remove_repeats(_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(_table(spark, sf_dir, "documents"), passage=suffix_dedup.PASSAGE)


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.json")
    ordered = token_files.in_order(_table(spark, sf_dir, "documents"))
    files = token_files.write(ordered, new_path(spark, "token-ids"), lambda: byte_bpe.byte_bpe(path).encode)
    return token_files.read_documents(files)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op11_match_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_language.predict(_table(spark, sf_dir, "documents")).drop("bits")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(_table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules, op2_url_filter, op3_word_bpe, op4_pitman_yor, op5_topk_search, op6_mixing, op7_super_kmers, op8_suffix_dedup, op9_token_files, op10_simhash,
        op11_match_language, op12_fill_middle, op13_source_divergence,
    )
}

__all__ = ["ORACLES", "QUERIES", "vocabulary"]
