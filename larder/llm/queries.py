"""Registered queries of the training-data operators: each applies its operator to its whole table."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession

from larder.session import checkpoint_dir

from .decontamination import decontaminate
from .filter_audit import filter_audit
from .jaccard_join import jaccard_components
from .language_id import language_id
from .license_scan import license_scan
from .oracles import decontamination_sql, earlier_passages_sql, filter_audit_sql, jaccard_sql, substring_sql
from .periodic_runs import periodic_runs, repeat_tail
from .pii import find_pii
from .quality import quality_rules
from .shared import documents
from .substring_dedup import remove_repeats
from .suffix_runs import remove_earlier_passages
from .token_counts import token_counts
from .toxicity import toxicity
from .word_bpe import encode_digests


def tokenizer_file(name: str) -> str:
    """Place of one of the public tokenizers' files; the operators themselves take a path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of ``documents`` linked by a Jaccard similarity of 0.8 over five-word shingles."""
    return jaccard_components(documents(spark, sf_dir)).select("doc_id", "n_shingles", "component_id")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every text of ``documents``, learned from ``labels.toxic``."""
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence templates found in every text of ``documents``."""
    return license_scan(documents(spark, sf_dir))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every text of ``documents``."""
    return find_pii(documents(spark, sf_dir)).drop("part")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text of ``documents``."""
    return language_id(documents(spark, sf_dir)).drop("part")


def op6_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every text of ``documents`` with the word-end BPE vocabulary."""
    return encode_digests(documents(spark, sf_dir), tokenizer_file("word_bpe_49k.json"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, base rule and compression-band verdict of every text of ``documents``."""
    return quality_rules(documents(spark, sf_dir))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of ``benchmark`` that occur in every text of ``documents``."""
    return decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(
        "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of every text of ``documents`` through a digest cache kept for this input in the shared folder."""
    cache = f"{checkpoint_dir(spark)}/larder-llm/token-cache/{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    return token_counts(documents(spark, sf_dir), tokenizer_file("byte_bpe_50k.json"), cache)


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every text of ``documents`` that lie in a 35-word passage found elsewhere too."""
    return remove_repeats(documents(spark, sf_dir))


def op11_suffix_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of every text of ``documents`` in a 50-byte string that a document with a smaller id holds too."""
    return remove_earlier_passages(documents(spark, sf_dir))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in every text of ``documents``, a tenth of which are rewritten as repetitions first."""
    return periodic_runs(documents(spark, sf_dir), rewrite=repeat_tail)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What every order of five filters keeps, removes and hides in each source of ``documents``."""
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES = {f.__name__: f for f in (
    op1_jaccard_join, op2_toxicity, op3_license_scan, op4_pii, op5_language_id, op6_word_bpe, op7_quality_rules, op8_decontamination, op9_token_counts,
    op10_substring_dedup, op11_suffix_runs, op12_periodic_runs, op13_filter_audit)}

SQL: dict[str, str] = {
    "op1_jaccard_join": jaccard_sql(),
    "op8_decontamination": decontamination_sql(),
    "op10_substring_dedup": substring_sql(),
    "op11_suffix_runs": earlier_passages_sql(),
    "op13_filter_audit": filter_audit_sql(),
}
