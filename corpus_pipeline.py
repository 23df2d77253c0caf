"""Corpus pipeline: documents to encoded training text, in five stages.

Each stage is one of the operators of ``larder.llm``; ``run`` writes every stage's rows to the shared folder and hands the
table that it reads back to the next, so a lost executor never costs more than the stage at hand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from larder.llm.decontamination import uncontaminated
from larder.llm.jaccard_join import one_of_each
from larder.llm.language_id import known_language
from larder.llm.pii import redact
from larder.llm.queries import tokenizer_file
from larder.llm.shared import documents, stored
from larder.llm.word_bpe import encode_digests


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that can be told."""
    return known_language(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and secrets replaced by their kind."""
    return redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded text of every document."""
    return encode_digests(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("language id", language),
    ("jaccard join", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("word bpe", encode),
]

#: Learned stages and BPE have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
