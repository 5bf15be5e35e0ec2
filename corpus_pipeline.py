"""The training-corpus pipeline: language ID, exact dedup, n-gram join, substring dedup, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidelog.llm.common import documents, stored
from tidelog.llm.exact_dedup import exact_dedup_filter
from tidelog.llm.language_id import language_filter
from tidelog.llm.ngram_join import ngram_filter
from tidelog.llm.packing import pack
from tidelog.llm.queries import WORD_BPE
from tidelog.llm.substring_dedup import substring_filter


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_filter(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup_filter(docs)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_filter(docs)


def without_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_filter(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs, WORD_BPE)


STAGES = [
    ("language_id", in_a_language),
    ("exact_dedup", without_copies),
    ("ngram_join", without_near_copies),
    ("substring_dedup", without_repeated_passages),
    ("packing", packed),
]

#: Language vectors, tokenizer ids and bins are beyond SQL; tests hold the run against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
