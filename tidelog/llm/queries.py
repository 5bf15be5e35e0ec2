"""The registered queries of this subpackage and the SQL that some can be held against."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup as ed
from . import merkle
from . import ngram_join as nj
from . import resampling
from . import substring_dedup as sd
from .common import documents
from .fingerprints import fingerprints
from .language_id import language_id
from .packing import pack
from .piece_codec import piece_codec
from .quality import quality_scores
from .suffix_lm import suffix_lm
from .token_output import token_output
from .toxicity import toxicity

#: Parameters: the tokenizer files.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(documents(spark, sf_dir), WORD_BPE)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ed.exact_dedup(documents(spark, sf_dir))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sd.substring_dedup(documents(spark, sf_dir))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(documents(spark, sf_dir))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nj.ngram_join(documents(spark, sf_dir))


def op6_suffix_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_lm(documents(spark, sf_dir))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_codec(documents(spark, sf_dir), PIECES)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), WORD_BPE)


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(documents(spark, sf_dir))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(documents(spark, sf_dir))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.importance_resampling(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_token_output, op2_exact_dedup, op3_substring_dedup, op4_fingerprints, op5_ngram_join, op6_suffix_lm, op7_quality, op8_piece_codec, op9_packing, op10_language_id, op11_toxicity, op12_merkle_manifest, op13_importance_resampling)}


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": ed.ORACLE_SQL, "op3_substring_dedup": sd.ORACLE_SQL, "op5_ngram_join": nj.ORACLE_SQL, "op12_merkle_manifest": merkle.ORACLE_SQL, "op13_importance_resampling": resampling.ORACLE_SQL}
