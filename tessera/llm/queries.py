"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import align, bpe, chat, collocations, fingerprint, linededup, lm, minhash, mixing, pii, quality, secrets, substrings
from tessera.llm.common import documents


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.query(documents(spark, sf_dir))


def quality_ablations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.ablation_query(documents(spark, sf_dir))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.query(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.query(documents(spark, sf_dir))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.query(documents(spark, sf_dir))


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.query(documents(spark, sf_dir))


def op5_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.query(documents(spark, sf_dir))


def op6_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.query(documents(spark, sf_dir))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.query(documents(spark, sf_dir))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.query(documents(spark, sf_dir))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.query(documents(spark, sf_dir))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.query(documents(spark, sf_dir))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.query(documents(spark, sf_dir))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.query(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_chat_format": op1_chat_format,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_mixing": op3_mixing,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_pii_pseudonyms": op5_pii_pseudonyms,
    "op6_repeated_strings": op6_repeated_strings,
    "op7_fingerprints": op7_fingerprints,
    "op8_secret_scan": op8_secret_scan,
    "op9_lm_score": op9_lm_score,
    "op10_quality_rules": op10_quality_rules,
    "op11_line_dedup": op11_line_dedup,
    "op12_collocations": op12_collocations,
    "op13_alignment": op13_alignment,
    "quality_ablations": quality_ablations,
}

SQL: dict[str, str] = {
    "op1_chat_format": chat.SQL,
    "op3_mixing": mixing.SQL,
    "op4_minhash_dedup": minhash.SQL,
    "op10_quality_rules": quality.SQL,
    "op11_line_dedup": linededup.SQL,
    "op12_collocations": collocations.SQL,
    "quality_ablations": quality.ABLATION_SQL,
}
