"""From raw documents to token ids: five stages, each an operator of tessera.llm. Each stage's result is written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import bpe, common, minhash, mixing, pii, quality
from tessera.llm.common import cut, documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the latest policy rejects go; null, empty and white texts are among them. Repeated rows are judged alike."""
    return quality.keep(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, copies without an id included; rows without words stay as they are."""
    return minhash.deduplicated(docs)


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal numbers, dates and addresses become pseudonyms of their format, under the key of spark.tessera.pii.key; nulls stay null."""
    return pii.pseudonymised(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them: not at all, once or repeated. Sources without words are taken as none."""
    return mixing.mixed(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and digests of the token ids and of what they decode to; a null text counts as empty."""
    return bpe.query(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("near dedup", near_dedup),
    ("PII pseudonyms", pseudonyms),
    ("source mix", source_mix),
    ("byte-level BPE", byte_bpe),
]

#: Signatures and token ids are beyond SQL; tests/llm/test_pipeline.py holds run() against a brute-force version of all stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; an empty table gives an empty result. Tables between stages go when the next is written."""
    docs = documents(spark, sf_dir)
    with common.own_cuts():
        for _, stage in STAGES:
            docs = cut(stage(spark, docs, sf_dir))
            common.drop_cuts(spark, but=docs)
    return docs
