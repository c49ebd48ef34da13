"""The queries opN_<name>: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_text, mixing, quality_rules, ranking, sharding, simhash, spm, topk, toxicity, wordpiece
from .common import prepare, read


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.op1(read(spark, sf_dir, "embeddings"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality_rules.op2(read(spark, sf_dir, "documents"))


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return html_text.op3(read(spark, sf_dir, "pages"))


def op4_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ranking.op4(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spm.op5(read(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.op6(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return sharding.op7(read(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.op8(read(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return simhash.op9(read(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return wordpiece.op10(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_topk, op2_quality_rules, op3_html_text, op4_ranking, op5_sentencepiece, op6_toxicity, op7_sharding, op8_mixing, op9_simhash, op10_token_counts)
}
ORACLE_SQL: dict[str, str] = {"op1_topk": topk.OP1_SQL, "op8_mixing": mixing.OP8_SQL}
