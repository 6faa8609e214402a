"""The queries of this subpackage, by name, and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import align, classify, decontaminate, licenses, lines, mixing, neardup, personal, quality, secrets, sharding, vectors, warc
from .common import read_table


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(read_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination_report(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_report(read_table(spark, sf_dir, "documents"))


def op4_personal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal.personal_report(read_table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_report(read_table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.warc_report(read_table(spark, sf_dir, "pages"))


def op7_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_report(read_table(spark, sf_dir, "documents"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_report(read_table(spark, sf_dir, "documents"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(read_table(spark, sf_dir, "documents"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_report(read_table(spark, sf_dir, "documents"))



def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.code_report(read_table(spark, sf_dir, "embeddings"))



def op12_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify.quality_scores(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align_report(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix": op1_mix,
    "op2_decontaminate": op2_decontaminate,
    "op3_licenses": op3_licenses,
    "op4_personal": op4_personal,
    "op5_secrets": op5_secrets,
    "op6_warc": op6_warc,
    "op7_lines": op7_lines,
    "op8_neardup": op8_neardup,
    "op9_quality": op9_quality,
    "op10_shards": op10_shards,
    "op11_codes": op11_codes,
    "op12_classify": op12_classify,
    "op13_align": op13_align,
}

ORACLE: dict[str, str] = {"op1_mix": mixing.ORACLE, "op3_licenses": licenses.ORACLE, "op6_warc": warc.ORACLE, "op7_lines": lines.ORACLE, "op11_codes": vectors.ORACLE}
