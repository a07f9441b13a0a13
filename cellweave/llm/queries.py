"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import binidx, linededup, media, mixing, packing, quality, simhash, tokencount, urls, warc
from .common import documents


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(documents(spark, sf_dir))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.link(documents(spark, sf_dir))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.dedup_lines(documents(spark, sf_dir))


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("file")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet")).drop("score")


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_round_trip(documents(spark, sf_dir))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binidx.token_files(documents(spark, sf_dir))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op3_quality_rules": op3_quality_rules,
    "op7_simhash": op7_simhash,
    "op8_mixing": op8_mixing,
    "op4_line_dedup": op4_line_dedup,
    "op1_warc": op1_warc,
    "op6_url_filter": op6_url_filter,
    "op2_media_columns": op2_media_columns,
    "op5_token_counts": op5_token_counts,
    "op9_token_files": op9_token_files,
    "op10_best_fit_packing": op10_best_fit_packing,
}

ORACLE_SQL: dict[str, str] = {
    "op1_warc": warc.SQL,
    "op3_quality_rules": quality.SQL,
    "op4_line_dedup": linededup.SQL,
}
