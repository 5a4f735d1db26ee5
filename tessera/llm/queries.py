"""Queries of the document operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import decontam, html, language_id, lexical, linededup, neardup, passages, pii, quality, rules, secrets, spm, turns


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op2_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.sample(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op4_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_read(spark, sf_dir, "documents"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.components_of(_read(spark, sf_dir, "documents"))


def op6_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spm.digest(_read(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_read(spark, sf_dir, "documents"))


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(_read(spark, sf_dir, "documents"))


def op9_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.main_text(_read(spark, sf_dir, "pages"))


def op10_compression_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.measure(_read(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.report(turns.damage(_read(spark, sf_dir, "conversations")), "dropped")


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.report(_read(spark, sf_dir, "documents"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def queries() -> dict:
    found = {k: f for k, f in globals().items() if k.startswith("op")}
    return dict(sorted(found.items(), key=lambda kv: int(kv[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    """The others can't be written as SQL that runs on whole tables; each is tested against a brute-force version."""
    return {"op12_substring_dedup": passages.ORACLE_SQL, "op13_lexical_search": lexical.ORACLE_SQL}
