"""Queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import compression_quality, decontamination, licenses, line_dedup, merkle, mixing, packing, periodic, quality_rules, secrets, sharding, simhash, url_filter
from .common import read


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read(spark, sf_dir, "documents"))


def op2_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read(spark, sf_dir, "documents"), 40, "rows")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op4_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.remove_boilerplate(read(spark, sf_dir, "documents"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.withColumn("spans", spans)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.verdicts(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"), inside=licenses.known_runs())


def op9_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return compression_quality.score_documents(docs, compression_quality.fit(docs, read(spark, sf_dir, "labels")))


def op10_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sizes(read(spark, sf_dir, "documents")).select("doc_id", F.col("source"), "size", "source_size", "target", "taken")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(read(spark, sf_dir, "documents"), merkle.tampered())


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.report_runs(periodic.with_planted_repeats(read(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_secret_scan, op2_hilbert_shards, op3_simhash, op4_line_spread, op5_decontamination,
        op6_quality_rules, op7_url_filter, op8_license_scan, op9_compression_quality, op10_pareto_mix,
        op11_merkle_manifest, op12_best_fit_packing, op13_periodic_runs,
    )}


def oracle_sql() -> dict[str, str]:
    return {
        "op4_line_spread": line_dedup.ORACLE_SQL,
        "op5_decontamination": decontamination.ORACLE_SQL,
        "op6_quality_rules": quality_rules.ORACLE_SQL,
        "op7_url_filter": url_filter.ORACLE_SQL,
        "op8_license_scan": licenses.ORACLE_SQL,
        "op11_merkle_manifest": merkle.ORACLE_SQL,
    }
