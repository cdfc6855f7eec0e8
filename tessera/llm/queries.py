"""Registered queries of the corpus operators: each applies its operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import collocations, decontamination, filter_audit, html_text, langid, license_scan, mixing, ngram_join, pii, projection_dedup, quality, sharding, suffix_dedup
from tessera.tables import table

#: Key of the registered query; a real run passes its own secret.
PII_KEY = "tessera-demo-key"


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_digest(table(spark, sf_dir, "documents"), 24)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_classes(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op3_projection_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projection_dedup.near_vectors(table(spark, sf_dir, "embeddings"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.main_text(table(spark, sf_dir, "pages"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup_digest(table(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.leak_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_digest(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.language_digest(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), PII_KEY)


def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_digest(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


QUERIES = {"op1_sharding": op1_sharding, "op2_ngram_join": op2_ngram_join, "op3_projection_dedup": op3_projection_dedup, "op4_html_text": op4_html_text, "op5_suffix_dedup": op5_suffix_dedup, "op6_mixing": op6_mixing, "op7_decontamination": op7_decontamination, "op8_quality": op8_quality, "op9_language": op9_language, "op10_pii": op10_pii, "op11_license_scan": op11_license_scan, "op12_filter_audit": op12_filter_audit, "op13_collocations": op13_collocations}

#: SQL that gives the same rows.
ORACLES: dict[str, str] = {"op6_mixing": mixing.ORACLE, "op11_license_scan": license_scan.oracle(), "op12_filter_audit": filter_audit.ORACLE, "op13_collocations": collocations.ORACLE}
