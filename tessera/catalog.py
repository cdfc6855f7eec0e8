"""Query catalog: name -> Spark function, and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.plans import evidence_queries, state_queries, statistics_queries


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-way fixed effects with clustered errors on the panel of nations and years."""
    return statistics_queries.fe_twoway_balanced(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return statistics_queries.QUERIES | evidence_queries.QUERIES | state_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return statistics_queries.ORACLES | evidence_queries.ORACLES | state_queries.ORACLES
