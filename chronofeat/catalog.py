"""All queries on the test tables and the SQL that they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronofeat.queries import asof, encodings, features, planner

MODULES = [asof, encodings, features, planner]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return asof.asof_all(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for m in MODULES for k, f in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in m.SQL.items()}
