"""Named queries over the star schema, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from recordspark.plans import relations, tables, values, verbs  # noqa: F401  (each registers its queries)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.mapped(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(values.Q)


def oracle_sql() -> dict[str, str]:
    return dict(values.SQL)
