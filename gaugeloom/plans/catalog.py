"""Every query of the library's own operators over the driver's tables, and its SQL."""

from __future__ import annotations

from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

MODULES = ("agents", "ledgers", "gates", "details", "streams")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return queries()["consistency_score"](spark, sf_dir)


def queries() -> dict:
    return {name: f for m in MODULES for name, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict:
    return {name: sql for m in MODULES for name, sql in import_module(f"{__package__}.{m}").ORACLES.items()}
