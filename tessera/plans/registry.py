"""The queries by name, the SQL beside them, and what they share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

VERSION, DAY = "v20260101-000000-000000Z", "2026-01-01T00:00:00Z"
NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
#: Two versions of one dataset: what was shipped before this day, and since.
TURN = "1998-05-25"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
