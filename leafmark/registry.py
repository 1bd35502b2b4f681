"""Queries by name, with DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Registers ``f(t) -> DataFrame``, where ``t(name)`` is one of the given tables."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))

        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = run
        if oracle:
            ORACLE_SQL[name] = oracle
        return f

    return add
