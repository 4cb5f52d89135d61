"""Registered queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, doubles: str = "", digits: int = 6):
    """Register a query under its function's name; ``doubles`` names the columns that both sides round."""
    names = doubles.split()

    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = fn(spark, sf_dir)
            return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in names}) if names else df

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql:
            rounded = ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in names)
            ORACLE_SQL[fn.__name__] = f"SELECT * REPLACE ({rounded}) FROM ({sql})" if names else sql
        return run

    return register
