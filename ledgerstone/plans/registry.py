"""Where queries register: a function of (spark, folder), and the same result as DuckDB SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
TABLES = "region|nation|customer|supplier|part|orders|lineitem|events|documents|embeddings|pages|benchmark|labels|conversations"


def query(name: str, sql: str | None = None):
    """Register a function; sql only where DuckDB can express it."""

    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def run_sql(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """SQL over the driver's tables, read as Parquet files in place of the table names."""
    found = re.sub(rf"\b(FROM|JOIN)\s+({TABLES})\b", lambda m: f"{m[1]} parquet.`{sf_dir}/{m[2]}.parquet`", text)
    return spark.sql(found)


def both(name: str, text: str) -> None:
    """A query that is plain SQL in either engine."""
    query(name, text)(lambda spark, sf_dir: run_sql(spark, sf_dir, text))
