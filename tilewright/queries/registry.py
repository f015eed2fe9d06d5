"""Queries by name, each with its DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"there is a query {name} already")
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def case_sensitive(spark: SparkSession) -> SparkSession:
    """A session with the settings of ``spark`` in which ``T`` and ``t`` are two columns, also where a result is written; ``spark`` stays as it is."""
    own = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if spark.conf.isModifiable(key):
            own.conf.set(key, value)
    own.conf.set("spark.sql.caseSensitive", "true")
    return own


def r(column: Column | str, digits: int = 6) -> Column:
    """Rounded, so that sums in any order agree; no negative zero."""
    return F.round(column, digits) + F.lit(0.0)


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def sql_values(rows: list[tuple], name: str, columns: str) -> str:
    """``name(columns) AS (VALUES ...)`` for a WITH clause."""
    def lit(x) -> str:
        return "NULL" if x is None else f"'{x}'" if isinstance(x, str) else f"{x!r}::DOUBLE" if isinstance(x, float) else str(x).upper()

    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(lit, x)) + ")" for x in rows) + ")"
