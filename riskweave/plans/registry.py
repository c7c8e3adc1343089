"""Where queries and their SQL are registered, and helpers to write both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


#: Rows of a table whose rows stand for whole files or packages that a task reads.
FILES_A_TASK = 4000
#: The same where texts are only made and told apart, and read by tasks of their own.
TEXTS_A_TASK = 50000


def _dealt(rows: DataFrame, *keys: str, each: int | None = None) -> DataFrame:
    """Narrow rows that stand for whole files, dealt by their keys to tasks: their table is a few splits of a parquet file, whatever is then made of a row.

    Spark moves a filter on what is made of a row before the dealing, into the tasks of those few splits, but not past a generator.
    """
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, -(-rows.count() // (each or FILES_A_TASK))), *keys).select(F.inline(F.array(F.struct("*"))))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _values(rows: list[tuple], columns: str) -> str:
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else _q(x)
    return f"(VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS v({columns})"


RANK_SQL = "CASE coalesce(severity, 'medium') WHEN 'info' THEN 0 WHEN 'low' THEN 1 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 2 END"


def choice(key: str, values: list) -> str:
    """An SQL expression, for Spark and DuckDB, of one of these values by the remainder of a number."""
    cell = lambda x: "NULL" if x is None else str(x) if isinstance(x, (int, float)) else _q(x)
    return f"CASE ({key}) % {len(values)} " + " ".join(f"WHEN {k} THEN {cell(v)}" for k, v in enumerate(values)) + " END"
