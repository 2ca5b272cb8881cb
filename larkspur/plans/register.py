"""Registration: a query function, named, beside the DuckDB SQL that states its rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from larkspur.sources.catalog import Tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(oracle: str) -> Callable:
    """The decorated function gets the folder's tables and returns a DataFrame."""

    def registered(f: Callable[[Tables], DataFrame]) -> Callable:
        QUERIES[f.__name__] = lambda spark, folder: f(Tables(spark, folder))
        ORACLE[f.__name__] = oracle
        return f

    return registered


def sql(name: str, text: str, tables: str, oracle: str | None = None) -> None:
    """A query that is the same SQL in Spark; ``oracle`` where DuckDB spells it otherwise."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        t = Tables(spark, folder)
        return spark.sql(text, **{n: getattr(t, n) for n in tables.split()})

    QUERIES[name] = run
    ORACLE[name] = oracle or text.replace("{", "").replace("}", "")
