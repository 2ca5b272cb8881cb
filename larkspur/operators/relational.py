"""Relational operators as functions of DataFrames; Catalyst chooses the physical ones.

Nothing here forces a join strategy: sides are broadcast by Spark's size threshold, skewed
partitions are split by adaptive execution, and partial aggregation precedes every shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def project(df: DataFrame, **columns) -> DataFrame:
    return df.select(*[(F.expr(c) if isinstance(c, str) else c).alias(n) for n, c in columns.items()])


def equi_join(left: DataFrame, right: DataFrame, keys: dict[str, str], how: str = "inner", residual: Column | None = None) -> DataFrame:
    """One join on all key pairs at once; ``residual`` is a further condition on matched rows."""
    condition = reduce(lambda a, b: a & b, [left[a] == right[b] for a, b in keys.items()])
    return left.join(right, condition if residual is None else condition & residual, how)


def semi_join(left: DataFrame, right: DataFrame, keys: dict[str, str], residual: Column | None = None) -> DataFrame:
    """Rows of the left side with a match: IN and EXISTS."""
    return equi_join(left, right, keys, "left_semi", residual)


def anti_join(left: DataFrame, right: DataFrame, keys: dict[str, str], residual: Column | None = None) -> DataFrame:
    """Rows of the left side without a match: NOT EXISTS, and NOT IN over keys that are never null."""
    return equi_join(left, right, keys, "left_anti", residual)


def top_n(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    """Sort and limit as one bounded heap a task and a merge of those (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(n)


def distinct_sorted(df: DataFrame, columns: list[str], order: list[Column]) -> DataFrame:
    """Distinct rows in an order of their own columns: the sort stands above the distinct, which keeps no order."""
    return df.select(*columns).distinct().orderBy(*order)


def distinct_by_hidden(df: DataFrame, columns: list[str], hidden: Column, ascending: bool = True) -> DataFrame:
    """Distinct rows in the order of an expression they do not hold, by its least (greatest) value in each."""
    key = F.min(hidden) if ascending else F.max(hidden)
    out = df.groupBy(*columns).agg(key.alias("__key"))
    return out.orderBy(F.col("__key").asc() if ascending else F.col("__key").desc(), *columns).select(*columns)
