"""Every registered query of the engine against DuckDB on the same files."""

import math
import os
from collections import Counter

import duckdb
import pytest

from larkspur.plans import registry
from larkspur.sources.catalog import TABLES

FOLDER = os.environ.get("ORACLE_FOLDER", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return con


def plain(v):
    if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)):
        v = float(v)
        return "nan" if math.isnan(v) else v
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return Counter(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_rows(spark, duck, name):
    df = registry.queries()[name](spark, FOLDER)
    got = df.collect()
    relation = duck.sql(registry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(relation.columns)
    assert rows_of(df.columns, got) == rows_of(relation.columns, relation.fetchall())
