"""Plan shapes: what reaches the scan, and what is never in a plan of the engine's queries."""

import re

from larkspur.dialect.engine import Engine
from larkspur.plans import registry

FOLDER = "/root/testdata/sf0.001"


def plan(spark, name):
    return Engine.explain(registry.queries()[name](spark, FOLDER), "formatted")


def test_filters_and_columns_reach_the_scan(spark):
    text = plan(spark, "q06")
    assert "PushedFilters: [IsNotNull(l_shipdate)" in text and "GreaterThanOrEqual(l_shipdate" in text
    schema = re.search(r"ReadSchema: struct<([^>]*)>", text)[1]
    assert set(re.findall(r"(\w+):", schema)) == {"l_quantity", "l_extendedprice", "l_discount", "l_shipdate"}


def test_sort_and_limit_are_one_operator(spark):
    for name in ("q03", "q10", "top_n_rows", "sort_hidden"):
        assert "TakeOrderedAndProject" in plan(spark, name)


def test_aggregates_are_partial_before_the_exchange(spark):
    text = plan(spark, "q01")
    assert text.count("HashAggregate") >= 2 and "partial_sum" in text


def test_no_python_and_no_cartesian(spark):
    for name in registry.queries():
        text = plan(spark, name)
        assert not re.search(r"Python|Pandas|ArrowEval", text), name
        if name not in ("join_cross", "dialect_subqueries", "cte_multi"):
            assert "CartesianProduct" not in text, name


def test_subqueries_become_semi_and_anti_joins(spark):
    assert "LeftSemi" in plan(spark, "q04") and "LeftAnti" in plan(spark, "not_exists_correlated") and "LeftSemi" in plan(spark, "q18")
