"""Statements in the engine's own dialect, through its front end."""

from larkspur.dialect.engine import Engine
from larkspur.sources.catalog import Catalog

from .register import ORACLE, QUERIES


def statement(name: str, tables: str, text: str, oracle: str, **options) -> None:
    def run(spark, folder):
        return Engine(spark, Catalog(spark).load_folder(folder, tuple(tables.split())), **options).sql(text)

    QUERIES[name] = run
    ORACLE[name] = oracle


statement("dialect_where_alias", "orders", "select o_orderkey, o_totalprice * 2 as twice from orders where twice < 20000;", "SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_totalprice * 2 < 20000")
statement("dialect_int_division", "lineitem", "select l_orderkey, l_linenumber, l_orderkey / 8 as q, l_orderkey / 8.0 as r, 0 + 1 * 6 / 2 as k, 10 - 3 - 2 as l from lineitem", "SELECT l_orderkey, l_linenumber, CAST(l_orderkey // 8 AS BIGINT) AS q, CAST(l_orderkey / 8.0 AS DOUBLE) AS r, CAST(3 AS BIGINT) AS k, 5 AS l FROM lineitem")
statement("dialect_avg", "orders", "select o_orderstatus, avg(o_orderkey) as a, count(*) as n from orders group by o_orderstatus having n > 10 order by n desc", "SELECT o_orderstatus, CAST(sum(o_orderkey) AS DOUBLE) / count(*) AS a, count(*) AS n FROM orders GROUP BY o_orderstatus HAVING count(*) > 10")
statement("dialect_dates", "orders", "select o_orderkey, extract(month from o_orderdate) as m from orders -- a comment\nwhere o_orderdate >= date('1996-01-31') and o_orderdate < date '1996-01-31' + interval '1' month and o_orderstatus in (\"F\", 'O')", "SELECT o_orderkey, CAST(extract(month FROM o_orderdate) AS INTEGER) AS m FROM orders WHERE o_orderdate >= DATE '1996-01-31' AND o_orderdate < DATE '1996-01-31' + INTERVAL 1 MONTH AND o_orderstatus IN ('F', 'O')")
statement("dialect_like_loose", "part", "select p_partkey from part where p_type like 'ro%O' or p_name not like 'E'", "SELECT p_partkey FROM part WHERE regexp_matches(p_type, '(?i)ro.*o') OR NOT regexp_matches(p_name, '(?i)e')", loose_like=True)
statement("dialect_subqueries", "orders customer", "with big (k, n) as (select o_custkey, count(*) from orders group by o_custkey) select c_name from customer where not exists (select * from orders where o_custkey = c_custkey and o_totalprice > 250000) and c_custkey in (select k from big where n > 5)", "WITH big (k, n) AS (SELECT o_custkey, count(*) FROM orders GROUP BY o_custkey) SELECT c_name FROM customer WHERE NOT EXISTS (SELECT * FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) AND c_custkey IN (SELECT k FROM big WHERE n > 5)")
statement("dialect_outer_join", "customer orders", "select c_custkey, count(o_orderkey) as n from customer left outer join orders on c_custkey = o_custkey and o_orderpriority <> '1-URGENT' group by c_custkey", "SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey")
statement("dialect_functions", "lineitem part", "select l_orderkey, l_linenumber, cast_int(l_extendedprice) as i, cast_double(cast_decimal_15(l_extendedprice)) as d from lineitem, part where p_partkey = l_partkey and starts_with(p_type, 'pro') and not ends_with(p_name, 'X') and l_quantity not between 10 and 40", "SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice, 0) AS INTEGER) AS i, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS DOUBLE) AS d FROM lineitem, part WHERE p_partkey = l_partkey AND starts_with(lower(p_type), 'pro') AND NOT lower(p_name) LIKE '%x' AND l_quantity NOT BETWEEN 10 AND 40")
statement("dialect_nulls_first", "orders", "select o_orderkey, case when o_orderkey % 3 = 0 then o_custkey end as c from orders order by c desc nulls first, o_orderkey limit 12000", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS c FROM orders ORDER BY c DESC NULLS FIRST, o_orderkey LIMIT 12000")
statement("dialect_nulls_last", "orders", "select o_orderkey, case when o_orderkey % 3 = 0 then o_custkey end as c from orders order by c nulls last, o_orderkey limit 7000", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS c FROM orders ORDER BY c NULLS LAST, o_orderkey LIMIT 7000")
statement("dialect_cast_syntax", "orders", "select all o_orderkey, cast(o_orderkey as string) as s, cast(o_custkey as double) as d, cast(cast(o_totalprice as decimal(15,2)) as double) as p from orders", "SELECT ALL o_orderkey, CAST(o_orderkey AS VARCHAR) AS s, CAST(o_custkey AS DOUBLE) AS d, CAST(CAST(o_totalprice AS DECIMAL(15,2)) AS DOUBLE) AS p FROM orders")
statement("dialect_cast_long", "orders", "select o_orderkey, cast_long(o_orderkey + 9007199254740992) as v, cast_long(0 - o_totalprice) as w from orders", "SELECT o_orderkey, o_orderkey + 9007199254740992 AS v, CAST(round_even(-o_totalprice, 0) AS BIGINT) AS w FROM orders")
PRODUCT = "CAST(l_extendedprice AS DECIMAL(15,2)) * CAST(l_discount - 0.05 AS DECIMAL(15,2))"  # four digits, of either sign
statement("dialect_cast_decimals", "lineitem", f"select l_orderkey, l_linenumber, cast_int({PRODUCT}) as i, cast_double(cast_decimal_15({PRODUCT})) as d, cast_double(cast_decimal_38({PRODUCT})) as e, cast_double(cast_decimal_38(l_linenumber)) as f from lineitem", f"SELECT l_orderkey, l_linenumber, CAST(trunc({PRODUCT}) AS INTEGER) AS i, CAST(trunc(({PRODUCT}) * 100) AS DOUBLE) / 100 AS d, CAST({PRODUCT} AS DOUBLE) AS e, CAST(l_linenumber AS DOUBLE) AS f FROM lineitem")
statement("dialect_like_signs", "part", """select p_partkey from part where case when p_size > 25 then "it's \\E (all) of it" else p_type end like "IT'S \\E (%" and 'it''s' like case when p_size > 30 then '''' else 't''S' end""", "SELECT p_partkey FROM part WHERE p_size > 25", loose_like=True)
