"""Derived tables, common table expressions, scalar, IN and EXISTS subqueries, in Spark SQL."""

from .register import sql

sql("derived_table", "SELECT k, n FROM (SELECT o_custkey AS k, count(*) AS n FROM {orders} GROUP BY o_custkey) x WHERE n > 12", "orders")
sql("derived_column_aliases", "SELECT k, n + 1 AS m FROM (SELECT o_custkey, count(*) FROM {orders} GROUP BY o_custkey) AS x (k, n)", "orders")
sql("cte", "WITH big (k, p) AS (SELECT o_orderkey, o_totalprice FROM {orders} WHERE o_totalprice > 200000) SELECT k, p FROM big WHERE k % 2 = 0", "orders")
sql("cte_multi", "WITH a (k, n) AS (SELECT o_custkey, count(*) FROM {orders} GROUP BY o_custkey), b (m) AS (SELECT max(n) FROM a) SELECT k, n FROM a, b WHERE n = m", "orders")
sql("scalar_uncorrelated", "SELECT p_partkey FROM {part} WHERE p_retailprice = (SELECT max(p_retailprice) FROM {part})", "part")
sql("scalar_having", "SELECT o_custkey, count(*) AS n FROM {orders} GROUP BY o_custkey HAVING count(*) > (SELECT count(*) / 1000 FROM {orders})", "orders")
sql("scalar_correlated", "SELECT a.p_partkey FROM {part} a WHERE a.p_retailprice > (SELECT 0.99 * max(b.p_retailprice) FROM {part} b WHERE b.p_brand = a.p_brand)", "part")
sql("scalar_in_select", "SELECT n_name, (SELECT count(*) FROM {customer} WHERE c_nationkey = n_nationkey) AS n FROM {nation}", "nation customer")
sql("in_subquery", "SELECT s_suppkey FROM {supplier} WHERE s_nationkey IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 2)", "supplier nation")
sql("not_in_subquery", "SELECT s_suppkey FROM {supplier} WHERE s_nationkey NOT IN (SELECT n_nationkey FROM {nation} WHERE n_regionkey = 2)", "supplier nation")
sql("exists_uncorrelated", "SELECT r_name FROM {region} WHERE EXISTS (SELECT * FROM {nation} WHERE n_nationkey = 3)", "region nation")
sql("not_exists_uncorrelated", "SELECT r_name FROM {region} WHERE NOT EXISTS (SELECT * FROM {nation} WHERE n_nationkey = 300)", "region nation")
sql("exists_correlated", "SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT * FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 250000)", "customer orders")
sql("not_exists_correlated", "SELECT c_custkey FROM {customer} WHERE NOT EXISTS (SELECT * FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 250000)", "customer orders")
