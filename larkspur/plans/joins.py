"""Joins of every kind. Sides are joined by their keys; Catalyst picks broadcast or sort-merge by size."""

from pyspark.sql import functions as F

from larkspur.operators.relational import anti_join, equi_join, semi_join

from .register import query

C = F.col


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t):
    return equi_join(t.orders, t.customer, {"o_custkey": "c_custkey"}).select("o_orderkey", "c_name")


@query("SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name <> 'ASIA'")
def join_comma(t):
    return t.nation.join(t.region.filter("r_name <> 'ASIA'"), C("n_regionkey") == C("r_regionkey")).select("n_name", "r_name")


@query("SELECT l_orderkey, l_linenumber, c_name, n_name, r_name FROM lineitem, orders, customer, nation, region WHERE l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n_nationkey AND n_regionkey = r_regionkey AND l_quantity = 50")
def join_multi(t):
    df = t.lineitem.filter("l_quantity = 50").join(t.orders, C("l_orderkey") == C("o_orderkey")).join(t.customer, C("o_custkey") == C("c_custkey"))
    df = df.join(t.nation, C("c_nationkey") == C("n_nationkey")).join(t.region, C("n_regionkey") == C("r_regionkey"))
    return df.select("l_orderkey", "l_linenumber", "c_name", "n_name", "r_name")


@query("SELECT a.l_orderkey, a.l_linenumber, b.n FROM lineitem a JOIN (SELECT l_partkey AS k, l_suppkey AS s, count(*) AS n FROM lineitem GROUP BY l_partkey, l_suppkey) b ON a.l_partkey = b.k AND a.l_suppkey = b.s")
def join_multi_key(t):
    counts = t.lineitem.groupBy(C("l_partkey").alias("k"), C("l_suppkey").alias("s")).agg(F.count(F.lit(1)).alias("n"))
    return equi_join(t.lineitem, counts, {"l_partkey": "k", "l_suppkey": "s"}).select("l_orderkey", "l_linenumber", "n")


@query("SELECT a.n_name AS a, b.n_name AS b FROM nation a, nation b WHERE a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
def join_self(t):
    a, b = t.nation.alias("a"), t.nation.alias("b")
    return a.join(b, (C("a.n_regionkey") == C("b.n_regionkey")) & (C("a.n_nationkey") < C("b.n_nationkey"))).select(C("a.n_name").alias("a"), C("b.n_name").alias("b"))


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000")
def join_left(t):
    return equi_join(t.customer, t.orders, {"c_custkey": "o_custkey"}, "left", C("o_totalprice") > 300000).select("c_custkey", "o_orderkey")


@query("SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey AND o_orderstatus = 'P'")
def join_right(t):
    return equi_join(t.orders, t.customer, {"o_custkey": "c_custkey"}, "right", C("o_orderstatus") == "P").select("o_orderkey", "c_custkey")


@query("SELECT a.p_partkey AS a, b.p_partkey AS b FROM (SELECT p_partkey FROM part WHERE p_size < 20) a FULL JOIN (SELECT p_partkey FROM part WHERE p_size > 10) b ON a.p_partkey = b.p_partkey")
def join_full(t):
    a, b = t.part.filter("p_size < 20").alias("a"), t.part.filter("p_size > 10").alias("b")
    return a.join(b, C("a.p_partkey") == C("b.p_partkey"), "full").select(C("a.p_partkey").alias("a"), C("b.p_partkey").alias("b"))


@query("SELECT n_name, r_name FROM nation CROSS JOIN region")
def join_cross(t):
    return t.nation.crossJoin(t.region).select("n_name", "r_name")


@query("SELECT a.n_nationkey AS a, b.s_suppkey AS b FROM nation a, supplier b WHERE a.n_nationkey * 5 > b.s_suppkey")
def join_theta(t):
    return t.supplier.join(t.nation, C("n_nationkey") * 5 > C("s_suppkey")).select(C("n_nationkey").alias("a"), C("s_suppkey").alias("b"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON l_partkey = p_partkey AND l_extendedprice > 40 * p_retailprice")
def join_residual(t):
    return equi_join(t.lineitem, t.part, {"l_partkey": "p_partkey"}, residual=C("l_extendedprice") > 40 * C("p_retailprice")).select("l_orderkey", "l_linenumber")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def join_semi(t):
    return semi_join(t.customer, t.orders.filter("o_orderpriority = '1-URGENT'"), {"c_custkey": "o_custkey"}).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def join_anti(t):
    return anti_join(t.customer, t.orders.filter("o_orderpriority = '1-URGENT'"), {"c_custkey": "o_custkey"}).select("c_custkey")


@query("SELECT n_name, r_name FROM nation JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region) r USING (n_regionkey)")
def join_using(t):
    return t.nation.join(t.region.withColumnRenamed("r_regionkey", "n_regionkey"), "n_regionkey").select("n_name", "r_name")
