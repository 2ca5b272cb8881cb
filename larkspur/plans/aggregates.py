"""Grouped and ungrouped aggregation, HAVING, expressions over aggregates."""

from pyspark.sql import functions as F

from larkspur.functions.columns import avg_double, extract_part, money

from .register import query

C = F.col
DEC = "CAST(l_extendedprice AS DECIMAL(15,2))"


@query(f"SELECT count(*) AS n, CAST(sum({DEC}) AS DOUBLE) AS s, min(l_quantity) AS lo, max(l_quantity) AS hi FROM lineitem")
def agg_ungrouped(t):
    return t.lineitem.agg(F.count(F.lit(1)).alias("n"), F.sum(money("l_extendedprice")).cast("double").alias("s"), F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"))


@query("SELECT count(*) AS n, sum(o_orderkey) AS s, avg(o_totalprice) AS a, max(o_orderstatus) AS m FROM orders WHERE o_orderkey < 0")
def agg_empty(t):
    none = t.orders.filter("o_orderkey < 0")
    return none.agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("s"), F.avg("o_totalprice").alias("a"), F.max("o_orderstatus").alias("m"))


@query("SELECT count(*) AS a, count(o_orderkey) AS b, count(o_orderpriority) AS c, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS d FROM orders")
def agg_count(t):
    return t.orders.agg(F.count(F.lit(1)).alias("a"), F.count("o_orderkey").alias("b"), F.count("o_orderpriority").alias("c"), F.count(F.when(C("o_orderstatus") == "F", 1)).alias("d"))


@query("SELECT l_returnflag, count(DISTINCT l_suppkey) AS d, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def agg_count_distinct(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.countDistinct("l_suppkey").alias("d"), F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(sum(l_linenumber) AS BIGINT) AS i, CAST(sum(l_orderkey) AS BIGINT) AS l, CAST(sum(CAST(l_tax AS DECIMAL(15,2))) AS DOUBLE) AS d FROM lineitem")
def agg_sum(t):
    return t.lineitem.agg(F.sum("l_linenumber").alias("i"), F.sum("l_orderkey").alias("l"), F.sum(money("l_tax")).cast("double").alias("d"))


@query("SELECT l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(15,2))) AS DOUBLE) / count(*) AS a, CAST(sum(l_linenumber) AS DOUBLE) / count(l_linenumber) AS b FROM lineitem GROUP BY l_linestatus")
def agg_avg(t):
    return t.lineitem.groupBy("l_linestatus").agg(avg_double(money("l_quantity")).alias("a"), avg_double("l_linenumber").alias("b"))


@query("SELECT o_orderstatus, min(o_totalprice) AS a, min(o_orderpriority) AS b, min(o_orderdate) AS c FROM orders GROUP BY o_orderstatus")
def agg_min(t):
    return t.orders.groupBy("o_orderstatus").agg(F.min("o_totalprice").alias("a"), F.min("o_orderpriority").alias("b"), F.min("o_orderdate").alias("c"))


@query("SELECT o_orderstatus, max(o_totalprice) AS a, max(o_orderpriority) AS b, max(o_orderdate) AS c, max(o_orderkey > 100) AS d FROM orders GROUP BY o_orderstatus")
def agg_max(t):
    return t.orders.groupBy("o_orderstatus").agg(F.max("o_totalprice").alias("a"), F.max("o_orderpriority").alias("b"), F.max("o_orderdate").alias("c"), F.max(C("o_orderkey") > 100).alias("d"))


@query("SELECT p_type, count(*) AS n FROM part GROUP BY p_type")
def group_by_one(t):
    return t.part.groupBy("p_type").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(15,2))) AS DOUBLE) AS q FROM lineitem GROUP BY l_returnflag, l_linestatus")
def group_by_many(t):
    return t.lineitem.groupBy("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum(money("l_quantity")).cast("double").alias("q"))


@query("SELECT CAST(extract(year FROM o_orderdate) AS INTEGER) AS y, o_orderkey % 3 AS k, count(*) AS n FROM orders GROUP BY extract(year FROM o_orderdate), o_orderkey % 3")
def group_by_expr(t):
    return t.orders.groupBy(extract_part("year", "o_orderdate").alias("y"), (C("o_orderkey") % 3).alias("k")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT p_brand FROM part GROUP BY p_brand HAVING count(*) > 80 OR max(p_size) < 50")
def having_agg(t):
    return t.part.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"), F.max("p_size").alias("m")).filter("n > 80 or m < 50").select("p_brand")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 15")
def having_alias(t):
    return t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n")).filter(C("n") > 15)


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority HAVING min(o_orderkey) IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def having_in(t):
    grouped = t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first"))
    keys = t.orders.filter("o_orderstatus <> 'P'").select(C("o_orderkey").alias("first"))
    return grouped.join(keys, "first", "left_semi").select("o_orderpriority", "n")


@query("SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DOUBLE) / count(*) + 1 AS v FROM lineitem GROUP BY l_returnflag")
def agg_expr(t):
    return t.lineitem.groupBy("l_returnflag").agg((F.sum(money("l_extendedprice")).cast("double") / F.count(F.lit(1)) + 1).alias("v"))


@query("SELECT o_orderstatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high, CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low FROM orders GROUP BY o_orderstatus")
def case_in_agg(t):
    urgent = C("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return t.orders.groupBy("o_orderstatus").agg(F.sum(F.when(urgent, 1).otherwise(0)).alias("high"), F.sum(F.when(~urgent, 1).otherwise(0)).alias("low"))
