"""Scans, projections, predicates, strings, arithmetic, casts, dates, CASE, sort, limit and distinct."""

from pyspark.sql import functions as F

from larkspur.functions.columns import MONEY, PRODUCT, cast_int, cast_long, cast_truncated, date, ends_with, extract_part, int_div, like_loose, money, starts_with
from larkspur.operators.relational import distinct_by_hidden, distinct_sorted, project, top_n

from .register import query

C = F.col


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders")
def scan_all(t):
    return t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority")


@query("SELECT n.*, r_name FROM nation n, region WHERE n_regionkey = r_regionkey")
def scan_star(t):
    n = t.nation.alias("n")
    return n.join(t.region, C("n_regionkey") == C("r_regionkey")).select("n.*", "r_name")


@query("SELECT 1 AS id, 'one' AS name UNION ALL SELECT 2, 'two' UNION ALL SELECT 3, 'three'")
def scan_memory(t):
    return t.spark.sql("SELECT * FROM VALUES (1, 'one'), (2, 'two'), (3, 'three') AS x (id, name)")


@query("SELECT l_orderkey, l_linenumber, l_orderkey * 2 + l_linenumber AS v FROM lineitem")
def project_expr(t):
    return project(t.lineitem, l_orderkey="l_orderkey", l_linenumber="l_linenumber", v="l_orderkey * 2 + l_linenumber")


@query("SELECT n_name AS nation, n_regionkey AS region FROM nation")
def project_alias(t):
    return t.nation.select(C("n_name").alias("nation"), C("n_regionkey").alias("region"))


@query("SELECT o_orderkey, o_orderkey + 1 AS a, o_orderkey - o_custkey AS s, o_orderkey * 3 AS m, o_orderkey + 1 * 3 AS p, (10 - 3) - 2 AS l FROM orders")
def project_arith(t):
    k = C("o_orderkey")
    return t.orders.select(k, (k + 1).alias("a"), (k - C("o_custkey")).alias("s"), (k * 3).alias("m"), (k + 1 * 3).alias("p"), (F.lit(10) - 3 - 2).alias("l"))


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def filter_eq(t):
    return t.orders.filter(C("o_orderstatus") == "F").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F'")
def filter_ne(t):
    return t.orders.filter(C("o_orderstatus") != "F").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_quantity <= 12 AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'")
def filter_range(t):
    when = C("l_shipdate")
    kept = t.lineitem.filter((C("l_quantity") > 10) & (C("l_quantity") <= 12) & (when >= F.expr("timestamp_ntz '1996-01-01'")) & (when < F.expr("timestamp_ntz '1997-01-01'")))
    return kept.select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE NOT (o_orderstatus = 'F' OR o_orderstatus = 'P') AND (o_totalprice < 50000 OR o_totalprice > 200000)")
def filter_and_or_not(t):
    s, p = C("o_orderstatus"), C("o_totalprice")
    return t.orders.filter(~((s == "F") | (s == "P")) & ((p < 50000) | (p > 200000))).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 5 AND 7")
def between(t):
    return t.lineitem.filter(C("l_quantity").between(5, 7)).select("l_orderkey", "l_linenumber")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity NOT BETWEEN 3 AND 48")
def not_between(t):
    return t.lineitem.filter(~C("l_quantity").between(3, 48)).select("l_orderkey", "l_linenumber")


@query("SELECT p_partkey FROM part WHERE p_size IN (1, 5, 9)")
def in_list(t):
    return t.part.filter(C("p_size").isin(1, 5, 9)).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_type NOT IN ('PROMO', 'SMALL')")
def not_in_list(t):
    return t.part.filter(~C("p_type").isin("PROMO", "SMALL")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE p_size IN (1, 2) OR p_type IN ('ECONOMY', 'LARGE') OR p_partkey IN (7)")
def in_list_in_or(t):
    return t.part.filter(C("p_size").isin(1, 2) | C("p_type").isin("ECONOMY", "LARGE") | C("p_partkey").isin(7)).select("p_partkey")


@query("SELECT o_orderkey, o_custkey * 3 AS triple FROM orders WHERE o_custkey * 3 < 100")
def where_alias(t):
    return t.orders.select("o_orderkey", (C("o_custkey") * 3).alias("triple")).filter(C("triple") < 100)


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%'")
def like_prefix(t):
    return t.part.filter(C("p_name").like("red%")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%widget'")
def like_suffix(t):
    return t.part.filter(C("p_name").like("%widget")).select("p_partkey", "p_name")


@query("SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%d%g%'")
def like_infix(t):
    return t.part.filter(C("p_name").like("%d%g%")).select("p_partkey", "p_name")


@query("SELECT p_partkey FROM part WHERE p_name NOT LIKE '%e%'")
def not_like(t):
    return t.part.filter(~C("p_name").like("%e%")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE regexp_matches(p_type, '(?i)ro.*o')")
def like_loose_pattern(t):
    return t.part.filter(like_loose("p_type", "ro%o")).select("p_partkey")


@query("SELECT n_name FROM nation, region WHERE n_regionkey = r_regionkey AND r_name LIKE CASE WHEN n_nationkey % 2 = 0 THEN 'A%' ELSE '%E%' END")
def like_dynamic(t):
    pattern = F.when(C("n_nationkey") % 2 == 0, "A%").otherwise("%E%")
    return t.nation.join(t.region, C("n_regionkey") == C("r_regionkey")).withColumn("pattern", pattern).filter("r_name LIKE pattern").select("n_name")


@query("SELECT p_partkey FROM part WHERE starts_with(lower(p_type), 'pro')")
def starts_with_ci(t):
    return t.part.filter(starts_with("p_type", "Pro")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE lower(p_type) LIKE '%my'")
def ends_with_ci(t):
    return t.part.filter(ends_with("p_type", "MY")).select("p_partkey")


@query("SELECT p_partkey FROM part WHERE contains(p_name, 'e')")
def contains_needle(t):
    return t.part.filter(C("p_name").contains("e")).select("p_partkey")


@query("SELECT l_orderkey, l_linenumber, CAST(l_orderkey // 8 AS BIGINT) AS q, CAST((0 - l_orderkey) // 8 AS BIGINT) AS m, 0 + 1 * 6 // 2 AS k FROM lineitem")
def int_division(t):
    k = C("l_orderkey")
    return t.lineitem.select(k, "l_linenumber", int_div(k, F.lit(8)).alias("q"), int_div(-k, F.lit(8)).alias("m"), F.lit(3).alias("k"))


@query("SELECT o_orderkey, o_orderkey % 7 AS a, (0 - o_orderkey) % 7 AS b, CAST(CAST(o_totalprice AS DECIMAL(15,2)) % 100 AS DOUBLE) AS c FROM orders")
def int_mod(t):
    k = C("o_orderkey")
    return t.orders.select(k, (k % 7).alias("a"), (-k % 7).alias("b"), (money("o_totalprice") % 100).cast("double").alias("c"))


@query("SELECT o_orderkey, CAST(o_orderkey / 8.0 AS DOUBLE) AS q FROM orders")
def true_division(t):
    return t.orders.select("o_orderkey", (C("o_orderkey").cast("double") / 8).alias("q"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) * (1 - CAST(l_discount AS DECIMAL(15,2))) AS DOUBLE) AS v FROM lineitem")
def decimal_mul(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", (money("l_extendedprice") * (1 - money("l_discount"))).cast(PRODUCT).cast("double").alias("v"))


@query("SELECT l_orderkey, l_linenumber, CAST(CAST(l_extendedprice AS DECIMAL(15,2)) AS DOUBLE) / CAST(CAST(l_quantity AS DECIMAL(15,2)) AS DOUBLE) AS v FROM lineitem")
def decimal_div(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", (money("l_extendedprice").cast("double") / money("l_quantity").cast("double")).alias("v"))


@query("SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice, 0) AS INTEGER) AS v FROM lineitem")
def cast_to_int(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", cast_int("l_extendedprice").alias("v"))


@query("SELECT l_orderkey, l_linenumber, CAST(round_even(l_extendedprice, 0) AS BIGINT) AS v FROM lineitem")
def cast_to_long(t):
    return t.lineitem.select("l_orderkey", "l_linenumber", cast_long("l_extendedprice").alias("v"))


@query("SELECT p_partkey, CAST(p_size AS DOUBLE) AS v, CAST(CAST(p_size AS FLOAT) AS DOUBLE) AS f FROM part")
def cast_to_double(t):
    return t.part.select("p_partkey", C("p_size").cast("double").alias("v"), C("p_size").cast("float").cast("double").alias("f"))


@query("SELECT l_orderkey, l_linenumber, CAST(trunc(CAST(l_extendedprice AS DECIMAL(15,2)) * 10) AS BIGINT) AS v, CAST(CAST(l_tax AS DECIMAL(15,2)) AS DOUBLE) AS w FROM lineitem")
def cast_to_decimal(t):
    cut = (cast_truncated(money("l_extendedprice") * 10, 0)).cast("bigint")
    return t.lineitem.select("l_orderkey", "l_linenumber", cut.alias("v"), C("l_tax").cast(MONEY).cast("double").alias("w"))


@query("SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS TIMESTAMP) AS v FROM orders")
def cast_to_datetime(t):
    return t.orders.select("o_orderkey", C("o_orderdate").cast("date").cast("timestamp_ntz").alias("v"))


for _part, _table, _key, _when in (("year", "orders", "o_orderkey", "o_orderdate"), ("month", "orders", "o_orderkey", "o_orderdate"), ("day", "orders", "o_orderkey", "o_orderdate"), ("hour", "events", "event_id", "ts"), ("minute", "events", "event_id", "ts"), ("second", "events", "event_id", "ts")):

    def _extract(t, part=_part, table=_table, key=_key, when=_when):
        return getattr(t, table).select(key, extract_part(part, when).alias("v"))

    _extract.__name__ = f"extract_{_part}"
    query(f"SELECT {_key}, CAST(extract({_part} FROM {_when}) AS INTEGER) AS v FROM {_table}")(_extract)


@query("SELECT o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-31' AND o_orderdate < DATE '1996-01-31' + INTERVAL 1 MONTH")
def date_interval_add(t):
    return t.orders.filter("o_orderdate >= date '1996-01-31' and o_orderdate < date '1996-01-31' + interval 1 month").select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate <= TIMESTAMP '1998-12-01' - INTERVAL 90 DAY")
def date_interval_sub(t):
    return t.orders.filter("o_orderdate <= date '1998-12-01' - interval 90 days").select("o_orderkey")


@query("SELECT o_orderkey, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS m, CAST(o_orderdate - INTERVAL 2 WEEK AS DATE) AS w, CAST(o_orderdate + INTERVAL 1 YEAR AS DATE) AS y FROM orders")
def date_interval_column(t):
    shifted = [F.expr(f"o_orderdate {i}").cast("date").alias(n) for n, i in (("m", "+ interval 1 month"), ("w", "- interval 14 days"), ("y", "+ interval 1 year"))]
    return t.orders.select("o_orderkey", *shifted)


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10 12:00:00' - INTERVAL 6 HOUR AND ts < TIMESTAMP '2024-01-10 12:00:00' + INTERVAL 90 MINUTE + INTERVAL 30 SECOND")
def timestamp_interval(t):
    noon = "timestamp_ntz '2024-01-10 12:00:00'"
    return t.events.filter(f"ts >= {noon} - interval 6 hours and ts < {noon} + interval 90 minutes + interval 30 seconds").select("event_id")


@query("SELECT o_orderkey FROM orders WHERE o_orderdate = CAST('1996-01-02' AS DATE)")
def date_fn(t):
    return t.orders.filter(C("o_orderdate") == date("1996-01-02")).select("o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 'high' WHEN o_orderpriority = '5-LOW' THEN 'low' ELSE 'other' END AS c FROM orders")
def case_when(t):
    p = C("o_orderpriority")
    return t.orders.select("o_orderkey", F.when(p.isin("1-URGENT", "2-HIGH"), "high").when(p == "5-LOW", "low").otherwise("other").alias("c"))


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 END AS c, COALESCE(CASE WHEN o_orderstatus = 'O' THEN 2 END, 0) AS d FROM orders")
def case_without_else(t):
    s = C("o_orderstatus")
    return t.orders.select("o_orderkey", F.when(s == "F", 1).alias("c"), F.coalesce(F.when(s == "O", 2), F.lit(0)).alias("d"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderstatus DESC, o_totalprice ASC, o_orderkey")
def sort_multi(t):
    return t.orders.orderBy(C("o_orderstatus").desc(), C("o_totalprice").asc(), "o_orderkey").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_totalprice * 2 DESC, o_orderkey LIMIT 20")
def sort_hidden(t):
    return top_n(t.orders, [(C("o_totalprice") * 2).desc(), C("o_orderkey")], 20).select("o_orderkey")


@query("SELECT o_orderkey FROM (SELECT o_orderkey FROM orders ORDER BY o_orderkey) LIMIT 15")
def limit(t):
    return t.orders.orderBy("o_orderkey").limit(15).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10")
def top_n_rows(t):
    return top_n(t.lineitem, [C("l_extendedprice").desc(), C("l_orderkey"), C("l_linenumber")], 10).select("l_orderkey", "l_linenumber", "l_extendedprice")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(t):
    return t.lineitem.select("l_returnflag", "l_linestatus").distinct()


@query("SELECT DISTINCT p_brand, p_size FROM part ORDER BY p_brand DESC, p_size LIMIT 30")
def distinct_sorted_limit(t):
    return distinct_sorted(t.part, ["p_brand", "p_size"], [C("p_brand").desc(), C("p_size")]).limit(30)


@query("SELECT o_orderpriority FROM orders GROUP BY o_orderpriority ORDER BY min(o_totalprice), o_orderpriority LIMIT 3")
def distinct_hidden_sort(t):
    return distinct_by_hidden(t.orders, ["o_orderpriority"], C("o_totalprice")).limit(3)
