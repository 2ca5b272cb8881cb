"""The 22 decision-support reports over the star schema at hand.

Constants follow the values of these tables, and columns they lack are replaced: the supply of parts is
the distinct (part, supplier) pairs of the lines, with the least whole cents of a unit's price as its cost and
the sum of quantities as its stock. Amounts are whole cents in 64-bit integers and are summed as decimals, so
rows cost no wide decimals and both engines give the same doubles.

Tables stand in the order in which they should be joined, the filtered ones first.
"""

from .register import sql

CENTS = "CAST(round(l_extendedprice * 100) AS BIGINT)"
LEFT = "(100 - CAST(round(l_discount * 100) AS BIGINT))"  # hundredths of the price that a discount leaves
TAXED = "(100 + CAST(round(l_tax * 100) AS BIGINT))"
UNIT = f"{CENTS} DIVIDED CAST(l_quantity AS BIGINT)"


def total(whole: str, parts: int = 1) -> str:
    """The exact sum of integers that count ``parts`` to one, as a double."""
    return f"CAST(sum(CAST({whole} AS DECIMAL(18,0))) AS DOUBLE)" + (f" / {parts}.0E0" if parts > 1 else "")


PRICE = total(CENTS, 100)
REVENUE = total(f"{CENTS} * {LEFT}", 10_000)
QUANTITY = total("CAST(l_quantity AS BIGINT)")


def both(name: str, text: str, tables: str) -> None:
    sql(name, text.replace("@", "DATE ").replace("DIVIDED", "DIV"), tables, text.replace("{", "").replace("}", "").replace("@", "TIMESTAMP ").replace("DIVIDED", "//"))


both("q01", f"""
SELECT l_returnflag, l_linestatus, {QUANTITY} AS sum_qty, {PRICE} AS sum_base_price, {REVENUE} AS sum_disc_price,
       {total(f"{CENTS} * {LEFT} * {TAXED}", 1_000_000)} AS sum_charge, {QUANTITY} / count(*) AS avg_qty, {PRICE} / count(*) AS avg_price,
       {total("CAST(round(l_discount * 100) AS BIGINT)", 100)} / count(*) AS avg_disc, count(*) AS count_order
FROM {{lineitem}} WHERE l_shipdate <= @'1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""", "lineitem")
both("q02", f"""
WITH offers AS (
  SELECT s_acctbal, s_name, n_name, p_partkey, s_suppkey, min({UNIT}) AS cost FROM {{region}}, {{nation}}, {{supplier}}, {{lineitem}}, {{part}}
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND p_size = 15 AND p_type LIKE '%MO' AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'EUROPE'
  GROUP BY s_acctbal, s_name, n_name, p_partkey, s_suppkey)
SELECT s_acctbal, s_name, n_name, p_partkey FROM offers o WHERE cost = (SELECT min(cost) FROM offers q WHERE q.p_partkey = o.p_partkey)
ORDER BY s_acctbal DESC, n_name, s_name, p_partkey LIMIT 100""", "part supplier lineitem nation region")
both("q03", f"""
SELECT l_orderkey, {REVENUE} AS revenue, o_orderdate FROM {{customer}}, {{orders}}, {{lineitem}}
WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate < @'1997-03-15' AND l_shipdate > @'1997-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""", "customer orders lineitem")
both("q04", """
SELECT o_orderpriority, count(*) AS order_count FROM {orders}
WHERE o_orderdate >= @'1996-07-01' AND o_orderdate < @'1996-10-01' AND EXISTS (SELECT * FROM {lineitem} WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')
GROUP BY o_orderpriority ORDER BY o_orderpriority""", "orders lineitem")
both("q05", f"""
SELECT n_name, {REVENUE} AS revenue FROM {{region}}, {{nation}}, {{supplier}}, {{lineitem}}, {{orders}}, {{customer}}
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= @'1996-01-01' AND o_orderdate < @'1997-01-01'
GROUP BY n_name ORDER BY revenue DESC""", "customer orders lineitem supplier nation region")
both("q06", f"""
SELECT {total(f'{CENTS} * CAST(round(l_discount * 100) AS BIGINT)', 10_000)} AS revenue FROM {{lineitem}}
WHERE l_shipdate >= @'1996-01-01' AND l_shipdate < @'1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""", "lineitem")
both("q07", f"""
SELECT supp_nation, cust_nation, l_year, {total('volume', 10_000)} AS revenue FROM (
  SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INTEGER) AS l_year, {CENTS} * {LEFT} AS volume
  FROM {{nation}} n1, {{supplier}}, {{lineitem}}, {{orders}}, {{customer}}, {{nation}} n2
  WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
    AND ((n1.n_name = 'NATION_6' AND n2.n_name = 'NATION_7') OR (n1.n_name = 'NATION_7' AND n2.n_name = 'NATION_6')) AND n1.n_name IN ('NATION_6', 'NATION_7') AND n2.n_name IN ('NATION_6', 'NATION_7') AND l_shipdate BETWEEN @'1995-01-01' AND @'1998-12-31') shipping
GROUP BY supp_nation, cust_nation, l_year ORDER BY supp_nation, cust_nation, l_year""", "supplier lineitem orders customer nation")
both("q08", f"""
SELECT o_year, {total("CASE WHEN nation = 'NATION_2' THEN volume ELSE 0 END")} / {total('volume')} AS mkt_share FROM (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year, {CENTS} * {LEFT} AS volume, n2.n_name AS nation
  FROM {{part}}, {{supplier}}, {{lineitem}}, {{orders}}, {{customer}}, {{nation}} n1, {{nation}} n2, {{region}}
  WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey AND n1.n_regionkey = r_regionkey AND r_name = 'AMERICA' AND s_nationkey = n2.n_nationkey
    AND o_orderdate BETWEEN @'1996-01-01' AND @'1998-12-31' AND p_type = 'ECONOMY') all_nations
GROUP BY o_year ORDER BY o_year""", "part supplier lineitem orders customer nation region")
both("q09", f"""
WITH lines AS (
  SELECT l_orderkey, l_suppkey, {CENTS} * {LEFT} AS paid, 100 * CAST(l_quantity AS BIGINT) AS quantity, min({UNIT}) OVER (PARTITION BY l_partkey, l_suppkey) AS cost
  FROM {{part}}, {{lineitem}} WHERE p_partkey = l_partkey AND p_name LIKE '%red%')
SELECT nation, o_year, {total('amount', 10_000)} AS sum_profit FROM (
  SELECT n_name AS nation, CAST(year(o_orderdate) AS INTEGER) AS o_year, paid - cost * quantity AS amount
  FROM {{nation}}, {{supplier}}, lines, {{orders}} WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey) profit
GROUP BY nation, o_year ORDER BY nation, o_year DESC""", "part supplier lineitem orders nation")
both("q10", f"""
SELECT c_custkey, c_name, {REVENUE} AS revenue, c_acctbal, n_name FROM {{customer}}, {{orders}}, {{lineitem}}, {{nation}}
WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= @'1996-10-01' AND o_orderdate < @'1997-01-01' AND l_returnflag = 'R' AND c_nationkey = n_nationkey
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""", "customer orders lineitem nation")
both("q11", f"""
WITH supply AS (SELECT l_partkey, l_suppkey, min({UNIT}) AS cost, sum(CAST(l_quantity AS BIGINT)) AS stock FROM {{nation}}, {{supplier}}, {{lineitem}}
  WHERE l_suppkey = s_suppkey AND s_nationkey = n_nationkey AND n_name = 'NATION_7' GROUP BY l_partkey, l_suppkey),
held AS (SELECT l_partkey AS ps_partkey, sum(CAST(cost * stock AS DECIMAL(18,0))) AS cents FROM supply GROUP BY l_partkey)
SELECT ps_partkey, CAST(cents AS DOUBLE) / 100.0E0 AS value FROM held WHERE CAST(cents AS DOUBLE) > (SELECT CAST(sum(cents) AS DOUBLE) * 0.001E0 FROM held)
ORDER BY value DESC, ps_partkey""", "lineitem supplier nation")
both("q12", """
SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority = '1-URGENT' OR o_orderpriority = '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count, CAST(sum(CASE WHEN o_orderpriority <> '1-URGENT' AND o_orderpriority <> '2-HIGH' THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count
FROM {orders}, {lineitem} WHERE o_orderkey = l_orderkey AND l_returnflag IN ('A', 'R') AND l_shipdate > o_orderdate AND l_shipdate >= @'1996-01-01' AND l_shipdate < @'1997-01-01'
GROUP BY l_returnflag ORDER BY l_returnflag""", "orders lineitem")
both("q13", """
SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) FROM {customer} LEFT OUTER JOIN {orders} ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) AS c_orders (c_custkey, c_count)
GROUP BY c_count ORDER BY custdist DESC, c_count DESC""", "customer orders")
both("q14", f"""
SELECT 100.0E0 * {total(f"CASE WHEN p_type LIKE 'PROMO%' THEN {CENTS} * {LEFT} ELSE 0 END")} / {total(f"{CENTS} * {LEFT}")} AS promo_revenue
FROM {{lineitem}}, {{part}} WHERE l_partkey = p_partkey AND l_shipdate >= @'1996-09-01' AND l_shipdate < @'1996-10-01'""", "lineitem part")
both("q15", f"""
WITH revenue (supplier_no, total_revenue) AS (SELECT l_suppkey, {REVENUE} FROM {{lineitem}} WHERE l_shipdate >= @'1996-01-01' AND l_shipdate < @'1996-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total_revenue FROM {{supplier}}, revenue WHERE s_suppkey = supplier_no AND total_revenue = (SELECT max(total_revenue) FROM revenue) ORDER BY s_suppkey""", "lineitem supplier")
both("q16", f"""
SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM {{part}}, {{lineitem}}
WHERE p_partkey = l_partkey AND p_brand <> 'Brand#45' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9) AND l_suppkey NOT IN (SELECT s_suppkey FROM {{supplier}} WHERE s_acctbal < 0)
GROUP BY p_brand, p_type, p_size ORDER BY supplier_cnt DESC, p_brand, p_type, p_size""", "lineitem part supplier")
both("q17", f"""
SELECT {PRICE} / 7.0E0 AS avg_yearly FROM {{lineitem}} l, {{part}} WHERE p_partkey = l.l_partkey AND p_brand = 'Brand#23'
  AND l.l_quantity < (SELECT 0.6 * avg(i.l_quantity) FROM {{lineitem}} i WHERE i.l_partkey = p_partkey)""", "lineitem part")
both("q18", f"""
SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, {QUANTITY} AS quantity FROM {{customer}}, {{orders}}, {{lineitem}}
WHERE o_orderkey IN (SELECT l_orderkey FROM {{lineitem}} GROUP BY l_orderkey HAVING sum(l_quantity) > 300) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderdate, o_orderkey LIMIT 100""", "customer orders lineitem")
both("q19", f"""
SELECT {REVENUE} AS revenue FROM {{lineitem}}, {{part}} WHERE
  (p_partkey = l_partkey AND p_brand = 'Brand#12' AND p_type IN ('SMALL', 'PROMO') AND l_quantity >= 1 AND l_quantity <= 11 AND p_size BETWEEN 1 AND 15 AND l_returnflag IN ('A', 'R'))
  OR (p_partkey = l_partkey AND p_brand = 'Brand#23' AND p_type IN ('MEDIUM', 'LARGE') AND l_quantity >= 10 AND l_quantity <= 20 AND p_size BETWEEN 1 AND 30 AND l_returnflag IN ('A', 'R'))
  OR (p_partkey = l_partkey AND p_brand = 'Brand#3' AND p_type IN ('LARGE', 'ECONOMY') AND l_quantity >= 20 AND l_quantity <= 30 AND p_size BETWEEN 1 AND 45 AND l_returnflag IN ('A', 'R'))""", "lineitem part")
both("q20", f"""
SELECT s_name, s_suppkey FROM {{supplier}}, {{nation}} WHERE s_suppkey IN (SELECT ps_suppkey FROM (SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, {QUANTITY} AS ps_availqty FROM {{lineitem}}
      WHERE l_partkey IN (SELECT p_partkey FROM {{part}} WHERE p_name LIKE 'red%') GROUP BY l_partkey, l_suppkey) ps
    WHERE ps_availqty > (SELECT 0.5 * sum(l.l_quantity) FROM {{lineitem}} l WHERE l.l_partkey = ps_partkey AND l.l_suppkey = ps_suppkey AND l.l_shipdate >= @'1996-01-01' AND l.l_shipdate < @'1997-01-01'))
  AND s_nationkey = n_nationkey AND n_name IN ('NATION_3', 'NATION_4', 'NATION_9') ORDER BY s_name""", "supplier nation lineitem part")
both("q21", """
SELECT s_name, count(*) AS numwait FROM {supplier}, {lineitem} l1, {orders}, {nation} WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F' AND l1.l_returnflag = 'R'
  AND EXISTS (SELECT * FROM {lineitem} l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
  AND NOT EXISTS (SELECT * FROM {lineitem} l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R')
  AND s_nationkey = n_nationkey AND n_regionkey <> 4 GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""", "supplier lineitem orders nation")
both("q22", """
SELECT cntrycode, count(*) AS numcust, CAST(sum(CAST(c_acctbal AS DECIMAL(15,2))) AS DOUBLE) AS totacctbal FROM (
  SELECT substring(c_mktsegment FROM 1 FOR 2) AS cntrycode, c_acctbal FROM {customer}
  WHERE substring(c_mktsegment FROM 1 FOR 2) IN ('AU', 'BU', 'FU', 'MA') AND c_acctbal > (SELECT avg(c_acctbal) FROM {customer} WHERE c_acctbal > 0.00 AND substring(c_mktsegment FROM 1 FOR 2) IN ('AU', 'BU', 'FU', 'MA'))
    AND NOT EXISTS (SELECT * FROM {orders} WHERE o_custkey = c_custkey AND o_totalprice > 250000)) custsale
GROUP BY cntrycode ORDER BY cntrycode""", "customer orders")
