"""Star-schema questions over the driver's tables, end to end."""

from ..catalogue import sql

sql("q2_best_supplier", """
    SELECT s_suppkey, s_name, n_name, p_partkey FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem) l
    JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey
    JOIN region ON r_regionkey = n_regionkey
    WHERE p_size = 15 AND r_name = 'EUROPE' AND s_acctbal = (
      SELECT max(s2.s_acctbal) FROM lineitem l2 JOIN supplier s2 ON s2.s_suppkey = l2.l_suppkey WHERE l2.l_partkey = p_partkey)
    ORDER BY p_partkey, s_suppkey LIMIT 100""")
sql("q3_shipping_priority", """
    SELECT l_orderkey, round(CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE), 4) AS revenue, CAST(o_orderdate AS DATE) AS day
    FROM customer, orders, lineitem WHERE c_mktsegment = 'BUILDING' AND c_custkey = o_custkey AND l_orderkey = o_orderkey
      AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15'
    GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC NULLS LAST, l_orderkey LIMIT 10""")
sql("q4_order_priority", """
    SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01'
      AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 40) GROUP BY o_orderpriority""")
sql("q5_local_supplier", """
    SELECT n_name, round(CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE), 4) AS revenue FROM customer, orders, lineitem, supplier, nation, region
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND l_suppkey = s_suppkey AND c_nationkey = s_nationkey
      AND s_nationkey = n_nationkey AND n_regionkey = r_regionkey AND r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01'
      AND o_orderdate < DATE '1997-01-01' GROUP BY n_name""")
sql("q6_forecast_revenue", """
    SELECT round(CAST(sum(CAST(l_extendedprice * l_discount AS DECIMAL(18, 4))) AS DOUBLE), 4) AS revenue FROM lineitem
    WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
sql("q7_volume_shipping", """
    SELECT supp_nation, cust_nation, l_year, round(CAST(sum(CAST(volume AS DECIMAL(18, 4))) AS DOUBLE), 4) AS revenue FROM (
      SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS l_year, l_extendedprice * (1 - l_discount) AS volume
      FROM supplier, lineitem, orders, customer, nation n1, nation n2
      WHERE s_suppkey = l_suppkey AND o_orderkey = l_orderkey AND c_custkey = o_custkey AND s_nationkey = n1.n_nationkey AND c_nationkey = n2.n_nationkey
        AND n1.n_regionkey = 1 AND n2.n_regionkey = 2) t
    GROUP BY supp_nation, cust_nation, l_year""")
sql("q8_market_share", """
    SELECT o_year, round(sum(CASE WHEN nation_name = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 6) AS share FROM (
      SELECT CAST(year(o_orderdate) AS INT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation_name
      FROM part, supplier, lineitem, orders, customer, nation n1, nation n2, region
      WHERE p_partkey = l_partkey AND s_suppkey = l_suppkey AND l_orderkey = o_orderkey AND o_custkey = c_custkey AND c_nationkey = n1.n_nationkey
        AND n1.n_regionkey = r_regionkey AND r_name = 'EUROPE' AND s_nationkey = n2.n_nationkey AND p_size < 25) t GROUP BY o_year""")
sql("q9_profit", """
    SELECT n_name, CAST(year(o_orderdate) AS INT) AS o_year, round(CAST(sum(CAST(l_extendedprice * (1 - l_discount) - p_retailprice * l_quantity * 0.1 AS DECIMAL(18, 4))) AS DOUBLE), 4) AS profit
    FROM part, supplier, lineitem, orders, nation
    WHERE s_suppkey = l_suppkey AND p_partkey = l_partkey AND o_orderkey = l_orderkey AND s_nationkey = n_nationkey AND p_name LIKE '%ring%'
    GROUP BY n_name, year(o_orderdate)""")
sql("q10_returned_items", """
    SELECT c_custkey, c_name, round(CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE), 4) AS revenue, n_name FROM customer, orders, lineitem, nation
    WHERE c_custkey = o_custkey AND l_orderkey = o_orderkey AND o_orderdate >= DATE '1996-10-01' AND o_orderdate < DATE '1997-01-01'
      AND l_returnflag = 'R' AND c_nationkey = n_nationkey GROUP BY c_custkey, c_name, n_name ORDER BY revenue DESC NULLS LAST, c_custkey LIMIT 20""")
sql("q11_important_parts", """
    SELECT l_partkey, round(sum(l_extendedprice), 2) AS value FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey < 8
    GROUP BY l_partkey HAVING sum(l_extendedprice) > (
      SELECT sum(l_extendedprice) * 0.0012 FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE s_nationkey < 8)""")
sql("q12_line_priority", """
    SELECT l_linestatus, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high,
           CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low
    FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' GROUP BY l_linestatus""")
sql("q13_customer_distribution", """
    SELECT c_count, count(*) AS custdist FROM (
      SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT OUTER JOIN orders ON c_custkey = o_custkey AND o_orderpriority NOT LIKE '%URGENT%'
      GROUP BY c_custkey) t GROUP BY c_count""")
sql("q14_promotion_effect", """
    SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'P%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS share
    FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-12-01'""",
    """
    SELECT round(100 * sum(CASE WHEN p_type LIKE 'P%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END) / sum(l_extendedprice * (1 - l_discount)), 6) AS share
    FROM lineitem, part WHERE l_partkey = p_partkey AND l_shipdate >= DATE '1996-09-01' AND l_shipdate < DATE '1996-12-01'""")
sql("q16_supplier_relationship", """
    SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS suppliers FROM lineitem, part
    WHERE p_partkey = l_partkey AND p_size IN (1, 5, 9, 14, 23, 36, 45, 49) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0)
    GROUP BY p_brand, p_type, p_size""")
sql("q17_small_quantity", """
    SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_size < 10
      AND l_quantity < (SELECT 0.4 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)""",
    """
    SELECT round(sum(l_extendedprice) / 7, 2) AS avg_yearly FROM lineitem, part WHERE p_partkey = l_partkey AND p_size < 10
      AND l_quantity < (SELECT 0.4 * avg(l_quantity) FROM lineitem WHERE l_partkey = p_partkey)""")
sql("q18_large_orders", """
    SELECT c_name, c_custkey, o_orderkey, round(o_totalprice, 2) AS price, sum(l_quantity) AS q FROM customer, orders, lineitem
    WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250) AND c_custkey = o_custkey AND o_orderkey = l_orderkey
    GROUP BY c_name, c_custkey, o_orderkey, o_totalprice ORDER BY price DESC NULLS LAST, o_orderkey LIMIT 100""")
sql("q19_disjunction", """
    SELECT round(CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE), 4) AS revenue FROM lineitem, part WHERE p_partkey = l_partkey AND (
      (p_size BETWEEN 1 AND 5 AND l_quantity BETWEEN 1 AND 11) OR (p_size BETWEEN 6 AND 15 AND l_quantity BETWEEN 10 AND 20)
      OR (p_size BETWEEN 16 AND 30 AND l_quantity BETWEEN 20 AND 30 AND l_returnflag IN ('A', 'R')))""")
sql("q20_part_promotion", """
    SELECT s_name FROM supplier, nation WHERE s_nationkey = n_nationkey AND n_regionkey IN (0, 3) AND s_suppkey IN (
      SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'red%')
      GROUP BY l_suppkey, l_partkey HAVING sum(l_quantity) > (SELECT avg(l_quantity) FROM lineitem))""")
sql("q21_waiting_suppliers", """
    SELECT s_name, count(*) AS numwait FROM supplier, lineitem l1, orders WHERE s_suppkey = l1.l_suppkey AND o_orderkey = l1.l_orderkey AND o_orderstatus = 'F'
      AND l1.l_quantity > 25 AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
      AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_quantity > 25)
    GROUP BY s_name ORDER BY numwait DESC NULLS LAST, s_name LIMIT 100""")
sql("q22_sales_opportunity", """
    SELECT c_nationkey, count(*) AS n, round(sum(c_acctbal), 2) AS total FROM customer
    WHERE c_nationkey IN (1, 3, 5, 7, 9, 11, 13) AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)
      AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000) GROUP BY c_nationkey""")
sql("q1_pricing_summary", """
    SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
           round(CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE), 4) AS sum_disc_price, round(avg(l_quantity), 4) AS avg_qty, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= DATE '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag NULLS LAST, l_linestatus NULLS LAST""")
sql("q51_cumulative_full_join", """
    WITH a AS (SELECT user_id, CAST(ts AS DATE) AS d, sum(value) AS v FROM events WHERE event_type = 'purchase' GROUP BY user_id, CAST(ts AS DATE)),
         b AS (SELECT user_id, CAST(ts AS DATE) AS d, sum(value) AS v FROM events WHERE event_type = 'view' GROUP BY user_id, CAST(ts AS DATE))
    SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.d, b.d) AS d,
           round(sum(a.v) OVER (PARTITION BY coalesce(a.user_id, b.user_id) ORDER BY coalesce(a.d, b.d) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS bought,
           round(sum(b.v) OVER (PARTITION BY coalesce(a.user_id, b.user_id) ORDER BY coalesce(a.d, b.d) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS viewed
    FROM a FULL OUTER JOIN b ON a.user_id = b.user_id AND a.d = b.d""")
sql("q67_ranked_rollup", """
    SELECT * FROM (SELECT n_regionkey, n_name, c_mktsegment, s, CAST(rank() OVER (PARTITION BY n_regionkey ORDER BY s DESC NULLS LAST, n_name NULLS FIRST, c_mktsegment NULLS FIRST) AS BIGINT) AS rk FROM (
      SELECT n_regionkey, n_name, c_mktsegment, round(sum(c_acctbal), 2) AS s FROM customer JOIN nation ON n_nationkey = c_nationkey
      GROUP BY ROLLUP (n_regionkey, n_name, c_mktsegment)) t) u WHERE rk <= 10""")
