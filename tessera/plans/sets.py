"""Set operations, common table expressions, derived tables and views."""

from pyspark.sql import DataFrame, SparkSession

from ..catalogue import query, sql, table

sql("set_union_all", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
sql("set_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
sql("set_intersect", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 9000 INTERSECT SELECT s_nationkey FROM supplier")
sql("set_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
sql("set_intersect_all", "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
sql("set_except_all", "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
sql("set_nulls", "SELECT nullif(n_regionkey, 1) AS k FROM nation INTERSECT SELECT nullif(r_regionkey, 1) FROM region")
sql("set_widened", "SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation UNION ALL SELECT c_custkey FROM customer")
sql("cte_shared", "WITH t AS (SELECT c_nationkey, round(sum(c_acctbal), 2) AS s FROM customer GROUP BY c_nationkey) SELECT a.c_nationkey AS x, b.c_nationkey AS y FROM t a JOIN t b ON a.s < b.s")
sql("cte_chain", "WITH a AS (SELECT * FROM orders WHERE o_totalprice > 200000), b AS (SELECT o_custkey, count(*) AS n FROM a GROUP BY o_custkey) SELECT n, count(*) AS customers FROM b GROUP BY n")
sql("sub_derived", "SELECT n, count(*) AS customers FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) t GROUP BY n")
sql("cte_values", "SELECT k, v FROM (VALUES (1, 'a'), (2, NULL), (NULL, 'c')) AS t(k, v)")


@query("""
    WITH revenue AS (SELECT l_suppkey, round(CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE), 4) AS total FROM lineitem
                     WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
    SELECT s_suppkey, s_name, total FROM supplier JOIN revenue ON s_suppkey = l_suppkey WHERE total = (SELECT max(total) FROM revenue)""")
def view_top_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    for t in ("lineitem", "supplier"):
        table(spark, sf_dir, t).createOrReplaceTempView(t)
    spark.sql("""
        SELECT l_suppkey, round(CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE), 4) AS total FROM lineitem
        WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey""").createOrReplaceTempView("revenue")
    return spark.sql("SELECT s_suppkey, s_name, total FROM supplier JOIN revenue ON s_suppkey = l_suppkey WHERE total = (SELECT max(total) FROM revenue)")
