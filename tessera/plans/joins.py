"""Joins."""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..catalogue import query, sql, table

#: Keys of a block in joi_self; two blocks give BLOCK * BLOCK pairs at most.
BLOCK = 1024

sql("joi_inner", "SELECT n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
sql("joi_left", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 350000")
sql("joi_right", "SELECT o_orderkey, c_custkey FROM (SELECT * FROM orders WHERE o_totalprice > 350000) o RIGHT JOIN customer ON o_custkey = c_custkey")
sql("joi_full", "SELECT a.s_suppkey AS a_key, b.s_suppkey AS b_key FROM (SELECT * FROM supplier WHERE s_acctbal > 0) a FULL JOIN (SELECT * FROM supplier WHERE s_nationkey < 12) b ON a.s_suppkey = b.s_suppkey")
sql("joi_semi", "SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49)", "SELECT o_orderkey FROM orders LEFT SEMI JOIN (SELECT * FROM lineitem WHERE l_quantity > 49) l ON l_orderkey = o_orderkey")
sql("joi_anti", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 10)", "SELECT o_orderkey FROM orders LEFT ANTI JOIN (SELECT * FROM lineitem WHERE l_quantity > 10) l ON l_orderkey = o_orderkey")
sql("joi_semi_residual", "SELECT a.l_orderkey, a.l_suppkey, a.l_linenumber FROM lineitem a WHERE EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)")
sql("joi_anti_residual", "SELECT a.l_orderkey, a.l_suppkey, a.l_linenumber FROM lineitem a WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)")
sql("joi_mark", "SELECT n_nationkey FROM nation WHERE n_nationkey < 5 OR EXISTS (SELECT 1 FROM region WHERE r_regionkey = n_regionkey AND r_name LIKE 'A%')")
sql("joi_residual_range", "SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_shipdate BETWEEN o_orderdate AND o_orderdate + INTERVAL '20' DAY")
sql("joi_left_residual", "SELECT n_nationkey, s_suppkey FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > n_nationkey * 400")
sql("joi_cross", "SELECT r_name, n_name FROM region CROSS JOIN nation")
sql("joi_theta", "SELECT r_regionkey, n_nationkey FROM region JOIN nation ON r_regionkey < n_regionkey")
sql("joi_theta_left", "SELECT r_regionkey, n_nationkey FROM region LEFT JOIN nation ON n_nationkey > r_regionkey * 8")
sql("joi_theta_full", "SELECT r_regionkey, n_nationkey FROM region FULL JOIN nation ON n_nationkey = r_regionkey * 30 OR n_nationkey > 22")
sql("joi_null_keys", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM (SELECT *, nullif(n_regionkey, 1) AS k FROM nation) a JOIN (SELECT *, nullif(n_regionkey, 1) AS k FROM nation) b ON a.k = b.k")
sql("joi_null_safe", "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM (SELECT *, nullif(n_regionkey, 1) AS k FROM nation) a JOIN (SELECT *, nullif(n_regionkey, 1) AS k FROM nation) b ON a.k IS NOT DISTINCT FROM b.k")
sql("joi_comma", "SELECT c_name, n_name FROM customer, nation WHERE c_nationkey = n_nationkey AND c_acctbal < -900")


@query("SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey")
def joi_sort_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The merge hint keeps both sides partitioned by the key, and the aggregation reuses it."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders").select("o_orderkey")
    joined = lines.join(orders.hint("merge"), lines["l_orderkey"] == orders["o_orderkey"])
    return joined.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("q"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def joi_shuffled_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    return customer.join(orders.hint("shuffle_hash"), customer["c_custkey"] == orders["o_custkey"], "left_semi").select("c_custkey")


@query("SELECT a.c_custkey AS a_key, b.c_custkey AS b_key FROM customer a JOIN customer b ON a.c_nationkey = b.c_nationkey AND a.c_custkey < b.c_custkey AND a.c_mktsegment = b.c_mktsegment")
def joi_self(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pairs grow with the square of a group, so pairs of blocks are dealt out before they are expanded.

    A task holds two blocks at a time, and no group is bound to one task. Blocks
    follow the order of keys, so a block meets itself and later ones only; the
    comparison stays, as a key that occurs twice can end one block and begin the next.
    """
    group = ["c_nationkey", "c_mktsegment"]
    rows = table(spark, sf_dir, "customer").select(*group, "c_custkey").dropna()
    rank = F.row_number().over(Window.partitionBy(*group).orderBy("c_custkey"))
    blocks = rows.withColumn("block", F.floor((rank - 1) / BLOCK)).groupBy(*group, "block").agg(F.collect_list("c_custkey").alias("keys"))
    first, second = (blocks.select(*group, F.col("block").alias(i), F.col("keys").alias(keys)) for i, keys in (("i", "a_keys"), ("j", "b_keys")))
    units = first.join(second.hint("merge"), group).where("i <= j")
    # a given number is not coalesced: the units are small, what they expand to is not
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = units.repartition(parts, *group, "i", "j").select(F.explode("a_keys").alias("a_key"), "b_keys")
    return dealt.select("a_key", F.explode("b_keys").alias("b_key")).where("a_key < b_key")
