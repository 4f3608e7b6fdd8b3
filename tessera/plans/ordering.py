"""Sort, top-k, limit and offset, repartitioning."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query, sql, table

sql("srt_multi_key", "SELECT c_custkey, c_nationkey, c_acctbal FROM customer ORDER BY c_nationkey DESC NULLS FIRST, c_acctbal ASC NULLS LAST, c_custkey")
sql("srt_nulls_first_top", "SELECT n_nationkey, nullif(n_regionkey, 1) AS k FROM nation ORDER BY k ASC NULLS FIRST, n_nationkey LIMIT 7")
sql("srt_nulls_last_top", "SELECT n_nationkey, nullif(n_regionkey, 1) AS k FROM nation ORDER BY k DESC NULLS LAST, n_nationkey LIMIT 7")
sql("srt_expression", "SELECT p_partkey, p_size FROM part ORDER BY p_size % 7, p_partkey DESC LIMIT 50")
sql("srt_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20")
sql("lim_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 25")
sql("lim_zero", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 0")
sql("lim_beyond", "SELECT r_regionkey FROM region ORDER BY r_regionkey LIMIT 100 OFFSET 3")


@query("SELECT l_orderkey, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45")
def par_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_partkey", "l_quantity")
    return lines.repartition("l_orderkey").sortWithinPartitions("l_orderkey")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_orderstatus = 'F'")
def par_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey").repartition(8)


@query("SELECT n_nationkey FROM nation")
def par_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select("n_nationkey").repartition(4).coalesce(1)


@query("SELECT c_custkey, c_acctbal FROM customer")
def par_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return customer.repartitionByRange(8, F.col("c_acctbal").asc_nulls_last()).sortWithinPartitions("c_acctbal")
