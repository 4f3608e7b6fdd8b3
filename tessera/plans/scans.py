"""Scans: projection, predicate and limit pushdown, several files, one-row and metadata sources."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query, sql, table

sql("src_projection", "SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 30")
sql("src_pushed_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderdate >= DATE '1997-01-01' AND o_orderdate < DATE '1997-07-01'")
sql("src_limit", "SELECT r_regionkey, r_name FROM region ORDER BY r_regionkey LIMIT 3")
sql("src_count_only", "SELECT count(*) AS n FROM lineitem")
sql("src_one_row", "SELECT 1 AS one, 'a' AS letter")
sql("prj_rename", "SELECT n_nationkey AS id, n_name AS label FROM nation")
sql("prj_expression", "SELECT o_orderkey, o_totalprice * 2 + 1 AS gross FROM orders")


@query("SELECT c_custkey AS id, c_name AS label FROM customer UNION ALL SELECT c_custkey, c_name FROM customer")
def src_several_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/customer.parquet"
    return spark.read.parquet(path, path).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("label"))


@query("SELECT count(*) AS n, count(*) FILTER (WHERE c_acctbal > 0) AS positive FROM customer")
def prj_empty_for_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_acctbal") > 0).alias("positive"))
