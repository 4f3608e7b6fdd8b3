"""Filters and predicates."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query, sql, table

sql("fil_filter", "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 5000")
sql("fil_fused_projection", "SELECT p_name, p_partkey FROM part WHERE p_size < 10 AND p_retailprice > 950")
for _name, _op in {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}.items():
    sql(f"prd_{_name}", f"SELECT p_partkey FROM part WHERE p_size {_op} 20")
sql("prd_and_or_not", "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_nationkey = 3) AND NOT c_acctbal < 0")
sql("prd_three_valued", "SELECT n_nationkey, (CASE WHEN n_nationkey > 12 THEN NULL ELSE n_nationkey END > 5 AND n_regionkey = 1) AS v FROM nation")
sql("prd_is_null", "SELECT n_nationkey, nullif(n_regionkey, 2) IS NULL AS gone, nullif(n_regionkey, 2) IS NOT NULL AS here FROM nation")
sql("prd_distinct_from", "SELECT n_nationkey, nullif(n_regionkey, 2) IS DISTINCT FROM nullif(n_regionkey, 3) AS differs, nullif(n_regionkey, 2) IS NOT DISTINCT FROM nullif(n_nationkey, 2) AS same FROM nation")
sql("prd_in_list", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
sql("prd_in_long_list", "SELECT o_orderkey FROM orders WHERE o_custkey IN (1, 2, 3, 5, 8, 13, 21, 34, 55, 89, 144, 233, 377)")
sql("prd_not_in_list", "SELECT n_name FROM nation WHERE n_regionkey NOT IN (0, 4)")
sql("prd_between", "SELECT p_partkey, p_size FROM part WHERE p_size BETWEEN 10 AND 15")
sql("prd_like", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%A%' AND p_name NOT LIKE '_e% ri%'")
sql("prd_ilike", "SELECT n_name FROM nation WHERE n_name ILIKE 'nation__'")
sql("prd_exists", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
sql("prd_not_exists", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
sql("prd_in_subquery", "SELECT s_suppkey FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
sql("prd_not_in_subquery", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 9000)")
sql("prd_not_in_with_null", "SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT nullif(r_regionkey, 3) FROM region) OR n_regionkey = 2")
sql("prd_scalar_subquery", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) * 1.5 FROM customer)")
sql("prd_correlated_scalar", "SELECT l_orderkey, l_partkey, l_quantity FROM lineitem a WHERE l_quantity < (SELECT 0.2 * avg(l_quantity) FROM lineitem b WHERE b.l_partkey = a.l_partkey)")
sql("prd_correlated_count", "SELECT c_custkey FROM customer WHERE (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000) = 0")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0 AND s_nationkey IN (1, 2, 3)")
def fil_dataframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").where((F.col("s_acctbal") > 0) & F.col("s_nationkey").isin(1, 2, 3)).select("s_suppkey", "s_name")
