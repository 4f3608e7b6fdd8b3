"""Aggregation."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalogue import query, sql, table

sql("agg_count_star", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY c_mktsegment")
sql("agg_count_column", "SELECT n_regionkey, count(nullif(n_nationkey, 7)) AS n FROM nation GROUP BY n_regionkey")
sql("agg_sum", "SELECT c_nationkey, round(sum(c_acctbal), 2) AS s FROM customer GROUP BY c_nationkey")
sql("agg_min_max", "SELECT o_orderpriority, min(o_totalprice) AS lo, max(o_totalprice) AS hi, min(o_orderdate) AS first, max(o_orderdate) AS last FROM orders GROUP BY o_orderpriority")
sql("agg_avg", "SELECT p_brand, round(avg(p_retailprice), 4) AS a FROM part GROUP BY p_brand")
sql("agg_expression", "SELECT l_suppkey, round(CAST(sum(CAST(l_extendedprice * (1 - l_discount) AS DECIMAL(18, 4))) AS DOUBLE), 4) AS revenue, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS returned FROM lineitem GROUP BY l_suppkey")
sql("agg_global", "SELECT count(*) AS n, round(sum(l_tax), 4) AS s, round(avg(l_discount), 6) AS a FROM lineitem")
sql("agg_global_empty", "SELECT count(*) AS n, sum(l_tax) AS s, max(l_partkey) AS m FROM lineitem WHERE l_quantity < 0")
sql("agg_decimal", "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(15, 2))) AS DECIMAL(25, 2)) AS s, round(CAST(avg(CAST(l_quantity AS DECIMAL(15, 2))) AS DOUBLE), 4) AS a FROM lineitem GROUP BY l_returnflag")
sql("agg_distinct_rows", "SELECT DISTINCT p_brand, p_size FROM part")
sql("agg_count_distinct", "SELECT event_type, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
sql("agg_distinct_mixed", "SELECT event_type, count(DISTINCT user_id) AS users, count(*) AS n, round(sum(value), 2) AS s, count(DISTINCT CAST(ts AS DATE)) AS days FROM events GROUP BY event_type")
sql("agg_rollup", "SELECT r_name, n_name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
sql("agg_cube", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
sql("agg_grouping_sets", "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())")
sql("agg_grouping", "SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INT) AS g1, CAST(grouping(o_orderpriority) AS INT) AS g2, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
sql("agg_stddev", "SELECT event_type, round(stddev_samp(value), 4) AS sd, round(var_samp(value), 2) AS vs, round(stddev_pop(value), 4) AS sp FROM events GROUP BY event_type")
sql("agg_having", "SELECT l_orderkey, sum(l_quantity) AS q FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 200")
sql("agg_filter", "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, round(sum(o_totalprice) FILTER (WHERE o_totalprice > 100000), 2) AS big FROM orders GROUP BY o_orderpriority")
sql("agg_median_corr", "SELECT p_brand, median(p_retailprice) AS m, round(corr(p_size, p_retailprice), 4) AS c FROM part GROUP BY p_brand")
sql("agg_bool", "SELECT c_nationkey, bool_and(c_acctbal > -1000) AS all_of, bool_or(c_acctbal > 9900) AS any_of FROM customer GROUP BY c_nationkey")
sql("agg_array", "SELECT n_regionkey, array_to_string(list_sort(list(n_name)), '|') AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, array_join(sort_array(collect_list(n_name)), '|') AS names FROM nation GROUP BY n_regionkey")
sql("agg_two_level", "SELECT n, count(*) AS customers FROM (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) t GROUP BY n")


@query("SELECT l_partkey, count(*) AS n, round(sum(l_quantity), 2) AS q FROM lineitem GROUP BY l_partkey")
def agg_salted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stages over a salted key: partial results of a hot key meet only as 16 rows."""
    lines = table(spark, sf_dir, "lineitem").withColumn("salt", F.pmod("l_orderkey", F.lit(16)))
    parts = lines.groupBy("l_partkey", "salt").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("q"))
    return parts.groupBy("l_partkey").agg(F.sum("n").alias("n"), F.round(F.sum("q"), 2).alias("q"))


@query("SELECT event_type, CAST(sum(CASE WHEN user_id < 50 THEN 1 ELSE 0 END) AS BIGINT) AS low, CAST(sum(CASE WHEN user_id >= 50 THEN 1 ELSE 0 END) AS BIGINT) AS high FROM events GROUP BY event_type")
def agg_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    side = F.when(F.col("user_id") < 50, "low").otherwise("high")
    events = table(spark, sf_dir, "events").withColumn("side", side)
    return events.groupBy("event_type").pivot("side", ["low", "high"]).count().na.fill(0)
sql("agg_percentile", "SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.9), 6) AS p, round(median(l_quantity), 6) AS m FROM lineitem GROUP BY l_returnflag",
    "SELECT l_returnflag, round(percentile(l_extendedprice, 0.9), 6) AS p, round(median(l_quantity), 6) AS m FROM lineitem GROUP BY l_returnflag")
sql("agg_string_agg", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS s FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS s FROM nation GROUP BY n_regionkey")
sql("agg_first_last", "SELECT o_custkey, arg_min(o_orderkey, o_orderkey) AS f, arg_max(o_orderkey, o_orderkey) AS l FROM orders GROUP BY o_custkey",
    "SELECT o_custkey, min_by(o_orderkey, o_orderkey) AS f, max_by(o_orderkey, o_orderkey) AS l FROM orders GROUP BY o_custkey")
sql("agg_covariance", "SELECT l_returnflag, round(covar_pop(l_quantity, l_extendedprice), 2) AS c, round(regr_slope(l_extendedprice, l_quantity), 4) AS s FROM lineitem GROUP BY l_returnflag")
# a value's repeats change no sketch, so both counts read the distinct keys; beside count(DISTINCT), Spark would keep a sketch of 3 KB for each key
sql("agg_approx_distinct", "SELECT true AS near", "SELECT abs(approx_count_distinct(k, 0.02) - count(k)) <= 0.1 * count(k) AS near FROM (SELECT DISTINCT o_custkey AS k FROM orders) t")
sql("agg_decimal_global", "SELECT sum(CAST(c_acctbal AS DECIMAL(15, 2))) AS s, CAST(count(*) AS BIGINT) AS n FROM customer", "SELECT CAST(sum(CAST(c_acctbal AS DECIMAL(15, 2))) AS DECIMAL(38, 2)) AS s, count(*) AS n FROM customer")
sql("agg_decimal_global_empty", "SELECT sum(CAST(c_acctbal AS DECIMAL(15, 2))) AS s, avg(c_acctbal) AS a FROM customer WHERE c_custkey < 0", "SELECT CAST(sum(CAST(c_acctbal AS DECIMAL(15, 2))) AS DECIMAL(38, 2)) AS s, avg(c_acctbal) AS a FROM customer WHERE c_custkey < 0")
