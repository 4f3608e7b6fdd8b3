"""Semantics that are easy to get wrong, and the plans that the queries must have."""

import pytest
from pyspark.sql import functions as F

from tessera import catalogue
from tessera.functions import concat_or_empty, gcd, int_div, lcm, sort_key, trunc_number


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (None, "d")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (None, "y"), (3, "z")], "k int, w string")
    left.createOrReplaceTempView("nulls_l")
    right.createOrReplaceTempView("nulls_r")
    return left, right


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_null_keys_never_match(sides):
    left, right = sides
    assert left.join(right, "k").count() == 2
    assert left.join(right, left["k"].eqNullSafe(right["k"])).count() == 3


def test_semi_and_anti_split_the_left_side(sides):
    left, right = sides
    assert left.join(right, "k", "left_semi").count() + left.join(right, "k", "left_anti").count() == left.count()


def test_not_in_with_null_is_empty(spark, sides):
    assert spark.sql("SELECT v FROM nulls_l WHERE k NOT IN (SELECT k FROM nulls_r)").count() == 0


def test_left_join_residual_keeps_unmatched_rows(spark, sides):
    assert spark.sql("SELECT v FROM nulls_l l LEFT JOIN nulls_r r ON l.k = r.k AND r.w = 'none'").count() == 4


def test_range_frame_takes_peers_together(spark):
    df = spark.sql("SELECT o, sum(v) OVER (ORDER BY o) AS r FROM VALUES (1, 1), (1, 1), (2, 2) AS t(o, v)")
    assert sorted(r["r"] for r in df.collect()) == [2, 2, 4]


def test_limit_zero_and_empty_aggregates(spark):
    assert spark.range(5).limit(0).count() == 0
    row = spark.range(0).agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("s")).first()
    assert (row["n"], row["s"]) == (0, None)


def test_helpers(spark):
    row = spark.sql("SELECT -7L AS a, 2L AS b, 0L AS z, CAST(NULL AS STRING) AS n, 'x' AS x, -3.789D AS d, 84L AS p, 36L AS q").select(
        int_div(F.col("a"), F.col("b")).alias("div"), int_div(F.col("a"), F.col("z")).alias("by_zero"),
        concat_or_empty(F.col("n"), F.col("x")).alias("c"), trunc_number(F.col("d"), 2).alias("t"),
        gcd(F.col("p"), F.col("q")).alias("g"), lcm(F.col("p"), F.col("q")).alias("l"), lcm(F.col("p"), F.col("z")).alias("l0"),
    ).first()
    assert (row["div"], row["by_zero"], row["c"], row["t"], row["g"], row["l"], row["l0"]) == (-3, None, "x", -3.78, 12, 252, 0)


def test_sort_key_defaults(spark):
    df = spark.createDataFrame([(1,), (None,), (2,)], "k int")
    assert [r["k"] for r in df.orderBy(sort_key("k")).collect()] == [1, 2, None]
    assert [r["k"] for r in df.orderBy(sort_key("k", descending=True)).collect()] == [None, 2, 1]


@pytest.mark.parametrize(("name", "parts"), [
    ("joi_mark", ["ExistenceJoin"]),
    ("prd_not_in_subquery", ["LeftAnti", "true)"]),
    ("srt_top_k", ["TakeOrderedAndProject"]),
    ("win_rank_top", ["WindowGroupLimit"]),
    ("src_pushed_range", ["PushedFilters: [IsNotNull(o_orderdate)", "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double,o_orderdate"]),
    ("fil_filter", ["GreaterThan(c_acctbal,5000.0)"]),
    ("agg_rollup", ["Expand"]),
    ("joi_sort_merge", ["SortMergeJoin"]),
    ("joi_shuffled_hash", ["ShuffledHashJoin"]),
    ("joi_theta_left", ["BroadcastNestedLoopJoin"]),
])
def test_plan(name, parts, spark, sf_dir):
    plan = catalogue.queries()[name](spark, sf_dir)._jdf.queryExecution().toString()
    for part in parts:
        assert part in plan, plan[-3000:]


def test_no_python_in_catalogue_plans(spark, sf_dir):
    for name, query in catalogue.queries().items():
        plan = plan_of(query(spark, sf_dir))
        assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan, name


def test_results_do_not_depend_on_partitions(spark, sf_dir):
    query = catalogue.queries()["q5_local_supplier"]
    kept, found = spark.conf.get("spark.sql.shuffle.partitions"), []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        found.append(sorted(query(spark, sf_dir).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", kept)
    assert found[0] == found[1]


def test_large_integers_keep_every_digit(spark):
    rows = spark.createDataFrame([(9007199254740993, 1, 3037000493, 3037000499)], "a long, b long, p long, q long")
    found = rows.select(int_div(F.col("a"), F.col("b")).alias("d"), lcm(F.col("p"), F.col("q")).alias("l")).first()
    assert found["d"] == 9007199254740993 and found["l"] == 3037000493 * 3037000499


def test_pairs_of_one_group_come_from_many_tasks(spark, tmp_path):
    """Keys recur across the bounds of blocks, and rows with a null part match nothing."""
    group = spark.range(6000).selectExpr("id DIV 3 AS c_custkey", "1 AS c_nationkey", "'A' AS c_mktsegment")
    nulls = spark.sql("SELECT * FROM VALUES (1L, null, 'A'), (2L, null, 'A'), (3L, 1, null), (4L, 1, null), (null, 1, 'A') AS t(c_custkey, c_nationkey, c_mktsegment)")
    customer = group.union(nulls).coalesce(1)
    customer.write.parquet(str(tmp_path / "customer.parquet"))
    digest = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a_key", "b_key").cast("decimal(38, 0)")).alias("h")]
    found = catalogue.queries()["joi_self"](spark, str(tmp_path))
    tasks = found.groupBy(F.spark_partition_id()).agg(*digest).collect()
    spark.read.parquet(str(tmp_path / "customer.parquet")).createOrReplaceTempView("customer")
    wanted = spark.sql(catalogue.oracle_sql()["joi_self"]).agg(*digest).first()
    assert wanted["n"] == 9 * 2000 * 1999 // 2
    assert (sum(t["n"] for t in tasks), sum(t["h"] for t in tasks)) == tuple(wanted)
    assert max(t["n"] for t in tasks) <= wanted["n"] / 3


def test_sketch_is_kept_for_the_table_not_for_each_key(spark, sf_dir):
    plan = plan_of(catalogue.queries()["agg_approx_distinct"](spark, sf_dir))
    grouped = [line for line in plan.split("\n") if "Aggregate(keys=[" in line and "keys=[]" not in line]
    assert grouped and not any("approx_count_distinct" in line for line in grouped), plan


def test_sketch_of_distinct_keys_is_that_of_all_rows(spark):
    rows = spark.range(50_000, numPartitions=5).select(F.when(F.col("id") % 11 > 0, F.pmod(F.hash("id"), F.lit(9000))).cast("long").alias("k"))
    counts = [F.approx_count_distinct("k", 0.02), F.count_distinct("k")]
    assert rows.select(*counts).first() == rows.distinct().select(*counts).first()
