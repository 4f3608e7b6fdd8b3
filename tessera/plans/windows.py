"""Window functions. Every order is total, so that ties can't make a result ambiguous, unless peers are the point."""

from ..catalogue import sql

sql("win_partition_aggregates", "SELECT c_custkey, round(sum(c_acctbal) OVER w, 2) AS s, round(avg(c_acctbal) OVER w, 4) AS a, min(c_acctbal) OVER w AS lo, max(c_acctbal) OVER w AS hi, count(*) OVER w AS n FROM customer WINDOW w AS (PARTITION BY c_nationkey)")
sql("win_running_rows", "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS running FROM orders")
sql("win_range_peers", "SELECT n_nationkey, CAST(sum(n_nationkey) OVER (ORDER BY n_regionkey NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS r, CAST(sum(n_nationkey) OVER (ORDER BY n_regionkey NULLS LAST, n_nationkey NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS w FROM nation")
sql("win_rank", "SELECT s_suppkey, CAST(rank() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC NULLS LAST) AS BIGINT) AS r FROM supplier")
sql("win_rank_top", "SELECT * FROM (SELECT c_custkey, c_nationkey, CAST(rank() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC NULLS LAST, c_custkey) AS BIGINT) AS r FROM customer) t WHERE r <= 3")
sql("win_row_number", "SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS BIGINT) AS n FROM orders")
sql("win_dense_rank", "SELECT p_partkey, CAST(dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS BIGINT) AS d FROM part")
sql("win_ntile", "SELECT c_custkey, CAST(ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS BIGINT) AS q FROM customer")
sql("win_lag_lead", "SELECT event_id, lag(event_id) OVER w AS before, lead(event_id, 2) OVER w AS after, lag(event_id, 1, -1) OVER w AS with_default FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
sql("win_first_last_nth", "SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS s FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)")
sql("win_percent_cume", "SELECT s_suppkey, round(percent_rank() OVER w, 6) AS p, round(cume_dist() OVER w, 6) AS c FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey)")
sql("win_count_nulls", "SELECT n_nationkey, count(*) OVER (PARTITION BY n_regionkey) AS all_rows, count(nullif(n_nationkey, 3)) OVER (PARTITION BY n_regionkey) AS not_null FROM nation")
sql("win_over_aggregate", "SELECT c_nationkey, c_mktsegment, round(sum(c_acctbal) * 100 / sum(sum(c_acctbal)) OVER (PARTITION BY c_nationkey), 4) AS share FROM customer GROUP BY c_nationkey, c_mktsegment")
sql("win_sliding", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 6) AS a FROM events")
sql("win_range_offset", "SELECT p_partkey, count(*) OVER (PARTITION BY p_brand ORDER BY p_size RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS near FROM part")
sql("win_computed_key", "SELECT o_orderkey, count(*) OVER (PARTITION BY CASE WHEN o_totalprice > 200000 THEN 'big' ELSE 'small' END, o_orderstatus) AS n FROM orders")
sql("win_sessions", "SELECT user_id, session, count(*) AS n, min(ts) AS started FROM (SELECT *, CAST(sum(CASE WHEN gap THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (SELECT *, coalesce(ts > lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL '6' HOUR, false) AS gap FROM events) a) b GROUP BY user_id, session")
