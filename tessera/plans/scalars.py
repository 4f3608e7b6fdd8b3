"""Expressions and scalar functions."""

from ..catalogue import sql

sql("exp_arithmetic", "SELECT o_orderkey, o_orderkey + 1 AS a, o_orderkey - 2 AS b, o_orderkey * 3 AS c, o_orderkey % 7 AS d, -o_orderkey AS e FROM orders")
sql("exp_int_division", "SELECT o_orderkey, CAST(o_orderkey // 7 AS BIGINT) AS q FROM orders", "SELECT o_orderkey, CAST(o_orderkey div 7 AS BIGINT) AS q FROM orders")
sql("exp_bitwise", "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 5 AS o, xor(o_orderkey, 9) AS x, (o_orderkey % 1000) << 2 AS l, o_orderkey >> 1 AS r FROM orders",
    "SELECT o_orderkey, o_orderkey & 12 AS a, o_orderkey | 5 AS o, o_orderkey ^ 9 AS x, shiftleft(o_orderkey % 1000, 2) AS l, shiftright(o_orderkey, 1) AS r FROM orders")
sql("exp_concat", "SELECT n_nationkey, n_name || '-' || CAST(n_regionkey AS VARCHAR) AS s, nullif(n_name, 'NATION_6') || 'x' AS t FROM nation",
    "SELECT n_nationkey, n_name || '-' || CAST(n_regionkey AS STRING) AS s, nullif(n_name, 'NATION_6') || 'x' AS t FROM nation")
sql("exp_case", "SELECT p_partkey, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' END AS c, CASE p_size % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' ELSE 'c' END AS v FROM part")
sql("exp_cast", "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) - CAST(round(o_totalprice) AS BIGINT) = 0 OR true AS whole, CAST(floor(o_totalprice) AS BIGINT) AS b, CAST(o_orderkey AS DOUBLE) AS d, CAST(CAST(o_orderkey AS VARCHAR) AS BIGINT) AS back, CAST(o_orderdate AS DATE) AS day FROM orders",
    "SELECT o_orderkey, CAST(o_totalprice AS BIGINT) - CAST(round(o_totalprice) AS BIGINT) = 0 OR true AS whole, CAST(floor(o_totalprice) AS BIGINT) AS b, CAST(o_orderkey AS DOUBLE) AS d, CAST(CAST(o_orderkey AS STRING) AS BIGINT) AS back, CAST(o_orderdate AS DATE) AS day FROM orders")
sql("exp_try_cast", "SELECT n_nationkey, TRY_CAST(n_name AS INT) AS i, TRY_CAST('12' AS INT) AS j FROM nation")
sql("exp_decimal", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_extendedprice AS DECIMAL(15, 2)) * CAST(l_discount AS DECIMAL(15, 2)) AS DECIMAL(31, 4)) AS m, CAST(CAST(l_extendedprice AS DECIMAL(15, 2)) + CAST(l_tax AS DECIMAL(10, 4)) AS DECIMAL(18, 4)) AS p, CAST(floor(CAST(CAST(l_extendedprice AS DECIMAL(15, 2)) AS DOUBLE) / CAST(CAST(l_quantity AS DECIMAL(15, 2)) AS DOUBLE)) AS BIGINT) AS q FROM lineitem")
sql("fn_date_parts", "SELECT event_id, CAST(year(ts) AS INT) AS y, CAST(month(ts) AS INT) AS mo, CAST(day(ts) AS INT) AS d, CAST(hour(ts) AS INT) AS h, CAST(minute(ts) AS INT) AS mi, CAST(floor(second(ts)) AS INT) AS s, CAST(quarter(ts) AS INT) AS q, CAST(dayofyear(ts) AS INT) AS doy FROM events")
sql("fn_extract", "SELECT o_orderkey, CAST(EXTRACT(YEAR FROM o_orderdate) AS INT) AS y, CAST(EXTRACT(MONTH FROM o_orderdate) AS INT) AS m, CAST(EXTRACT(DAY FROM o_orderdate) AS INT) AS d FROM orders")
sql("fn_day_of_week", "SELECT o_orderkey, CAST(dayofweek(o_orderdate) AS INT) AS dow FROM orders", "SELECT o_orderkey, CAST(dayofweek(o_orderdate) - 1 AS INT) AS dow FROM orders")
sql("fn_date_trunc", "SELECT event_id, CAST(date_trunc('month', ts) AS TIMESTAMP) AS m, CAST(date_trunc('hour', ts) AS TIMESTAMP) AS h FROM events",
    "SELECT event_id, CAST(date_trunc('month', ts) AS TIMESTAMP_NTZ) AS m, CAST(date_trunc('hour', ts) AS TIMESTAMP_NTZ) AS h FROM events")
sql("fn_date_interval", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL '90' DAY AS DATE) AS a, CAST(CAST(o_orderdate AS DATE) - INTERVAL '1' MONTH AS DATE) AS b, CAST(o_orderdate AS DATE) + 5 AS c FROM orders")
sql("fn_date_row_interval", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(CAST(l_shipdate AS DATE) + l_linenumber AS DATE) AS due FROM lineitem")
sql("fn_date_difference", "SELECT l_orderkey, l_linenumber, l_partkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS BIGINT) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "SELECT l_orderkey, l_linenumber, l_partkey, CAST(datediff(l_shipdate, o_orderdate) AS BIGINT) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
sql("fn_date_bin", "SELECT event_id, time_bucket(INTERVAL '15 minutes', ts, TIMESTAMP '2000-01-01') AS bin FROM events",
    "SELECT event_id, CAST(timestamp_seconds(unix_timestamp(CAST(ts AS TIMESTAMP)) div 900 * 900) AS TIMESTAMP_NTZ) AS bin FROM events")
sql("fn_make_date", "SELECT n_nationkey, make_date(2000 + n_nationkey, 1 + n_regionkey, 15) AS d, strftime(make_date(2000 + n_nationkey, 1 + n_regionkey, 15), '%Y/%m/%d') AS f FROM nation",
    "SELECT n_nationkey, make_date(2000 + n_nationkey, 1 + n_regionkey, 15) AS d, date_format(make_date(2000 + n_nationkey, 1 + n_regionkey, 15), 'yyyy/MM/dd') AS f FROM nation")
sql("fn_substring", "SELECT p_partkey, substring(p_name, 2, 4) AS a, substring(p_name, 3) AS b, left(p_name, 3) AS l, right(p_name, 2) AS r FROM part")
sql("fn_case_and_length", "SELECT n_nationkey, lower(n_name) AS lo, upper(lower(n_name)) AS up, CAST(length(n_name) AS BIGINT) AS n, CAST(octet_length(encode('é' || n_name)) AS BIGINT) AS bytes FROM nation",
    "SELECT n_nationkey, lower(n_name) AS lo, upper(lower(n_name)) AS up, CAST(length(n_name) AS BIGINT) AS n, CAST(octet_length('é' || n_name) AS BIGINT) AS bytes FROM nation")
sql("fn_concat_nulls", "SELECT n_nationkey, concat(nullif(n_name, 'NATION_6'), '/', n_regionkey) AS c, concat_ws('-', n_name, NULL, 'x') AS w FROM nation",
    "SELECT n_nationkey, concat_ws('', nullif(n_name, 'NATION_6'), '/', n_regionkey) AS c, concat_ws('-', n_name, NULL, 'x') AS w FROM nation")
sql("fn_coalesce", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 1), 99) AS c, ifnull(nullif(n_regionkey, 2), -1) AS i, nullif(n_regionkey, 3) AS n, greatest(n_nationkey, n_regionkey, 4) AS g, least(n_nationkey, n_regionkey, 4) AS l FROM nation")
sql("fn_nvl2", "SELECT n_nationkey, CASE WHEN nullif(n_regionkey, 1) IS NOT NULL THEN 'set' ELSE 'gone' END AS v FROM nation", "SELECT n_nationkey, nvl2(nullif(n_regionkey, 1), 'set', 'gone') AS v FROM nation")
sql("fn_abs_round", "SELECT c_custkey, abs(c_acctbal) AS a, round(c_acctbal, 1) AS r, ceil(c_acctbal) = -floor(-c_acctbal) AS mirror, CAST(ceil(c_acctbal) AS BIGINT) AS c, CAST(floor(c_acctbal) AS BIGINT) AS f, CAST(sign(c_acctbal) AS INT) AS s FROM customer")
sql("fn_math", "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS sq, round(cbrt(p_size), 6) AS cb, round(exp(p_size / 50.0), 6) AS ex, round(ln(p_retailprice), 6) AS l, round(log10(p_retailprice), 6) AS l10, round(log2(p_retailprice), 6) AS l2, round(pow(p_size, 1.5), 4) AS p FROM part",
    "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS sq, round(cbrt(p_size), 6) AS cb, round(exp(CAST(p_size AS DOUBLE) / 50), 6) AS ex, round(ln(p_retailprice), 6) AS l, round(log10(p_retailprice), 6) AS l10, round(log2(p_retailprice), 6) AS l2, round(pow(p_size, 1.5), 4) AS p FROM part")
sql("fn_trigonometry", "SELECT p_partkey, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(tan(p_size), 6) AS t, round(asin(p_size / 100.0), 9) AS a_s, round(acos(p_size / 100.0), 9) AS a_c, round(atan(p_size), 9) AS a_t, round(atan2(p_size, 7), 9) AS a2, round(sinh(p_size / 20.0), 9) AS sh, round(cosh(p_size / 20.0), 9) AS ch, round(tanh(p_size / 20.0), 9) AS th, round(degrees(p_size), 6) AS dg, round(radians(p_size), 9) AS rd FROM part",
    "SELECT p_partkey, round(sin(p_size), 9) AS s, round(cos(p_size), 9) AS c, round(tan(p_size), 6) AS t, round(asin(CAST(p_size AS DOUBLE) / 100), 9) AS a_s, round(acos(CAST(p_size AS DOUBLE) / 100), 9) AS a_c, round(atan(p_size), 9) AS a_t, round(atan2(p_size, 7), 9) AS a2, round(sinh(CAST(p_size AS DOUBLE) / 20), 9) AS sh, round(cosh(CAST(p_size AS DOUBLE) / 20), 9) AS ch, round(tanh(CAST(p_size AS DOUBLE) / 20), 9) AS th, round(degrees(p_size), 6) AS dg, round(radians(p_size), 9) AS rd FROM part")
sql("fn_hyperbolic_inverse", "SELECT p_partkey, round(asinh(p_size), 9) AS a, round(acosh(p_size + 1), 9) AS c, round(atanh(p_size / 100.0), 9) AS t FROM part",
    "SELECT p_partkey, round(asinh(p_size), 9) AS a, round(acosh(p_size + 1), 9) AS c, round(atanh(CAST(p_size AS DOUBLE) / 100), 9) AS t FROM part")
sql("fn_trunc_number", "SELECT c_custkey, trunc(c_acctbal) AS t, round(pi(), 9) AS pi, c_custkey = 0 AS is_zero, isnan(c_acctbal) AS nan FROM customer",
    "SELECT c_custkey, CAST(CAST(c_acctbal AS BIGINT) AS DOUBLE) AS t, round(pi(), 9) AS pi, c_custkey = 0 AS is_zero, isnan(c_acctbal) AS nan FROM customer")
sql("fn_gcd_lcm", "SELECT n_nationkey, CAST(gcd(n_nationkey * 6, 84) AS BIGINT) AS g, CAST(lcm(n_nationkey + 1, 12) AS BIGINT) AS l FROM nation",
    """SELECT n_nationkey, aggregate(sequence(1, 92), named_struct('a', CAST(n_nationkey * 6 AS BIGINT), 'b', 84L), (s, i) -> CASE WHEN s.b = 0 THEN s ELSE named_struct('a', s.b, 'b', s.a % s.b) END, s -> s.a) AS g,
       CAST((n_nationkey + 1) * 12 / aggregate(sequence(1, 92), named_struct('a', CAST(n_nationkey + 1 AS BIGINT), 'b', 12L), (s, i) -> CASE WHEN s.b = 0 THEN s ELSE named_struct('a', s.b, 'b', s.a % s.b) END, s -> s.a) AS BIGINT) AS l FROM nation""")
sql("fn_factorial", "SELECT n_nationkey, CAST(factorial(n_regionkey + 3) AS BIGINT) AS f FROM nation")
sql("fn_trim_pad", "SELECT n_nationkey, trim('  ' || n_name || ' ') AS t, ltrim('  ' || n_name) AS l, rtrim(n_name || '  ') AS r, lpad(n_name, 12, '*') AS lp, rpad(n_name, 5, '.') AS rp FROM nation")
sql("fn_replace_reverse", "SELECT n_nationkey, replace(n_name, 'A', 'aa') AS r, reverse(n_name) AS v, repeat(left(n_name, 1), 3) AS p, translate(n_name, 'AEI', '431') AS t FROM nation")
sql("fn_find", "SELECT n_nationkey, starts_with(n_name, 'A') AS s, ends_with(n_name, 'A') AS e, contains(n_name, 'AN') AS c, CAST(instr(n_name, 'N') AS BIGINT) AS i FROM nation",
    "SELECT n_nationkey, startswith(n_name, 'A') AS s, endswith(n_name, 'A') AS e, contains(n_name, 'AN') AS c, CAST(instr(n_name, 'N') AS BIGINT) AS i FROM nation")
sql("fn_split_part", "SELECT p_partkey, split_part(p_name, ' ', 2) AS a, CAST(ascii(p_name) AS INT) AS asc, chr(65 + p_size % 26) AS ch, lower(to_hex(p_partkey)) AS hx FROM part",
    "SELECT p_partkey, split_part(p_name, ' ', 2) AS a, CAST(ascii(p_name) AS INT) AS asc, chr(65 + p_size % 26) AS ch, lower(hex(p_partkey)) AS hx FROM part")
sql("fn_regexp", "SELECT p_partkey, regexp_matches(p_brand, '#1[0-9]') AS m, regexp_extract(p_brand, '([0-9]+)', 1) AS e, regexp_replace(p_name, '[aeiou]', '_', 'g') AS r, CAST(len(regexp_extract_all(p_name, '[a-z]')) AS BIGINT) AS n FROM part",
    "SELECT p_partkey, regexp_like(p_brand, '#1[0-9]') AS m, regexp_extract(p_brand, '([0-9]+)', 1) AS e, regexp_replace(p_name, '[aeiou]', '_') AS r, CAST(regexp_count(p_name, '[a-z]') AS BIGINT) AS n FROM part")
sql("fn_levenshtein", "SELECT n_nationkey, CAST(levenshtein(n_name, 'NOTION 11') AS BIGINT) AS d FROM nation")
sql("fn_overlay", "SELECT n_nationkey, substring(n_name, 1, 1) || '##' || substring(n_name, 4) AS o FROM nation", "SELECT n_nationkey, overlay(n_name PLACING '##' FROM 2 FOR 2) AS o FROM nation")
sql("fn_epoch", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS e, to_timestamp(1700000000 + event_id) AT TIME ZONE 'UTC' AS t FROM events",
    "SELECT event_id, unix_timestamp(CAST(ts AS TIMESTAMP)) AS e, CAST(timestamp_seconds(1700000000 + event_id) AS TIMESTAMP_NTZ) AS t FROM events")
sql("fn_json", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events", "SELECT event_id, CAST(get_json_object(props, '$.k') AS INT) AS k FROM events")
sql("fn_length_family", "SELECT n_nationkey, CAST(bit_length('é' || n_name) AS BIGINT) AS bits, CAST(length('é' || n_name) AS BIGINT) AS chars FROM nation",
    "SELECT n_nationkey, CAST(bit_length('é' || n_name) AS BIGINT) AS bits, CAST(char_length('é' || n_name) AS BIGINT) AS chars FROM nation")
sql("fn_btrim_initcap", "SELECT n_nationkey, trim('xx' || n_name || 'x', 'x') AS t, upper(left(n_name, 1)) || lower(substring(n_name, 2)) AS i FROM nation",
    "SELECT n_nationkey, btrim('xx' || n_name || 'x', 'x') AS t, initcap(n_name) AS i FROM nation")
sql("fn_substr_index", "SELECT p_partkey, array_to_string(string_split(p_name, ' ')[1:2], ' ') AS s, CAST(coalesce(list_position(string_split('Brand#12,Brand#13', ','), p_brand), 0) AS INT) AS f FROM part",
    "SELECT p_partkey, substring_index(p_name, ' ', 2) AS s, find_in_set(p_brand, 'Brand#12,Brand#13') AS f FROM part")
sql("fn_encode", "SELECT n_nationkey, base64(encode(n_name)) AS b, decode(from_base64(base64(encode(n_name)))) AS back FROM nation",
    "SELECT n_nationkey, base64(encode(n_name, 'UTF-8')) AS b, decode(unbase64(base64(encode(n_name, 'UTF-8'))), 'UTF-8') AS back FROM nation")
sql("fn_log_base", "SELECT p_partkey, round(ln(p_size) / ln(3), 9) AS l FROM part", "SELECT p_partkey, round(log(3, p_size), 9) AS l FROM part")
sql("fn_nan", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN -1.0::DOUBLE ELSE CAST(p_size AS DOUBLE) END AS v, p_size % 5 = 0 AS nan FROM part",
    "SELECT p_partkey, nanvl(x, -1.0D) AS v, isnan(x) AS nan FROM (SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN CAST('NaN' AS DOUBLE) ELSE CAST(p_size AS DOUBLE) END AS x FROM part) t")
sql("fn_to_date", "SELECT n_nationkey, CAST(strptime((2000 + n_nationkey) || '/03/05', '%Y/%m/%d') AS DATE) AS d, strptime((2000 + n_nationkey) || '-03-05 04:05:06', '%Y-%m-%d %H:%M:%S') AS t FROM nation",
    "SELECT n_nationkey, to_date((2000 + n_nationkey) || '/03/05', 'yyyy/MM/dd') AS d, CAST(to_timestamp((2000 + n_nationkey) || '-03-05 04:05:06', 'yyyy-MM-dd HH:mm:ss') AS TIMESTAMP_NTZ) AS t FROM nation")
sql("fn_to_char", "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y') AS c FROM orders", "SELECT o_orderkey, date_format(o_orderdate, 'dd.MM.yyyy') AS c FROM orders")
sql("fn_timestamp_scales", "SELECT event_id, make_timestamp((1700000000000 + event_id) * 1000) AS ms, make_timestamp(1700000000000000 + event_id) AS us, make_timestamp((1700000000 + event_id) * 1000000) AS s FROM events",
    "SELECT event_id, CAST(timestamp_millis(1700000000000 + event_id) AS TIMESTAMP_NTZ) AS ms, CAST(timestamp_micros(1700000000000000 + event_id) AS TIMESTAMP_NTZ) AS us, CAST(from_unixtime(1700000000 + event_id) AS TIMESTAMP_NTZ) AS s FROM events")
sql("fn_now", "SELECT r_regionkey, current_date > DATE '2020-01-01' AS later, now() = now() AS steady FROM region", "SELECT r_regionkey, current_date() > DATE '2020-01-01' AS later, now() = current_timestamp() AS steady FROM region")
sql("fn_random", "SELECT n_nationkey, random() >= 0 AND random() < 1 AS inside, length(CAST(uuid() AS VARCHAR)) = 36 AS u FROM nation", "SELECT n_nationkey, rand() >= 0 AND rand() < 1 AS inside, length(uuid()) = 36 AS u FROM nation")
