"""SQL that DuckDB runs on the same tables, one statement for each registered query."""

ORACLE_SQL: dict[str, str] = {
    "scan_parquet": "SELECT n_nationkey, n_name, n_regionkey FROM nation",
    "select_columns": "SELECT o_totalprice, o_orderkey FROM orders",
    "filter_lt": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 100",
    "filter_le": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey <= 100",
    "filter_gt": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey > 1400",
    "filter_ge": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey >= 1400",
    "filter_eq": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 3",
    "filter_ne": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber <> 3",
    "filter_between_exclusive": "SELECT p_partkey, p_size FROM part WHERE p_size > 10 AND p_size < 20",
    "filter_in": "SELECT l_orderkey, l_suppkey FROM lineitem WHERE l_suppkey IN (1, 5, 9)",
    "filter_is_null": "SELECT p_partkey FROM (SELECT p_partkey, NULLIF(p_size, 10) AS s FROM part) t WHERE s IS NULL",
    "filter_not_null": "SELECT p_partkey, s FROM (SELECT p_partkey, NULLIF(p_size, 10) AS s FROM part) t WHERE s IS NOT NULL",
    "filter_col_eq": "SELECT l_orderkey, l_suppkey, l_linenumber FROM lineitem WHERE l_suppkey = l_linenumber",
    "filter_and": "SELECT l_orderkey FROM lineitem WHERE l_suppkey < 50 AND l_linenumber > 2 AND l_partkey >= 100 AND l_orderkey <= 9000",
    "filter_or": "SELECT p_partkey, p_size FROM part WHERE p_size < 5 OR p_size > 45",
    "filter_not_complement": "SELECT p_partkey, s FROM (SELECT p_partkey, NULLIF(p_size, 10) AS s FROM part) t WHERE NOT COALESCE(s < 20, FALSE)",
    "filter_partial_lt": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey < 50 AND l_linenumber < 3",
    "string_contains": "SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'ring')",
    "string_contains_partial": "SELECT p_partkey, p_name FROM part WHERE p_size < 10 AND contains(p_name, 'ed')",
    "string_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE 'red%g_t'  OR p_name LIKE '%bolt'",
    "smart_string_on_top": "SELECT doc_id, n_chars FROM documents WHERE n_chars < 2000 AND contains(text, 'the')",
    "sort_asc_topk": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey ASC, o_orderkey ASC LIMIT 100",
    "topk_desc": "SELECT o_orderkey, o_custkey FROM orders ORDER BY o_custkey DESC, o_orderkey ASC LIMIT 100",
    "sort_null_as_zero": """
SELECT p_partkey, s FROM (SELECT p_partkey, NULLIF(p_size, 50) AS s FROM part) t ORDER BY COALESCE(s, 0) ASC, p_partkey ASC LIMIT
80
""",
    "filter_top_file_order": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 250",
    "argsort_indices": """
SELECT s_suppkey AS idx, CAST(row_number() OVER (ORDER BY s_nationkey ASC, s_suppkey ASC) - 1 AS BIGINT) AS rank_pos FROM supplier
""",
    "dsl_pipeline": """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey > 100 AND o_custkey < 700 AND contains(o_orderpriority, 'URGENT') ORDER
BY o_orderkey DESC LIMIT 50
""",
    "redundant_bound_elimination": "SELECT o_orderkey FROM orders WHERE o_custkey < 300 AND o_custkey < 200 AND o_custkey IS NOT NULL",
    "join_inner": """
SELECT c.c_custkey AS customer_c_custkey, c.c_nationkey AS customer_c_nationkey, o.o_orderkey AS orders_o_orderkey, o.o_custkey AS
orders_o_custkey FROM customer c JOIN orders o ON c.c_custkey = o.o_custkey
""",
    "join_multi_key": """
SELECT a.l_orderkey AS a_l_orderkey, a.l_linenumber AS a_l_linenumber, b.o_custkey AS b_o_custkey FROM lineitem a JOIN (SELECT
o_orderkey, CAST(o_custkey % 7 + 1 AS INTEGER) AS ln, o_custkey FROM orders) b ON a.l_orderkey = b.o_orderkey AND a.l_linenumber =
b.ln
""",
    "join_multi_table": """
SELECT r.r_name AS r_name, n.n_name AS n_name, s.s_suppkey AS s_suppkey FROM supplier s JOIN nation n ON s.s_nationkey =
n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
""",
    "xor_filter_semi": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)",
    "xor_filter_partial": """
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey < 5000 AND o_custkey IN (SELECT c_custkey FROM customer WHERE
c_nationkey = 3)
""",
    "join_chain_lengths": """
WITH a AS (SELECT CAST(o_custkey AS UBIGINT) AS v FROM orders), b AS (SELECT xor(v, v >> 33) AS v FROM a), c AS (SELECT (v &
4294967295::UBIGINT) * 3981806797::UBIGINT AS v FROM b), d AS (SELECT xor(v, v >> 33) AS v FROM c), e AS (SELECT (v &
4294967295::UBIGINT) * 444984403::UBIGINT AS v FROM d) SELECT CAST(xor(v, v >> 33) % 32 AS BIGINT) AS bucket, count(*) AS chain_len
FROM e GROUP BY 1
""",
    "agg_count": "SELECT l_linenumber, count(*) AS cnt FROM lineitem GROUP BY l_linenumber",
    "agg_min_max": "SELECT l_suppkey, min(l_partkey) AS min_part, max(l_partkey) AS max_part FROM lineitem GROUP BY l_suppkey",
    "agg_sum": "SELECT l_suppkey, CAST(sum(l_partkey) AS BIGINT) AS sum_part FROM lineitem GROUP BY l_suppkey",
    "agg_mean": "SELECT l_suppkey, round(avg(l_partkey), 6) AS mean_part FROM lineitem GROUP BY l_suppkey",
    "agg_min_string": "SELECT p_size, min(p_name) AS min_name FROM part GROUP BY p_size",
    "agg_multi": """
SELECT o_custkey, count(*) AS cnt, min(o_orderkey) AS mn, max(o_orderkey) AS mx FROM orders WHERE o_orderkey < 6000 GROUP BY
o_custkey
""",
    "ticket_ids": """
WITH f AS (SELECT o_custkey, min(o_orderkey) AS fp FROM orders GROUP BY 1), t AS (SELECT o_custkey, CAST(row_number() OVER (ORDER
BY fp) - 1 AS BIGINT) AS ticket FROM f) SELECT o.o_orderkey, t.ticket FROM orders o JOIN t ON o.o_custkey = t.o_custkey
""",
    "ticket_keys_distinct": "SELECT DISTINCT o_custkey FROM orders",
    "ticket_len": "SELECT count(DISTINCT o_custkey) AS n_groups FROM orders",
    "concat": "SELECT s_suppkey AS k, s_name AS name FROM supplier UNION ALL SELECT c_custkey AS k, c_name AS name FROM customer",
    "horizontal_stack": """
SELECT s.s_suppkey AS s_suppkey, s.s_name AS "L_name", c.c_name AS "R_name" FROM supplier s JOIN customer c ON s.s_suppkey =
c.c_custkey
""",
    "rename_cols": "SELECT r_regionkey AS a, r_name AS b FROM region",
    "slice": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey >= 1000 AND o_orderkey < 1500",
    "slice_selection": "SELECT o_orderkey - 1000 AS idx FROM orders WHERE o_custkey < 300 AND o_orderkey >= 1000 AND o_orderkey < 1500",
    "sel_intersect": "SELECT o_orderkey AS idx FROM orders WHERE o_custkey < 700 INTERSECT SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'",
    "sel_union": "SELECT o_orderkey AS idx FROM orders WHERE o_custkey < 100 UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'",
    "sel_invert": "SELECT o_orderkey AS idx FROM orders EXCEPT SELECT o_orderkey FROM orders WHERE o_custkey < 700",
    "set_selection": "SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey IN (0, 3, 9, 2000, 14999)",
    "take": """
WITH idx AS (SELECT o_orderkey AS j, CAST((o_orderkey * 7919) % 1500 AS BIGINT) AS i FROM orders WHERE o_orderkey < 500) SELECT
idx.j AS j, c.c_name AS c_name FROM idx LEFT JOIN customer c ON c.c_custkey = idx.i
""",
    "interleave": """
WITH idx AS (SELECT o_orderkey AS j, o_orderkey % 2 AS a, o_orderkey % 100 AS i FROM orders WHERE o_orderkey < 400)
SELECT idx.j AS j, s.s_name AS name FROM idx JOIN supplier s ON s.s_suppkey = idx.i WHERE a = 0
UNION ALL SELECT idx.j AS j, c.c_name AS name FROM idx JOIN customer c ON c.c_custkey = idx.i WHERE a = 1
""",
    "nullif_mask": "SELECT p_partkey, CASE WHEN p_size > 25 THEN NULL ELSE p_size END AS v FROM part",
    "zip_if_else": "SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name ELSE p_type END AS v FROM part",
    "shift_right": "SELECT o_orderkey, lag(o_custkey, 2) OVER (ORDER BY o_orderkey) AS v FROM orders",
    "shift_left": "SELECT o_orderkey, lead(o_custkey, 1) OVER (ORDER BY o_orderkey) AS v FROM orders",
    "compute_runs": """
SELECT CAST(sum(CASE WHEN prev AND NOT cur THEN 1 ELSE 0 END) AS BIGINT) AS runs FROM (SELECT o_custkey < 700 AS cur,
lag(o_custkey < 700, 1, FALSE) OVER (ORDER BY o_orderkey) AS prev FROM orders) t
""",
    "run_length_encode": """
WITH m AS (SELECT o_orderkey, o_orderstatus, CASE WHEN lag(o_orderstatus) OVER (ORDER BY o_orderkey) IS DISTINCT FROM
o_orderstatus THEN 1 ELSE 0 END AS st FROM orders), g AS (SELECT *, sum(st) OVER (ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING) AS
run_id FROM m) SELECT CAST(run_id AS BIGINT) AS run_id, min(o_orderstatus) AS v, max(o_orderkey) + 1 AS run_end FROM g GROUP BY 1
""",
    "row_chunk_stats": """
SELECT CAST(o_orderkey // 1000 AS BIGINT) AS rg, count(*) AS row_count, count(*) - count(o_custkey) AS null_count, min(o_custkey)
AS mn, max(o_custkey) AS mx FROM orders GROUP BY 1
""",
    "array_equal": "SELECT count(*) AS n_diff FROM (SELECT l_suppkey, l_linenumber FROM lineitem) t WHERE t.l_suppkey IS DISTINCT FROM t.l_linenumber",
    "mix_hash": """
WITH a AS (SELECT o_custkey, CAST(o_custkey AS UBIGINT) AS v FROM orders), b AS (SELECT o_custkey, xor(v, v >> 33) AS v FROM a), c
AS (SELECT o_custkey, (v & 4294967295::UBIGINT) * 3981806797::UBIGINT AS v FROM b), d AS (SELECT o_custkey, xor(v, v >> 33) AS v
FROM c), e AS (SELECT o_custkey, (v & 4294967295::UBIGINT) * 444984403::UBIGINT AS v FROM d) SELECT o_custkey, CAST(xor(v, v >>
33) AS BIGINT) AS h FROM e
""",
    "filter_selectivity_features": """
SELECT CAST(o_orderkey // 4096 AS BIGINT) AS chunk, count(*) AS num_rows, round(avg(CASE WHEN o_custkey < 700 THEN CAST(1 AS
DOUBLE) ELSE CAST(0 AS DOUBLE) END), 9) AS selectivity FROM orders GROUP BY 1
""",
    "needle_feature": """
SELECT CAST(doc_id // 256 AS BIGINT) AS chunk, round(1.0 / (1.0 + 3.0 / avg(strlen(text))), 9) AS needle_feature FROM documents
GROUP BY 1
""",
    "inversions_unique": """
WITH s AS (SELECT o_orderkey AS i, o_custkey AS v FROM orders WHERE o_orderkey % 100 = 1) SELECT (SELECT count(*) FROM s a JOIN s
b ON a.i < b.i AND a.v > b.v) AS inversions, (SELECT count(DISTINCT v) FROM s) AS uniq
""",
    "regret_best_single": """
WITH r AS (SELECT l_partkey AS c0, l_suppkey * 20 AS c1, l_orderkey // 7 AS c2 FROM lineitem), m AS (SELECT c0, c1, c2, least(c0,
c1, c2) AS b FROM r) SELECT CAST(sum(c0 - b) AS BIGINT) AS regret0, CAST(sum(c1 - b) AS BIGINT) AS regret1, CAST(sum(c2 - b) AS
BIGINT) AS regret2 FROM m
""",
    "rbf_weighted_means": """
WITH w AS (SELECT exp(-((l_discount - 0.05) * (l_discount - 0.05)) / 0.01) AS w, l_partkey AS y0, l_suppkey AS y1 FROM lineitem)
SELECT round(sum(w * y0) / sum(w), 6) AS mean0, round(sum(w * y1) / sum(w), 6) AS mean1, round(sum(w) * sum(w) / sum(w * w), 4) AS
neff FROM w
""",
    "ucb_lcb": """
WITH a AS (SELECT l_linenumber AS arm, count(*) AS n, avg(l_partkey) AS mean FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS t
FROM a) SELECT arm, n, round(mean - 1.0 * sqrt(2.0 * ln(t.t) / n), 6) AS lcb FROM a, t
""",
    "ucb_choice": """
WITH a AS (SELECT l_linenumber AS arm, count(*) AS n, avg(l_partkey) AS mean FROM lineitem GROUP BY 1), t AS (SELECT sum(n) AS t
FROM a) SELECT arm FROM a, t ORDER BY mean - sqrt(2.0 * ln(t.t) / n), arm LIMIT 1
""",
    "kernel_policy_choices": """
WITH q AS (SELECT CAST(range AS INTEGER) AS tenth FROM range(11)), m AS (SELECT tenth, exp(-power(p_size / 50.0 - tenth / 10.0, 2) /
0.01) AS w, p_size AS a, 60.0 - p_size AS b FROM part, q WHERE p_partkey < 150) SELECT tenth, CAST(CASE WHEN sum(w * a) <= sum(w *
b) THEN 0 ELSE 1 END AS INTEGER) AS choice FROM m GROUP BY tenth
""",
    "regret_tree_choices": """
WITH m AS (SELECT min(p_size) AS cut FROM part WHERE p_partkey < 150 AND p_size > 30) SELECT p_partkey, CAST(CASE WHEN p_size < cut
THEN 0 ELSE 1 END AS INTEGER) AS choice FROM part, m
""",
    "simple_policy_choices": """
SELECT CAST(i AS INTEGER) AS i, 1 AS rule, 0 AS single, CAST(r AS INTEGER) AS replay FROM (VALUES (0, 1), (1, 0), (2, 1)) t(i, r)
""",
    "pipeline_not_null": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NOT NULL AND o_custkey < 50",
    "pipeline_is_null": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IS NULL",
    "filter_all": "SELECT r_regionkey FROM region",
    "filter_hints": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey < 20 AND l_linenumber > 5",
    "filter_wide_literal": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber < 5000000000 AND l_linenumber > 5.5",
    "predicate_depth": "SELECT 3 AS depth",
    "join_default_keys": "SELECT c_custkey, c_name, o_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey",
    "agg_user_defined": """
SELECT l_linenumber, round(sum(CAST(l_partkey AS DOUBLE) * l_partkey) / count(*) - sum(CAST(l_partkey AS DOUBLE)) / count(*) *
sum(CAST(l_partkey AS DOUBLE)) / count(*), 3) AS spread, count(*) AS cnt FROM lineitem GROUP BY 1
""",
    "run_decode": "SELECT o_orderkey AS at, o_orderstatus AS v FROM orders",
    "sel_check": """
SELECT i, EXISTS (SELECT 1 FROM orders WHERE o_orderkey = i AND o_custkey < 700) AS chosen FROM (SELECT CAST(unnest([0, 1, 2, 3,
10000000]) AS BIGINT) AS i) t
""",
    "sel_all_none": "SELECT TRUE AS whole, TRUE AS none, FALSE AS some",
    "sel_filter_values": "SELECT o_orderkey AS idx FROM orders WHERE o_custkey < 300 AND o_custkey % 7 = 3",
    "sel_filter_strings": "SELECT o_orderkey AS idx FROM orders WHERE o_custkey < 300 AND contains(o_orderpriority, 'URGENT')",
    "sel_map_values": "SELECT o_orderkey AS at, o_custkey * 2 + 1 AS v FROM orders WHERE o_custkey < 300",
    "sel_gather": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 300",
    "sel_bitmap_round_trip": "SELECT o_orderkey AS idx FROM orders WHERE o_custkey < 300",
    "sel_intersect_strategies": """
SELECT o_orderkey AS idx, CAST(k AS INTEGER) AS strategy FROM orders, range(3) t(k) WHERE o_custkey < 700 AND o_orderstatus = 'F'
""",
    "intersection_features": """
WITH a AS (SELECT o_orderkey AS i FROM orders WHERE o_custkey < 300), b AS (SELECT o_orderkey AS i FROM orders WHERE o_orderstatus =
'F'), f AS (SELECT i FROM a ORDER BY i LIMIT 10) SELECT round((SELECT count(*) FROM b) / (SELECT count(*) FROM a), 9) AS len_ratio,
round((SELECT count(*) FROM a WHERE i BETWEEN (SELECT min(i) FROM b) AND (SELECT max(i) FROM b)) / (SELECT count(*) FROM a), 9) AS
overlap, (SELECT count(*) FROM f WHERE i IN (SELECT i FROM b)) AS hits
""",
    "value_sizes": """
SELECT p_partkey, CAST(strlen(p_name) + 4 + 4 + 4 + strlen(p_brand) + 4 + strlen(p_type) + 4 + 4 + 1 + 4 + 8 AS BIGINT) AS size FROM
part
""",
    "mix_hash_double": """
WITH a AS (SELECT p_partkey, CAST(CAST(p_retailprice AS DOUBLE) AS BIT)::UBIGINT AS v FROM part), b AS (SELECT p_partkey, xor(v, v >>
33) AS v FROM a), c AS (SELECT p_partkey, (v & 4294967295::UBIGINT) * 3981806797::UBIGINT AS v FROM b), d AS (SELECT p_partkey, xor(v,
v >> 33) AS v FROM c), e AS (SELECT p_partkey, (v & 4294967295::UBIGINT) * 444984403::UBIGINT AS v FROM d), f AS (SELECT p_partkey,
xor(v, v >> 33) AS v FROM e) SELECT p_partkey, CAST(CASE WHEN v >= 9223372036854775808::UBIGINT THEN CAST(v AS HUGEINT) -
18446744073709551616::HUGEINT ELSE CAST(v AS HUGEINT) END AS BIGINT) AS h FROM f
""",
    "random_strings": """
WITH d AS (SELECT c_custkey, k, w, CAST('0x' || substr(md5('calyxa:' || w || ':' || c_custkey || ':' || k), 1, 4) AS INTEGER) AS x
FROM customer, (SELECT 'word' AS w, CAST(range AS VARCHAR) AS k FROM range(10) UNION ALL VALUES ('length', '0'), ('pattern', '0')) t),
n AS (SELECT c_custkey, max(x) FILTER (WHERE w = 'length') % 8 + 1 AS n, max(x) FILTER (WHERE w = 'pattern') < 39321 AS p FROM d GROUP
BY 1) SELECT c_custkey, string_agg(CASE WHEN k = '0' AND p THEN s || ' PATTERN' ELSE s END, ' ' ORDER BY CAST(k AS INTEGER)) AS s FROM
(SELECT c_custkey, k, p, n, ['oak', 'elm', 'ash', 'fir', 'yew'][x % 5 + 1] AS s FROM d JOIN n USING (c_custkey) WHERE w = 'word') u WHERE
CAST(k AS INTEGER) <= n GROUP BY c_custkey
""",
    "filter_features": """
SELECT count(*) AS num_rows, round(avg(CASE WHEN o_custkey < 700 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END), 9) AS selectivity,
CAST(sum(8 + 4 + strlen(o_orderpriority)) AS BIGINT) AS bytes FROM orders
""",
    "chunked_counts": """
SELECT CAST(CASE WHEN (SELECT count(*) FROM orders) < 1000 THEN 0 ELSE o_orderkey // 500 END AS BIGINT) AS chunk, count(*) AS num_rows
FROM orders GROUP BY 1
""",
    "json_round_trip": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (1, 2, 3) OR (o_custkey > 10 AND o_custkey < 13)",
    "from_arrow": "SELECT * FROM nation",
    "stream_rows": "SELECT * FROM nation",
    "spooled": "SELECT * FROM region",
    "cached_load": "SELECT s_suppkey FROM supplier WHERE s_nationkey < 9 ORDER BY s_nationkey, s_suppkey LIMIT 20",
    "footer_statistics": """
SELECT count(*) AS row_count, CAST(count(*) - count(o_custkey) AS BIGINT) AS null_count, min(o_custkey) AS mn, max(o_custkey) AS mx FROM
orders
""",
    "literal_columns": "SELECT CAST(a AS INTEGER) AS a, CAST(b AS INTEGER) AS b FROM (VALUES (1, 4), (5, -2), (9, 0)) t(a, b)",
    "materialized_table": "SELECT n_nationkey, n_name FROM nation",
    "table_columns": """
SELECT CAST(i AS INTEGER) AS place, n AS name, k AS kind FROM (VALUES (0, 'n_nationkey', 'int'), (1, 'n_name', 'string'), (2,
'n_regionkey', 'int')) t(i, n, k)
""",
    "runner_result": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 20",
}
for _k in range(2):
    ORACLE_SQL[f"strategy_filter_{_k}"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 100"
    ORACLE_SQL[f"strategy_needle_{_k}"] = "SELECT p_partkey, p_name FROM part WHERE p_size < 10 AND contains(p_name, 'ed')"
    ORACLE_SQL[f"strategy_sort_{_k}"] = "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey < 50"
