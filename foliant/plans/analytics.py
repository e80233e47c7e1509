"""Operational analytics: runs are orders, users customers (department: market segment), steps line items, feedback events.

The dialects agree on most of these queries; ``both`` registers one text for the two engines, or one for each."""

from __future__ import annotations

from foliant.sources.tables import sql

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def both(name: str, text: str, spark_text: str | None = None) -> None:
    """Registers ``name``; Spark runs spark_text, or the same text."""
    mine = spark_text or text
    ORACLE[name] = text

    def run(spark, sf_dir, mine=mine):
        return sql(spark, sf_dir, mine)

    run.__name__ = name
    QUERIES[name] = run


both("admin_stats", """SELECT count(*) AS runs, count(DISTINCT o_custkey) AS users, round(sum(o_totalprice), 2) AS cost, round(avg(o_totalprice), 4) AS mean_cost,
  count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS finished FROM orders""")
both("user_stats_preagg", """WITH r AS (SELECT o_custkey, count(*) AS runs, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS finished, max(o_orderdate) AS last_run FROM orders GROUP BY o_custkey),
  f AS (SELECT user_id, count(*) AS notes FROM events GROUP BY user_id)
  SELECT c_custkey, coalesce(runs, 0) AS runs, coalesce(finished, 0) AS finished, coalesce(notes, 0) AS notes, last_run
  FROM customer LEFT JOIN r ON o_custkey = c_custkey LEFT JOIN f ON user_id = c_custkey""")
both("facet_counts", """SELECT 'status' AS facet, o_orderstatus AS value, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderpriority = '1-URGENT' GROUP BY 1, 2
  UNION ALL SELECT 'department', c_mktsegment, count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND c_mktsegment IS NOT NULL GROUP BY 1, 2
  UNION ALL SELECT 'priority', o_orderpriority, count(*) FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND c_mktsegment = 'BUILDING' GROUP BY 1, 2""")
both("status_pills", """SELECT count(*) AS total, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS open_runs, count(CASE WHEN o_orderstatus = 'F' THEN 1 END) AS finished,
  count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS partial_runs, count(CASE WHEN o_totalprice > 200000 THEN 1 END) AS costly, count(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 END) AS urgent FROM orders""")
both("submission_rollup", """SELECT c_mktsegment AS department, count(CASE WHEN c_nationkey < 12 THEN 1 END) AS own, count(CASE WHEN c_nationkey >= 12 THEN 1 END) AS behalf, count(*) AS total
  FROM orders LEFT JOIN customer ON c_custkey = o_custkey GROUP BY ROLLUP (c_mktsegment)""")
both("department_counts", "SELECT c_mktsegment AS department, count(*) AS n FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment")
both("faculty_last_run", "SELECT c_name, count(*) AS n, max(o_orderdate) AS last_run FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY c_name")
both("runs_with_feedback_exists", "SELECT o_orderkey, EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') AS has_feedback FROM orders")
both("runs_without_feedback_anti", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
both("needs_feedback_users", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey)")
both("three_way_join", "SELECT n_name, r_name, count(*) AS suppliers, round(sum(s_acctbal), 2) AS balance FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY n_name, r_name")
both("orphan_anti_join", "SELECT p_partkey FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey)")
both("stage_avg", "SELECT l_linenumber AS step, round_even(avg(l_quantity), 1) AS mean, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_linenumber",
     "SELECT l_linenumber AS step, bround(avg(l_quantity), 1) AS mean, count(*) AS n FROM lineitem WHERE l_linestatus = 'F' GROUP BY l_linenumber")
P95 = """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL)
  SELECT event_type, max(value) AS p95 FROM r WHERE k = {}(0.95 * (n - 1), 0) GROUP BY event_type"""
# Spark ranks distinct values by their counts, so rows aren't sorted
P95_COUNTS = """WITH c AS (SELECT event_type, value, count(*) AS k FROM events WHERE value IS NOT NULL GROUP BY event_type, value),
  s AS (SELECT event_type, value, sum(k) OVER (PARTITION BY event_type ORDER BY value) AS upto, sum(k) OVER (PARTITION BY event_type) AS n FROM c)
  SELECT event_type, min(value) AS p95 FROM s WHERE upto - 1 >= bround(0.95 * (n - 1), 0) GROUP BY event_type"""
both("p95_nearest_rank", P95.format("round_even"), P95_COUNTS)
both("recent_median", "SELECT median(o_totalprice) AS median_cost FROM (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50)")
both("queue_eta", """WITH m AS (SELECT median(o_totalprice) AS s FROM (SELECT o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50)),
  q AS (SELECT o_orderpriority AS lane, count(CASE WHEN o_orderstatus = 'P' THEN 1 END) AS waiting, count(CASE WHEN o_orderstatus = 'O' THEN 1 END) AS running, CASE WHEN o_orderpriority LIKE '5%' THEN 0 ELSE 8 END AS workers FROM orders GROUP BY o_orderpriority)
  SELECT lane, waiting, running, CAST(ceil((waiting + running) * (SELECT s FROM m) / nullif(workers, 0) / 60) AS BIGINT) AS minutes FROM q""")
both("page_2_of_runs", "SELECT o_orderkey, o_orderdate, c_name FROM orders LEFT JOIN customer ON c_custkey = o_custkey ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 25")
both("queue_position", """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN rank() OVER (PARTITION BY CASE WHEN o_orderstatus = 'P' THEN 1 END, o_orderpriority ORDER BY o_orderdate) END AS place FROM orders""",
     """WITH c AS (SELECT o_orderpriority AS p, o_orderdate AS d, count(*) AS k FROM orders WHERE o_orderstatus = 'P' GROUP BY o_orderpriority, o_orderdate),
  s AS (SELECT p, d, sum(k) OVER (PARTITION BY p ORDER BY d) - k + 1 AS place FROM c)
  SELECT o_orderkey, place FROM orders LEFT JOIN s ON o_orderstatus = 'P' AND p = o_orderpriority AND d = o_orderdate""")
both("daily_quota_et", """SELECT user_id, date_trunc('day', timezone('America/New_York', timezone('UTC', ts))) AS local_day, count(*) AS used, count(*) > 3 AS blocked FROM events GROUP BY 1, 2""",
     """SELECT user_id, CAST(date_trunc('DAY', from_utc_timestamp(CAST(ts AS TIMESTAMP), 'America/New_York')) AS TIMESTAMP_NTZ) AS local_day, count(*) AS used, count(*) > 3 AS blocked FROM events GROUP BY 1, 2""")
both("monthly_quota_et", """SELECT user_id, date_trunc('month', timezone('America/New_York', timezone('UTC', ts))) AS local_month, count(*) AS used FROM events GROUP BY 1, 2""",
     """SELECT user_id, CAST(date_trunc('MONTH', from_utc_timestamp(CAST(ts AS TIMESTAMP), 'America/New_York')) AS TIMESTAMP_NTZ) AS local_month, count(*) AS used FROM events GROUP BY 1, 2""")
both("cost_rollup", """SELECT o_orderpriority, round(sum(l_extendedprice * (1 - l_discount)), 2) AS cost, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS charged, count(*) AS steps
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY o_orderpriority""")
both("lane_loads", "SELECT o_orderstatus, o_orderpriority LIKE '1%' AS single_lane, count(*) AS n, min(o_orderdate) AS oldest FROM orders GROUP BY 1, 2")
both("latest_run_per_key", "SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS k FROM orders) WHERE k = 1")
both("running_cost", "SELECT event_id, user_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS so_far FROM events")
both("batch_completion", "SELECT l_orderkey, count(*) AS steps, min(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) = 1 AS all_terminal FROM lineitem GROUP BY l_orderkey")
both("correlation", "SELECT event_type, CASE WHEN stddev_pop(value) > 0 THEN round(corr(value, user_id), 2) END AS pearson, count(*) AS n FROM events GROUP BY event_type")
both("cost_with_price_dimension", """WITH price AS (SELECT p_partkey, p_retailprice / 1000000 AS rate FROM part) SELECT l_returnflag, round(sum(l_quantity * rate + l_quantity * rate * 0.1), 8) AS cost FROM lineitem LEFT JOIN price ON p_partkey = l_partkey GROUP BY l_returnflag""")
both("stale_runs", "SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus IN ('O', 'P') AND o_orderdate < TIMESTAMP '1997-01-01 00:00:00'")
DURATION = """SELECT doc_id, tokens, low_s, greatest(CAST(floor(tokens * 480 / 3500 * 1.3) AS BIGINT), low_s + 30) AS high_s FROM (
  SELECT doc_id, tokens, greatest(CAST(floor(tokens * 480 / 3500 * 0.6) AS BIGINT), 30) AS low_s FROM (SELECT doc_id, CAST(floor(greatest(n_chars, 1000) / 4) AS BIGINT) AS tokens FROM documents))"""
both("duration_estimate", DURATION)
both("id_priority_join", """SELECT event_id, CASE WHEN c.c_custkey IS NOT NULL THEN 'customer' WHEN s.s_suppkey IS NOT NULL THEN 'supplier' WHEN p.p_partkey IS NOT NULL THEN 'part' ELSE 'none' END AS route, coalesce(c.c_name, CAST(s.s_suppkey AS VARCHAR), p.p_name) AS name
  FROM events LEFT JOIN customer c ON c.c_custkey = user_id + 1450 LEFT JOIN supplier s ON s.s_suppkey = user_id LEFT JOIN part p ON p.p_partkey = user_id""",
     """SELECT event_id, CASE WHEN c.c_custkey IS NOT NULL THEN 'customer' WHEN s.s_suppkey IS NOT NULL THEN 'supplier' WHEN p.p_partkey IS NOT NULL THEN 'part' ELSE 'none' END AS route, coalesce(c.c_name, CAST(s.s_suppkey AS STRING), p.p_name) AS name
  FROM events LEFT JOIN customer c ON c.c_custkey = user_id + 1450 LEFT JOIN supplier s ON s.s_suppkey = user_id LEFT JOIN part p ON p.p_partkey = user_id""")
both("corpus_sweep", "SELECT lang, count(DISTINCT source) AS sources, count(*) AS docs, count(CASE WHEN quality = 0 THEN 1 END) AS warned, count(CASE WHEN toxic = 1 THEN 1 END) AS errors, count(quality) AS ran FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
both("cap_frequency", "SELECT CASE WHEN toxic = 1 THEN 25 WHEN quality = 0 THEN 40 WHEN quality IS NULL THEN 84 ELSE 100 END AS cap, count(*) AS runs FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1")
