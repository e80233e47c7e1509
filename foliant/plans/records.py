"""Record shaping: fan-out, ordering, merging of spans, top-k, budgets."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.sources.tables import sql, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(text: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if text:
            ORACLE[f.__name__] = text
        return f

    return add


@query("SELECT doc_id, n, unnest(parts) AS part, generate_subscripts(parts, 1) - 1 AS ord FROM (SELECT doc_id, parts, len(parts) AS n FROM (SELECT doc_id, list_filter(string_split(string_split(text, chr(10))[1], ', '), lambda x: length(x) > 0) AS parts FROM documents)) WHERE n > 1")
def fan_out_records(spark, d):
    """First lines with several parts become a row for each, in order."""
    parts = F.filter(F.split(F.split("text", "\n").getItem(0), ", "), lambda x: F.length(x) > 0)
    return table(spark, d, "documents").select("doc_id", parts.alias("parts")).filter(F.size("parts") > 1).select("doc_id", F.size("parts").alias("n"), F.posexplode("parts").alias("ord", "part"))


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'O' THEN 99991231 ELSE year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) END DESC, o_orderkey) AS place FROM orders""")
def reverse_chron_sort(spark, d):
    """Open ones first, then latest; the sort key is a partial date, not a date."""
    key = F.when(F.col("o_orderstatus") == "O", 99991231).otherwise(F.year("o_orderdate") * 10000 + F.month("o_orderdate") * 100 + F.day("o_orderdate"))
    return table(spark, d, "orders").select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(key.desc(), "o_orderkey")).cast("long").alias("place"))


TOPK = "0.4 * (1 - least((2000 - year(o_orderdate)) / 20.0, 1.0)) + 0.1 * least(o_totalprice / 500000, 1.0) + CASE WHEN o_orderpriority = '1-URGENT' THEN 0.15 ELSE 0 END"


@query(f"SELECT o_custkey, o_orderkey, round(w, 6) AS w FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY w DESC, o_orderkey) AS k FROM (SELECT *, round({TOPK}, 9) AS w FROM orders)) WHERE k <= 3")
def topk_per_code(spark, d):
    recency = 1 - F.least((2000 - F.year("o_orderdate")) / 20.0, F.lit(1.0))
    w = F.round(0.4 * recency + 0.1 * F.least(F.col("o_totalprice") / 500000, F.lit(1.0)) + F.when(F.col("o_orderpriority") == "1-URGENT", 0.15).otherwise(0), 9)
    ranked = table(spark, d, "orders").withColumn("w", w).withColumn("k", F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("w"), "o_orderkey")))
    return ranked.filter("k <= 3").select("o_custkey", "o_orderkey", F.round("w", 6).alias("w"))


@query("""SELECT doc_id, idx, used FROM (SELECT *, max(CASE WHEN used > 2000 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS over_it FROM (
SELECT doc_id, idx, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY idx)::BIGINT AS used FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents))) WHERE over_it = 0""")
def token_budget_cut(spark, d, budget: int = 2000):
    """Lines until the first that overflows the budget, newlines counted."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("idx", "line"))
    used = rows.withColumn("used", F.sum(F.length("line") + 1).over(w))
    return used.filter(F.col("used") <= budget).select("doc_id", "idx", "used")


YEARS = "SELECT DISTINCT o_custkey, year(o_orderdate) AS y FROM orders"


@query(f"SELECT o_custkey, min(y) AS first_y, max(y) AS last_y, count(*) AS n FROM (SELECT *, y - row_number() OVER (PARTITION BY o_custkey ORDER BY y) AS island FROM ({YEARS})) GROUP BY o_custkey, island")
def consecutive_year_merge(spark, d):
    """2001, 2002, 2003 become 2001-2003: gaps and islands."""
    y = table(spark, d, "orders").select("o_custkey", F.year("o_orderdate").alias("y")).distinct()
    at = y.withColumn("island", F.col("y") - F.row_number().over(Window.partitionBy("o_custkey").orderBy("y")))
    return at.groupBy("o_custkey", "island").agg(F.min("y").alias("first_y"), F.max("y").alias("last_y"), F.count(F.lit(1)).alias("n")).drop("island")


SPANS = "SELECT l_suppkey AS k, l_orderkey * 10 AS a, l_orderkey * 10 + CAST(l_quantity AS BIGINT) AS b FROM lineitem"


@query(f"""SELECT k, min(a) AS a, max(b) AS b, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY k ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM (
SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY k ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM ({SPANS}))) GROUP BY k, g""")
def overlap_merge(spark, d):
    """Overlapping spans coalesce: a span opens a group where it begins after all before it have ended."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") * 10).alias("a"), (F.col("l_orderkey") * 10 + F.col("l_quantity").cast("long")).alias("b"))
    w = Window.partitionBy("k").orderBy("a", "b")
    fresh = F.when(F.col("a") <= F.max("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), 0).otherwise(1)
    g = rows.withColumn("fresh", fresh).withColumn("g", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return g.groupBy("k", "g").agg(F.min("a").alias("a"), F.max("b").alias("b"), F.count(F.lit(1)).alias("n")).drop("g")


RUNS = "SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS island FROM conversations"


@query(f"SELECT conv_id, role, min(turn) AS first_turn, count(*) AS n FROM ({RUNS}) GROUP BY conv_id, role, island")
def same_key_runs(spark, d):
    return sql(spark, d, f"SELECT conv_id, role, min(turn) AS first_turn, count(*) AS n FROM ({RUNS}) GROUP BY conv_id, role, island")


@query("SELECT conv_id, turn, lag(role) OVER w AS before_role, lead(role) OVER w AS after_role, length(text) AS n FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)")
def neighbours(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn")
    return table(spark, d, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("before_role"), F.lead("role").over(w).alias("after_role"), F.length("text").cast("long").alias("n"))


@query("SELECT conv_id, arg_min(text, turn) AS opening, count(*) AS turns FROM conversations GROUP BY conv_id")
def opening_line(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.min_by("text", "turn").alias("opening"), F.count(F.lit(1)).alias("turns"))


@query("SELECT event_id, min(ts) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 MICROSECOND FOLLOWING AND UNBOUNDED FOLLOWING) AS next_start FROM events")
def section_end_boundary(spark, d):
    """The smallest start strictly after a row's own: rows of one time share it."""
    starts = table(spark, d, "events").select("user_id", "ts").distinct()
    nxt = starts.withColumn("next_start", F.lead("ts").over(Window.partitionBy("user_id").orderBy("ts")))
    return table(spark, d, "events").join(nxt, ["user_id", "ts"]).select("event_id", "next_start")


@query("SELECT doc_id, y, last_value(y IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx) AS year_group, idx FROM (SELECT doc_id, idx, CASE WHEN regexp_matches(line, '[0-9]{4}') THEN regexp_extract(line, '[0-9]{4}') END AS y FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents))")
def year_group_ffill(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("idx", "line"))
    y = F.when(F.col("line").rlike("[0-9]{4}"), F.regexp_extract("line", "([0-9]{4})", 1))
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("doc_id", "idx", y.alias("y")).withColumn("year_group", F.last("y", True).over(w))


@query("SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_returnflag = 'R' THEN l_shipdate END, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END, TIMESTAMP '1900-01-01 00:00:00') AS d FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey")
def multi_field_coalesce_date(spark, d):
    at = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return at.select("l_orderkey", "l_linenumber", F.coalesce(F.when(F.col("l_returnflag") == "R", F.col("l_shipdate")), F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")), F.to_timestamp_ntz(F.lit("1900-01-01 00:00:00"))).alias("d"))


@query("SELECT p_brand, string_agg(DISTINCT CAST(p_size AS VARCHAR), ',' ORDER BY CAST(p_size AS VARCHAR)) AS sizes, count(DISTINCT p_type) AS types FROM part GROUP BY p_brand")
def distinct_parts(spark, d):
    return table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.array_sort(F.collect_set(F.col("p_size").cast("string"))), ",").alias("sizes"), F.countDistinct("p_type").alias("types"))


@query("(SELECT c_nationkey AS n FROM customer) INTERSECT (SELECT s_nationkey FROM supplier)")
def common_values(spark, d):
    return table(spark, d, "customer").select(F.col("c_nationkey").alias("n")).intersect(table(spark, d, "supplier").select("s_nationkey"))


@query("(SELECT p_partkey AS k FROM part) EXCEPT (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")
def unclaimed_rows(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("k")).exceptAll(table(spark, d, "lineitem").filter("l_quantity > 45").select("l_partkey").distinct())


@query("SELECT doc_id, substr(md5(text), 1, 12) AS fingerprint FROM documents")
def content_fingerprint(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.md5("text"), 1, 12).alias("fingerprint"))


