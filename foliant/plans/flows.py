"""Queue, batch and model-shaped queries: packing, claims, deliveries, retries, quotas, second passes."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions.text import significant_words
from foliant.operators import batching, lints, segment
from foliant.plans.documents import FINDINGS, LINES
from foliant.plans.identities import WORDS
from foliant.plans.registry import registry
from foliant.sources.entries import ENTRIES, entries
from foliant.sources.tables import table

QUERIES, ORACLE, query = registry()


@query(f"""WITH RECURSIVE l AS MATERIALIZED (SELECT doc_id, idx, length(line) // 4 + 1 AS t FROM ({LINES})), c AS (SELECT doc_id, idx, t AS used, 0 AS chunk FROM l WHERE idx = 0
UNION ALL SELECT l.doc_id, l.idx, CASE WHEN c.used + l.t > 200 THEN l.t ELSE c.used + l.t END, CASE WHEN c.used + l.t > 200 THEN c.chunk + 1 ELSE c.chunk END FROM c JOIN l ON l.doc_id = c.doc_id AND l.idx = c.idx + 1)
SELECT doc_id, chunk, count(*) AS lines, min(idx) AS first_idx FROM c GROUP BY ALL""")
def token_budget_chunks(spark, d):
    at = batching.chunks(segment.lines(table(spark, d, "documents")), 200, F.floor(F.length("line") / 4) + 1)
    return at.groupBy("doc_id", "chunk").agg(F.count(F.lit(1)).alias("lines"), F.min("idx").alias("first_idx"))


@query(f"""WITH RECURSIVE g AS (SELECT doc_id, record, count(*) AS n FROM (SELECT doc_id, sum(CASE WHEN length(line) > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx) AS record FROM ({LINES})) GROUP BY doc_id, record),
s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY record) AS k FROM g),
c AS (SELECT doc_id, record, k, n AS used, 0 AS batch, n FROM s WHERE k = 1 UNION ALL SELECT s.doc_id, s.record, s.k, CASE WHEN c.used + s.n > 5 THEN s.n ELSE c.used + s.n END, CASE WHEN c.used + s.n > 5 THEN c.batch + 1 ELSE c.batch END, s.n FROM c JOIN s ON s.doc_id = c.doc_id AND s.k = c.k + 1)
SELECT doc_id, batch, sum(n)::BIGINT AS lines, count(*) AS records FROM c GROUP BY ALL""")
def record_aligned_batches(spark, d):
    """Batches of five lines at most that never cut a record; a line of over 60 characters opens one."""
    at = batching.record_batches(segment.lines(table(spark, d, "documents")), 5, F.length("line") > 60)
    return at.groupBy("doc_id", "batch").agg(F.count(F.lit(1)).alias("lines"), F.countDistinct("record").alias("records"))


@query(f"SELECT doc_id, idx, reverse(line) AS result FROM ({LINES})")
def ordered_parallel_map(spark, d):
    return batching.map_texts(segment.lines(table(spark, d, "documents")), lambda x: x[::-1], "doc_id long, idx int", "line")


CODE = "CASE WHEN regexp_matches(text, '(?i)professor') THEN 'D' WHEN regexp_matches(text, '(?i)grant') THEN 'M' WHEN regexp_matches(text, '(?i)paper') THEN 'S' ELSE 'T' END"


def _first_pass(text: str) -> str:
    low = text.lower()
    return "D" if "professor" in low else "M" if "grant" in low else "S" if "paper" in low else "T"


@query(f"SELECT entry_id, {CODE} AS code FROM {ENTRIES}")
def model_call(spark, d):
    """The model is a parameter; this one is a rule, so that its answers can be checked."""
    return batching.map_texts(entries(spark, d), _first_pass, "entry_id long", "text", "code")


@query(f"SELECT entry_id, first_code, CASE WHEN first_code <> 'T' THEN first_code WHEN contains(text, 'Committee') THEN 'N' WHEN contains(text, 'Award') THEN 'H' ELSE 'T' END AS code FROM (SELECT entry_id, text, {CODE} AS first_code FROM {ENTRIES})")
def second_pass(spark, d):
    """Rows that the first pass left unplaced are looked at again, and only those."""
    e = entries(spark, d).select("entry_id", "text")
    first = batching.map_texts(e, _first_pass, "entry_id long", "text", "first_code").join(e, "entry_id")
    again = F.when(F.col("text").contains("Committee"), "N").when(F.col("text").contains("Award"), "H").otherwise("T")
    return first.select("entry_id", "first_code", F.when(F.col("first_code") == "T", again).otherwise(F.col("first_code")).alias("code"))


CORRECTORS = (("D3", "undated", "X1"), ("L2", "Principal Investigator", "L1"), ("S1", "in press", "S4"), ("S1", "Journal", "S2"))


@query(f"""SELECT entry_id, code, CASE WHEN code = 'D3' AND kind = 6 THEN 'X1' WHEN code = 'L2' THEN 'L1' WHEN code = 'S1' THEN 'S4' ELSE code END AS corrected FROM {ENTRIES}""")
def ordered_correctors(spark, d):
    """Rules in a fixed order; the first that fires decides."""
    out = F.col("code")
    for code, marker, new in reversed(CORRECTORS):
        out = F.when((F.col("code") == code) & F.col("text").contains(marker), new).otherwise(out)
    return entries(spark, d).select("entry_id", "code", out.alias("corrected"))


@query(f"SELECT entry_id, parent FROM (SELECT entry_id, kind, coalesce(max(CASE WHEN kind <> 6 THEN entry_id END) OVER (PARTITION BY person ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), min(CASE WHEN kind <> 6 THEN entry_id END) OVER (PARTITION BY person ORDER BY entry_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)) AS parent FROM {ENTRIES}) WHERE kind = 6 AND parent IS NOT NULL")
def fragment_reconnection(spark, d):
    """Orphans go to the entry before them, else to the one after."""
    w = Window.partitionBy("person").orderBy("entry_id")
    whole = F.when(F.col("kind") != 6, F.col("entry_id"))
    parent = F.coalesce(F.last(whole, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first(whole, True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    return entries(spark, d).withColumn("parent", parent).filter("kind = 6 and parent is not null").select("entry_id", "parent")


@query(f"""SELECT entry_id, CASE WHEN entry_id % 5 = 0 AND NOT contains(text, other) AND others > 0 THEN NULL ELSE value END AS value FROM (SELECT a.*, CASE WHEN a.entry_id % 5 = 0 THEN o ELSE a.place END AS value, o AS other, (SELECT count(*) FROM {ENTRIES} b WHERE b.person = a.person AND b.entry_id <> a.entry_id AND contains(b.text, o)) AS others FROM (SELECT *, ['Example State University', 'Example Regional Hospital', 'General Clinic of the North', 'Institute for Surgery'][(entry_id // 5) % 4 + 1] AS o FROM {ENTRIES}) a)""")
def grounding(spark, d):
    """A value that an entry's own text lacks, and another entry of the person has, was borrowed: it goes."""
    from foliant.sources.entries import PLACES, pick

    e = entries(spark, d)
    claimed = pick(PLACES, F.floor(F.col("entry_id") / 5).cast("long") % 4)
    rows = e.select("person", "entry_id", "text", F.when(F.col("entry_id") % 5 == 0, claimed).otherwise(F.col("place")).alias("value"))
    # which values stand in which entries of a person: counted, not paired
    has = e.select("person", "entry_id", F.col("place").alias("value")).groupBy("person", "value").agg(F.count(F.lit(1)).alias("n"))
    at = rows.join(has, ["person", "value"], "left")
    own = F.contains("text", "value")
    return at.select("entry_id", F.when(own | (F.coalesce("n", F.lit(0)) == 0), F.col("value")).alias("value"))


@query(f"SELECT entry_id, CASE WHEN share < 0.5 THEN text ELSE title END AS field, share < 0.5 AS recovered FROM (SELECT entry_id, title, text, len(list_intersect({WORDS.format('text')}, {WORDS.format('title')})) / len({WORDS.format('text')}) AS share FROM {ENTRIES})")
def recovery(spark, d):
    """Entries whose field holds less than half of their words are extracted again; the rest keep what they have."""
    w, f = significant_words(F.col("text")), significant_words(F.col("title"))
    poor = F.size(F.array_intersect(w, f)) / F.size(w) < 0.5
    return entries(spark, d).select("entry_id", F.when(poor, F.col("text")).otherwise(F.col("title")).alias("field"), poor.alias("recovered"))


@query(f"""SELECT person, 'Recent work: ' || string_agg(title, '; ' ORDER BY k) || '.' AS summary FROM (SELECT person, title, row_number() OVER (PARTITION BY person ORDER BY y DESC, entry_id) AS k FROM {ENTRIES}) WHERE k <= 3 GROUP BY person""")
def summary_text(spark, d):
    """The latest three entries of a person in a sentence: a top-3 by person, then an ordered join of three."""
    k = F.row_number().over(Window.partitionBy("person").orderBy(F.desc("y"), "entry_id"))
    top = entries(spark, d).select("person", "title", k.alias("k")).filter("k <= 3").groupBy("person").agg(F.sort_array(F.collect_list(F.struct("k", "title"))).alias("l"))
    return top.select("person", F.concat(F.lit("Recent work: "), F.array_join("l.title", "; "), F.lit(".")).alias("summary"))


@query(f"""SELECT person, arg_max(place, (w, n, place)) AS owner_place FROM (SELECT person, place, sum(CASE WHEN code = 'D3' THEN 3 WHEN code = 'H' THEN 2 ELSE 1 END) AS w, count(*) AS n FROM {ENTRIES} GROUP BY ALL) GROUP BY person""")
def owner_inference(spark, d):
    """The best of ranked candidates, by the weight of where they stand, then how often."""
    w = F.sum(F.when(F.col("code") == "D3", 3).when(F.col("code") == "H", 2).otherwise(1))
    c = entries(spark, d).groupBy("person", "place").agg(w.alias("w"), F.count(F.lit(1)).alias("n"))
    return c.groupBy("person").agg(F.max_by("place", F.struct("w", "n", "place")).alias("owner_place"))


# A queue: tokens are users, deliveries their events, an error an unacknowledged delivery.
IDLE = "INTERVAL 30 MINUTE"


@query(f"""SELECT user_id, count(*) FILTER (event_type = 'error' AND next - ts > {IDLE}) AS reclaimed, count(*) FILTER (event_type = 'error' AND (next IS NULL OR next - ts <= {IDLE})) AS pending, count(*) FILTER (event_type <> 'error') AS acked FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS next FROM events) GROUP BY user_id""")
def reclaim_idle(spark, d):
    """Deliveries without an acknowledgement that stayed idle are taken over by the next one."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = table(spark, d, "events").withColumn("idle", F.lead("ts").over(w) - F.col("ts"))
    bad, late = F.col("event_type") == "error", F.coalesce(F.col("idle") > F.expr(IDLE), F.lit(False))
    return e.groupBy("user_id").agg(F.count_if(bad & late).alias("reclaimed"), F.count_if(bad & ~late).alias("pending"), F.count_if(~bad).alias("acked"))


@query("SELECT user_id AS token, event_id AS delivery, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def claim_once(spark, d):
    """Of all deliveries of a token the first claims it."""
    first = table(spark, d, "events").groupBy(F.col("user_id").alias("token")).agg(F.min(F.struct("ts", "event_id")).alias("f"))
    return first.select("token", F.col("f.event_id").alias("delivery"), F.col("f.ts").alias("ts"))


@query("SELECT o_orderkey, CASE WHEN o_custkey % 10 < 3 THEN 'batch' ELSE 'single' END AS lane, CASE WHEN o_orderstatus = 'P' THEN row_number() OVER (PARTITION BY o_orderstatus, o_orderdate ORDER BY CASE WHEN o_custkey % 10 < 3 THEN 1 ELSE 0 END, o_orderkey) END AS place FROM orders")
def two_lane_priority(spark, d):
    """Of one day's queue the single lane goes first."""
    batch = F.col("o_custkey") % 10 < 3
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderstatus", batch.alias("b"))
    place = F.row_number().over(Window.partitionBy("o_orderstatus", "o_orderdate").orderBy(F.col("b").cast("int"), "o_orderkey"))
    return o.select("o_orderkey", F.when(F.col("b"), "batch").otherwise("single").alias("lane"), F.when(F.col("o_orderstatus") == "P", place).cast("long").alias("place"))


@query("""SELECT user_id, max(ts) > TIMESTAMP '2024-01-30 00:00:00' OR count(*) FILTER (event_type = 'error') > 5 AS live FROM events GROUP BY user_id""")
def liveness(spark, d):
    """Consumers seen of late, or with entries pending in any group."""
    recent = F.max("ts") > F.to_timestamp_ntz(F.lit("2024-01-30 00:00:00"))
    return table(spark, d, "events").groupBy("user_id").agg((recent | (F.count_if(F.col("event_type") == "error") > 5)).alias("live"))


NOW = "1998-01-01 00:00:00"


@query(f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' AND o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 365 DAY THEN 'requeued' WHEN o_orderstatus = 'O' AND o_orderdate < TIMESTAMP '{NOW}' - INTERVAL 730 DAY THEN CASE WHEN o_custkey % 4 < 2 THEN 'retried' ELSE 'failed' END WHEN o_orderstatus = 'O' AND o_totalprice > 250000 THEN 'watched' ELSE 'left' END AS action FROM orders""")
def reap_and_retry(spark, d):
    """Stranded ones are queued again, stale running ones tried again while attempts are left, long ones watched. The time is a parameter."""
    now, at, s = F.to_timestamp_ntz(F.lit(NOW)), F.col("o_orderdate"), F.col("o_orderstatus")
    stale = (s == "O") & (at < now - F.expr("INTERVAL 730 DAYS"))
    action = F.when((s == "P") & (at < now - F.expr("INTERVAL 365 DAYS")), "requeued").when(stale & (F.col("o_custkey") % 4 < 2), "retried").when(stale, "failed").when((s == "O") & (F.col("o_totalprice") > 250_000), "watched").otherwise("left")
    return table(spark, d, "orders").select("o_orderkey", action.alias("action"))


@query("SELECT event_type, r_name AS socket, count(*) AS sent FROM events JOIN region ON user_id % 5 = r_regionkey OR event_type = 'error' GROUP BY ALL")
def event_fan_out(spark, d):
    """An event goes to its own subscriber, an error to all; subscribers are few, and named by the event."""
    all_ = F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))
    to = F.explode(F.when(F.col("event_type") == "error", all_).otherwise(F.array(F.col("user_id") % 5))).alias("r_regionkey")
    sent = table(spark, d, "events").select("event_type", to).groupBy("event_type", "r_regionkey").agg(F.count(F.lit(1)).alias("sent"))
    return sent.join(table(spark, d, "region").select("r_regionkey", F.col("r_name").alias("socket")), "r_regionkey").select("event_type", "socket", "sent")


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE user_id END AS done, CASE WHEN event_type = 'error' THEN NULL ELSE 500 END AS total FROM events")
def progress_extraction(spark, d):
    line = F.when(F.col("event_type") == "error", F.lit("no progress of any kind")).otherwise(F.format_string("Step 3: batch %d of 500 done", F.col("user_id")))
    p = r"(\d+) of (\d+)"
    part = lambda g: F.when(line.rlike(p), F.regexp_extract(line, p, g).cast("long"))
    return table(spark, d, "events").select("event_id", part(1).alias("done"), part(2).alias("total"))


@query("""WITH u AS (SELECT user_id, count(*) FILTER (date_trunc('day', t) = TIMESTAMP '2024-01-15') AS today, count(*) FILTER (date_trunc('month', t) = TIMESTAMP '2024-01-01') AS month FROM (SELECT user_id, timezone('America/New_York', timezone('UTC', ts)) AS t FROM events) GROUP BY user_id)
SELECT c_custkey, coalesce(today, 0) AS today, coalesce(month, 0) AS month, CASE WHEN c_custkey % 5 = 0 THEN NULL WHEN coalesce(month, 0) + 2 > 60 THEN 'month' WHEN coalesce(today, 0) + 2 > 3 THEN 'day' END AS blocked_by FROM customer LEFT JOIN u ON user_id = c_custkey""")
def quota_check(spark, d):
    """Two requested runs against a month's and a day's limit from local midnight, the month first. Users without limits are never blocked."""
    t = F.from_utc_timestamp(F.col("ts").cast("timestamp"), "America/New_York")
    day, month = F.date_trunc("DAY", t) == F.lit("2024-01-15").cast("timestamp"), F.date_trunc("MONTH", t) == F.lit("2024-01-01").cast("timestamp")
    used = table(spark, d, "events").groupBy(F.col("user_id").alias("c_custkey")).agg(F.count_if(day).alias("today"), F.count_if(month).alias("month"))
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 5 != 0, 3).alias("per_day"), F.when(F.col("c_custkey") % 5 != 0, 60).alias("per_month"))
    at = c.join(used, "c_custkey", "left").na.fill(0, ["today", "month"])
    return at.select("c_custkey", "today", "month", F.when(F.col("month") + 2 > F.col("per_month"), "month").when(F.col("today") + 2 > F.col("per_day"), "day").alias("blocked_by"))


@query("""SELECT o_custkey, count(*) AS runs, count(*) >= 5 AND count(*) FILTER (o_orderstatus = 'O') = 0 AS complete FROM orders GROUP BY o_custkey""")
def batch_complete_once(spark, d):
    """A batch is complete when it has as many runs as were handed in and none is running; the aggregate gives one row a batch, so one notice."""
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("runs"), ((F.count(F.lit(1)) >= 5) & (F.count_if(F.col("o_orderstatus") == "O") == 0)).alias("complete"))


# One known defect in every third document.
MUTATED = "(SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN text || chr(10) || 'write to someone@example.org now' ELSE text END AS text, lang, source, n_chars FROM documents)"
NEW = FINDINGS.replace("FROM documents", "FROM changed")


@query(f"""WITH changed AS {MUTATED} SELECT lang, count(*) AS injected, count(*) FILTER (caught) AS caught FROM (SELECT doc_id, lang, doc_id IN (SELECT doc_id FROM ({NEW}) WHERE lint = 'protected_data') AS caught FROM documents WHERE doc_id % 3 = 0) GROUP BY lang""")
def mutation_catch_rate(spark, d):
    """Documents with an injected defect, and how many of them the check for it finds."""
    docs = table(spark, d, "documents")
    bad = docs.withColumn("text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.col("text"), F.lit("\nwrite to someone@example.org now"))).otherwise(F.col("text")))
    hit = lints.findings(bad).filter("lint = 'protected_data'").select("doc_id").distinct().withColumn("hit", F.lit(True))
    at = docs.filter("doc_id % 3 = 0").join(hit, "doc_id", "left")
    return at.groupBy("lang").agg(F.count(F.lit(1)).alias("injected"), F.count_if(F.coalesce("hit", F.lit(False))).alias("caught"))
