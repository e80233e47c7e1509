"""Coverage, comparison and evaluation queries: documents against an altered copy, reports against labels, snapshots against snapshots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions.text import significant_words, squash
from foliant.operators import lints, segment
from foliant.plans.documents import FINDINGS, LINES
from foliant.plans.identities import WORDS
from foliant.plans.registry import registry
from foliant.sources.entries import ENTRIES, entries
from foliant.sources.tables import table

QUERIES, ORACLE, query = registry()

SUBSTANTIVE = 15
MEGA_RECORDS = 3

# The copy lost every 7th line, and had every 11th joined to the next without white space.
KEPT = f"SELECT * FROM ({LINES}) WHERE (doc_id + idx) % 7 > 0"


def _kept(spark, d):
    return segment.lines(table(spark, d, "documents")).filter((F.col("doc_id") + F.col("idx")) % 7 > 0)


SQUASH = r"lower(regexp_replace({}, '\s+', '', 'g'))"
METRICS = f"""SELECT l.doc_id, count(*) AS lines, count(*) FILTER (length(trim(line, ' ')) >= 15) AS substantive, count(*) FILTER (length(trim(line, ' ')) >= 15 AND NOT contains(coalesce(body, ''), {SQUASH.format('line')})) AS lost
FROM ({LINES}) l LEFT JOIN (SELECT doc_id, string_agg({SQUASH.format('line')}, chr(0) ORDER BY idx) AS body FROM ({KEPT}) GROUP BY doc_id) k ON k.doc_id = l.doc_id GROUP BY l.doc_id"""


@query(f"SELECT *, CASE WHEN substantive = 0 THEN 100.0 ELSE round_even(100.0 * (substantive - lost) / substantive, 1) END AS pct FROM ({METRICS})")
def coverage_metrics(spark, d):
    """Substantive lines of each document that stand, white space apart, in what was kept of it."""
    body = _kept(spark, d).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", squash(F.col("line")).alias("s")))), lambda x: x["s"]), "\0").alias("body"))
    at = segment.lines(table(spark, d, "documents")).join(body, "doc_id", "left")
    real = F.length(F.trim("line")) >= SUBSTANTIVE
    gone = real & ~F.contains(F.coalesce("body", F.lit("")), squash(F.col("line")))
    out = at.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(real).alias("substantive"), F.count_if(gone).alias("lost"))
    return out.withColumn("pct", F.when(F.col("substantive") == 0, 100.0).otherwise(F.bround(100.0 * (F.col("substantive") - F.col("lost")) / F.col("substantive"), 1)))


@query(f"SELECT doc_id, pct, lost FROM ({ORACLE['coverage_metrics']}) WHERE pct < 97 OR lost > 0")
def absolute_flags(spark, d):
    return coverage_metrics(spark, d).filter("pct < 97 or lost > 0").select("doc_id", "pct", "lost")


# A second snapshot lost other lines.
OTHER = METRICS.replace("(doc_id + idx) % 7 > 0", "(doc_id + 2 * idx) % 9 > 0")


def _other(spark, d):
    docs = segment.lines(table(spark, d, "documents"))
    body = docs.filter((F.col("doc_id") + 2 * F.col("idx")) % 9 > 0).groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("idx", squash(F.col("line")).alias("s")))), lambda x: x["s"]), "\0").alias("body"))
    real = F.length(F.trim("line")) >= SUBSTANTIVE
    gone = real & ~F.contains(F.coalesce("body", F.lit("")), squash(F.col("line")))
    return docs.join(body, "doc_id", "left").groupBy("doc_id").agg(F.count_if(gone).alias("lost_after"))


@query(f"""SELECT doc_id, a.lost, b.lost AS lost_after, CASE WHEN b.lost > a.lost THEN 'REGRESSION' WHEN b.lost < a.lost THEN 'IMPROVED' ELSE 'OK' END AS verdict FROM ({METRICS}) a JOIN ({OTHER}) b USING (doc_id)""")
def metric_verdict(spark, d):
    both = coverage_metrics(spark, d).select("doc_id", "lost").join(_other(spark, d), "doc_id")
    return both.withColumn("verdict", F.when(F.col("lost_after") > F.col("lost"), "REGRESSION").when(F.col("lost_after") < F.col("lost"), "IMPROVED").otherwise("OK"))


@query(f"""SELECT verdict, count(*) AS docs, sum(lost_after - lost)::BIGINT AS more_lost FROM ({ORACLE['metric_verdict']}) GROUP BY verdict""")
def snapshot_compare(spark, d):
    return metric_verdict(spark, d).groupBy("verdict").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.col("lost_after") - F.col("lost")).alias("more_lost"))


@query(f"""SELECT side, doc_id, line, n FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.line, b.line) AS line, CASE WHEN coalesce(a.n, 0) > coalesce(b.n, 0) THEN 'before' ELSE 'after' END AS side, abs(coalesce(a.n, 0) - coalesce(b.n, 0)) AS n
FROM (SELECT doc_id, line, count(*) AS n FROM ({KEPT}) GROUP BY ALL) a FULL JOIN (SELECT doc_id, line, count(*) AS n FROM ({LINES}) WHERE (doc_id + 2 * idx) % 9 > 0 GROUP BY ALL) b ON a.doc_id = b.doc_id AND a.line = b.line) WHERE n > 0""")
def render_diff_gate(spark, d):
    """Paragraphs that one of two renders has more often; multisets, not sets."""
    side = lambda rows, n: rows.groupBy("doc_id", "line").agg(F.count(F.lit(1)).alias(n))
    other = segment.lines(table(spark, d, "documents")).filter((F.col("doc_id") + 2 * F.col("idx")) % 9 > 0)
    both = side(_kept(spark, d), "a").join(side(other, "b"), ["doc_id", "line"], "full").na.fill(0, ["a", "b"])
    return both.filter("a <> b").select(F.when(F.col("a") > F.col("b"), "before").otherwise("after").alias("side"), "doc_id", "line", F.abs(F.col("a") - F.col("b")).alias("n"))


@query(rf"""WITH w AS (SELECT entry_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w FROM {ENTRIES}), f AS (SELECT entry_id, unnest(regexp_extract_all(lower(title || ' ' || CASE WHEN entry_id % 2 = 0 THEN dates ELSE '' END), '[a-z0-9]+')) AS w FROM {ENTRIES}),
a AS (SELECT entry_id, w, count(*) AS n FROM w GROUP BY ALL), b AS (SELECT entry_id, w, count(*) AS m FROM f GROUP BY ALL) SELECT entry_id, sum(n - least(n, coalesce(m, 0)))::BIGINT AS uncovered, sum(n)::BIGINT AS tokens FROM a LEFT JOIN b USING (entry_id, w) GROUP BY entry_id""")
def uncovered_tokens(spark, d):
    """Tokens of an entry, as a multiset, that none of its fields holds."""
    words = lambda c: F.explode(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1))).alias("w")
    e = entries(spark, d)
    a = e.select("entry_id", words(F.col("text"))).groupBy("entry_id", "w").agg(F.count(F.lit(1)).alias("n"))
    b = e.select("entry_id", words(F.concat_ws(" ", "title", F.when(F.col("entry_id") % 2 == 0, F.col("dates")).otherwise("")))).groupBy("entry_id", "w").agg(F.count(F.lit(1)).alias("m"))
    return a.join(b, ["entry_id", "w"], "left").groupBy("entry_id").agg(F.sum(F.col("n") - F.least("n", F.coalesce("m", F.lit(0)))).alias("uncovered"), F.sum("n").alias("tokens"))


@query(f"""SELECT entry_id, CASE WHEN n = 0 THEN 100.0 ELSE round_even(100.0 * k / n, 1) END AS pct FROM (SELECT entry_id, len(w) AS n, len(list_intersect(w, f)) AS k FROM (SELECT entry_id, list_filter({WORDS.format('text')}, lambda x: length(x) > 2) AS w, {WORDS.format('title')} AS f FROM {ENTRIES}))""")
def unextracted_content(spark, d):
    """Share of an entry's distinct words of three letters or more that the title field holds."""
    w, f = F.filter(significant_words(F.col("text")), lambda x: F.length(x) > 2), significant_words(F.col("title"))
    rows = entries(spark, d).select("entry_id", F.size(w).alias("n"), F.size(F.array_intersect(w, f)).alias("k"))
    return rows.select("entry_id", F.when(F.col("n") == 0, 100.0).otherwise(F.bround(100.0 * F.col("k") / F.col("n"), 1)).alias("pct"))


@query(f"""SELECT doc_id, count(*) AS pairs, count(*) FILTER (list_sort(regexp_extract_all(lower(a), '[a-z0-9]+')) = list_sort(regexp_extract_all(lower(b), '[a-z0-9]+'))) AS same FROM (SELECT doc_id, line AS a, lead(line) OVER (PARTITION BY doc_id ORDER BY idx) AS b FROM ({LINES})) WHERE b IS NOT NULL GROUP BY doc_id""")
def multiset_coverage(spark, d):
    """Of every two neighbouring lines of a document, whether they hold the same tokens, in any order."""
    tokens = lambda c: F.sort_array(F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"), F.lit(1)))
    rows = table(spark, d, "documents").select("doc_id", F.split("text", "\n", -1).alias("l")).filter(F.size("l") > 1).select("doc_id", F.transform("l", tokens).alias("t"))
    same = F.zip_with(F.slice("t", F.lit(1), F.size("t") - 1), F.slice("t", F.lit(2), F.size("t") - 1), lambda a, b: a == b)
    return rows.select("doc_id", (F.size("t") - 1).cast("long").alias("pairs"), F.size(F.filter(same, lambda x: x)).cast("long").alias("same"))


@query(f"SELECT doc_id, count(*) FILTER (length(trim(line, ' ')) > 60 AND contains(line, ', ')) >= 3 AS mega FROM ({LINES}) GROUP BY doc_id")
def mega_entries(spark, d):
    """Entries that pack three record-like lines or more."""
    record = (F.length(F.trim("line")) > 60) & F.col("line").contains(", ")
    return segment.lines(table(spark, d, "documents")).groupBy("doc_id").agg((F.count_if(record) >= MEGA_RECORDS).alias("mega"))


@query(f"""SELECT doc_id, b AS batch, count(*) AS lines, count(*) FILTER (last_line AND NOT ends) AS carried, count(*) FILTER (last_line AND ends) AS clean FROM (SELECT doc_id, idx // 50 AS b, regexp_matches(line, '[.!?]$') AS ends, idx = max(idx) OVER (PARTITION BY doc_id, idx // 50) AS last_line FROM ({LINES})) GROUP BY ALL""")
def batch_carry_counts(spark, d):
    """Batches of 50 lines, and whether their last line ends a sentence. The last line is found by an aggregate."""
    b = F.floor(F.col("idx") / 50).cast("long")
    last = segment.lines(table(spark, d, "documents")).groupBy("doc_id", b.alias("batch")).agg(F.count(F.lit(1)).alias("lines"), F.max_by(F.col("line").rlike("[.!?]$"), "idx").alias("ends"))
    return last.select("doc_id", "batch", "lines", F.when(F.col("ends"), 0).otherwise(1).cast("long").alias("carried"), F.when(F.col("ends"), 1).otherwise(0).cast("long").alias("clean"))


@query(f"WITH f AS ({FINDINGS}) SELECT doc_id, count(DISTINCT lint) AS lints, sum(n)::BIGINT AS findings, bool_or(severity = 'ERROR') AS has_error FROM f GROUP BY doc_id")
def doctor_metrics(spark, d):
    f = lints.findings(table(spark, d, "documents"))
    return f.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lints"), F.sum("n").alias("findings"), F.max(F.col("severity") == "ERROR").alias("has_error"))


@query(f"WITH f AS ({FINDINGS}) SELECT lint, count(*) AS docs, sum(n)::BIGINT AS findings, row_number() OVER (ORDER BY count(*), lint) AS place FROM f GROUP BY lint")
def doctor_groups(spark, d):
    """Findings by lint, the rarest first; a handful of rows are ranked."""
    g = lints.findings(table(spark, d, "documents")).groupBy("lint").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("findings"))
    return g.withColumn("place", F.row_number().over(Window.orderBy("docs", "lint")).cast("long"))


@query(f"WITH f AS ({FINDINGS}) SELECT doc_id, lint, severity, n FROM f ORDER BY CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END, doc_id, lint LIMIT 1000")
def report_cap(spark, d):
    """A report lists a thousand findings at most, errors first."""
    rank = F.when(F.col("severity") == "ERROR", 0).when(F.col("severity") == "WARN", 1).otherwise(2)
    return lints.findings(table(spark, d, "documents")).orderBy(rank, "doc_id", "lint").limit(1000)


@query(f"""WITH f AS ({FINDINGS}), h AS (SELECT l.doc_id, source, lang, toxic::VARCHAR AS toxic, CASE WHEN length(text) < 500 THEN 'short' WHEN length(text) < 5000 THEN 'middle' ELSE 'long' END AS size, l.doc_id IN (SELECT doc_id FROM f) AS hit FROM labels l JOIN documents d ON d.doc_id = l.doc_id WHERE quality = 0)
SELECT facet, value, count(*) AS verified, count(*) FILTER (hit) AS caught, round(count(*) FILTER (hit) / count(*), 6) AS recall FROM (SELECT 'all' AS facet, 'all' AS value, hit FROM h UNION ALL SELECT 'source', source, hit FROM h UNION ALL SELECT 'lang', lang, hit FROM h UNION ALL SELECT 'toxic', toxic, hit FROM h UNION ALL SELECT 'size', size, hit FROM h) GROUP BY facet, value""")
def recall_by_group(spark, d):
    """Verified findings that some lint caught, overall and by four groupings, as grouping sets of one aggregate."""
    docs = table(spark, d, "documents")
    hit = lints.findings(docs).select("doc_id").distinct().withColumn("hit", F.lit(True))
    size = F.when(F.length("text") < 500, "short").when(F.length("text") < 5000, "middle").otherwise("long")
    bad = table(spark, d, "labels").filter("quality = 0").select("doc_id", F.col("toxic").cast("string").alias("toxic")).join(docs.select("doc_id", "source", "lang", size.alias("size")), "doc_id").join(hit, "doc_id", "left")
    by = ["source", "lang", "toxic", "size"]
    sets = bad.withColumn("hit", F.coalesce("hit", F.lit(False))).groupingSets([[], *([c] for c in by)], *by)
    out = sets.agg(F.count(F.lit(1)).alias("verified"), F.count_if("hit").alias("caught"), F.round(F.count_if("hit") / F.count(F.lit(1)), 6).alias("recall"), *(F.grouping(c).alias(f"no_{c}") for c in by))
    pick = lambda of: F.coalesce(*(F.when(F.col(f"no_{c}") == 0, of(c)) for c in by), F.lit("all"))
    return out.select(pick(F.lit).alias("facet"), pick(F.col).alias("value"), "verified", "caught", "recall")


@query("""WITH r AS (SELECT event_type, value, user_id, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS rv, rank() OVER (PARTITION BY event_type ORDER BY user_id) + (count(*) OVER (PARTITION BY event_type, user_id) - 1) / 2.0 AS ru FROM events WHERE value IS NOT NULL)
SELECT event_type, round(corr(rv, ru), 2) AS spearman FROM r GROUP BY event_type""")
def spearman(spark, d):
    """Correlation of average-tie ranks. Ranks come from counts by distinct value, so only distinct values are sorted."""
    e = table(spark, d, "events").filter("value is not null")

    def ranks(c: str, name: str):
        n = e.groupBy("event_type", c).agg(F.count(F.lit(1)).alias("k"))
        before = F.sum("k").over(Window.partitionBy("event_type").orderBy(c).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("k")
        return n.select("event_type", c, (before + 1 + (F.col("k") - 1) / 2.0).alias(name))

    at = e.join(ranks("value", "rv"), ["event_type", "value"]).join(ranks("user_id", "ru"), ["event_type", "user_id"])
    return at.groupBy("event_type").agg(F.round(F.corr("rv", "ru"), 2).alias("spearman"))


@query("""SELECT source, tp, judged, CASE WHEN judged > 0 THEN round(tp / judged, 6) END AS prec, round((tp + 1) / (judged + 2), 6) AS smoothed FROM (SELECT source, count(*) FILTER (quality = 0) AS tp, count(quality) AS judged FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)""")
def precision_smoothing(spark, d):
    at = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("tp"), F.count("quality").alias("judged"))
    return at.select("source", "tp", "judged", F.when(F.col("judged") > 0, F.round(F.col("tp") / F.col("judged"), 6)).alias("prec"), F.round((F.col("tp") + 1) / (F.col("judged") + 2), 6).alias("smoothed"))


@query("""SELECT source, max(ratio) AS worst, max(ratio) > 0.05 AS fires FROM (SELECT source, CASE WHEN count(quality) > 0 THEN round(count(*) FILTER (quality = 0) / count(quality), 6) END AS ratio FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
UNION ALL SELECT source, CASE WHEN count(toxic) > 0 THEN round(count(*) FILTER (toxic = 1) / count(toxic), 6) END FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source) GROUP BY source""")
def fallback_ratio_gate(spark, d):
    """Two ratios against one limit; without counters it never fires."""
    at = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").groupBy("source").agg(F.count("quality").alias("n"), F.count_if(F.col("quality") == 0).alias("a"), F.count("toxic").alias("m"), F.count_if(F.col("toxic") == 1).alias("b"))
    ratio = lambda k, n: F.when(F.col(n) > 0, F.round(F.col(k) / F.col(n), 6))
    return at.select("source", F.greatest(ratio("a", "n"), ratio("b", "m")).alias("worst")).withColumn("fires", F.col("worst") > 0.05)


@query("SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 'v2' ELSE 'v1' END AS weights, CASE WHEN doc_id % 4 = 0 THEN n_chars % 100 ELSE length(text) % 97 END AS score, doc_id % 4 <> 0 AS rescored FROM documents")
def score_backfill(spark, d):
    """Only rows scored with stale weights are scored anew."""
    stale = F.col("doc_id") % 4 != 0
    score = F.when(stale, F.length("text") % 97).otherwise(F.col("n_chars") % 100)
    return table(spark, d, "documents").select("doc_id", F.when(stale, "v1").otherwise("v2").alias("weights"), score.cast("long").alias("score"), stale.alias("rescored"))


@query("""SELECT user_id, count(*) AS edits, count(DISTINCT event_type) AS kinds, max(ts) AS latest, round(sum(value), 2) AS total FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def corrected_copy_report(spark, d):
    return table(spark, d, "events").filter("event_type <> 'error'").groupBy("user_id").agg(F.count(F.lit(1)).alias("edits"), F.countDistinct("event_type").alias("kinds"), F.max("ts").alias("latest"), F.round(F.sum("value"), 2).alias("total"))


@query(f"SELECT coalesce(place || ' > ' || CASE WHEN span > 0 THEN title END, '(none)') AS path, count(*) AS n FROM {ENTRIES} GROUP BY 1")
def group_by_hierarchy(spark, d):
    """The path joined; a path with a missing part is the sentinel's."""
    path = F.concat(F.col("place"), F.lit(" > "), F.when(F.col("span") > 0, F.col("title")))
    return entries(spark, d).groupBy(F.coalesce(path, F.lit("(none)")).alias("path")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT upper(line) = line AS caps, ends_with(line, '.') AS stopped, length(line) // 40 AS width, count(*) AS n, min(doc_id) AS first_doc FROM ({LINES}) GROUP BY ALL")
def group_by_signature(spark, d):
    """Lines by how they look."""
    l = segment.lines(table(spark, d, "documents"))  # noqa: E741
    return l.groupBy((F.upper("line") == F.col("line")).alias("caps"), F.col("line").endswith(".").alias("stopped"), F.floor(F.length("line") / 40).cast("long").alias("width")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


@query(f"SELECT caps, stopped, width, n, round(0.4 * CASE WHEN caps THEN 1 ELSE 0 END + 0.3 * (1 - least(width / 10, 1)) + 0.2 * CASE WHEN stopped THEN 0 ELSE 1 END + 0.1 * (1 / n), 6) AS prominence FROM ({ORACLE['group_by_signature']})")
def prominence_score(spark, d):
    """How much a signature stands out: weights of style, width and rarity."""
    on = lambda c: F.when(c, 1).otherwise(0)
    p = 0.4 * on(F.col("caps")) + 0.3 * (1 - F.least(F.col("width") / 10, F.lit(1))) + 0.2 * on(~F.col("stopped")) + 0.1 * (1 / F.col("n"))
    return group_by_signature(spark, d).select("caps", "stopped", "width", "n", F.round(p, 6).alias("prominence"))


@query(f"SELECT code, count(*) AS n, count(DISTINCT person) AS persons FROM (SELECT code, person, text FROM {ENTRIES} GROUP BY ALL) GROUP BY code")
def group_by_code(spark, d):
    """Entries by code after copies are gone."""
    return entries(spark, d).select("code", "person", "text").distinct().groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("person").alias("persons"))


@query("SELECT user_id, count(*) AS notes, max(ts) AS latest, max(CASE WHEN event_type = 'purchase' THEN value END) AS mine FROM events GROUP BY user_id")
def feedback_summary(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("notes"), F.max("ts").alias("latest"), F.max(F.when(F.col("event_type") == "purchase", F.col("value"))).alias("mine"))


@query("SELECT l_orderkey, string_agg(l_suppkey::VARCHAR, ',' ORDER BY last DESC, l_suppkey) AS reviewers FROM (SELECT l_orderkey, l_suppkey, max(l_shipdate) AS last FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL) GROUP BY l_orderkey")
def reviewer_collection(spark, d):
    """Reviewers of a run, each once, the newest first."""
    each = table(spark, d, "lineitem").filter("l_returnflag = 'R'").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_shipdate").alias("last"))
    ordered = F.array_sort(F.collect_list(F.struct("last", "l_suppkey")), lambda a, b: F.when(a["last"] > b["last"], -1).when(a["last"] < b["last"], 1).when(a["l_suppkey"] < b["l_suppkey"], -1).otherwise(1))
    return each.groupBy("l_orderkey").agg(ordered.alias("r")).select("l_orderkey", F.array_join(F.transform("r", lambda x: x["l_suppkey"].cast("string")), ",").alias("reviewers"))


@query("SELECT o_custkey AS batch, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS finished, count(*) FILTER (o_orderstatus = 'O') AS running, count(*) FILTER (o_orderstatus NOT IN ('F', 'O')) AS other FROM orders GROUP BY 1")
def batch_status_counts(spark, d):
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("batch")).agg(F.count(F.lit(1)).alias("total"), F.count_if(s == "F").alias("finished"), F.count_if(s == "O").alias("running"), F.count_if(~s.isin("F", "O")).alias("other"))


@query("SELECT o_orderpriority AS queue, count(*) AS waiting, min(o_orderdate) AS oldest FROM orders WHERE o_orderstatus = 'P' GROUP BY 1")
def queue_stats(spark, d):
    return table(spark, d, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_orderpriority").alias("queue")).agg(F.count(F.lit(1)).alias("waiting"), F.min("o_orderdate").alias("oldest"))


@query("SELECT n_chars, doc_id, greatest(least(100 + (n_chars - 500) / 1500.0 * (20 - 100), 100), 20) AS score FROM documents")
def linear_interpolation(spark, d):
    """500 to 2,000 characters to 100 down to 20, clamped."""
    x = 100 + (F.col("n_chars") - 500) / F.lit(1500.0) * (20 - 100)
    return table(spark, d, "documents").select("n_chars", "doc_id", F.greatest(F.least(x, F.lit(100.0)), F.lit(20.0)).alias("score"))


@query(f"SELECT entry_id, CASE WHEN code = 'L2' THEN 0.15 WHEN code = 'S1' AND owner % 3 = 0 THEN 0.1 ELSE 0.0 END AS bonus FROM {ENTRIES}")
def seniority_score(spark, d):
    """Principal investigators of grants, and papers whose first or last author is the owner."""
    text, author = F.lower("text"), F.col("owner") % 3 == 0
    grant = F.when(text.contains("co-principal") | text.contains("co-pi"), 0.105).when(text.contains("principal investigator"), 0.15)
    return entries(spark, d).select("entry_id", F.coalesce(F.when(F.col("code") == "L2", grant), F.when((F.col("code") == "S1") & author, 0.1), F.lit(0.0)).alias("bonus"))


@query("SELECT event_id, least(60, 2 * pow(2, event_id % 7)) AS seconds, coalesce(CASE WHEN event_id % 5 = 0 THEN user_id * 1.0 END, least(60, 2 * pow(2, event_id % 7))) AS waits FROM events")
def backoff_wait(spark, d):
    """Doubling waits up to a minute; what the server asks for goes first."""
    own = F.least(F.lit(60.0), 2 * F.pow(F.lit(2.0), F.col("event_id") % 7))
    return table(spark, d, "events").select("event_id", own.alias("seconds"), F.coalesce(F.when(F.col("event_id") % 5 == 0, F.col("user_id") * F.lit(1.0)), own).alias("waits"))


@query("SELECT o_orderkey, '$' || format('{:,}', round_even(o_totalprice, 0)::BIGINT) AS shown FROM orders")
def money_parse(spark, d):
    """Text in several ways of writing to dollars with separators."""
    raw = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("USD "), F.format_number("o_totalprice", 2))).otherwise(F.concat(F.lit("$"), F.format_number("o_totalprice", 2), F.lit(" per year")))
    number = F.regexp_replace(F.regexp_extract(raw, r"([0-9][0-9,]*(?:\.[0-9]+)?)", 1), ",", "").cast("double")
    return table(spark, d, "orders").select("o_orderkey", F.concat(F.lit("$"), F.format_number(F.bround(number), 0)).alias("shown"))


@query("SELECT l_orderkey, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY l_orderkey HAVING abs(sum(l_quantity) - 100) > 0.5")
def column_total_check(spark, d):
    """Columns whose sum is off the configured one by more than the tolerance."""
    at = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum("l_quantity"), 2).alias("total"))
    return at.filter(F.abs(F.col("total") - 100) > 0.5)


@query("SELECT doc_id, greatest(length(text), 1000) // 4 AS tokens, round(0.5 + greatest(length(text), 1000) // 4 * 3 / 1e6 * 12 + greatest(length(text), 1000) // 4 * 15 / 1e6 * 4, 6) AS usd FROM documents")
def run_cost_estimate(spark, d):
    """A fixed part, and the tokens of several passes at two rates."""
    tokens = F.floor(F.greatest(F.length("text"), F.lit(1000)) / 4).cast("long")
    return table(spark, d, "documents").select("doc_id", tokens.alias("tokens"), F.round(0.5 + tokens * 3 / 1e6 * 12 + tokens * 15 / 1e6 * 4, 6).alias("usd"))
