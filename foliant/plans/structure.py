"""Queries on headings, sections, spans and chains."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions.text import squash
from foliant.operators import segment, structure
from foliant.plans.documents import HEADINGS, LINES
from foliant.plans.documents import ORACLE as DOCS
from foliant.plans.registry import registry
from foliant.sources.entries import ENTRIES, entries
from foliant.sources.tables import table

QUERIES, ORACLE, query = registry()


@query(f"SELECT l.doc_id, l.idx, s.section, s.header FROM ({LINES}) l JOIN ({DOCS['section_intervals']}) s ON s.doc_id = l.doc_id AND l.idx BETWEEN s.start_idx AND s.end_idx")
def interval_join(spark, d):
    """Lines to the sections that hold them. Sections don't overlap, so the last start at or before a line decides: no range join."""
    docs = table(spark, d, "documents")
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    at = segment.scored_lines(docs).withColumn("section", F.sum(F.col("is_header").cast("int")).over(w)).withColumn("header", F.last(F.when(F.col("is_header"), F.col("line")), True).over(w))
    return at.select("doc_id", "idx", "section", "header")


TREE = f"SELECT page_id AS doc, ord, level, ord * 10 AS start, ord * 10 + (page_id + ord) % 25 AS end_, coalesce(lead(level) OVER (PARTITION BY page_id ORDER BY ord), 0) <= level AS leaf FROM ({HEADINGS})"


def _tree(spark, d):
    """Headings of pages with a claimed end."""
    h = segment.headings(table(spark, d, "pages"))
    leaf = F.coalesce(F.lead("level").over(Window.partitionBy("page_id").orderBy("ord")), F.lit(0)) <= F.col("level")
    return h.select(F.col("page_id").alias("doc"), "ord", "level", (F.col("ord") * 10).alias("start"), (F.col("ord") * 10 + (F.col("page_id") + F.col("ord")) % 25).alias("end"), leaf.alias("leaf"), "title")


@query(f"""WITH t AS ({TREE}) SELECT doc, ord, CASE WHEN leaf THEN least(end_, coalesce((SELECT min(u.start) FROM t u WHERE u.doc = t.doc AND u.start > t.start) - 1, end_)) ELSE end_ END AS end_at FROM t""")
def clip_leaf_ends(spark, d):
    return structure.clip_leaves(_tree(spark, d)).select("doc", "ord", F.col("end").alias("end_at"))


@query(f"""WITH t AS ({TREE}), s AS (SELECT *, coalesce((SELECT min(u.ord) FROM t u WHERE u.doc = t.doc AND u.ord > t.ord AND u.level <= t.level), 1000000) AS stop FROM t)
SELECT s.doc, s.ord, max(u.end_) AS end_at FROM s JOIN t u ON u.doc = s.doc AND u.ord >= s.ord AND u.ord < s.stop GROUP BY s.doc, s.ord""")
def ancestor_cover(spark, d):
    return structure.ancestor_cover(_tree(spark, d)).select("doc", "ord", F.col("end").alias("end_at"))


@query(f"""WITH t AS ({TREE}), s AS (SELECT *, coalesce((SELECT min(u.ord) FROM t u WHERE u.doc = t.doc AND u.ord > t.ord AND u.level <= t.level), 1000000) AS stop FROM t)
SELECT s.doc, s.ord, count(*) AS nodes FROM s JOIN t u ON u.doc = s.doc AND u.ord >= s.ord AND u.ord < s.stop GROUP BY s.doc, s.ord""")
def tree_count(spark, d):
    """Nodes of each heading's tree, itself included."""
    up = structure.with_ancestors(_tree(spark, d))
    return up.select("doc", F.explode(F.concat("above", F.array("ord"))).alias("ord")).groupBy("doc", "ord").agg(F.count(F.lit(1)).alias("nodes"))


@query(f"""WITH t AS (SELECT *, (doc + ord) % 3 > 0 AS found FROM ({TREE})), s AS (SELECT *, coalesce((SELECT min(u.ord) FROM t u WHERE u.doc = t.doc AND u.ord > t.ord AND u.level <= t.level), 1000000) AS stop FROM t)
SELECT doc, ord FROM s WHERE EXISTS (SELECT 1 FROM t u WHERE u.doc = s.doc AND u.ord >= s.ord AND u.ord < s.stop AND u.found)""")
def tree_prune(spark, d):
    """A heading that isn't found goes, unless one below it stays."""
    up = structure.with_ancestors(_tree(spark, d)).filter((F.col("doc") + F.col("ord")) % 3 > 0)
    return up.select("doc", F.explode(F.concat("above", F.array("ord"))).alias("ord")).distinct()


@query(f"""WITH t AS ({TREE}) SELECT doc, ord, (SELECT max(u.ord) FROM t u WHERE u.doc = t.doc AND u.ord < t.ord AND u.level < t.level) AS parent FROM t""")
def outline_parents(spark, d):
    """The nearest heading above of a smaller level."""
    up = structure.with_ancestors(_tree(spark, d))
    return up.select("doc", "ord", F.array_max("above").alias("parent"))


@query(f"""WITH t AS ({TREE}), p AS (SELECT doc, ord, start, (SELECT max(u.ord) FROM t u WHERE u.doc = t.doc AND u.ord < t.ord AND u.level < t.level) AS parent FROM t)
SELECT c.doc, c.ord FROM p c LEFT JOIN p q ON q.doc = c.doc AND q.ord = c.parent WHERE q.ord IS NULL OR c.start % 20 <> q.start % 20""")
def dedupe_children(spark, d):
    """Headings that don't stand on their parent's place."""
    up = structure.with_ancestors(_tree(spark, d)).withColumn("parent", F.array_max("above"))
    of = up.select("doc", F.col("ord").alias("parent"), F.col("start").alias("p_start"))
    return up.join(of, ["doc", "parent"], "left").filter("p_start is null or start % 20 <> p_start % 20").select("doc", "ord")


EVENTS = "SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS idx, event_type AS text, event_id FROM events"
SEQUENCE = ("view", "click", "purchase")


def _elements(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select(F.col("user_id").alias("doc"), (F.row_number().over(w) - 1).alias("idx"), F.col("event_type").alias("text"), "event_id")


@query(f"""WITH e AS ({EVENTS}), a AS (SELECT doc, min(idx) AS at_0 FROM e WHERE text = 'view' GROUP BY doc), b AS (SELECT a.doc, at_0, min(idx) AS at_1 FROM a JOIN e ON e.doc = a.doc AND text = 'click' AND idx > at_0 GROUP BY ALL)
SELECT b.doc, at_0, at_1, min(idx) AS at_2 FROM b JOIN e ON e.doc = b.doc AND text = 'purchase' AND idx > at_1 GROUP BY ALL""")
def header_sequence_join(spark, d):
    """A path of texts in document order, each after the one before; documents that break it have no row."""
    return structure.find_sequence(_elements(spark, d), SEQUENCE)


@query(f"SELECT h.doc, h.text AS header, (SELECT min(idx) FROM ({EVENTS}) e WHERE e.doc = h.doc AND e.text = h.text) AS at FROM (SELECT DISTINCT u.user_id AS doc, t.event_type AS text FROM (SELECT DISTINCT user_id FROM events) u, (SELECT DISTINCT event_type FROM events) t WHERE t.event_type IN ('purchase', 'error')) h")
def header_fallback_join(spark, d):
    """Headers that have no place yet take the first line of their text; those without one stay, without a place."""
    e = _elements(spark, d)
    wanted = e.select("doc").distinct().select("doc", F.explode(F.array(F.lit("purchase"), F.lit("error"))).alias("header"))
    first = e.groupBy("doc", F.col("text").alias("header")).agg(F.min("idx").alias("at"))
    return wanted.join(first, ["doc", "header"], "left")


SPANS = "SELECT l_suppkey AS doc, l_orderkey * 10 + l_linenumber AS id, l_orderkey % 500 * 10 AS start, l_orderkey % 500 * 10 + (l_quantity * 3)::BIGINT AS end_ FROM lineitem"


@query(f"""WITH s AS ({SPANS}) SELECT doc, count(*) AS kept, sum(end_ - start)::BIGINT AS held FROM (SELECT doc, start, end_ FROM (SELECT DISTINCT doc, start, end_ FROM s) a WHERE NOT EXISTS (SELECT 1 FROM s b WHERE b.doc = a.doc AND b.start <= a.start AND b.end_ >= a.end_ AND (b.start < a.start OR b.end_ > a.end_))) GROUP BY doc""")
def subset_removal(spark, d):
    i = table(spark, d, "lineitem")
    at = (F.col("l_orderkey") % 500) * 10
    spans = i.select(F.col("l_suppkey").alias("doc"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), at.alias("start"), (at + (F.col("l_quantity") * 3).cast("long")).alias("end"))
    return structure.without_subsets(spans).groupBy("doc").agg(F.count(F.lit(1)).alias("kept"), F.sum(F.col("end") - F.col("start")).alias("held"))


@query(f"""SELECT person, string_agg(text, chr(9) ORDER BY entry_id) AS text, min(entry_id) AS first_id, count(*) AS n FROM (SELECT *, sum(CASE WHEN kind = 6 THEN 0 ELSE 1 END) OVER (PARTITION BY person ORDER BY entry_id) AS g FROM {ENTRIES}) GROUP BY person, g, CASE WHEN g = 0 THEN entry_id END""")
def fold_labelled_detail(spark, d):
    """Undated lines fold into the entry above, one after another; those with none above stay alone."""
    at = structure.opened_groups(entries(spark, d), F.lit(False), F.col("kind") == 6, "person", "entry_id")
    alone = F.when(F.col("group") == 0, F.col("entry_id"))
    rows = at.groupBy("person", "group", alone.alias("alone")).agg(F.sort_array(F.collect_list(F.struct("entry_id", "text"))).alias("l"))
    return rows.select("person", F.array_join("l.text", "\t").alias("text"), F.col("l")[0]["entry_id"].alias("first_id"), F.size("l").cast("long").alias("n"))


@query(f"""SELECT person, entry_id, CASE WHEN kind NOT IN (3, 4) AND nk = 4 THEN text || chr(9) || nd ELSE text END AS text FROM (SELECT *, lead(kind) OVER w AS nk, lead(dates) OVER w AS nd, lag(kind) OVER w AS pk FROM {ENTRIES} WINDOW w AS (PARTITION BY person ORDER BY entry_id)) WHERE NOT (kind = 4 AND pk IS NOT NULL AND pk NOT IN (3, 4))""")
def fold_bare_dates(spark, d):
    """A line that is a date alone (here those written with slashes) completes the record above it, unless that ends in such a date or a month."""
    w = Window.partitionBy("person").orderBy("entry_id")
    at = entries(spark, d).withColumn("next", F.lead(F.struct("kind", "dates")).over(w)).withColumn("before", F.lag("kind").over(w))
    takes = ~F.col("kind").isin(3, 4) & F.coalesce(F.col("next.kind") == 4, F.lit(False))
    gone = (F.col("kind") == 4) & F.col("before").isNotNull() & ~F.col("before").isin(3, 4)
    return at.filter(~gone).select("person", "entry_id", F.when(takes, F.concat_ws("\t", "text", "next.dates")).otherwise(F.col("text")).alias("text"))


@query(f"""SELECT entry_id, CASE WHEN head THEN first_y END AS year_group FROM (SELECT entry_id, first_value(kind = 7) OVER w AS head, first_value(y) OVER w AS first_y FROM (SELECT *, sum(CASE WHEN kind IN (6, 8) THEN 0 ELSE 1 END) OVER (PARTITION BY person ORDER BY entry_id) AS g FROM {ENTRIES}) WINDOW w AS (PARTITION BY person, g ORDER BY entry_id))""")
def year_group_redate(spark, d):
    """A head opens a group with its year; the members that follow it belong to it; any other row ends it."""
    at = structure.opened_groups(entries(spark, d), F.col("kind") == 7, F.col("kind").isin(6, 8), "person", "entry_id")
    w = Window.partitionBy("person", "group").orderBy("entry_id")
    return at.select("entry_id", F.when(F.col("opened") == 1, F.first("y").over(w)).alias("year_group"))


RUNS = f"SELECT *, sum(fresh) OVER (PARTITION BY person ORDER BY entry_id) AS run FROM (SELECT *, CASE WHEN lag(place) OVER (PARTITION BY person ORDER BY entry_id) = place THEN 0 ELSE 1 END AS fresh FROM {ENTRIES})"


@query(f"""SELECT entry_id, max(CASE WHEN kind % 2 = 0 THEN entry_id END) OVER (PARTITION BY person, run ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up, min(CASE WHEN kind % 2 = 0 THEN entry_id END) OVER (PARTITION BY person, run ORDER BY entry_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS down FROM ({RUNS})""")
def nearest_numbered(spark, d):
    """The nearest numbered rows on either side, inside a run of one place."""
    at = structure.nearest(structure.islands(entries(spark, d), "place", "person", "entry_id"), F.col("kind") % 2 == 0, ["person", "run"], "entry_id")
    return at.select("entry_id", F.col("before").alias("up"), F.col("after").alias("down"))


@query(f"""WITH n AS (SELECT person, entry_id, code, kind, run, max(CASE WHEN kind % 2 = 0 THEN entry_id END) OVER (PARTITION BY person, run ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up, min(CASE WHEN kind % 2 = 0 THEN entry_id END) OVER (PARTITION BY person, run ORDER BY entry_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS down FROM ({RUNS}))
SELECT n.entry_id, n.up AS mentee_row FROM n JOIN n a ON a.entry_id = n.up JOIN n b ON b.entry_id = n.down WHERE n.kind % 2 = 1 AND b.kind = a.kind + 2""")
def mentee_bracket(spark, d):
    """Rows between a numbered row and the next number of the same run."""
    at = structure.nearest(structure.islands(entries(spark, d), "place", "person", "entry_id"), F.col("kind") % 2 == 0, ["person", "run"], "entry_id")
    w = Window.partitionBy("person", "run").orderBy("entry_id")
    number = F.when(F.col("kind") % 2 == 0, F.col("kind"))
    up, down = F.last(number, True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.first(number, True).over(w.rowsBetween(1, Window.unboundedFollowing))
    return at.withColumn("a", up).withColumn("b", down).filter("kind % 2 = 1 and b = a + 2").select("entry_id", F.col("before").alias("mentee_row"))


LINKS = "SELECT c_custkey AS node, CASE c_custkey % 6 WHEN 0 THEN NULL WHEN 5 THEN CASE WHEN c_custkey % 4 = 1 THEN c_custkey + 1 ELSE c_custkey - 1 END WHEN 4 THEN CASE WHEN c_custkey % 5 = 0 THEN c_custkey + 1 ELSE c_custkey - 1 END ELSE c_custkey - 1 END AS target FROM customer"


@query(f"""WITH RECURSIVE l AS ({LINKS}), walk AS (SELECT node, target AS at, sign(target - node) AS way FROM l WHERE target IS NOT NULL
UNION ALL SELECT w.node, l.target, CASE WHEN sign(l.target - w.at) = w.way THEN w.way ELSE 0 END FROM walk w JOIN l ON l.node = w.at WHERE l.target IS NOT NULL AND w.way <> 0)
SELECT l.node, max(CASE WHEN e.target IS NULL AND w.way <> 0 THEN w.at END) AS root FROM l JOIN walk w ON w.node = l.node LEFT JOIN l e ON e.node = w.at WHERE l.target IS NOT NULL GROUP BY l.node""")
def fragment_chain(spark, d):
    """Fragments point at the entry they go on from; a chain that turns back leads nowhere."""
    k = F.col("c_custkey")
    target = F.when(k % 6 == 0, None).when(k % 6 == 5, F.when(k % 4 == 1, k + 1).otherwise(k - 1)).when(k % 6 == 4, F.when(k % 5 == 0, k + 1).otherwise(k - 1)).otherwise(k - 1)
    return structure.follow(table(spark, d, "customer").select(k.alias("node"), target.alias("target")))


@query(f"""SELECT entry_id, row_number() OVER (PARTITION BY person ORDER BY parent, entry_id) AS place FROM (SELECT person, entry_id, coalesce(max(CASE WHEN kind <> 6 THEN entry_id END) OVER (PARTITION BY person ORDER BY entry_id), entry_id) AS parent FROM {ENTRIES})""")
def fragment_merge_order(spark, d):
    """Parents in document order, each followed by its fragments."""
    w = Window.partitionBy("person").orderBy("entry_id")
    parent = F.coalesce(F.last(F.when(F.col("kind") != 6, F.col("entry_id")), True).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.col("entry_id"))
    return entries(spark, d).withColumn("parent", parent).select("entry_id", F.row_number().over(Window.partitionBy("person").orderBy("parent", "entry_id")).cast("long").alias("place"))


PASSAGES = f"SELECT doc_id, idx, md5(concat_ws('|', squashed, lead(squashed, 1) OVER w, lead(squashed, 2) OVER w)) AS h, lead(squashed, 2) OVER w IS NOT NULL AS whole FROM (SELECT doc_id, idx, lower(regexp_replace(line, '\\s+', '', 'g')) AS squashed FROM ({LINES}) WHERE line <> '') WINDOW w AS (PARTITION BY doc_id ORDER BY idx)"


@query(f"SELECT h, count(*) AS n, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM ({PASSAGES}) WHERE whole GROUP BY h HAVING count(*) > 1")
def duplicate_passages(spark, d):
    """Three lines in a row that stand twice or more anywhere."""
    w = Window.partitionBy("doc_id").orderBy("idx")
    rows = segment.lines(table(spark, d, "documents")).filter("line <> ''").select("doc_id", "idx", squash(F.col("line")).alias("s"))
    rows = rows.withColumn("b", F.lead("s", 1).over(w)).withColumn("c", F.lead("s", 2).over(w)).filter("c is not null")
    return rows.groupBy(F.md5(F.concat_ws("|", "s", "b", "c")).alias("h")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc")).filter("n > 1")


@query(f"""SELECT entry_id, place FROM (SELECT e.entry_id, CASE WHEN readable THEN s.own ELSE e.own END AS place FROM (SELECT *, row_number() OVER (PARTITION BY person, y, kind <> 6 ORDER BY CASE WHEN kind <> 6 THEN -m END, entry_id) AS nth FROM (SELECT *, kind <> 6 AS readable, row_number() OVER (PARTITION BY person, y ORDER BY entry_id) AS own FROM {ENTRIES})) e
LEFT JOIN (SELECT person, y, own, row_number() OVER (PARTITION BY person, y ORDER BY own) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY person, y ORDER BY entry_id) AS own FROM {ENTRIES}) WHERE kind <> 6) s ON s.person = e.person AND s.y = e.y AND s.nth = e.nth AND readable)""")
def tie_order(spark, d):
    """Entries of one year: those with a readable month go latest first, into the places of such entries."""
    rows = entries(spark, d).withColumn("start", F.when(F.col("kind") != 6, F.col("m")))
    return structure.slots(rows, ["person", "y"], "entry_id", "start").select("entry_id", F.col("place").cast("long").alias("place"))


INDEX = "CASE l_linenumber % 3 WHEN 0 THEN l_orderkey::VARCHAR WHEN 1 THEN l_orderkey || '.' || l_partkey % 12 ELSE 'table_' || l_orderkey END"


@query(f"""SELECT l_suppkey, index, row_number() OVER (PARTITION BY l_suppkey ORDER BY CASE WHEN index LIKE 'table_%' THEN 1000000000 + split_part(index, '_', 2)::BIGINT ELSE split_part(index, '.', 1)::BIGINT END, coalesce(try_cast(split_part(index, '.', 2) AS INT), 0), index) AS place FROM (SELECT DISTINCT l_suppkey, {INDEX} AS index FROM lineitem)""")
def document_order(spark, d):
    """Plain, dotted and table indexes of every supplier in one order."""
    k = F.col("l_linenumber") % 3
    o = F.col("l_orderkey").cast("string")
    index = F.when(k == 0, o).when(k == 1, F.concat_ws(".", o, (F.col("l_partkey") % 12).cast("string"))).otherwise(F.concat(F.lit("table_"), o))
    rows = table(spark, d, "lineitem").select("l_suppkey", index.alias("index")).distinct()
    main = F.when(F.col("index").startswith("table_"), F.split("index", "_")[1].try_cast("long") + 1_000_000_000).otherwise(F.split("index", r"\.")[0].try_cast("long"))
    row = F.coalesce(F.try_element_at(F.split("index", r"\."), F.lit(2)).try_cast("int"), F.lit(0))
    return rows.select("l_suppkey", "index", F.row_number().over(Window.partitionBy("l_suppkey").orderBy(main, row, "index")).cast("long").alias("place"))


@query(f"SELECT person, min(n) AS lines, sum(n - used)::BIGINT AS free FROM (SELECT person, 40 AS n, count(DISTINCT entry_id % 40) AS used FROM {ENTRIES} GROUP BY person) GROUP BY person")
def unclaimed_coverage(spark, d):
    """Of forty lines, those that no entry claims."""
    used = entries(spark, d).groupBy("person").agg(F.collect_set(F.col("entry_id") % 40).alias("used"))
    return used.select("person", F.lit(40).alias("lines"), F.size(F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(39).cast("long")), F.col("used"))).cast("long").alias("free"))
