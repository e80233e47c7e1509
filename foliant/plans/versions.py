"""Queries on lines by kind and on two versions of a document."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import lines as L
from foliant.functions.text import significant_words, squash
from foliant.operators import alignment, segment
from foliant.plans.documents import LINES
from foliant.plans.identities import WORDS
from foliant.plans.registry import registry
from foliant.sources.entries import ENTRIES, entries
from foliant.sources.tables import table

QUERIES, ORACLE, query = registry()

RUNNING = f"SELECT doc_id, idx, line, count(*) OVER (PARTITION BY doc_id, line) > 1 AND coalesce(min(gap) OVER (PARTITION BY doc_id, line), 0) >= 8 AS repeated FROM (SELECT *, idx - lag(idx) OVER (PARTITION BY doc_id, line ORDER BY idx) AS gap FROM ({LINES}))"


def _running(spark, d):
    """Lines, and whether they run through the document: every two of them a page apart."""
    w = Window.partitionBy("doc_id", "line")
    gap = F.col("idx") - F.lag("idx").over(w.orderBy("idx"))
    at = segment.lines(table(spark, d, "documents")).withColumn("gap", gap)
    return at.withColumn("repeated", (F.count(F.lit(1)).over(w) > 1) & (F.coalesce(F.min("gap").over(w), F.lit(0)) >= L.REPEAT_SPACING))


NUMBER = r"regexp_matches(line, '[0-9]') AND NOT regexp_matches(regexp_replace(lower(line), '(^|[^\p{L}])(pages?|of|p)([^\p{L}]|$)', '\1 \3', 'g'), '\p{L}')"
# between letters only: two page words side by side need a second pass
NUMBER = NUMBER.replace("regexp_replace(lower(line)", r"regexp_replace(regexp_replace(lower(line), '(^|[^\p{L}])(pages?|of|p)([^\p{L}]|$)', '\1 \3', 'g')")
FURNITURE = rf"""(({NUMBER}) OR regexp_matches(line, '(^|[^\p{{L}}])(MERGEFORMAT|NUMPAGES|HYPERLINK|PAGE)([^\p{{L}}]|$)') OR regexp_matches(line, '(?i)curriculum\s*vita') OR line[-1] = ':'
 OR regexp_matches(lower(line), '^[^\p{{L}}]*(\p{{L}}+[^\p{{L}}]+)?(denotes?|designates?|indicates?|marks?)([^\p{{L}}]|$)') OR regexp_matches(lower(line), '^[^a-z0-9]*((last[^a-z0-9]+)?date[^a-z0-9]+prepared|(last[^a-z0-9]+)?(updated|revised)|rev)([^a-z0-9-]|-[^a-z0-9]|-?$)')
 OR regexp_matches(lower(line), '(^|[^a-z0-9-]|[^a-z0-9]-)(h-index|i-?10-index)([^a-z0-9-]|-[^a-z0-9]|-?$)'))"""
COLS = "'activity', 'awarded', 'course', 'date', 'dates', 'degree', 'dissertation', 'enrollment', 'granted', 'inclusive', 'institution', 'location', 'name', 'organisation', 'organization', 'position', 'rank', 'role', 'thesis', 'title', 'year', 'years'"
SPLIT = r"list_filter(regexp_split_to_array(trim(line, ' '), '\s+'), lambda w: w <> '')"
KINDS = rf"""SELECT doc_id, idx, furniture, col_header, caps, furniture OR col_header OR caps OR (len(w) <= 6 AND repeated) AS noise, regexp_matches(line, '\p{{L}}') AND NOT (furniture OR col_header OR caps OR (len(w) <= 6 AND repeated)) AND len(w) >= CASE WHEN regexp_matches(line, '[0-9]') THEN 5 ELSE 8 END AS content,
 length(trim(line, ' ')) > 60 AND (contains(line, ' | ') OR contains(line, chr(9))) AS record, len(low) >= 4 AND len(low) * 2 > len(long) AS prose FROM (
SELECT *, list_filter(long, lambda x: lower(x[1]) = x[1]) AS low, {FURNITURE} AS furniture, upper(line) = line AND lower(line) <> line AND NOT regexp_matches(line, '[0-9]') AS caps,
 len(list_filter(regexp_extract_all(lower(line), '\p{{L}}+'), lambda x: x IN ({COLS}))) >= 2 AND NOT regexp_matches(line, '[0-9,.;:()]') AND len(list_filter(w, lambda x: lower(x[1]) = x[1] AND upper(x[1]) <> x[1])) = 0 AS col_header FROM (
SELECT *, {SPLIT} AS w, list_filter(regexp_extract_all(line, '\p{{L}}+'), lambda x: length(x) >= 4) AS long FROM ({RUNNING})))"""


@query(KINDS)
def line_predicates(spark, d):
    t = F.col("line")
    at = _running(spark, d)
    return at.select("doc_id", "idx", L.is_furniture(t).alias("furniture"), L.is_column_header(t).alias("col_header"), L.is_caps_heading(t).alias("caps"), L.is_gap_noise(t, F.col("repeated")).alias("noise"), L.is_content(t, F.col("repeated")).alias("content"), L.is_record(t).alias("record"), L.is_prose(t).alias("prose"))


@query(rf"""SELECT doc_id, count(*) AS lines, count(*) FILTER (regexp_matches(trim(line, ' '), '(?i)^(please|do not|list all|include|enter|provide)\b|\b(delete this|if applicable|see instructions|use the format)\b|^\[[^\]]*\]$')) AS instructions,
count(*) FILTER (trim(lower(line), ' ') IN (SELECT trim(lower(string_split(text, chr(10))[1]), ' ') FROM benchmark)) AS of_template FROM ({LINES}) GROUP BY doc_id""")
def template_boilerplate(spark, d):
    """Lines that a template says to who fills it in, by their words or because they stand in the template (here the items' first lines)."""
    known = table(spark, d, "benchmark").select(F.trim(F.lower(F.split("text", "\n")[0])).alias("key")).distinct().withColumn("known", F.lit(True))
    at = segment.lines(table(spark, d, "documents")).withColumn("key", F.trim(F.lower("line"))).join(known, "key", "left")
    return at.groupBy("doc_id").agg(F.count(F.lit(1)).alias("lines"), F.count_if(L.is_instruction(F.col("line"))).alias("instructions"), F.count_if(F.coalesce("known", F.lit(False))).alias("of_template"))


@query(f"""WITH m AS (SELECT place, title, min(entry_id) % 7 AS code FROM {ENTRIES} WHERE span > 2 GROUP BY ALL), t AS (SELECT title, arg_max(code, (place, code)) AS code FROM m GROUP BY title)
SELECT entry_id, coalesce(m.code, t.code) AS mapped, CASE WHEN m.code IS NOT NULL THEN 'path' WHEN t.code IS NOT NULL THEN 'title' ELSE 'none' END AS by_what FROM {ENTRIES} e LEFT JOIN m ON m.place = e.place AND m.title = e.title LEFT JOIN t ON t.title = e.title""")
def entry_header_mapping(spark, d):
    """The whole path first, then the bare title, for which the last node wins."""
    e = entries(spark, d)
    m = e.filter("span > 2").groupBy("place", "title").agg((F.min("entry_id") % 7).alias("full"))
    t = m.groupBy("title").agg(F.max_by("full", F.struct("place", "full")).alias("bare"))
    at = e.join(m, ["place", "title"], "left").join(t, "title", "left")
    return at.select("entry_id", F.coalesce("full", "bare").alias("mapped"), F.when(F.col("full").isNotNull(), "path").when(F.col("bare").isNotNull(), "title").otherwise("none").alias("by_what"))


def _versions(spark, d):
    """A version without every fifth line, and with the first line at the end."""
    at = segment.lines(table(spark, d, "documents")).filter("line <> ''").select(F.col("doc_id").alias("doc"), F.col("idx").cast("long").alias("idx"), F.col("line").alias("text"))
    after = at.filter("idx % 5 <> 3").withColumn("idx", F.when(F.col("idx") == 0, 1_000_000).otherwise(F.col("idx")).cast("long"))
    return at, after


@query()
def block_alignment(spark, d):
    """Order-dependent; the tests hold it against an alignment by hand."""
    return alignment.aligned(*_versions(spark, d))


@query(f"""SELECT count(*) AS docs, sum(lost)::BIGINT AS gone FROM (SELECT doc_id, count(*) FILTER (idx % 5 = 3) AS lost FROM ({LINES}) WHERE line <> '' GROUP BY doc_id)""")
def alignment_totals(spark, d):
    """Whatever the order, as many blocks went as the version lacks: deleted or moved, less those that came or moved."""
    at = alignment.aligned(*_versions(spark, d)).groupBy("doc").agg((F.count("before_idx") - F.count("after_idx")).alias("lost"))
    return at.agg(F.count(F.lit(1)).alias("docs"), F.sum("lost").alias("gone"))


BLOCKS = f"SELECT person AS doc, entry_id AS block, {WORDS.format("place || ' ' || dates")} AS words FROM {ENTRIES} WHERE kind <> 6"


@query(f"""WITH b AS ({BLOCKS}), s AS (SELECT b.doc, block, e.entry_id AS entry, len(list_intersect(b.words, {WORDS.format('e.text')})) AS k, len(list_distinct(list_concat(b.words, {WORDS.format('e.text')}))) AS u, len(b.words) AS n FROM b JOIN {ENTRIES} e ON e.person = b.doc),
r AS (SELECT doc, block, entry, rank() OVER (PARTITION BY doc, block ORDER BY k / u DESC) AS r FROM s WHERE n > 0 AND k >= 0.5 * n), f AS (SELECT doc, block, min(entry) AS entry, count(*) AS ties FROM r WHERE r = 1 GROUP BY doc, block)
SELECT b.doc, b.block, CASE WHEN ties = 1 THEN entry END AS entry FROM b LEFT JOIN f ON f.doc = b.doc AND f.block = b.block""")
def block_attribution(spark, d):
    """Blocks of a person's output to that person's entries; a person has few of either."""
    e = entries(spark, d)
    blocks = e.filter("kind <> 6").select(F.col("person").alias("doc"), F.col("entry_id").alias("block"), significant_words(F.concat_ws(" ", "place", "dates")).alias("words"))
    return alignment.attributed(blocks, e.select(F.col("person").alias("doc"), F.col("entry_id").alias("entry"), significant_words(F.col("text")).alias("words")))


SQ = r"lower(regexp_replace({}, '\s+', '', 'g'))"


@query(f"""SELECT entry_id, contains(hay, {SQ.format('title')}) AND contains(hay, {SQ.format('dates')}) AS rendered FROM {ENTRIES} e JOIN (SELECT person, string_agg({SQ.format("CASE WHEN entry_id % 3 = 0 THEN title ELSE text END")}, '' ORDER BY entry_id) AS hay FROM {ENTRIES} GROUP BY person) h ON h.person = e.person""")
def render_presence(spark, d):
    """Whether an entry's title and dates stand in the person's output, white space apart."""
    e = entries(spark, d)
    shown = squash(F.when(F.col("entry_id") % 3 == 0, F.col("title")).otherwise(F.col("text")))
    hay = e.groupBy("person").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("entry_id", shown.alias("s")))), lambda x: x["s"]), "").alias("hay"))
    return e.join(hay, "person").select("entry_id", (F.contains("hay", squash(F.col("title"))) & F.contains("hay", squash(F.col("dates")))).alias("rendered"))


@query(f"""SELECT person, count(*) FILTER (kind = 6 AND nk = 4) AS shifted, count(*) AS pairs, count(*) FILTER (kind = 6 AND nk = 4) * 2 > count(*) AS fires FROM (SELECT person, kind, lead(kind) OVER (PARTITION BY person ORDER BY entry_id) AS nk FROM {ENTRIES}) WHERE nk IS NOT NULL GROUP BY person""")
def record_date_shift(spark, d):
    """A list grouped one record off: dateless entries followed by ones that begin with a date, for more than half of the pairs."""
    nk = F.lead("kind").over(Window.partitionBy("person").orderBy("entry_id"))
    at = entries(spark, d).select("person", "kind", nk.alias("nk")).filter("nk is not null")
    shifted = F.count_if((F.col("kind") == 6) & (F.col("nk") == 4))
    return at.groupBy("person").agg(shifted.alias("shifted"), F.count(F.lit(1)).alias("pairs"), (shifted * 2 > F.count(F.lit(1))).alias("fires"))
