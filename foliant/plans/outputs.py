"""Queries on source and output together."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import paired, segment
from foliant.plans.documents import LINES
from foliant.plans.registry import registry
from foliant.sources.tables import table

QUERIES, ORACLE, query = registry()


def _sides(spark, d):
    """The documents, and an output that lacks a document in ten, and of the others some lines, has some twice and dates some."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    at = segment.lines(docs).filter("doc_id % 10 <> 9 and idx % 7 <> 3")
    shown = F.when(F.col("idx") % 13 == 2, F.concat("line", F.lit(" 1987"))).when(F.col("idx") % 11 == 5, F.concat("line", F.lit("\n"), "line")).otherwise(F.col("line"))
    return docs, at.select("doc_id", shown.alias("text"))


SHOWN = f"(SELECT doc_id, CASE WHEN idx % 13 = 2 THEN line || ' 1987' WHEN idx % 11 = 5 THEN line || chr(10) || line ELSE line END AS text FROM ({LINES}) WHERE doc_id % 10 <> 9 AND idx % 7 <> 3)"
_BOTH = f"(SELECT doc_id, text, 's' AS side FROM documents UNION ALL SELECT doc_id, text, 'o' FROM {SHOWN})"
DIFF = rf"""WITH w AS (SELECT doc_id, side, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS key FROM {_BOTH}), l AS (SELECT * FROM (SELECT doc_id, side, regexp_replace(unnest(string_split(lower(text), chr(10))), '[^\p{{L}}\p{{N}}]', '', 'g') AS key FROM {_BOTH}) WHERE key <> ''),
wc AS (SELECT doc_id, key, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 'o') AS o, regexp_full_match(key, '(19|20)[0-9][0-9]') AS year FROM w GROUP BY doc_id, key), lc AS (SELECT doc_id, key, count(*) FILTER (side = 's') AS s, count(*) FILTER (side = 'o') AS o FROM l GROUP BY doc_id, key),
a AS (SELECT doc_id, sum(s)::BIGINT AS words, sum(o)::BIGINT AS out_words, sum(greatest(s - o, 0))::BIGINT AS lost_words, sum(greatest(o - s, 0))::BIGINT AS new_words, count(*) FILTER (year AND o = 0) AS lost_years, count(*) FILTER (year AND s = 0) AS new_years FROM wc GROUP BY doc_id),
b AS (SELECT doc_id, count(*) FILTER (o = 0) AS lost_lines, coalesce(sum(o - s) FILTER (s > 0 AND o > s), 0)::BIGINT AS twice FROM lc GROUP BY doc_id),
p AS (SELECT doc_id, doc_id IN (SELECT doc_id FROM {SHOWN} WHERE text IS NOT NULL) AS there, {', '.join(f'coalesce({c}, 0) AS {c}' for c in ('words', 'out_words', 'lost_words', 'new_words', 'lost_years', 'new_years', 'lost_lines', 'twice'))} FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN a USING (doc_id) LEFT JOIN b USING (doc_id))"""
CHECKED = f"""{DIFF}, c AS (SELECT doc_id, there, 'content_lost' AS lint, 'ERROR' AS severity, CASE WHEN lost_words / words > 0.2 THEN lost_words ELSE 0 END AS n FROM p UNION ALL SELECT doc_id, there, 'words_new', 'WARN', CASE WHEN new_words / out_words > 0.05 THEN new_words ELSE 0 END FROM p
 UNION ALL SELECT doc_id, there, 'years_lost', 'WARN', lost_years FROM p UNION ALL SELECT doc_id, there, 'years_new', 'ERROR', new_years FROM p UNION ALL SELECT doc_id, there, 'lines_lost', 'WARN', lost_lines FROM p UNION ALL SELECT doc_id, there, 'lines_twice', 'WARN', twice FROM p)"""


@query(f"{DIFF} SELECT doc_id, there, words, out_words, lost_words, new_words, lost_years, new_years, lost_lines, twice FROM p")
def output_differences(spark, d):
    """What each document's output lost, has anew and repeats."""
    return paired.differences(*_sides(spark, d))


@query(f"{CHECKED} SELECT doc_id, lint, severity, n FROM c WHERE there AND n > 0")
def output_findings(spark, d):
    return paired.findings(*_sides(spark, d))


@query(f"{CHECKED} SELECT lint, CASE WHEN there THEN 'ran' ELSE 'skipped: no output' END AS status, count(*) AS docs, count(*) FILTER (there AND n > 0) AS found FROM c GROUP BY ALL")
def output_check_status(spark, d):
    """On how many documents each check ran, and where it was skipped for want of an output."""
    return paired.status(*_sides(spark, d))
