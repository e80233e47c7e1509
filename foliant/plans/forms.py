"""Queries on what a form gives, not its author."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import segment, templates
from foliant.plans.documents import LINES
from foliant.plans.registry import registry
from foliant.sources.tables import table

QUERIES, ORACLE, query = registry()

#: What is made of a document's lines by turns, around its own words: forms' lines, and lines that only look like them.
SHAPES = (
    "B. {head} (include {tail})", "2) {head}: N/A", "{head}) : not applicable.", "(please list {tail}): N/A", "NOTE: This section lists what you {tail}", "iv. {head} (Specify {tail}",
    "Attending {head} (provide {tail})", "C. {head} (list available upon request)", "a. {head} (include {tail}) and {head}", "Note: this table is for {tail}", "3. {head}: none", "{head} (list {tail}): N/A | x", "{line}",
)


def form_lines(spark, d) -> DataFrame:
    """doc_id, idx, line: the documents' lines, written as a form's by turns."""
    at = segment.lines(table(spark, d, "documents"))
    words = F.regexp_extract_all("line", F.lit(r"(\p{L}+)"), F.lit(1))
    part = {"head": F.array_join(F.slice(words, 1, 3), " "), "tail": F.array_join(F.slice(words, 4, 4), " "), "line": F.col("line")}
    shown = []
    for shape in SHAPES:
        bits = shape.replace("{", "\0").replace("}", "\0").split("\0")
        shown.append(F.concat(*(part[b] if k % 2 else F.lit(b) for k, b in enumerate(bits))))
    return at.select("doc_id", "idx", F.element_at(F.array(*shown), (F.col("idx") % len(SHAPES) + 1).cast("int")).alias("line"))


def _shape_sql(shape: str) -> str:
    return "'" + shape.replace("{head}", "' || head || '").replace("{tail}", "' || tail || '").replace("{line}", "' || line || '") + "'"


FORM_LINES = rf"""(SELECT doc_id, idx, CASE idx % {len(SHAPES)} {' '.join(f'WHEN {k} THEN {_shape_sql(x)}' for k, x in enumerate(SHAPES))} END AS line FROM (
 SELECT doc_id, idx, line, array_to_string(w[1:3], ' ') AS head, array_to_string(w[4:7], ' ') AS tail FROM (SELECT *, regexp_extract_all(line, '\p{{L}}+') AS w FROM ({LINES}))))"""

_ANSWER = "rtrim(trim({}), '.') IN ('n/a', 'na', 'not applicable')"
# Lines are taken apart by their first bracket and their first colon.
SCAFFOLD = rf"""SELECT doc_id, idx, NOT contains(line, '|') AND length(low) BETWEEN 1 AND 400 AND ((mark <> '' AND length(label) BETWEEN 3 AND 80 AND NOT regexp_matches(label, '[0-9)]') AND ordered) OR (label = '' AND ordered) OR (mark <> '' AND unanswered) OR (unanswered AND trim(prompt)[-1] = ')')
 OR (trim(prompt_all) = 'note' AND told[1] = 'this' AND told[2] IN ('section', 'category', 'table') AND (told[3] IN ('include', 'includes', 'should', 'list', 'lists') OR (told[3] = 'is' AND told[4] IN ('for', 'to'))) AND list_has_any(told[4:], ['you', 'your', 'please', 'should']))) AS scaffold
FROM (SELECT *, contains(rest, '(') AND NOT contains(asked, '(') AND o IN ('include', 'list', 'provide', 'indicate', 'describe', 'specify', 'give', 'enter') AND NOT (p IN ('of', 'available', 'upon', 'below', 'above') OR (p = 'on' AND q = 'request')) AND (trim(after) IN ('', ':') OR {_ANSWER.format("ltrim(after, ' :')")}) AS ordered,
 contains(rest, ':') AND length(prompt) BETWEEN 3 AND 160 AND NOT regexp_matches(prompt, '[0-9]') AND {_ANSWER.format("rest[length(prompt) + 2:]")} AS unanswered
FROM (SELECT *, trim(split_part(rest, '(', 1)) AS label, aw[k] AS o, coalesce(aw[k + 1], '') AS p, coalesce(aw[k + 2], '') AS q, split_part(rest, ':', 1) AS prompt, split_part(low, ':', 1) AS prompt_all, regexp_extract_all(low[length(split_part(low, ':', 1)) + 2:], '[a-z]+') AS told
FROM (SELECT *, CASE WHEN aw[1] = 'please' THEN 2 ELSE 1 END AS k FROM (SELECT *, split_part(inside, ')', 1) AS asked, inside[length(split_part(inside, ')', 1)) + 2:] AS after, list_transform(string_split(trim(split_part(inside, ')', 1)), ' '), lambda x: regexp_extract(x, '^[a-z]+')) AS aw
FROM (SELECT *, rest[length(split_part(rest, '(', 1)) + 2:] AS inside FROM (SELECT *, trim(low[length(mark) + 1:]) AS rest FROM (SELECT *, regexp_extract(low, '^([0-9][0-9]?|[a-z]|[ivx]{{2,4}})[.,)] ') AS mark FROM (SELECT *, lower(trim(regexp_replace(line, '\s+', ' ', 'g'))) AS low FROM {FORM_LINES}))))))))"""


@query(SCAFFOLD)
def foreign_scaffold(spark, d):
    """Lines of other forms by their shape: which of them are scaffolding."""
    return form_lines(spark, d).select("doc_id", "idx", templates.is_scaffold(F.col("line")).alias("scaffold"))


SHARE, LEAST = 0.04, 3
_KEYED = rf"SELECT doc_id, coalesce(source, '') AS source, trim(regexp_replace(lower(unnest(string_split(text, chr(10)))), '[^\p{{L}}]+', ' ', 'g')) AS key FROM documents"
FOUND = f"""WITH l AS MATERIALIZED (SELECT * FROM ({_KEYED}) WHERE length(key) >= 3), n AS (SELECT coalesce(source, '') AS source, count(DISTINCT doc_id) AS of FROM documents WHERE text IS NOT NULL GROUP BY 1),
t AS MATERIALIZED (SELECT source, key, count(DISTINCT doc_id) AS docs FROM l GROUP BY ALL), f AS MATERIALIZED (SELECT t.* FROM t JOIN n USING (source) WHERE docs >= {LEAST} AND docs >= {SHARE} * n.of)"""


def _keyed(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", F.explode(F.split("text", "\n", -1)).alias("line"))
    return docs.select("doc_id", "source", templates.line_key(F.col("line")).alias("key"))


@query(f"{FOUND} SELECT source, key, docs FROM f")
def source_templates(spark, d):
    """Lines that a source's documents share."""
    at = _keyed(spark, d).withColumn("source", F.coalesce("source", F.lit("")))
    return templates.source_templates(at, SHARE, LEAST)


@query(f"""{FOUND}, h AS (SELECT key, arg_min(source, (-docs, source)) AS home FROM f GROUP BY key)
SELECT doc_id, count(*) AS lines, count(*) FILTER (f.key IS NOT NULL) AS own, count(*) FILTER (f.key IS NULL AND home IS NOT NULL) AS foreign_lines, count(DISTINCT CASE WHEN f.key IS NULL THEN home END) AS homes FROM l LEFT JOIN f ON f.source = l.source AND f.key = l.key LEFT JOIN h ON h.key = l.key GROUP BY doc_id""")
def foreign_template_lines(spark, d):
    """Of each document's lines, how many are its source's template, how many other sources' alone, and from how many sources those are."""
    at = templates.by_origin(_keyed(spark, d), SHARE, LEAST)
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).cast("long")
    return at.groupBy("doc_id").agg(F.sum("n").cast("long").alias("lines"), n(F.col("own")).alias("own"), n(F.col("foreign")).alias("foreign_lines"), F.count_distinct(F.when(F.col("foreign"), F.col("home"))).alias("homes"))
