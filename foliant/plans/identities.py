"""Queries on what is the same: copies with preference, near copies, identity keys, containment."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import identity
from foliant.plans.dates import spans_sql
from foliant.plans.registry import registry
from foliant.sources.entries import ENTRIES, entries

QUERIES, ORACLE, query = registry()

STOPS = "'a', 'an', 'and', 'as', 'at', 'be', 'by', 'for', 'from', 'i', 'in', 'is', 'it', 'of', 'on', 'or', 'the', 'to', 'was', 'with'"
WORDS = f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({{}}), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({STOPS}))))"


@query(rf"""WITH k AS (SELECT entry_id, code, regexp_replace(lower(text), '[^\p{{L}}\p{{N}}_]', '', 'g') AS key FROM {ENTRIES} WHERE length(text) >= 20),
g AS (SELECT *, first_value(entry_id) OVER w AS first_id, first_value(code) OVER w AS first_code, count(*) OVER (PARTITION BY key) AS n, count(*) FILTER (code LIKE 'M%') OVER (PARTITION BY key) AS ms,
 count(*) FILTER (code NOT LIKE 'T%') OVER (PARTITION BY key ORDER BY entry_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM k WINDOW w AS (PARTITION BY key ORDER BY entry_id))
SELECT entry_id, first_id, CASE WHEN first_code LIKE 'T%' AND ms > 0 THEN code LIKE 'M%' AND before = 0 ELSE entry_id = first_id END AS kept FROM g WHERE n > 1""")
def dup_with_preference(spark, d):
    """Titles are left out of the text, so that copies stand under several codes."""
    return identity.preferred_copies(_bare(spark, d))


ORACLE["dup_with_preference"] = ORACLE["dup_with_preference"].replace("lower(text)", "lower(place || ', ' || dates)").replace("length(text)", "length(place || ', ' || dates)")


def _bare(spark, d):
    return entries(spark, d).withColumn("text", F.concat_ws(", ", "place", "dates"))


NEAR = f"""WITH s AS (SELECT person, code, entry_id, text, {WORDS.format('text')} AS w, {WORDS.format("substr(text, 1, 100)")} AS t, {spans_sql('text')} AS sp FROM {ENTRIES}),
p AS (SELECT a.person, a.code, a.entry_id AS a, b.entry_id AS b, len(list_intersect(a.w, b.w)) AS k, len(a.w) AS na, len(b.w) AS nb, len(list_intersect(a.t, b.t)) AS kt, len(a.t) AS ta, len(b.t) AS tb, length(a.text) >= length(b.text) AS drops_b,
  CASE WHEN length(a.text) >= length(b.text) THEN b.sp ELSE a.sp END AS dropped, CASE WHEN length(a.text) >= length(b.text) THEN a.sp ELSE b.sp END AS kept FROM s a JOIN s b ON a.person = b.person AND a.code = b.code AND a.entry_id < b.entry_id),
q AS (SELECT *, k / (na + nb - k) AS j, k / least(na, nb) AS c, CASE WHEN least(ta, tb) >= 4 THEN kt / least(ta, tb) ELSE 0 END AS title FROM p)
SELECT person, code, a, b, round(j, 6) AS jaccard, round(c, 6) AS containment, round(title, 6) AS title, drops_b FROM q WHERE (j >= 0.6 OR c >= 0.75 OR title >= 0.8) AND NOT (title < 0.8 AND least(ta, tb) >= 3 AND kt / (ta + tb - kt) <= 0.25)
AND (code NOT IN ('D3', 'M1', 'N3A') OR (len(list_filter(dropped, lambda x: x.last > x.first AND len(list_filter(kept, lambda y: y.last > y.first AND x.first <= y.last AND y.first <= x.last)) = 0)) = 0
 AND len(list_filter(dropped, lambda x: x.last = x.first AND len(list_filter(kept, lambda y: y.first = x.first OR y.last = x.first OR (y.last > y.first AND y.first <= x.first AND x.first <= y.last))) = 0)) = 0))"""


@query(NEAR)
def near_dup_entries(spark, d):
    return identity.near_decisions(entries(spark, d))


def folded(pairs: str, group: str) -> str:
    """Pairs (a, b, drops_b) of a group in order, through a list of what is gone."""
    return f"""SELECT {group}, unnest(gone) AS dropped FROM (SELECT {group}, list_reduce(list_prepend({{'a': 0, 'b': 0, 'd': false, 'gone': []::BIGINT[]}}, list({{'a': a, 'b': b, 'd': drops_b, 'gone': []::BIGINT[]}} ORDER BY a, b)),
  lambda x, y: {{'a': 0, 'b': 0, 'd': false, 'gone': CASE WHEN list_contains(x.gone, y.a) OR list_contains(x.gone, y.b) THEN x.gone ELSE list_append(x.gone, CASE WHEN y.d THEN y.b ELSE y.a END) END}}).gone AS gone FROM ({pairs}) GROUP BY {group})"""


@query(folded(NEAR, "person, code"))
def near_dup_drops(spark, d):
    return identity.left_to_right(identity.near_decisions(entries(spark, d)))


def _ids(spark, d):
    """Identity keys: a number that few entries have, another that fewer have, and the title with its year."""
    rows = entries(spark, d)
    some = lambda n, k: F.when(F.col("entry_id") % n == 0, F.col("entry_id") % k)
    return rows, [some(3, 7), some(4, 5), F.concat_ws("|", "title", "y")]


HELD = f"""SELECT person, entry_id, [x for x in ['0:' || CASE WHEN entry_id % 3 = 0 THEN entry_id % 7 END, '1:' || CASE WHEN entry_id % 4 = 0 THEN entry_id % 5 END, '2:' || title || '|' || y] if x IS NOT NULL] AS ks FROM {ENTRIES}"""


@query(f"""SELECT person, entry_id, holder FROM (SELECT person, unnest(copies, recursive := true) FROM (SELECT person, list_filter(list_reduce(list_prepend({{'i': 0, 'ks': []::VARCHAR[], 'seen': []::STRUCT(entry_id BIGINT, holder BIGINT, ks VARCHAR[])[]}}, list({{'i': entry_id, 'ks': ks, 'seen': []::STRUCT(entry_id BIGINT, holder BIGINT, ks VARCHAR[])[]}} ORDER BY entry_id)),
  lambda x, y: {{'i': 0, 'ks': []::VARCHAR[], 'seen': list_append(x.seen, {{'entry_id': y.i, 'holder': list_min([z.entry_id for z in x.seen if z.holder IS NULL AND list_has_any(z.ks, y.ks)]), 'ks': y.ks}})}}).seen, lambda z: z.holder IS NOT NULL) AS copies FROM ({HELD}) GROUP BY person))""")
def identity_key_copies(spark, d):
    return identity.first_holders(*_ids(spark, d))


@query(f"""SELECT a, b, code_a, code_b FROM (SELECT entry_id AS b, code AS code_b, lag(entry_id) OVER w AS a, lag(code) OVER w AS code_a FROM {ENTRIES} WINDOW w AS (PARTITION BY person, y || '|' || place ORDER BY entry_id)) WHERE a IS NOT NULL AND code_a <> code_b""")
def cross_code_twins(spark, d):
    return identity.across_codes(entries(spark, d), F.concat_ws("|", "y", "place"))


@query(f"""SELECT a.entry_id, min(b.entry_id) AS inside FROM {ENTRIES} a JOIN {ENTRIES} b ON a.person = b.person AND a.title = b.title AND a.kind = 6 AND b.kind <> 6
WHERE len(list_filter({WORDS.format('a.text')}, lambda x: x <> 'undated' AND NOT list_contains({WORDS.format('b.text')}, x))) = 0 GROUP BY a.entry_id""")
def undated_inside_dated(spark, d):
    return identity.undated_inside(entries(spark, d))


@query(f"""SELECT person, code, count(*) AS pairs, count(*) FILTER (y1 = y2) AS same_year FROM (SELECT a.person, a.code, a.y AS y1, b.y AS y2 FROM {ENTRIES} a JOIN {ENTRIES} b ON a.person = b.person AND a.title = b.title AND a.place = b.place AND b.entry_id > a.entry_id) GROUP BY ALL""")
def record_group_pairs(spark, d):
    """How many pairs of records of one title and place a person has, from counts alone: no pair is made."""
    n = entries(spark, d).groupBy("person", "code", "title", "place", "y").agg(F.count(F.lit(1)).alias("k"))
    per = n.groupBy("person", "code", "title", "place").agg(F.sum("k").alias("n"), F.sum((F.col("k") * (F.col("k") - 1) / 2).cast("long")).alias("same"))
    out = per.groupBy("person", "code").agg(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("long")).alias("pairs"), F.sum("same").alias("same_year"))
    return out.filter("pairs > 0")


@query(f"""SELECT person, arg_max(entry_id, (filled, length(text), -entry_id)) AS fullest FROM (SELECT *, (span > 0)::INT + (kind <> 6)::INT + (m > 6)::INT AS filled FROM {ENTRIES}) GROUP BY person""")
def fuller_first(spark, d):
    """More filled fields, then the longer text, then the earlier entry."""
    filled = (F.col("span") > 0).cast("int") + (F.col("kind") != 6).cast("int") + (F.col("m") > 6).cast("int")
    return entries(spark, d).groupBy("person").agg(F.max_by("entry_id", F.struct(filled, F.length("text"), -F.col("entry_id"))).alias("fullest"))


@query(f"""SELECT y, place, arg_max(entry_id, (kind <> 6, length(text), -entry_id)) AS best, count(*) AS copies FROM {ENTRIES} GROUP BY y, place""")
def best_citation_copy(spark, d):
    rank = F.struct(F.col("kind") != 6, F.length("text"), -F.col("entry_id"))
    return entries(spark, d).groupBy("y", "place").agg(F.max_by("entry_id", rank).alias("best"), F.count(F.lit(1)).alias("copies"))
