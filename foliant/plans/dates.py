"""Date queries over dated entries."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import dates as D
from foliant.plans.registry import registry
from foliant.sources.entries import ENTRIES, entries

QUERIES, ORACLE, query = registry()

CENTURY = "CASE WHEN {0} <= 30 THEN {0} + 2000 ELSE {0} + 1900 END"
SPAN_PATTERN = r"'((?:19|20)[0-9]{2})(?:\s*[-–]\s*((?:19|20)[0-9]{2}|present|current|ongoing|now|[0-9]{1,2})\b)?'"


def spans_sql(t: str) -> str:
    return f"""list_transform(list_zip(regexp_extract_all({t}, {SPAN_PATTERN}, 1), regexp_extract_all({t}, {SPAN_PATTERN}, 2)), lambda z: {{'first': z[1]::INT, 'last': greatest(z[1]::INT,
  CASE WHEN coalesce(z[2], '') = '' THEN z[1]::INT WHEN try_cast(z[2] AS INT) IS NULL THEN 9999 WHEN length(z[2]) = 1 THEN z[1]::INT // 10 * 10 + try_cast(z[2] AS INT) WHEN length(z[2]) = 2 THEN z[1]::INT // 100 * 100 + try_cast(z[2] AS INT) ELSE try_cast(z[2] AS INT) END)}})"""


@query(f"SELECT entry_id, y % 100 AS yy, {CENTURY.format('y % 100')} AS year FROM {ENTRIES}")
def two_digit_century(spark, d):
    return entries(spark, d).select("entry_id", (F.col("y") % 100).alias("yy"), D.full_year(F.col("y") % 100).alias("year"))


@query(f"""SELECT entry_id, CASE WHEN regexp_full_match(dates, '[0-9]{{4}}-[0-9]{{4}}') THEN dates[1:4] WHEN regexp_full_match(dates, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{4}}-[0-9]{{2}}') THEN dates[1:7] END AS start_date,
CASE WHEN regexp_full_match(dates, '[0-9]{{4}}-[0-9]{{4}}') THEN dates[6:9] WHEN regexp_full_match(dates, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{4}}-[0-9]{{2}}') THEN dates[9:15] END AS end_date FROM {ENTRIES}""")
def range_split(spark, d):
    r = D.split_range(F.col("dates"))
    return entries(spark, d).select("entry_id", r["start"].alias("start_date"), r["end"].alias("end_date"))


@query(f"""SELECT entry_id, CASE WHEN ok THEN a END AS start_year, CASE WHEN ok THEN a + ahead END AS end_year FROM (SELECT entry_id, a, ahead, ahead <= 20 AS ok FROM (
SELECT entry_id, try_cast(dates[1:4] AS INT) AS a, CASE WHEN regexp_full_match(dates, '[0-9]{{4}}-[0-9]{{2}}') THEN (try_cast(dates[6:7] AS INT) - try_cast(dates[3:4] AS INT) + 99) % 100 + 1 END AS ahead FROM {ENTRIES}))""")
def short_range(spark, d):
    r = D.split_short_range(F.col("dates"), F.col("text"))
    return entries(spark, d).select("entry_id", r["start"].alias("start_year"), r["end"].alias("end_year"))


@query(f"""SELECT entry_id, CASE WHEN regexp_matches(text, '(^|[^0-9/])' || mm || '/' || yy || '($|[^0-9/])') AND NOT regexp_matches(text, '(^|[^0-9/])' || yy || '/' || mm || '($|[^0-9/])') AND NOT regexp_matches(text, '(^|[^0-9])20' || mm || '($|[^0-9])')
THEN ({CENTURY.format('(y % 100)')}) || '-' || mm END AS reread FROM (SELECT *, lpad(m::VARCHAR, 2, '0') AS mm, lpad((y % 100)::VARCHAR, 2, '0') AS yy FROM {ENTRIES})""")
def month_slash_reread(spark, d):
    """A model that took MM/YY for YY/MM would have stored 20MM-YY."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    stored = F.concat(F.lit("20"), two(F.col("m")), F.lit("-"), two(F.col("y") % 100))
    return entries(spark, d).select("entry_id", D.reread_month_slash(stored, F.col("text")).alias("reread"))


@query(f"""SELECT entry_id, CASE WHEN regexp_matches(text, '/' || lpad((y % 100)::VARCHAR, 2, '0') || '($|[^0-9])') AND NOT contains(text, (y + 100)::VARCHAR) THEN {CENTURY.format('(y % 100)')} ELSE y + 100 END AS year FROM {ENTRIES}""")
def century_repair(spark, d):
    """Stored a century too late."""
    return entries(spark, d).select("entry_id", D.repair_century(F.col("y") + 100, F.col("text")).alias("year"))


@query(f"""SELECT entry_id, CASE WHEN contains(text, s::VARCHAR) OR regexp_matches(text, '[/'']' || lpad((s % 100)::VARCHAR, 2, '0') || '($|[^0-9])') THEN s END AS year FROM (SELECT *, y + entry_id % 3 AS s FROM {ENTRIES})""")
def year_not_in_source(spark, d):
    return entries(spark, d).select("entry_id", D.grounded_year((F.col("y") + F.col("entry_id") % 3), F.col("text")).alias("year"))


@query(f"""SELECT entry_id, regexp_matches(dates, '(?i)(^|[^0-9])' || y || '(\\.[0-9]{{1,2}}){{0,2}}([-–—]\\s*([^\\s0-9]|$)|\\s+[-–—] *(\\t|\\)|$)|\\s*([-–—]|\\bto\\b)\\s*(present|current|now)\\b)') OR regexp_matches(dates, '^\\s*' || y || '\\s+[-–—][ \\t]*[^\\s0-9]') AS is_open FROM {ENTRIES}""")
def open_year_test(spark, d):
    return entries(spark, d).select("entry_id", D.left_open(F.col("dates"), F.col("y")).alias("is_open"))


@query(f"SELECT entry_id, s.first AS first, s.last AS last, k - 1 AS ord FROM (SELECT entry_id, unnest(s) AS s, generate_subscripts(s, 1) AS k FROM (SELECT entry_id, {spans_sql('text')} AS s FROM {ENTRIES}))")
def written_spans(spark, d):
    return entries(spark, d).select("entry_id", F.posexplode(D.written_spans(F.col("text"))).alias("ord", "s")).select("entry_id", "s.first", "s.last", "ord")


@query(f"""SELECT entry_id, coalesce(list_aggregate(list_transform(s, lambda x: CASE WHEN x.last = x.first THEN x.first::VARCHAR WHEN x.last = 9999 THEN x.first || '-present' ELSE x.first || '-' || x.last END), 'string_agg', ', '), '') AS listed
FROM (SELECT entry_id, {spans_sql('text')} AS s FROM {ENTRIES})""")
def listed_spans(spark, d):
    return entries(spark, d).select("entry_id", D.listed(F.col("text")).alias("listed"))


@query(f"""SELECT entry_id, other, a1 <= b2 AND a2 <= b1 AS overlap FROM (SELECT entry_id, y * 12 + m AS a1, y * 12 + m + span * 12 AS b1, lead(entry_id) OVER w AS other, lead(y * 12 + m) OVER w AS a2, lead(y * 12 + m + span * 12) OVER w AS b2
FROM {ENTRIES} WINDOW w AS (PARTITION BY owner, title ORDER BY entry_id)) WHERE other IS NOT NULL""")
def month_span_overlap(spark, d):
    """Month spans of neighbouring entries of one owner and title."""
    w = Window.partitionBy("owner", "title").orderBy("entry_id")
    at = F.col("y") * 12 + F.col("m")
    span = F.struct(at.alias("first"), (at + F.col("span") * 12).alias("last"))
    rows = entries(spark, d).select("entry_id", "owner", "title", span.alias("s")).withColumn("other", F.lead("entry_id").over(w)).withColumn("t", F.lead("s").over(w))
    return rows.filter("other is not null").select("entry_id", "other", D.spans_overlap(F.col("s"), F.col("t")).alias("overlap"))


@query(f"""WITH p AS (SELECT entry_id, lead(entry_id) OVER w AS other, {spans_sql('text')} AS s, lead({spans_sql('text')}) OVER w AS t FROM {ENTRIES} WINDOW w AS (PARTITION BY owner, title ORDER BY entry_id))
SELECT entry_id, other, list_bool_and(list_transform(list_filter(s, lambda x: x.last > x.first), lambda x: len(list_filter(t, lambda k: k.last > k.first AND x.first <= k.last AND k.first <= x.last)) > 0)) IS NOT FALSE
 AND list_bool_and(list_transform(list_filter(s, lambda x: x.last = x.first), lambda x: len(list_filter(t, lambda k: k.first = x.first OR k.last = x.first OR (k.last > k.first AND k.first <= x.first AND x.first <= k.last))) > 0)) IS NOT FALSE AS compatible
FROM p WHERE other IS NOT NULL""")
def dates_compatible(spark, d):
    w = Window.partitionBy("owner", "title").orderBy("entry_id")
    rows = entries(spark, d).select("entry_id", "owner", "title", "text").withColumn("other", F.lead("entry_id").over(w)).withColumn("kept", F.lead("text").over(w))
    return rows.filter("other is not null").select("entry_id", "other", D.dates_compatible(F.col("text"), F.col("kept")).alias("compatible"))


@query(f"SELECT entry_id, string_split(regexp_replace(text, '\\b((?:19|20)[0-9]{{2}})\\b[;,] +', '\\1' || chr(10), 'g'), chr(10)) AS clauses FROM {ENTRIES}")
def date_clauses(spark, d):
    return entries(spark, d).select("entry_id", D.clauses(F.col("text")).alias("clauses"))


@query(f"SELECT entry_id, CASE WHEN kind IN (1, 5) AND dates[6:7] BETWEEN '01' AND '12' THEN title || ', ' || place || ', ' || ['January', 'February', 'March', 'April', 'May', 'June', 'July', 'August', 'September', 'October', 'November', 'December'][dates[6:7]::INT] || ' ' || dates[1:4] ELSE text END AS text FROM {ENTRIES}")
def iso_to_words(spark, d):
    return entries(spark, d).select("entry_id", D.iso_to_words(F.col("text")).alias("text"))


FORMS = {"D3": "mm/yy", "M1": "yyyy", "L2": "mm/yyyy", "N3A": "mm/yyyy"}


@query(f"""SELECT entry_id, CASE WHEN kind = 6 THEN 'Present' WHEN form = 'mm/yy' THEN lpad(m::VARCHAR, 2, '0') || '/' || lpad((y % 100)::VARCHAR, 2, '0') WHEN form = 'mm/yyyy' THEN lpad(m::VARCHAR, 2, '0') || '/' || y ELSE y::VARCHAR END AS shown
FROM (SELECT *, CASE code {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in FORMS.items())} ELSE 'yyyy' END AS form FROM {ENTRIES})""")
def section_date_format(spark, d):
    """The form comes from a small table of sections."""
    forms = spark.createDataFrame(list(FORMS.items()), "code string, form string")  # one row a section
    value = F.when(F.col("kind") == 6, "Present").otherwise(F.concat_ws("-", F.col("y").cast("string"), F.lpad(F.col("m").cast("string"), 2, "0")))
    return entries(spark, d).join(F.broadcast(forms), "code", "left").select("entry_id", D.section_date(value, F.coalesce("form", F.lit("yyyy"))).alias("shown"))


@query(f"SELECT entry_id, CASE WHEN kind = 2 THEN y || '-Present' WHEN kind = 6 OR span = 0 THEN y::VARCHAR ELSE y || '-' || (y + span) END AS shown FROM {ENTRIES}")
def range_format(spark, d):
    end = F.when(F.col("kind").isin(2, 6), "").otherwise(F.concat_ws("/", F.lpad(F.col("m").cast("string"), 2, "0"), (F.col("y") + F.col("span")).cast("string")))
    return entries(spark, d).select("entry_id", D.range_text(F.col("y").cast("string"), end, D.left_open(F.col("dates"), F.col("y"))).alias("shown"))


@query(f"SELECT entry_id FROM {ENTRIES} WHERE contains(text, 'in press') AND 1999 - y >= 2")
def stale_in_press(spark, d):
    return entries(spark, d).filter(D.stale_in_press(F.col("text"), F.col("y"), 1999)).select("entry_id")


@query(f"SELECT entry_id, round(CASE WHEN kind = 2 THEN 1.0 WHEN kind = 6 THEN 0.0 ELSE least(1.0, greatest(0.0, 1 - (2010 - (y + span)) / 20)) END, 6) AS recency FROM {ENTRIES}")
def recency_decay(spark, d):
    latest = F.when(F.col("kind") != 6, F.col("y") + F.col("span"))
    return entries(spark, d).select("entry_id", F.round(D.recency(latest, F.col("kind") == 2, 2010), 6).alias("recency"))


@query(f"""SELECT code, count(*) AS n, count(*) FILTER (regexp_matches(dates, '^[0-9]{{1,2}}/[0-9]{{1,2}}/[0-9]{{2}}$')) AS slashed, count(*) FILTER (regexp_matches(dates, '^[A-Z][a-z]+ [0-9]{{4}}$')) AS named,
sum(len(regexp_extract_all(text, '\\b(?:19|20)[0-9]{{2}}\\b')))::BIGINT AS years FROM {ENTRIES} GROUP BY code""")
def regex_dates(spark, d):
    has = lambda p: F.count_if(F.col("dates").rlike(p))
    return entries(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("n"), has(r"^\d{1,2}/\d{1,2}/\d{2}$").alias("slashed"), has(r"^[A-Z][a-z]+ \d{4}$").alias("named"), F.sum(F.regexp_count("text", F.lit(D.YEAR))).alias("years"))


@query(f"""SELECT code, min(s.first) AS first, max(CASE WHEN s.last < 9999 THEN s.last END) AS last, count(*) AS n, count(*) FILTER (s.last = 9999) AS still_open FROM (SELECT code, unnest({spans_sql('text')}) AS s FROM {ENTRIES}) GROUP BY code""")
def year_spans(spark, d):
    rows = entries(spark, d).select("code", F.explode(D.written_spans(F.col("text"))).alias("s"))
    return rows.groupBy("code").agg(F.min("s.first").alias("first"), F.max(F.when(F.col("s.last") < D.OPEN, F.col("s.last"))).alias("last"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("s.last") == D.OPEN).alias("still_open"))
