"""Queries on entries of several records, built from the records table by ranges of ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators import fanout
from foliant.plans.registry import registry
from foliant.sources.entries import ENTRIES, entries

QUERIES, ORACLE, query = registry()

SCHEMAS = {"H": ("title", "place", "year"), "S1": ("title", "year", "authors"), "D3": ("title", "place", "year"), "M1": ("title", "place", "year", "role")}
RANGE = 2_800


def grouped(spark, d) -> DataFrame:
    """entry_id, code, text, fields: what an owner has in a range of ids as one entry, in eight ways of filing it. A range has at most so many ids, so an entry is bounded."""
    e = entries(spark, d).filter(F.col("code").isin(*SCHEMAS))
    record = F.struct(F.col("entry_id").alias("id"), F.col("title"), F.when(F.col("kind") == 6, "").otherwise(F.col("place")).alias("place"), F.col("y").cast("string").alias("year"))
    g = e.groupBy("owner", "code", F.floor(F.col("entry_id") / RANGE).alias("r")).agg(F.min("entry_id").alias("entry_id"), F.array_sort(F.collect_list(record)).alias("rs"))
    v = (F.floor(F.col("entry_id") / 7) % 8).cast("int")
    bare = F.to_json(F.transform("rs", lambda x: F.struct(x["title"], x["place"], x["year"])))
    without = F.to_json(F.transform("rs", lambda x: F.struct(x["title"], x["year"])))
    timed = F.to_json(F.transform("rs", lambda x: F.struct(x["title"], x["year"], F.lit("9").alias("session"))))
    hollow = F.to_json(F.concat(F.transform("rs", lambda x: F.struct(x["title"], x["year"])), F.array(F.struct(F.lit(" ").alias("title"), F.lit("").alias("year")))))
    cat = lambda *c: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in c))
    ways = [cat('{"year":"1950","awards":', bare, "}"), cat('{"sessions":', timed, "}"), cat('{"awards":', without, ',"more":', without, "}"), cat('{"place":"Here","group":{"label":"x","items":', without, "}}"), cat('{"awards":', without, ',"formatted_text":"whole"}'), cat('{"awards":', without, "}"), cat('{"title":"One","awards":["a","b"]}'), cat('{"awards":', hollow, "}")]
    said = F.array_join(F.transform("rs", lambda x: F.concat_ws(", ", x["title"], x["year"])), " and the ")
    text = F.when(v == 5, F.concat(said, F.lit(" besides"))).when(v == 3, F.concat(said, F.lit(" here"))).otherwise(said)
    return g.select("entry_id", "code", text.alias("text"), F.get(F.array(*ways), v).alias("fields"))


def schemas(spark) -> DataFrame:
    return spark.createDataFrame([(k, list(v)) for k, v in SCHEMAS.items()], "code string, keys array<string>")  # one row a code


_JSON = "to_json(list({} ORDER BY entry_id))"
_BARE = _JSON.format("{'title': title, 'place': CASE WHEN kind = 6 THEN '' ELSE place END, 'year': y::VARCHAR}")
_SHORT = _JSON.format("{'title': title, 'year': y::VARCHAR}")
GROUPED = f"""(SELECT entry_id, code, said || CASE v WHEN 5 THEN ' besides' WHEN 3 THEN ' here' ELSE '' END AS text, (CASE v WHEN 0 THEN '{{"year":"1950","awards":' || bare || '}}' WHEN 1 THEN '{{"sessions":' || timed || '}}' WHEN 2 THEN '{{"awards":' || short || ',"more":' || short || '}}'
 WHEN 3 THEN '{{"place":"Here","group":{{"label":"x","items":' || short || '}}}}' WHEN 4 THEN '{{"awards":' || short || ',"formatted_text":"whole"}}' WHEN 5 THEN '{{"awards":' || short || '}}' WHEN 6 THEN '{{"title":"One","awards":["a","b"]}}' ELSE '{{"awards":' || short[:-2] || ',{{"title":" ","year":""}}]}}' END)::JSON AS fields
 FROM (SELECT min(entry_id) AS entry_id, code, (min(entry_id) // 7) % 8 AS v, {_BARE}::VARCHAR AS bare, {_SHORT}::VARCHAR AS short, {_JSON.format("{'title': title, 'year': y::VARCHAR, 'session': '9'}")}::VARCHAR AS timed, string_agg(title || ', ' || y, ' and the ' ORDER BY entry_id) AS said
 FROM {ENTRIES} WHERE code IN ({', '.join(f"'{c}'" for c in SCHEMAS)}) GROUP BY owner, code, entry_id // {RANGE}))"""
_KEYS = "CASE code " + " ".join(f"WHEN '{c}' THEN [{', '.join(repr(k) for k in ks)}]" for c, ks in SCHEMAS.items()) + " END"
_STOP = "['a', 'an', 'and', 'at', 'for', 'in', 'of', 'on', 'the', 'to']"
FAN = f"""WITH e AS MATERIALIZED (SELECT *, {_KEYS} AS ks FROM {GROUPED}), top AS MATERIALIZED (SELECT entry_id, k, json_extract(fields, '$.' || k) AS v FROM (SELECT entry_id, fields, unnest(json_keys(fields)) AS k, ks FROM e) WHERE NOT list_contains(ks, k)),
l AS MATERIALIZED (SELECT entry_id, k AS path, v FROM top WHERE json_type(v) = 'ARRAY' AND json_type(v, '$[0]') = 'OBJECT' UNION ALL SELECT entry_id, k || '.' || j, w FROM (SELECT entry_id, k, j, json_extract(v, '$.' || j) AS w FROM (SELECT *, unnest(json_keys(v)) AS j FROM top WHERE json_type(v) = 'OBJECT')) WHERE json_type(w) = 'ARRAY' AND json_type(w, '$[0]') = 'OBJECT'),
one AS (SELECT entry_id, count(*) AS n, any_value(path) AS path, any_value(v) AS v FROM l GROUP BY entry_id),
r AS MATERIALIZED (SELECT entry_id, code, ks, fields, unnest(json_extract(v, '$[*]')) AS rec, generate_subscripts(json_extract(v, '$[*]'), 1) - 1 AS ord FROM one JOIN e USING (entry_id) WHERE n = 1),
c AS MATERIALIZED (SELECT *, {', '.join(f"CASE WHEN list_contains(ks, '{k}') THEN coalesce(nullif(trim(rec->>'{k}'), ''), nullif(trim(fields->>'{k}'), '')) END AS {k}" for k in ('title', 'place', 'year'))}, len(list_filter(json_keys(rec), lambda k: NOT list_contains(ks, k))) > 0 AS odd, len(list_filter(json_keys(rec), lambda k: list_contains(ks, k) AND trim(json_extract_string(rec, '$.' || k)) <> '')) = 0 AS blank FROM r),
s AS (SELECT entry_id, bool_or(odd) AS odd, bool_or(blank) AS blank, regexp_extract_all(lower(string_agg(concat_ws(' ', title, place, year), ' ')), '[a-z0-9]+') AS words FROM c GROUP BY entry_id),
v AS MATERIALIZED (SELECT e.*, one.path, CASE WHEN n IS NULL THEN 'single' WHEN n > 1 THEN 'several' WHEN odd THEN 'foreign_key' WHEN trim(coalesce(fields->>'formatted_text', '')) <> '' THEN 'formatted' WHEN blank THEN 'blank_record'
 WHEN len(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: NOT list_contains({_STOP}, w) AND NOT list_contains(words, w))) > 0 THEN 'uncovered' END AS reason FROM e LEFT JOIN one USING (entry_id) LEFT JOIN s USING (entry_id))"""


@query(f"""{FAN} SELECT v.entry_id, v.code, c.ord, path AS from_key, title, place, year, reason FROM v JOIN c USING (entry_id) WHERE reason IS NULL UNION ALL
SELECT entry_id, code, NULL, NULL, nullif(trim(fields->>'title'), ''), CASE WHEN code <> 'S1' THEN nullif(trim(fields->>'place'), '') END, nullif(trim(fields->>'year'), ''), reason FROM v WHERE reason IS NOT NULL""")
def fan_out_children(spark, d):
    out = fanout.fan_out(grouped(spark, d), schemas(spark))
    return out.select("entry_id", "code", F.col("ord").cast("long").alias("ord"), "from_key", *(F.try_element_at("values", F.lit(k)).alias(k) for k in ("title", "place", "year")), "reason")


@query(f"{FAN} SELECT code, coalesce(reason, 'fanned') AS outcome, count(*) AS entries FROM v GROUP BY ALL")
def fan_out_outcomes(spark, d):
    """What became of the entries of each code."""
    out = fanout.fan_out(grouped(spark, d), schemas(spark)).filter("coalesce(ord, 0) = 0")
    return out.groupBy("code", F.coalesce("reason", F.lit("fanned")).alias("outcome")).agg(F.count(F.lit(1)).alias("entries"))
