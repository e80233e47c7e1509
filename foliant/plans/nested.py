"""Queries on nested values: lists, maps, JSON and XML."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.plans.registry import registry
from foliant.sources.entries import ENTRIES, entries
from foliant.sources.tables import table

QUERIES, ORACLE, query = registry()

SCHEMA = {"H": ("title", "year"), "S1": ("title", "authors", "year"), "D3": ("title", "place", "start_date")}


@query(f"""SELECT entry_id, unnest(p) AS part, generate_subscripts(p, 1) - 1 AS ord FROM (SELECT entry_id, string_split(text, ', ') AS p, text FROM {ENTRIES}) WHERE len(p) >= 3 AND list_min(list_transform(p, lambda x: length(x))) >= 4 AND list_sum(list_transform(p, lambda x: length(x))) * 10 >= length(text) * 9""")
def fan_out_guards(spark, d):
    """Fan out only entries of three parts or more, none of them a scrap, that cover nine tenths of the text."""
    p = F.split("text", ", ")
    sizes = F.transform(p, F.length)
    ok = (F.size(p) >= 3) & (F.array_min(sizes) >= 4) & (F.aggregate(sizes, F.lit(0), lambda a, x: a + x) * 10 >= F.length("text") * 9)
    return entries(spark, d).filter(ok).select("entry_id", F.posexplode(p).alias("ord", "part"))


def _fields(spark, d):
    """Fields of an entry as a map, some of them not in any schema."""
    e = entries(spark, d)
    pairs = F.map_from_arrays(F.array(F.lit("title"), F.lit("year"), F.when(F.col("kind") % 2 == 0, "place").otherwise("remark")), F.array(F.col("title"), F.col("y").cast("string"), F.col("place")))
    return e.select("entry_id", "code", "kind", pairs.alias("fields"))


@query(f"""SELECT entry_id, CASE WHEN kind % 2 = 1 THEN 'remark' WHEN code <> 'D3' THEN 'place' END AS undeclared, CASE WHEN code = 'D3' THEN 'year' END AS also FROM {ENTRIES} WHERE code IN ('H', 'S1', 'D3') AND (kind % 2 = 1 OR code <> 'D3' OR code = 'D3')""")
def offschema_keys(spark, d):
    """Keys that a code's schema doesn't declare."""
    schema = F.create_map(*(x for k, v in SCHEMA.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    rows = _fields(spark, d).filter(F.col("code").isin(*SCHEMA))
    off = F.map_keys(F.map_filter("fields", lambda k, _: ~F.array_contains(schema[F.col("code")], k)))
    pick = lambda *names: F.array_max(F.filter(off, lambda k: k.isin(*names)))
    return rows.select("entry_id", pick("remark", "place").alias("undeclared"), pick("year").alias("also"))


@query(f"SELECT entry_id, kind % 3 <> 1 AND kind > 0 AS clean FROM {ENTRIES}")
def clean_record_list(spark, d):
    """A list of two records or more, all of whose keys are the schema's."""
    rec = lambda *ks: F.map_from_arrays(F.array(*map(F.lit, ks)), F.array(*(F.lit("x") for _ in ks)))
    k = F.col("kind")
    records = F.when(k == 0, F.array(rec("title", "year"))).when(k % 3 == 1, F.array(rec("title"), rec("title", "other"))).otherwise(F.array(rec("title"), rec("year"), rec("title", "year")))
    clean = (F.size("records") >= 2) & F.forall("records", lambda r: F.forall(F.map_keys(r), lambda x: x.isin("title", "year")))
    return entries(spark, d).select("entry_id", records.alias("records")).select("entry_id", clean.alias("clean"))


@query(f"SELECT entry_id, CASE kind % 3 WHEN 0 THEN title || '; ' || place WHEN 1 THEN title ELSE '' END AS value FROM {ENTRIES}")
def list_to_scalar(spark, d):
    """A model's list becomes one value; what isn't a list stays; an empty list is empty."""
    k = F.col("kind") % 3
    stored = F.when(k == 0, F.to_json(F.array("title", "place"))).when(k == 1, F.col("title")).otherwise("[]")
    parsed = F.when(stored.startswith("["), F.from_json(stored, "array<string>"))
    return entries(spark, d).select("entry_id", F.coalesce(F.array_join(parsed, "; "), stored).alias("value"))


@query(f"SELECT entry_id, CASE kind % 3 WHEN 0 THEN 'place: ' || place || '; title: ' || title WHEN 1 THEN title || '; ' || place ELSE title END AS cell FROM {ENTRIES}")
def field_text(spark, d):
    """A dictionary, a list or a string as the text of a cell."""
    k = F.col("kind") % 3
    stored = F.when(k == 0, F.to_json(F.struct("title", "place"))).when(k == 1, F.to_json(F.array("title", "place"))).otherwise(F.col("title"))
    m = F.when(stored.startswith("{"), F.from_json(stored, "map<string,string>"))
    of_map = F.array_join(F.transform(F.array_sort(F.map_entries(m)), lambda x: F.concat_ws(": ", x["key"], x["value"])), "; ")
    of_list = F.array_join(F.when(stored.startswith("["), F.from_json(stored, "array<string>")), "; ")
    return entries(spark, d).select("entry_id", F.coalesce(of_map, of_list, stored).alias("cell"))


def _deep(spark, d):
    """Nested results, with errors at several depths, some of them null."""
    e = entries(spark, d)
    err = F.when(F.col("kind") % 2 == 0, F.concat(F.lit("bad \""), F.col("code"), F.lit("\"")))
    inner = F.struct(err.alias("error"), F.col("title").alias("name"))
    deep = F.struct(F.struct(F.array(inner, F.struct(F.lit("late").alias("error"), F.col("place").alias("name"))).alias("items")).alias("a"), F.when(F.col("kind") == 4, "top").alias("error"))
    return e.select("entry_id", F.to_json(deep, {"ignoreNullFields": "false"}).alias("json"))


STRING = r'"((?:[^"\\]|\\.)*)"'


@query(f"SELECT entry_id, list_filter([CASE WHEN kind % 2 = 0 THEN 'bad \"' || code || '\"' END, 'late', CASE WHEN kind = 4 THEN 'top' END], lambda x: x IS NOT NULL) AS errors FROM {ENTRIES}")
def nested_errors(spark, d):
    """Every error that isn't null, at any depth, in order."""
    found = F.regexp_extract_all("json", F.lit(r'"error":' + STRING), F.lit(1))
    return _deep(spark, d).select("entry_id", F.transform(found, lambda x: F.regexp_replace(x, r'\\(.)', "$1")).alias("errors"))


@query(f"SELECT entry_id, list_filter([CASE WHEN kind % 2 = 0 THEN 'bad \"' || code || '\"' END, title, 'late', place, CASE WHEN kind = 4 THEN 'top' END], lambda x: x IS NOT NULL) AS strings FROM {ENTRIES}")
def nested_strings(spark, d):
    """All string values of a nested value; keys aren't values."""
    found = F.regexp_extract_all("json", F.lit(r"[:\[,]" + STRING + r"(?=[,}\]])"), F.lit(1))
    return _deep(spark, d).select("entry_id", F.transform(found, lambda x: F.regexp_replace(x, r'\\(.)', "$1")).alias("strings"))


@query("SELECT event_id, (event_id % 7) || '.50' AS amount, event_type AS kind FROM events")
def json_reply_parse(spark, d):
    """Numbers keep the digits that were written."""
    reply = F.format_string('{"amount": %d.50, "kind": "%s", "extra": [1, 2]}', F.col("event_id") % 7, F.col("event_type"))
    literal = F.regexp_replace(reply, r"(:\s*)(-?[0-9]+(?:\.[0-9]+)?)(?=\s*[,}\]])", '$1"$2"')
    r = F.from_json(literal, "amount string, kind string")
    return table(spark, d, "events").select("event_id", r["amount"].alias("amount"), r["kind"].alias("kind"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS kind FROM events")
def json_last_object(spark, d):
    """The last whole object of a reply that talks around it; none if there is none."""
    reply = F.when(F.col("event_id") % 3 == 0, F.lit("no object {here")).otherwise(F.format_string('First {"kind": "draft"} then\n{"kind": "%s"}\nDone.', F.col("event_type")))
    last = F.try_element_at(F.regexp_extract_all(reply, F.lit(r"(\{[^{}]*\})"), F.lit(1)), F.lit(-1))
    return table(spark, d, "events").select("event_id", F.get_json_object(last, "$.kind").alias("kind"))


@query(f"SELECT entry_id, CASE WHEN owner % 2 = 0 THEN 'own' ELSE 'built-in' END AS title_source, CASE WHEN owner % 2 = 0 THEN 3 ELSE 2 END AS fields FROM {ENTRIES}")
def schema_overlay(spark, d):
    """A customer's own schema goes over the built-in one, key by key."""
    built = F.create_map(F.lit("title"), F.lit("built-in"), F.lit("year"), F.lit("built-in"))
    own = F.when(F.col("owner") % 2 == 0, F.create_map(F.lit("title"), F.lit("own"), F.lit("note"), F.lit("own"))).otherwise(F.create_map().cast("map<string,string>"))
    both = F.map_concat(F.map_filter(built, lambda k, _: ~F.array_contains(F.map_keys(own), k)), own)
    return entries(spark, d).select("entry_id", both["title"].alias("title_source"), F.size(both).alias("fields"))


@query(f"SELECT entry_id, CASE code WHEN 'H' THEN 2 WHEN 'S1' THEN 3 WHEN 'D3' THEN 3 ELSE 0 END AS fields, CASE code WHEN 'H' THEN 'title,year' WHEN 'S1' THEN 'title,authors,year' WHEN 'D3' THEN 'title,place,start_date' END AS names FROM {ENTRIES}")
def tag_map(spark, d):
    """Codes to their fields; a code without a schema has none."""
    schema = F.create_map(*(x for k, v in SCHEMA.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))
    of = F.try_element_at(schema, F.col("code"))
    return entries(spark, d).select("entry_id", F.coalesce(F.size(of), F.lit(0)).alias("fields"), F.array_join(of, ",").alias("names")).withColumn("fields", F.greatest("fields", F.lit(0)))


@query("SELECT p_partkey AS id, p_name AS title, p_size AS year, 'A B; C D' AS authors FROM part")
def xml_record(spark, d):
    """Records of an article file by path."""
    xml = F.concat(F.lit("<Article><Id>"), F.col("p_partkey"), F.lit("</Id><Title>"), F.col("p_name"), F.lit("</Title><Date><Year>"), F.col("p_size"), F.lit("</Year></Date><Authors><A><L>A</L><F>B</F></A><A><L>C</L><F>D</F></A></Authors></Article>"))
    rows = table(spark, d, "part").select(xml.alias("xml"))
    names = F.zip_with(F.xpath("xml", F.lit("Article/Authors/A/L/text()")), F.xpath("xml", F.lit("Article/Authors/A/F/text()")), lambda a, b: F.concat_ws(" ", a, b))
    return rows.select(F.xpath_string("xml", F.lit("Article/Id")).cast("long").alias("id"), F.xpath_string("xml", F.lit("Article/Title")).alias("title"), F.xpath_int("xml", F.lit("Article/Date/Year")).alias("year"), F.array_join(names, "; ").alias("authors"))


@query("SELECT batch, pos, unnest AS code FROM (SELECT doc_id // 15 AS batch, doc_id % 15 AS pos, CASE WHEN doc_id % 4 = 0 THEN 'T' ELSE upper(lang) END AS unnest FROM documents)")
def reply_positional_join(spark, d):
    """Replies of a batch to its rows by position; a row without a reply is T."""
    docs = table(spark, d, "documents")
    rows = docs.select(F.floor(F.col("doc_id") / 15).cast("long").alias("batch"), (F.col("doc_id") % 15).alias("pos"))
    replies = docs.filter("doc_id % 4 > 0").select(F.floor(F.col("doc_id") / 15).cast("long").alias("batch"), (F.col("doc_id") % 15).alias("pos"), F.upper("lang").alias("code"))
    return rows.join(replies, ["batch", "pos"], "left").select("batch", "pos", F.coalesce("code", F.lit("T")).alias("code"))


@query(f"SELECT entry_id, CASE WHEN entry_id % 3 = 0 THEN 'NO_MATCH' ELSE title END AS title, entry_id % 3 <> 0 AS extracted FROM {ENTRIES}")
def reply_merge(spark, d):
    """A model's items onto the entries by index; a repeated item counts once, the last one; an item without an entry is dropped."""
    e = entries(spark, d)
    items = e.filter("entry_id % 3 > 0").select("entry_id", F.col("title").alias("found"), F.lit(2).alias("n"))
    items = items.unionByName(items.select("entry_id", F.lit("draft").alias("found"), F.lit(1).alias("n"))).unionByName(spark.range(1).select(F.lit(-5).cast("long").alias("entry_id"), F.lit("x").alias("found"), F.lit(1).alias("n")))
    last = items.groupBy("entry_id").agg(F.max_by("found", "n").alias("found"))
    return e.join(last, "entry_id", "left").select("entry_id", F.coalesce("found", F.lit("NO_MATCH")).alias("title"), F.col("found").isNotNull().alias("extracted"))


@query("SELECT lower(regexp_replace(c_mktsegment, '[^A-Za-z]', '', 'g')) || ':' || c_nationkey AS key, count(*) AS customers, min(c_custkey) AS first FROM customer GROUP BY 1")
def cache_key(spark, d):
    key = F.concat_ws(":", F.lower(F.regexp_replace("c_mktsegment", "[^A-Za-z]", "")), F.col("c_nationkey").cast("string"))
    return table(spark, d, "customer").groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("customers"), F.min("c_custkey").alias("first"))


@query("""WITH i AS (SELECT DISTINCT c_nationkey AS k FROM customer) SELECT k, n_name AS name, n_name IS NULL AS miss, CASE WHEN n_name IS NULL THEN (count(*) FILTER (n_name IS NULL) OVER (ORDER BY k) - 1) // 10 END AS batch FROM i LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 > 0) ON n_nationkey = k""")
def institution_lookup(spark, d):
    """Distinct keys against the cache; the misses go to the service in batches of ten. There are as many rows as nations."""
    from pyspark.sql import Window

    cache = table(spark, d, "nation").filter("n_nationkey % 3 > 0").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    keys = table(spark, d, "customer").select(F.col("c_nationkey").alias("k")).distinct()
    at = keys.join(cache, "k", "left").withColumn("miss", F.col("name").isNull())
    nth = F.sum(F.col("miss").cast("int")).over(Window.orderBy("k").rowsBetween(Window.unboundedPreceding, 0)) - 1
    return at.select("k", "name", "miss", F.when(F.col("miss"), F.floor(nth / 10).cast("long")).alias("batch"))


@query("""SELECT event_id, coalesce(a.c_name, b.s_name, 'none') AS name, CASE WHEN a.c_name IS NOT NULL THEN 'first' WHEN b.s_name IS NOT NULL THEN 'second' ELSE 'none' END AS source FROM events LEFT JOIN customer a ON a.c_custkey = user_id * 20 LEFT JOIN supplier b ON b.s_suppkey = user_id""")
def secondary_source(spark, d):
    """A second source answers where the first has nothing."""
    e = table(spark, d, "events").select("event_id", (F.col("user_id") * 20).alias("c_custkey"), F.col("user_id").alias("s_suppkey"))
    at = e.join(table(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey", "left").join(table(spark, d, "supplier").select("s_suppkey", "s_name"), "s_suppkey", "left")
    return at.select("event_id", F.coalesce("c_name", "s_name", F.lit("none")).alias("name"), F.when(F.col("c_name").isNotNull(), "first").when(F.col("s_name").isNotNull(), "second").otherwise("none").alias("source"))


@query(f"""SELECT a.entry_id, b.entry_id AS record, CASE WHEN a.y <> b.y AND a.span <> b.span THEN 'contradicts' WHEN a.title <> b.title THEN 'other title' ELSE 'accepted' END AS status FROM {ENTRIES} a JOIN {ENTRIES} b ON b.person = a.person AND b.entry_id = a.entry_id + 1 OR b.person = a.person AND b.entry_id = a.entry_id + 7""")
def join_veto(spark, d):
    """A joined record is refused where year and volume both differ, or the title does."""
    e = entries(spark, d)
    a = e.select("person", F.col("entry_id").alias("a"), F.col("title").alias("ta"), F.col("y").alias("ya"), F.col("span").alias("sa"), F.explode(F.array(F.col("entry_id") + 1, F.col("entry_id") + 7)).alias("entry_id"))
    at = a.join(e.select("person", "entry_id", "title", "y", "span"), ["person", "entry_id"])
    status = F.when((F.col("ya") != F.col("y")) & (F.col("sa") != F.col("span")), "contradicts").when(F.col("ta") != F.col("title"), "other title").otherwise("accepted")
    return at.select(F.col("a").alias("entry_id"), F.col("entry_id").alias("record"), status.alias("status"))


@query(f"SELECT DISTINCT a.entry_id FROM {ENTRIES} a JOIN {ENTRIES} b ON a.person = b.person AND a.place = b.place AND a.y = b.y AND a.code = 'S1' AND b.code <> 'S1'")
def already_listed(spark, d):
    """In-press entries of which another entry is the same paper."""
    e = entries(spark, d)
    other = e.filter("code <> 'S1'").select("person", "place", "y")
    return e.filter("code = 'S1'").join(other, ["person", "place", "y"], "left_semi").select("entry_id")


@query("SELECT c_custkey, EXISTS (SELECT 1 FROM events WHERE user_id = c_custkey) AS gave_feedback FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def feedback_status(spark, d):
    """Users with completed runs, and whether they ever gave feedback."""
    done = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey")).distinct()
    gave = table(spark, d, "events").select(F.col("user_id").alias("c_custkey")).distinct().withColumn("g", F.lit(True))
    return done.join(table(spark, d, "customer").select("c_custkey"), "c_custkey", "left_semi").join(gave, "c_custkey", "left").select("c_custkey", F.coalesce("g", F.lit(False)).alias("gave_feedback"))


@query("SELECT o_custkey AS id FROM orders WHERE o_orderstatus = 'P' UNION SELECT user_id FROM events WHERE event_type = 'error'")
def live_ids_union(spark, d):
    """Ids that are outstanding in either lane."""
    return table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id")).union(table(spark, d, "events").filter("event_type = 'error'").select("user_id")).distinct()


@query("SELECT doc_id, batch, n FROM (SELECT doc_id, doc_id % 3 AS batch, length(text) AS n FROM documents)")
def concat_group_results(spark, d):
    """Results of batches in the order they were handed in, under one schema."""
    docs = table(spark, d, "documents")
    parts = [docs.filter(F.col("doc_id") % 3 == k).select("doc_id", F.lit(k).cast("long").alias("batch"), F.length("text").cast("long").alias("n")) for k in range(3)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"""SELECT entry_id, CASE WHEN text = '' THEN 'empty' WHEN code = 'L2' AND kind = 6 THEN 'no title' ELSE 'valid' END AS state, CASE WHEN kind = 2 THEN 'current' WHEN kind = 6 THEN 'undated' WHEN y + span < 2000 THEN 'ended' ELSE 'current' END AS now, length(text) < 60 AS skippable FROM {ENTRIES}""")
def entry_predicates(spark, d):
    """Valid, current or ended by a date that is given, and short enough to be skipped."""
    title = F.when((F.col("code") == "L2") & (F.col("kind") == 6), "None").otherwise(F.col("title"))
    valid = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "empty").when((F.col("code") == "L2") & (F.lower(F.trim(title)).isin("none", "")), "no title").otherwise("valid")
    now = F.when(F.col("kind") == 2, "current").when(F.col("kind") == 6, "undated").when(F.col("y") + F.col("span") < 2000, "ended").otherwise("current")
    return entries(spark, d).select("entry_id", valid.alias("state"), now.alias("now"), (F.length("text") < 60).alias("skippable"))


RULES = (("H", "max_entries", 3), ("D3", "max_words", 9), ("S1", "section_empty", 0), ("X9", "section_empty", 0))


@query(f"""SELECT person, 'H' AS code, 'max_entries' AS rule FROM {ENTRIES} WHERE code = 'H' GROUP BY person HAVING count(*) > 3 UNION ALL SELECT person, 'D3', 'max_words' FROM {ENTRIES} WHERE code = 'D3' GROUP BY person HAVING max(len(string_split(text, ' '))) > 9
UNION ALL SELECT person, 'S1', 'section_empty' FROM {ENTRIES} GROUP BY person HAVING count(*) FILTER (code = 'S1') = 0 UNION ALL SELECT DISTINCT person, 'X9', 'section_empty' FROM {ENTRIES}""")
def template_rules(spark, d):
    """A table of rules against each person's sections: empty, too many entries, too many words."""
    e = entries(spark, d).groupBy("person", "code").agg(F.count(F.lit(1)).alias("n"), F.max(F.size(F.split("text", " "))).alias("words"))
    rules = spark.createDataFrame(RULES, "code string, rule string, bound int")  # one row a rule
    wanted = e.select("person").distinct().withColumn("r", F.explode(F.array(*(F.struct(F.lit(c).alias("code"), F.lit(r).alias("rule"), F.lit(b).alias("bound")) for c, r, b in RULES)))).select("person", "r.*")
    at = wanted.join(e, ["person", "code"], "left").join(F.broadcast(rules.select("code", "rule")), ["code", "rule"])
    fires = F.when(F.col("rule") == "section_empty", F.col("n").isNull()).when(F.col("rule") == "max_entries", F.col("n") > F.col("bound")).otherwise(F.col("words") > F.col("bound"))
    return at.filter(F.coalesce(fires, F.lit(False))).select("person", "code", "rule")
