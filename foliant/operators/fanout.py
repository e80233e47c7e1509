"""Entries that hold several records become an entry for each.

An entry's fields are a JSON object. A list of objects under a key that the code's schema doesn't declare, or one level down inside an object under such a key, is a list of records. It is fanned out only if nothing is lost by that:

- there is one such list alone (``several``), and each of its records has keys, all of them the schema's (``foreign_key``);
- nothing has written the whole entry already (``formatted``);
- each record has a value that isn't blank (``blank_record``);
- each word of the entry's text stands in a value of a child (``uncovered``), stop words apart.

A child has the parent's own values, over which the record's win; its place in the list is its order. What isn't fanned out stays one row with its reason; ``single`` has no list. Null fields, or fields that aren't an object, are ``single``. Lists are whole: an entry's children are as many as its list is long.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Keys under which a whole entry has been written already, and words that needn't be covered.
FORMATTED = ("formatted_text", "formatted_citation")
STOP_WORDS = ("a", "an", "and", "at", "for", "in", "of", "on", "the", "to")

_MAP, _LIST = "map<string,string>", "array<map<string,string>>"


def _words(text: Column) -> Column:
    return F.array_except(F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))), F.array(*map(F.lit, STOP_WORDS)))


def _lists(fields: Column, schema: Column, prefix: Column | None = None) -> Column:
    """array of struct(path, records): the lists of objects among a map's values under keys that aren't declared."""
    off = F.map_filter(fields, lambda k, v: ~F.array_contains(schema, k) & v.startswith("[")) if prefix is None else F.map_filter(fields, lambda k, v: v.startswith("["))
    name = (lambda k: k) if prefix is None else (lambda k: F.concat(prefix, F.lit("."), k))
    parsed = F.transform(F.map_entries(off), lambda e: F.struct(name(e["key"]).alias("path"), F.from_json(e["value"], _LIST).alias("records")))
    return F.filter(parsed, lambda x: (F.size(x["records"]) > 0) & F.forall(x["records"], lambda r: r.isNotNull() & (F.size(r) > 0)))


def found_lists(entries: DataFrame, schemas: DataFrame) -> DataFrame:
    """The entries with __fields (a map), __schema (its declared keys) and __lists (path and records of each list). Schemas have code and keys, a row a code; a code without one declares nothing."""
    at = entries.join(F.broadcast(schemas.select("code", F.col("keys").alias("__schema"))), "code", "left").withColumn("__schema", F.coalesce("__schema", F.array().cast("array<string>")))
    at = at.withColumn("__fields", F.coalesce(F.from_json("fields", _MAP), F.create_map().cast(_MAP)))
    nested = F.map_entries(F.map_filter("__fields", lambda k, v: ~F.array_contains(F.col("__schema"), k) & v.startswith("{")))
    inner = F.flatten(F.transform(nested, lambda e: _lists(F.from_json(e["value"], _MAP), F.col("__schema"), e["key"])))
    return at.withColumn("__lists", F.concat(_lists(F.col("__fields"), F.col("__schema")), inner))


def fan_out(entries: DataFrame, schemas: DataFrame) -> DataFrame:
    """entry_id, code, ord, from_key, values, reason: a row for each child, or one with null ord and the reason for an entry that stays whole. ``values`` is a map of the declared keys that hold something. Entries have entry_id, code, text, fields. Schemas are a small table of rules."""
    at = found_lists(entries.select("entry_id", "code", "text", "fields"), schemas)
    declared = lambda m: F.map_filter(m, lambda k, v: F.array_contains(F.col("__schema"), k) & (F.trim(v) != ""))
    at = at.withColumn("__own", declared(F.col("__fields"))).withColumn("__records", F.coalesce(F.get(F.col("__lists"), F.lit(0))["records"], F.array().cast(_LIST)))
    at = at.withColumn("__kept", F.transform("__records", declared))
    # what a record doesn't fill is the parent's
    merge = lambda r: F.map_concat(F.map_filter("__own", lambda k, _: ~F.array_contains(F.map_keys(r), k)), r)
    at = at.withColumn("__children", F.transform("__kept", merge))
    at = at.withColumn("__said", F.array_join(F.flatten(F.transform("__children", lambda c: F.map_values(c))), " "))
    written = F.array_join(F.transform(F.array(*map(F.lit, FORMATTED)), lambda k: F.trim(F.coalesce(F.try_element_at(F.col("__fields"), k), F.lit("")))), "") != ""
    foreign = F.exists("__records", lambda r: F.exists(F.map_keys(r), lambda k: ~F.array_contains(F.col("__schema"), k)))
    bare = F.size(F.array_except(_words(F.coalesce("text", F.lit(""))), _words(F.col("__said")))) > 0
    reason = (
        F.when(F.size("__lists") == 0, "single").when(F.size("__lists") > 1, "several").when(foreign, "foreign_key").when(written, "formatted")
        .when(F.exists("__kept", lambda r: F.size(r) == 0), "blank_record").when(bare, "uncovered")
    )
    at = at.withColumn("reason", reason)
    shown = F.when(F.col("reason").isNull(), F.col("__children")).otherwise(F.array(F.col("__own")))
    rows = at.select("entry_id", "code", F.get(F.col("__lists"), F.lit(0))["path"].alias("path"), "reason", F.posexplode(shown).alias("place", "values"))
    fanned = F.col("reason").isNull()
    return rows.select("entry_id", "code", F.when(fanned, F.col("place")).alias("ord"), F.when(fanned, F.col("path")).alias("from_key"), "values", "reason")
