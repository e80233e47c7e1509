"""Nested values of any depth: JSON texts as variants, opened level by level for all rows at once, and replies that were cut off, closed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.rounds import Tables


def nodes(rows: DataFrame, key: str, json: str) -> DataFrame:
    """key, path, kind (object, array, string, number, boolean, null), value (of a leaf, as text), level: every value of every row's JSON text, the outermost at ``$``. One round a level, each a written table; texts that aren't JSON, and null ones, give nothing.
    Of a name that an object holds twice the last counts."""
    tables = Tables(rows.sparkSession)
    now = rows.select(F.col(key).alias("key"), F.lit("$").alias("path"), F.try_parse_json(F.col(json)).alias("v")).filter("v is not null")
    out, level = None, 0
    while True:
        kind = F.schema_of_variant("v")
        at = now.select("key", "path", "v", F.when(kind.startswith("OBJECT"), "object").when(kind.startswith("ARRAY"), "array").when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null").otherwise("number").alias("kind"))
        at = tables.keep(at.withColumn("json", F.to_json("v")).drop("v"))
        leaf = ~F.col("kind").isin("object", "array", "null")
        text = F.when(leaf, F.try_variant_get(F.parse_json("json"), "$", "string"))
        seen = at.select("key", "path", "kind", text.alias("value"), F.lit(level).alias("level"))
        out = seen if out is None else out.unionByName(seen)
        inner = at.filter(F.col("kind").isin("object", "array"))
        if inner.isEmpty():
            return tables.done(out.withColumnRenamed("key", key))
        opened = inner.select("key", "path", F.parse_json("json").alias("v")).lateralJoin(rows.sparkSession.tvf.variant_explode(F.col("v").outer()).toDF("pos", "name", "value"))
        step = F.when(F.col("name").isNull(), F.concat(F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("."), "name"))
        now = opened.select("key", F.concat("path", step).alias("path"), F.col("value").alias("v"))
        level += 1


_WHOLE_STRING = r'"(?:[^"\\]|\\.)*+"'


def closed(text: Column) -> Column:
    """A JSON text that was cut off anywhere, closed: an open string is ended, a name without a value gets null, a comma at the end goes, and brackets are closed from the innermost. Whole texts stay as they are, but for white space at their end. What isn't the beginning of JSON may still be none."""
    bare = F.regexp_replace(text, rf"(?s){_WHOLE_STRING}", "S")
    inside = F.contains(bare, F.lit('"'))
    # a backslash at the end, or the beginning of an escape, would take the closing quote in
    body = F.when(inside, F.concat(F.regexp_replace(text, r"(?s)(?<!\\)((?:\\\\)*)(?:\\|\\u[0-9a-fA-F]{0,3})\z", "$1"), F.lit('"'))).otherwise(F.regexp_replace(text, r"\s+\z", ""))
    bare = F.regexp_replace(F.regexp_replace(bare, r'(?s)".*\z', "S"), r"\s+\z", "")
    brackets = F.regexp_extract_all(bare, F.lit(r"([\[\]{}])"), F.lit(1))
    push = lambda s, c: F.when(c.isin("[", "{"), F.concat(s, c)).otherwise(F.substring(s, F.lit(1), F.length(s) - 1))
    stack = F.aggregate(brackets, F.lit(""), push)
    in_object = F.endswith(stack, F.lit("{"))
    partial = r"(?<=[\[:,\s{]|^)(?:t|tr|tru|f|fa|fal|fals|n|nu|nul|-|-?[0-9.]+(?:[.eE]|[eE][+-]))\z"
    fixed = F.when(F.endswith(bare, F.lit(",")), F.regexp_replace(body, r",\z", ""))
    fixed = fixed.when(F.endswith(bare, F.lit(":")), F.concat(body, F.lit("null"))).when(in_object & bare.rlike(r"[{,]\s*S\z"), F.concat(body, F.lit(":null"))).when(~inside & bare.rlike(partial), F.regexp_replace(body, partial, "null")).otherwise(body)
    return F.concat(fixed, F.reverse(F.translate(stack, "[{", "]}")))


def last_value(text: Column) -> Column:
    """The last JSON object or array of a reply that may have prose around it, by bracket depth outside of strings; cut-off ones are closed. Null without any."""
    start = F.regexp_instr(text, F.lit(r"[\[{]"))
    fenced = F.regexp_extract(text, r"(?s).*```(?:json)?\s*([\[{].*?)\s*(?:```|\z)", 1)
    return F.when(fenced != "", closed(fenced)).when(start > 0, closed(F.regexp_replace(F.substr(text, start, F.length(text)), r"(?s)(?<=[\]}])[^\]}\[{\"]*\z", "")))
