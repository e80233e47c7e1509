"""Queries on values nested to any depth, and on replies that were cut off."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import trees
from foliant.plans.registry import registry
from foliant.sources.tables import table

QUERIES, ORACLE, query = registry()


def _replies(spark, d):
    """Replies of five levels, with quotes, brackets and errors inside strings."""
    k = F.col("c_custkey").cast("string")
    parts = [F.lit('{"name":"'), "c_name", F.lit('","items":[{"id":'), k, F.lit(',"notes":[["say \\"no\\" ]","'), "c_mktsegment", F.lit('"],{"error":"bad {'), k, F.lit('}","deep":{"ok":true,"none":null}}]},[1,[2,["x}"]]]],"error":'), F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('"late '), k, F.lit('"'))).otherwise("null"), F.lit(',"empty":{},"list":[]}')]
    return table(spark, d, "customer").select("c_custkey", F.concat(*parts).alias("reply"))


REPLIES = """(SELECT c_custkey, '{"name":"' || c_name || '","items":[{"id":' || c_custkey || ',"notes":[["say \\"no\\" ]","' || c_mktsegment || '"],{"error":"bad {' || c_custkey || '}","deep":{"ok":true,"none":null}}]},[1,[2,["x}"]]]],"error":' || CASE WHEN c_custkey % 3 = 0 THEN '"late ' || c_custkey || '"' ELSE 'null' END || ',"empty":{},"list":[]}' AS reply FROM customer)"""
KIND = "CASE type WHEN 'OBJECT' THEN 'object' WHEN 'ARRAY' THEN 'array' WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'NULL' THEN 'null' ELSE 'number' END"
TREE = f"SELECT c_custkey, fullkey AS path, {KIND} AS kind, CASE WHEN type NOT IN ('OBJECT', 'ARRAY', 'NULL') THEN json_extract_string(atom, '$') END AS value FROM {REPLIES}, json_tree(reply)"


@query(TREE)
def nested_nodes(spark, d):
    """Every value with its path."""
    return trees.nodes(_replies(spark, d), "c_custkey", "reply").drop("level")


@query(f"SELECT c_custkey, count(*) AS errors, string_agg(value, '; ' ORDER BY path) AS texts FROM ({TREE}) WHERE kind = 'string' AND regexp_matches(path, '\\.error$') GROUP BY c_custkey")
def nested_errors_deep(spark, d):
    """Errors under any name ``error``, however deep."""
    at = trees.nodes(_replies(spark, d), "c_custkey", "reply").filter((F.col("kind") == "string") & F.col("path").endswith(".error"))
    found = F.array_sort(F.collect_list(F.struct("path", "value")))
    return at.groupBy("c_custkey").agg(F.count(F.lit(1)).alias("errors"), F.array_join(F.transform(found, lambda x: x["value"]), "; ").alias("texts"))


#: Where a reply is cut, and what is then left of it.
CUTS = ((',"none":null', ',"none":null}}]}]}'), ('"items":[', '"items":[]}'), ('"deep":', '"deep":null}]}]}'), ('"ok":tr', '"ok":null}}]}]}'), ('"say \\"no', '"say \\"no"]]}]}'))


@query(f"""SELECT c_custkey, split_part(reply, part, 1) || ended AS reply FROM (SELECT *, [{', '.join("'" + c + "'" for c, _ in CUTS)}][c_custkey % {len(CUTS)} + 1] AS part, [{', '.join("'" + e + "'" for _, e in CUTS)}][c_custkey % {len(CUTS)} + 1] AS ended FROM {REPLIES})""")
def closed_replies(spark, d):
    """Replies that were cut inside names, strings, words and lists."""
    k = (F.col("c_custkey") % len(CUTS) + 1).cast("int")
    part = F.element_at(F.array(*(F.lit(c) for c, _ in CUTS)), k)
    cut = F.substr("reply", F.lit(1), F.expr("instr(reply, part)") + F.length("part") - 1)
    return _replies(spark, d).withColumn("part", part).select("c_custkey", trees.closed(cut).alias("reply"))
