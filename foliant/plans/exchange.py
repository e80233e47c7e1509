"""Queries that write and read files: documents, JSON and CSV, and the choice among them."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliant.operators import lints
from foliant.plans.documents import FINDINGS
from foliant.plans.registry import registry
from foliant.sources import files
from foliant.sources.entries import ENTRIES, entries
from foliant.sources.tables import settled, shared_dir, table

QUERIES, ORACLE, query = registry()


def scratch(spark) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}"


PARTS = """SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents"""


@query(f"SELECT doc_id, idx, text FROM ({PARTS})")
def docx_scan(spark, d):
    """Every document as a file of its own kind, scanned again: paragraphs and table rows in body order."""
    made = files.write_docx(table(spark, d, "documents"), "kept apart")
    at = files.scan_docx(made).filter("part = 'document'")
    return at.select(F.regexp_extract("path", r"doc-(-?\d+)", 1).cast("long").alias("doc_id"), "idx", F.regexp_replace("text", "\t", "|").alias("text"))


@query("SELECT doc_id, 'kept apart' AS header, 2 AS parts FROM documents")
def docx_side_channel(spark, d):
    """Headers and footers, apart from the body."""
    at = files.scan_docx(files.write_docx(table(spark, d, "documents"), "kept apart"))
    out = at.groupBy("path").agg(F.max(F.when(F.col("part").startswith("header"), F.col("text"))).alias("header"), F.countDistinct("part").alias("parts"))
    return out.select(F.regexp_extract("path", r"doc-(-?\d+)", 1).cast("long").alias("doc_id"), "header", "parts")


@query(f"SELECT entry_id, title AS a, place AS b, dates AS c FROM {ENTRIES}")
def docx_table_scan(spark, d):
    """Rows of tables, cell by cell."""
    rows = entries(spark, d).select(F.col("entry_id").alias("doc_id"), F.concat_ws("\t", "title", "place", "dates").alias("text"))
    at = files.scan_docx(files.write_docx(rows, "")).filter("kind = 'row'")
    c = F.split("text", "\t")
    return at.select(F.regexp_extract("path", r"doc-(-?\d+)", 1).cast("long").alias("entry_id"), c[0].alias("a"), c[1].alias("b"), c[2].alias("c"))


@query("SELECT doc_id, lang, length(text) AS n FROM documents WHERE doc_id % 5 > 1")
def json_artifact_scan(spark, d):
    """Entries written as JSON and read with a schema; headers and breaks stay out."""
    root = scratch(spark)
    kind = F.when(F.col("doc_id") % 5 == 0, "header").when(F.col("doc_id") % 5 == 1, "break").otherwise("paragraph")
    table(spark, d, "documents").select("doc_id", "lang", "text", kind.alias("element_type")).write.json(f"{root}/stage")
    back = files.content_rows(spark.read.schema("doc_id long, lang string, text string, element_type string").json(f"{root}/stage"))
    return settled(back.select("doc_id", "lang", F.length("text").cast("long").alias("n")), root)


@query("SELECT n_name AS node, r_name AS parent, r_name || ' > ' || n_name AS path FROM nation JOIN region ON n_regionkey = r_regionkey")
def json_mapping_scan(spark, d):
    """A tree written as nested JSON, read and flattened to paths."""
    root = scratch(spark)
    nations = table(spark, d, "nation").groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("name"))).alias("children"))
    tree = table(spark, d, "region").join(nations, F.col("r_regionkey") == F.col("n_regionkey")).select(F.col("r_name").alias("name"), "children")
    tree.write.json(f"{root}/map")
    back = spark.read.schema("name string, children array<struct<name:string>>").json(f"{root}/map").select(F.col("name").alias("parent"), F.explode("children.name").alias("node"))
    return settled(back.select("node", "parent", F.concat_ws(" > ", "parent", "node").alias("path")), root)


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN '''=1+1' ELSE event_type END AS cell, value FROM events")
def csv_round_trip(spark, d):
    """Written with guarded cells and read back."""
    root = scratch(spark)
    files.write_csv(table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "error", "=1+1").otherwise(F.col("event_type")).alias("cell"), "value"), f"{root}/csv")
    return settled(spark.read.option("header", True).option("escape", '"').schema("event_id long, cell string, value double").csv(f"{root}/csv"), root)


@query(f"WITH f AS ({FINDINGS}) SELECT lint, severity, count(*) AS n FROM (SELECT * FROM f ORDER BY CASE severity WHEN 'ERROR' THEN 0 WHEN 'WARN' THEN 1 ELSE 2 END, doc_id, lint LIMIT 1000) GROUP BY ALL")
def doctor_report_sink(spark, d):
    """The capped report as JSON, read back."""
    root = scratch(spark)
    rank = F.when(F.col("severity") == "ERROR", 0).when(F.col("severity") == "WARN", 1).otherwise(2)
    lints.findings(table(spark, d, "documents")).orderBy(rank, "doc_id", "lint").limit(1000).write.json(f"{root}/report")
    back = spark.read.schema("doc_id long, lint string, severity string, n long").json(f"{root}/report")
    return settled(back.groupBy("lint", "severity").agg(F.count(F.lit(1)).alias("n")), root)


FILES = "SELECT 'runs/web' || lpad((c_custkey % 40)::VARCHAR, 2, '0') || CASE c_custkey % 3 WHEN 0 THEN '_stage4_' WHEN 1 THEN '0_stage4_' ELSE '-stage3_' END || c_custkey || '.json' AS path, 'web' || lpad((c_custkey % 40)::VARCHAR, 2, '0') AS uid FROM customer"


@query(f"SELECT uid, min(path) AS path FROM ({FILES}) WHERE contains(path, 'stage4') AND NOT regexp_matches(path, uid || '[A-Za-z0-9]') GROUP BY uid")
def artifact_resolution(spark, d):
    k = F.col("c_custkey")
    uid = F.concat(F.lit("web"), F.lpad((k % 40).cast("string"), 2, "0"))
    mark = F.when(k % 3 == 0, "_stage4_").when(k % 3 == 1, "0_stage4_").otherwise("-stage3_")
    listing = table(spark, d, "customer").select(F.concat(F.lit("runs/"), uid, mark, k.cast("string"), F.lit(".json")).alias("path"), uid.alias("uid"))
    return files.resolve(listing, F.col("uid"), "stage4")


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'latest' WHEN doc_id % 3 = 0 THEN 'earlier' ELSE 'first' END AS stage, CASE WHEN doc_id % 2 = 0 THEN length(text) WHEN doc_id % 3 = 0 THEN -1 ELSE 0 END AS n FROM documents")
def best_input(spark, d):
    """The latest stage that has the document."""
    docs = table(spark, d, "documents")
    latest = docs.filter("doc_id % 2 = 0").select("doc_id", F.struct(F.lit("latest").alias("stage"), F.length("text").alias("n")).alias("a"))
    earlier = docs.filter("doc_id % 3 = 0").select("doc_id", F.struct(F.lit("earlier").alias("stage"), F.lit(-1).alias("n")).alias("b"))
    at = docs.select("doc_id").join(latest, "doc_id", "left").join(earlier, "doc_id", "left")
    return at.select("doc_id", F.coalesce("a", "b", F.struct(F.lit("first").alias("stage"), F.lit(0).alias("n"))).alias("x")).select("doc_id", "x.stage", F.col("x.n").cast("long").alias("n"))


@query("SELECT count(*) AS parts, sum(n)::BIGINT AS docs FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def storage_listing(spark, d):
    """What lies in a folder: objects by prefix, one for each language here, and what they hold."""
    root = scratch(spark)
    table(spark, d, "documents").select("lang", "doc_id").write.partitionBy("lang").json(f"{root}/store")
    back = spark.read.schema("doc_id long, lang string").json(f"{root}/store").withColumn("prefix", F.regexp_extract(F.input_file_name(), r"lang=([^/]+)/", 1))
    return settled(back.agg(F.countDistinct("prefix").alias("parts"), F.count(F.lit(1)).alias("docs")), root)
