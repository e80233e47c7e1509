"""Documents to lines, sections and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import collapse, header_tenths

HEADER_AT = 4


def lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("idx", "line"))


def scored_lines(docs: DataFrame) -> DataFrame:
    return lines(docs).withColumn("tenths", header_tenths(F.col("line"))).withColumn("is_header", F.col("tenths") >= HEADER_AT)


def sections(docs: DataFrame) -> DataFrame:
    """Inclusive intervals from a header to the line before the next; section 0 is what stands before the first."""
    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    at = scored_lines(docs).withColumn("section", F.sum(F.col("is_header").cast("int")).over(w))
    return at.groupBy("doc_id", "section").agg(F.min("idx").alias("start_idx"), F.max("idx").alias("end_idx"), F.count(F.lit(1)).alias("n_lines"), F.max(F.when(F.col("is_header"), F.col("line"))).alias("header"))


def batches(docs: DataFrame, size: int = 15) -> DataFrame:
    return lines(docs).groupBy("doc_id", F.floor(F.col("idx") / size).cast("long").alias("batch")).agg(F.count(F.lit(1)).alias("n_lines"), F.min("idx").alias("first_idx"), F.sum(F.length("line")).alias("n_chars"))


def without_noise(docs: DataFrame) -> DataFrame:
    """No empty lines; of lines that are equal after collapsing, the first of the document."""
    key = collapse(F.col("line"))
    return lines(docs).filter(key != "").groupBy("doc_id", key.alias("key")).agg(F.min("idx").alias("idx"), F.count(F.lit(1)).alias("n"))


def headings(pages: DataFrame) -> DataFrame:
    """Headings of a page in order, with their level."""
    found = F.regexp_extract_all("html", F.lit(r"(<h[1-6][^>]*>[^<]*)"), F.lit(1))
    one = pages.select("page_id", F.posexplode(found).alias("ord", "tag"))
    return one.select("page_id", "ord", F.regexp_extract("tag", r"^<h([1-6])", 1).cast("int").alias("level"), F.regexp_extract("tag", r">([^<]*)$", 1).alias("title"))


def heading_paths(pages: DataFrame) -> DataFrame:
    """Each heading with the nearest h1 to h3 above it in document order."""
    w = Window.partitionBy("page_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
    out = headings(pages)
    for level in (1, 2, 3):
        out = out.withColumn(f"h{level}", F.last(F.when(F.col("level") == level, F.col("title")), ignorenulls=True).over(w))
    path = [F.when(F.col("level") >= k, F.col(f"h{k}")) for k in (1, 2, 3)]
    return out.select("page_id", "ord", "level", F.concat_ws(" > ", *path).alias("path"))
