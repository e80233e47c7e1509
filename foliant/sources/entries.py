"""Dated entries of a curriculum, in many ways of writing, derived from the orders table; and the same rows in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.sources.tables import table

TITLES = (
    "Associate Professor of Medicine", "Lecture on Cardiac Imaging in Children", "Grant for Sleep Research, Principal Investigator", "Committee on Teaching Quality",
    "Teacher of the Year Award", "Paper on Suture Methods, in press", "Reviewer for Clinical Trials",
)
CODES = ("D3", "M1", "L2", "T1", "H", "S1", "N3A")
PLACES = ("Example State University", "Example Regional Hospital", "General Clinic of the North", "Institute for Surgery")


def pick(values: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def date_text(kind: Column, y: Column, m: Column, d: Column, span: Column) -> Column:
    s, two = lambda c: c.cast("string"), lambda c: F.lpad(c.cast("string"), 2, "0")
    month = pick(("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December"), m - 1)
    return (
        F.when(kind == 0, F.concat(s(y), F.lit("-"), s(y + span)))
        .when(kind == 1, F.concat(s(y), F.lit("-"), two((y + span) % 100)))
        .when(kind == 2, F.concat(s(y), F.lit(" - present")))
        .when(kind == 3, F.concat(month, F.lit(" "), s(y)))
        .when(kind == 4, F.concat(s(m), F.lit("/"), s(d), F.lit("/"), two(y % 100)))
        .when(kind == 5, F.concat(s(y), F.lit("-"), two(m)))
        .when(kind == 6, F.lit("undated"))
        .when(kind == 7, F.concat(s(y), F.lit(", "), s(y + 1), F.lit(", "), s(y + 3)))
        .when(kind == 8, F.concat(two(m), F.lit("/"), two(y % 100), F.lit("- "), two(d % 12 + 1), F.lit("/"), two((y + span) % 100)))
        .otherwise(F.concat(s(y), F.lit("-"), two(m), F.lit("-"), s(y + span), F.lit("-"), two(d % 12 + 1)))
    )


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """entry_id, person, owner (of many persons), section (of the owner), code, title, place, y, m, d, span, kind, dates, text."""
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = o.select(
        key.alias("entry_id"), cust.alias("person"), (cust % 100).alias("owner"), (key % 5).alias("section"), pick(CODES, key % 7).alias("code"), pick(TITLES, key % 7).alias("title"), pick(PLACES, cust % 4).alias("place"),
        F.year("o_orderdate").alias("y"), F.month("o_orderdate").alias("m"), F.dayofmonth("o_orderdate").alias("d"), (cust % 6).cast("int").alias("span"), (F.floor(key / 7) % 10).cast("int").alias("kind"),
    )
    rows = rows.withColumn("dates", date_text(F.col("kind"), F.col("y"), F.col("m"), F.col("d"), F.col("span")))
    return rows.withColumn("text", F.concat_ws(", ", "title", "place", "dates"))


def _list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


ENTRIES = f"""(SELECT *, title || ', ' || place || ', ' || dates AS text FROM (SELECT *, CASE kind
  WHEN 0 THEN y || '-' || (y + span) WHEN 1 THEN y || '-' || lpad(((y + span) % 100)::VARCHAR, 2, '0') WHEN 2 THEN y || ' - present' WHEN 3 THEN mon || ' ' || y
  WHEN 4 THEN m || '/' || d || '/' || lpad((y % 100)::VARCHAR, 2, '0') WHEN 5 THEN y || '-' || lpad(m::VARCHAR, 2, '0') WHEN 6 THEN 'undated' WHEN 7 THEN y || ', ' || (y + 1) || ', ' || (y + 3)
  WHEN 8 THEN lpad(m::VARCHAR, 2, '0') || '/' || lpad((y % 100)::VARCHAR, 2, '0') || '- ' || lpad((d % 12 + 1)::VARCHAR, 2, '0') || '/' || lpad(((y + span) % 100)::VARCHAR, 2, '0')
  ELSE y || '-' || lpad(m::VARCHAR, 2, '0') || '-' || (y + span) || '-' || lpad((d % 12 + 1)::VARCHAR, 2, '0') END AS dates FROM (
SELECT o_orderkey AS entry_id, o_custkey AS person, o_custkey % 100 AS owner, o_orderkey % 5 AS section, {_list(CODES)}[o_orderkey % 7 + 1] AS code, {_list(TITLES)}[o_orderkey % 7 + 1] AS title, {_list(PLACES)}[o_custkey % 4 + 1] AS place,
  year(o_orderdate)::INT AS y, month(o_orderdate)::INT AS m, day(o_orderdate)::INT AS d, (o_custkey % 6)::INT AS span, ((o_orderkey // 7) % 10)::INT AS kind, strftime(o_orderdate, '%B') AS mon FROM orders)))"""
