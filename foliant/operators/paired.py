"""Checks that need a document's source and what was made of it: differences of their words, years and lines as multisets.

Words and lines of both sides are counted in one aggregation by (document, key), folded before they are shuffled, so a long document spreads over many tasks and no text meets another whole. A document without an output has its checks skipped. Null and empty source texts have nothing to lose; null outputs are none, empty outputs are outputs. Where a document has several rows, their texts count together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which share of words may be lost or new before a check fires, in hundredths.
LOST_PERCENT, NEW_PERCENT = 20, 5
# Both sides' counts travel in one number; a document has fewer than 2^31 of any word.
SOURCE, OUTPUT = 1, 1 << 32
#: check: severity, how many it finds, when it fires.
CHECKS: dict[str, tuple[str, str, str]] = {
    "content_lost": ("ERROR", "lost_words", f"lost_words * 100 > words * {LOST_PERCENT}"),
    "words_new": ("WARN", "new_words", f"new_words * 100 > out_words * {NEW_PERCENT}"),
    "years_lost": ("WARN", "lost_years", "lost_years > 0"),
    "years_new": ("ERROR", "new_years", "new_years > 0"),
    "lines_lost": ("WARN", "lost_lines", "lost_lines > 0"),
    "lines_twice": ("WARN", "twice", "twice > 0"),
}


def _counted(texts: DataFrame, one: int) -> DataFrame:
    """doc_id, key, n: a row for each word (key w...) and each line that has a letter or figure (key l...)."""
    low = F.lower("text")
    words = F.transform(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w: F.concat(F.lit("w"), w))
    lines = F.transform(F.split(low, "\n", -1), lambda x: F.concat(F.lit("l"), F.regexp_replace(x, r"[^\p{L}\p{N}]", "")))
    return texts.select("doc_id", F.explode(F.concat(words, F.filter(lines, lambda x: x != "l"))).alias("key")).withColumn("n", F.lit(one))


def differences(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """A row for each document of sources (doc_id, text): there (whether it has an output), words, out_words, lost_words, new_words, lost_years, new_years, lost_lines, twice (lines printed more often than in the source, which has them)."""
    sources, outputs = sources.select("doc_id", "text").filter("doc_id is not null"), outputs.select("doc_id", "text").filter("doc_id is not null and text is not null")
    marks = [f.select("doc_id", F.lit(k).alias("key"), F.lit(one).alias("n")) for f, k, one in ((sources, "s", SOURCE), (outputs, "o", OUTPUT))]
    each = _counted(sources, SOURCE).union(_counted(outputs, OUTPUT)).union(marks[0]).union(marks[1]).groupBy("doc_id", "key").agg(F.sum("n").alias("n"))
    folded = each.select("doc_id", "key", F.col("n").bitwiseAND(F.lit(OUTPUT - 1)).alias("s"), F.shiftright("n", 32).alias("o"))
    word, line, year = F.startswith("key", F.lit("w")), F.startswith("key", F.lit("l")), F.col("key").rlike(r"^w(19|20)\d\d$")
    total = lambda when, what: F.coalesce(F.sum(F.when(when, what)), F.lit(0)).alias
    lost, new = F.greatest(F.col("s") - F.col("o"), F.lit(0)), F.greatest(F.col("o") - F.col("s"), F.lit(0))
    gone, fresh = (F.col("s") > 0) & (F.col("o") == 0), (F.col("o") > 0) & (F.col("s") == 0)
    per = folded.groupBy("doc_id").agg(
        F.bool_or(F.col("key") == "s").alias("known"), F.bool_or(F.col("key") == "o").alias("there"), total(word, F.col("s"))("words"), total(word, F.col("o"))("out_words"), total(word, lost)("lost_words"), total(word, new)("new_words"),
        total(year & gone, F.lit(1))("lost_years"), total(year & fresh, F.lit(1))("new_years"), total(line & gone, F.lit(1))("lost_lines"), total(line & (F.col("s") > 0), new)("twice"),
    )
    return per.filter("known").drop("known")


def _checked(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    each = [F.struct(F.lit(k).alias("lint"), F.lit(severity).alias("severity"), F.when(F.col("there") & F.expr(when), F.col(n)).otherwise(0).cast("long").alias("n")) for k, (severity, n, when) in CHECKS.items()]
    return differences(sources, outputs).select("doc_id", "there", F.explode(F.array(*each)).alias("x")).select("doc_id", "there", "x.*")


def findings(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """doc_id, lint, severity, n: a row for each document and check that fires."""
    return _checked(sources, outputs).filter("n > 0").drop("there")


def status(sources: DataFrame, outputs: DataFrame) -> DataFrame:
    """lint, status, docs, found: on how many documents each check ran or was skipped for want of an output, and in how many it found something."""
    ran: Column = F.when(F.col("there"), "ran").otherwise("skipped: no output")
    return _checked(sources, outputs).groupBy("lint", ran.alias("status")).agg(F.count(F.lit(1)).alias("docs"), F.count_if(F.col("n") > 0).alias("found"))
