"""Lines that a form gives, not its author: by their shape, and as templates that are found in the corpus itself.

By shape: an outline mark with a short label and an order in brackets, a question that is answered with "not applicable" alone, an order in brackets by itself, a note to the author about the section.
By frequency: what many documents of a source share is that source's template; a line that is in another source's template and not in one's own is foreign scaffolding that came along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Words that open an order, what may follow them where it is none, answers that say nothing, whom a note addresses, and the longest line, label and prompt.
ORDERS = ("include", "list", "provide", "indicate", "describe", "specify", "give", "enter")
NO_ORDER = ("of", "available", "upon", "below", "above")  # and "on request"
UNANSWERED = ("n/a", "na", "not applicable")
NOTE_OPENS = ("section", "category", "table")
NOTE_VERBS = ("include", "includes", "should", "list", "lists")  # and "is for", "is to"
ADDRESSED = ("you", "your", "please", "should")
LONGEST, LABEL, PROMPT, SHORTEST = 400, 80, 160, 3


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("([a-z]+)"), F.lit(1))


def is_scaffold(line: Column) -> Column:
    """Whether a whole line has the shape of a form's own text; false for null, for table rows and for lines that go on after the bracket."""
    low = F.lower(F.trim(F.regexp_replace(line, r"\s+", " ")))
    mark = F.regexp_extract(low, r"^(\d{1,2}|[a-z]|[ivx]{1,4})[.,)] ", 0)
    rest = F.when(mark == "", low).otherwise(F.trim(F.substring(low, F.length(mark) + F.lit(1), F.length(low))))
    # label ( order ) tail, where "(s)" is a plural and no bracket
    plain = F.replace(rest, F.lit("(s)"), F.lit("s"))
    opened = F.locate("(", plain)
    label, inner = F.trim(F.substring(plain, F.lit(1), opened - 1)), F.substring(plain, opened + 1, F.length(plain))
    parts = F.split(inner, r"\)", 2)
    asked, after = parts[0], F.coalesce(F.try_element_at(parts, F.lit(2)), F.lit(""))
    said = F.trim(F.regexp_replace(F.regexp_replace(after, r"^ ?:", ""), r"\.$", ""))
    words = F.transform(F.split(F.trim(asked), " "), lambda w: F.regexp_extract(w, "^[a-z]+", 0))
    at = F.when(words[0] == "please", 2).otherwise(1)
    nth = lambda k: F.coalesce(F.try_element_at(words, at + k), F.lit(""))
    order = nth(0).isin(*ORDERS) & ~(nth(1).isin(*NO_ORDER) | (nth(1) == "on") & (nth(2) == "request"))
    bracket = (opened > 0) & order & ~asked.contains("(") & ((after == "") | (said == "") & after.rlike("^ ?:?$") | said.isin(*UNANSWERED))
    short = F.length(label).between(SHORTEST, LABEL) & ~label.rlike(r"[0-9()]")
    # a prompt and an answer that says nothing
    prompt = F.substring_index(rest, ":", 1)
    answer = F.trim(F.regexp_replace(F.substring(rest, F.length(prompt) + F.lit(2), F.length(rest)), r"\.$", ""))
    empty = rest.contains(":") & F.length(prompt).between(SHORTEST, PROMPT) & ~prompt.rlike("[0-9]") & answer.isin(*UNANSWERED)
    note = F.trim(F.substring_index(low, ":", 1)) == "note"
    told = _words(F.substring(low, F.locate(":", low) + F.lit(1), F.length(low)))
    nth_told = lambda k: F.coalesce(F.try_element_at(told, F.lit(k)), F.lit(""))
    says = nth_told(3).isin(*NOTE_VERBS) | (nth_told(3) == "is") & nth_told(4).isin("for", "to")
    directive = note & (nth_told(1) == "this") & nth_told(2).isin(*NOTE_OPENS) & says & F.arrays_overlap(F.slice(told, 4, 1_000), F.array(*map(F.lit, ADDRESSED)))
    shape = ((mark != "") & short & bracket) | ((mark != "") & empty) | (empty & F.endswith(F.rtrim(prompt), F.lit(")"))) | ((label == "") & bracket) | directive
    return F.coalesce(shape & ~line.contains("|") & (low != "") & (F.length(low) <= LONGEST), F.lit(False))


def line_key(line: Column) -> Column:
    """Case, figures, marks and white space apart, so that a numbered or dated form line is one line; empty without three letters."""
    key = F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}]+", " "))
    return F.when(F.length(key) >= SHORTEST, key).otherwise("")


def source_templates(lines: DataFrame, share: float, least: int) -> DataFrame:
    """source, key, docs: keys of lines that stand in at least ``share`` of a source's documents, and in ``least`` of them. Lines have doc_id, source, key; a line counts once a document.

    A key's documents are counted by two partial aggregates, so a line that a third of all documents share is folded before it is shuffled."""
    once = lines.filter("key <> ''").select("source", "key", "doc_id").distinct()
    docs = lines.select("source", "doc_id").distinct().groupBy("source").agg(F.count(F.lit(1)).alias("of"))
    return once.groupBy("source", "key").agg(F.count(F.lit(1)).alias("docs")).join(docs, "source").filter((F.col("docs") >= least) & (F.col("docs") >= share * F.col("of"))).select("source", "key", "docs")


def by_origin(lines: DataFrame, share: float = 0.04, least: int = 3) -> DataFrame:
    """doc_id, source, key, n, own, foreign, home: how often a document has a line, whether it belongs to its own source's template, or to others' alone, and the source whose template it is most (ties: the smaller name).

    Null sources are one source of their own, named by the empty string. Templates are small beside the lines: adaptive execution broadcasts them if their measured size allows, and else splits hot keys of a shuffled join."""
    rows = lines.withColumn("source", F.coalesce("source", F.lit(""))).filter("key <> ''").groupBy("doc_id", "source", "key").agg(F.count(F.lit(1)).alias("n"))
    found = source_templates(lines.withColumn("source", F.coalesce("source", F.lit(""))), share, least)
    homes = found.groupBy("key").agg(F.min(F.struct(-F.col("docs"), "source"))["source"].alias("home"))
    own = found.select("source", "key", F.lit(True).alias("own"))
    at = rows.join(homes, "key", "left").join(own, ["source", "key"], "left").withColumn("own", F.coalesce("own", F.lit(False)))
    return at.select("doc_id", "source", "key", "n", "own", (F.col("home").isNotNull() & ~F.col("own")).alias("foreign"), "home")
