"""Written dates as columns: ranges, spans, centuries, open ends, comparison. Years are integers; a missing value is null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The pivot of two-digit years, the longest short range, an open end, the recency window and the age at which an in-press note is stale.
PIVOT = 30
LONGEST_SHORT_RANGE = 20
OPEN = 9999
RECENCY_YEARS = 20
STALE_YEARS = 2
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")

SPAN = r"((?:19|20)\d{2})(?:\s*[-–]\s*((?:19|20)\d{2}|present|current|ongoing|now|\d{1,2})\b)?"
YEAR = r"\b((?:19|20)\d{2})\b"


def whole(value: Column, pattern: str, group: int) -> Column:
    """A group of a pattern that must match all of the trimmed value; null where it doesn't."""
    v = F.trim(value)
    return F.when(v.rlike(f"^(?:{pattern})$"), F.regexp_extract(v, f"^(?:{pattern})$", group))


def full_year(yy: Column) -> Column:
    return F.when(yy <= PIVOT, yy + 2000).otherwise(yy + 1900)


def split_range(value: Column) -> Column:
    """struct(start, end) of a value that is nothing but a range; nulls where it is something else."""
    years, months = r"(\d{4})-(\d{4})", r"(\d{4}-\d{2})-(\d{4}-\d{2})"
    going = r"(\d{4})-((?i)present|ongoing|current)"
    start = F.coalesce(*(whole(value, p, 1) for p in (years, going, months)))
    end = F.coalesce(whole(value, years, 2), F.when(whole(value, going, 2).isNotNull(), F.lit("present")), whole(value, months, 2))
    return F.struct(start.alias("start"), end.alias("end"))


def short_range_end(year: Column, yy: Column) -> Column:
    """The first year after ``year`` that ends in ``yy``; null if that is too far."""
    ahead = F.pmod(yy - year % 100 - 1, F.lit(100)) + 1
    return F.when(ahead <= LONGEST_SHORT_RANGE, year + ahead)


def split_short_range(value: Column, text: Column) -> Column:
    """struct(start, end) of a stored ``YYYY-YY`` that the text writes as one token."""
    year, yy = whole(value, r"(\d{4})-(\d{2})", 1).cast("int"), whole(value, r"(\d{4})-(\d{2})", 2).cast("int")
    end = short_range_end(year, yy)
    written = F.regexp_like(text, F.concat(F.lit(r"(?<!\d)"), F.trim(value), F.lit(r"(?![\d/-])")))
    ok = end.isNotNull() & written
    return F.struct(F.when(ok, year).alias("start"), F.when(ok, end).alias("end"))


def reread_month_slash(value: Column, text: Column) -> Column:
    """A stored ``YYYY-MM`` that the text writes as MM/YY; null where the text doesn't show that."""
    year, month = whole(value, r"(\d{4})-(\d{2})", 1), whole(value, r"(\d{4})-(\d{2})", 2)
    yy = F.substring(year, 3, 2)
    has = lambda token: F.regexp_like(text, F.concat(F.lit(r"(?<![\d/])"), token, F.lit(r"(?![\d/])")))
    shown = has(F.concat(yy, F.lit("/"), month)) & ~has(F.concat(month, F.lit("/"), yy)) & ~F.regexp_like(text, F.concat(F.lit(r"(?<!\d)"), year, F.lit(r"(?!\d)")))
    return F.when(yy.cast("int").between(1, 12) & shown, F.concat(full_year(month.cast("int")).cast("string"), F.lit("-"), yy))


def repair_century(year: Column, text: Column) -> Column:
    """19xx becomes 20xx, or the other way, where the text has only the two digits after a slash and they read so."""
    yy = F.lpad((year % 100).cast("string"), 2, "0")
    written = F.regexp_like(text, F.concat(F.lit(r"/"), yy, F.lit(r"(?!\d)"))) & ~F.contains(text, year.cast("string"))
    return F.when(written, full_year(year % 100)).otherwise(year)


def grounded_year(year: Column, text: Column) -> Column:
    """The year if the text writes it with four digits, or with two after a slash or an apostrophe; else null."""
    yy = F.lpad((year % 100).cast("string"), 2, "0")
    return F.when(F.contains(text, year.cast("string")) | F.regexp_like(text, F.concat(F.lit("[/']"), yy, F.lit(r"(?!\d)"))), year)


def left_open(text: Column, year: Column) -> Column:
    """Whether the text leaves the year open: a dash with nothing but an end or no space after it, or a word that says so. A digit closes it; a spaced dash between words is a column."""
    token = F.concat(F.lit(r"(?<!\d)"), year.cast("string"), F.lit(r"(?:\.\d{1,2}){0,2}"))
    dash = F.lit(r"(?:[-–—](?!\s*\d)(?!\d)|\s+[-–—] *(?:\t|\)|$)|\s*(?:[-–—]|\bto\b)\s*(?:present|current|now)\b)")
    begins = F.concat(F.lit(r"^\s*"), year.cast("string"), F.lit(r"\s+[-–—][ \t]*[^\s\d]"))
    return F.coalesce(F.regexp_like(text, F.concat(F.lit("(?i)"), token, dash)) | F.regexp_like(text, begins), F.lit(False))


def written_spans(text: Column) -> Column:
    """array<struct<first,last>> of all year spans in order. Short ends are completed from the start; an open end is OPEN; an end before its start counts as the start."""
    first = F.regexp_extract_all(text, F.lit(SPAN), F.lit(1))
    end = F.regexp_extract_all(text, F.lit(SPAN), F.lit(2))

    def span(y: Column, e: Column) -> Column:
        a = y.cast("int")
        short = F.length(e) <= 2
        wide = F.when(F.length(e) == 1, 10).otherwise(100)
        b = F.when(e == "", a).when(~e.rlike(r"^\d"), F.lit(OPEN)).when(short, a - a % wide + e.try_cast("int")).otherwise(e.try_cast("int"))
        return F.struct(a.alias("first"), F.greatest(a, b).alias("last"))

    return F.zip_with(first, end, span)


def ranges(text: Column) -> Column:
    """Only the spans that go beyond one year."""
    return F.filter(written_spans(text), lambda s: s["last"] > s["first"])


def lone_years(text: Column) -> Column:
    return F.transform(F.filter(written_spans(text), lambda s: s["last"] == s["first"]), lambda s: s["first"])


def spans_overlap(a: Column, b: Column) -> Column:
    return (a["first"] <= b["last"]) & (b["first"] <= a["last"])


def dates_compatible(dropped: Column, kept: Column) -> Column:
    """Every dropped range overlaps a kept one, and every dropped lone year is written in the kept text or inside one of its ranges. Undated text is compatible with all."""
    of_kept, years = ranges(kept), F.flatten(F.transform(written_spans(kept), lambda s: F.array(s["first"], s["last"])))
    wide = F.forall(ranges(dropped), lambda d: F.exists(of_kept, lambda k: spans_overlap(d, k)))
    lone = F.forall(lone_years(dropped), lambda y: F.array_contains(years, y) | F.exists(of_kept, lambda k: (k["first"] <= y) & (y <= k["last"])))
    return wide & lone


def clauses(text: Column) -> Column:
    """The text cut after each dated part."""
    return F.split(F.regexp_replace(text, rf"({YEAR})[;,] +", "$1\n"), "\n")


def listed(text: Column) -> Column:
    """All spans, as they would be listed."""
    show = lambda s: F.when(s["last"] == s["first"], s["first"].cast("string")).when(s["last"] == OPEN, F.concat(s["first"].cast("string"), F.lit("-present"))).otherwise(F.concat_ws("-", s["first"].cast("string"), s["last"].cast("string")))
    return F.array_join(F.transform(written_spans(text), show), ", ")


def iso_to_words(text: Column) -> Column:
    """2019-05 becomes May 2019; a longer chain of numbers stays."""
    for i, name in enumerate(MONTHS, 1):
        text = F.regexp_replace(text, rf"(?<![\d-])(\d{{4}})-{i:02d}(?![\d-])", f"{name} $1")
    return text


def section_date(value: Column, form: Column) -> Column:
    """A stored year, month or day in the form of its section: yyyy, mm/yyyy or mm/yy. Words for an open end become Present; what isn't a date stays; a month that can't be goes."""
    y, m = F.regexp_extract(value, r"^(\d{4})", 1), F.regexp_extract(value, r"^\d{4}-(0[1-9]|1[0-2])(?:-|$)", 1)
    out = F.when(form == "mm/yyyy", F.concat_ws("/", m, y)).when(form == "mm/yy", F.concat_ws("/", m, F.substring(y, 3, 2)))
    dated = F.when((m != "") & (form != "yyyy"), out).otherwise(y)
    return F.when(F.lower(F.trim(value)).isin("present", "current", "ongoing"), "Present").when(y != "", dated).otherwise(F.coalesce(value, F.lit("")))


def range_text(start: Column, end: Column, open_: Column) -> Column:
    """start-end; one of them if they are equal or the other is missing; start-Present where it is open. An end behind a plain year is a plain year."""
    plain = start.rlike(r"^\d{4}$")
    e = F.when(plain & end.rlike(r"\d{4}$"), F.regexp_extract(end, r"(\d{4})$", 1)).otherwise(end)
    both = F.when(start == e, start).otherwise(F.concat_ws("-", start, e))
    return F.when((start != "") & (e != ""), both).when(start != "", F.when(open_ & (start != "Present"), F.concat(start, F.lit("-Present"))).otherwise(start)).otherwise(e)


def recency(latest: Column, current: Column, as_of: int) -> Column:
    """1 if current, 0 if undated, else falling to 0 in a fixed number of years."""
    return F.when(current, 1.0).when(latest.isNull(), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), 1 - (as_of - latest) / F.lit(RECENCY_YEARS))))


def stale_in_press(text: Column, year: Column, run_year: int) -> Column:
    return F.coalesce(F.lower(text).rlike(r"\bin press\b") & (run_year - year >= STALE_YEARS), F.lit(False))
