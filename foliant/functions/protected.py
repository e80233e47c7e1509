"""Protected personal data: which stretches of a text a policy withholds, for all categories in two passes over the text.

One pattern finds every labelled value (a label at the start of a fragment, a colon, and what follows to the fragment's end), another every value that needs no label. A found piece is short, so its category is told from it alone. Scopes say in which sections a category holds.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.text import cut_spans, dea_digit_ok

ALL, PERSONAL, MEMBERSHIP = "all", "personal", "membership"

# Categories, scopes and the spellings of labels. The first that fits names the category.
LABELS = (
    ("date of birth", ALL, r"date\s*of\s*birth|birth\s*-?\s*date|birthdate|birthday|year\s*of\s*birth|d\.?o\.?b\.?"),
    ("place of birth", ALL, r"place\s*of\s*birth|birth\s*-?\s*place"),
    ("social security number", ALL, r"social\s*security(?:\s*(?:number|no\.?))?|ssn"),
    ("passport number", ALL, r"passport(?:\s*(?:number|no\.?))?"),
    ("alien registration number", ALL, r"alien\s*registration(?:\s*(?:number|no\.?))?"),
    ("driver's license", ALL, r"driver.?s?\s*licen[sc]e"),
    ("institutional ID number", ALL, r"(?:employee|student|faculty|staff|institutional)\s*id(?:\s*(?:number|no\.?))?"),
    ("tax ID number", ALL, r"tax\s*id(?:\s*(?:number|no\.?))?"),
    ("marital status", ALL, r"marital\s*status"),
    ("spouse", ALL, r"(?:names?\s+of\s+)?(?:spouse|husband|wife)(?:['’]s)?(?:\s*name)?"),
    ("emergency contact", ALL, r"emergency\s*contact"),
    ("visa / immigration status", ALL, r"visa(?:\s*status)?|immigration\s*status"),
    ("salary / honorarium", ALL, r"salary|honorarium"),
    ("date or place of birth", PERSONAL, r"born"),
    ("children / dependents", PERSONAL, r"(?:names?\s+of\s+)?(?:children|child|kids|dependents?)(?:['’]s\s*names?)?"),
    ("family", PERSONAL, r"family(?:\s+(?:information|data))?"),
    ("age", PERSONAL, r"age"),
    ("gender", PERSONAL, r"gender"),
    ("religion", MEMBERSHIP, r"religion"),
    ("ethnicity", PERSONAL, r"(?:race\s*(?:/|\s+and\s+)\s*)?ethnicity"),
    ("veteran status", PERSONAL, r"veteran(?:\s*status)?"),
    ("disability", PERSONAL, r"disability"),
    ("health", PERSONAL, r"health"),
    ("blood type", PERSONAL, r"blood\s*type"),
    ("home address / phone", PERSONAL, r"home\s*(?:address|phone|telephone|tel\.?)"),
)
FULL_DATE = r"(?:\d{1,2}[/-]\d{1,2}[/-]\d{2,4}|\d{4}-\d{1,2}-\d{1,2}|\d{1,2}\.\d{1,2}\.\d{2,4}|(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{1,2}(?:st|nd|rd|th)?,?\s*\d{4}|\d{1,2}(?:st|nd|rd|th)?\s+(?:of\s+)?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*,?\s*\d{4})"
SHAPES = (
    ("date of birth", ALL, r"(?<![\w-])(?:born(?:\s+on)?|d\.?o\.?b\.?|date\s+of\s+birth) " + FULL_DATE),
    ("social security number", ALL, r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    ("visa / immigration status", ALL, r"\b[A-Z]{1,2}-\d{1,2}[A-Z]?\s+visa\b"),
    ("DEA number", PERSONAL, r"\b[A-Z]{2}\d{7}\b"),
    ("third-party contact", PERSONAL, r"[\w.+-]{1,64}+@[\w-]+(?:\.[\w-]+)+|(?<![\d-])(?:\+1[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]\d{4}(?![\d-])"),
    ("network address", ALL, r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"),
)
#: Sections that a scope reaches.
REACHES = {ALL: ("body", "membership", "personal"), MEMBERSHIP: ("membership", "personal"), PERSONAL: ("personal",)}
#: Where a fragment begins and ends: a line, a cell, a clause, or a wide gap.
_START, _STOP = r"(?:^|(?<=[\n\t|;])|(?<=\x20{3})) *+", r"(?=\x20{3}|[\n\t|;]|\z)"
LABELLED = rf"(?im){_START}(?:{'|'.join(p for _, _, p in LABELS)})\s{{0,3}}:[^\n\t|;]*?{_STOP}"
SHAPED = "(?i)" + "|".join(p for _, _, p in SHAPES)
SPANS = "array<struct<start:int,end:int,category:string>>"


def found(text: Column, pattern: str) -> Column:
    """array<struct<start, end, piece>>: every match, by the lengths of what stands between. The pattern has no empty match. The array grows by one struct a match: meant for the few matches that a text has."""
    between, pieces = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    first = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<start:int,end:int,piece:string>>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        start = s["pos"] + F.length(x["gap"])
        end = start + F.length(x["piece"])
        return F.struct(end.alias("pos"), F.array_append(s["out"], F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), x["piece"].alias("piece"))).alias("out"))

    zipped = F.zip_with(F.slice(between, 1, F.size(pieces)), pieces, lambda gap, piece: F.struct(gap.alias("gap"), piece.alias("piece")))
    return F.when(F.size(pieces) > 0, F.aggregate(zipped, first, step)["out"]).otherwise(first["out"])


def first_fit(value: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    out = F.lit(None).cast("string")
    for category, _, pattern in reversed(rules):
        out = F.when(value.rlike(rf"(?i)^(?:{pattern})$"), category).otherwise(out)
    return out


def in_scope(category: Column, section: Column, rules: tuple[tuple[str, str, str], ...]) -> Column:
    """A category's scope by the first rule that has it."""
    ok = F.lit(False)
    for scope, sections in REACHES.items():
        names = [c for c, s, _ in rules if s == scope]
        ok = ok | (category.isin(*names) & section.isin(*sections))
    return ok


def spans(text: Column, section: Column) -> Column:
    """array<struct<start, end, category>> by place (code points from 0, end exclusive): what the policy withholds in a text of a section (body, membership, personal; null is body). A value inside a labelled one isn't named again; a number of a DEA number's shape needs its check digit.
    Null texts give an empty array."""
    section = F.coalesce(section, F.lit("body"))
    label = lambda piece: F.regexp_extract(piece, r"^\s*([^:]*?)\s*:", 1)
    named = F.transform(found(text, LABELLED), lambda x: F.struct(x["start"], x["end"], first_fit(label(x["piece"]), LABELS).alias("category")))
    named = F.filter(named, lambda x: in_scope(x["category"], section, LABELS))
    shaped = F.filter(found(text, SHAPED), lambda x: ~x["piece"].rlike(r"^[A-Za-z]{2}\d{7}$") | dea_digit_ok(x["piece"]))
    shaped = F.filter(F.transform(shaped, lambda x: F.struct(x["start"], x["end"], first_fit(x["piece"], SHAPES).alias("category"))), lambda x: in_scope(x["category"], section, SHAPES))
    alone = F.filter(shaped, lambda x: ~F.exists(named, lambda y: (y["start"] <= x["start"]) & (x["end"] <= y["end"])))
    return F.coalesce(F.array_sort(F.concat(named, alone)), F.array().cast(SPANS))


def withheld(text: Column, spans: Column) -> Column:
    """The text without the spans."""
    return F.when(F.size(spans) > 0, cut_spans(text, spans)).otherwise(text)


def notice(spans: Column) -> Column:
    """The categories, each once, by name."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda x: x["category"]))), "; ")
