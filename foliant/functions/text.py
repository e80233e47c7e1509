"""Text functions as columns; no Python on the executors."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stop words, header words, weights (tenths) and rejects, quotes, redaction patterns.
STOP_WORDS = ("a", "an", "and", "as", "at", "be", "by", "for", "from", "i", "in", "is", "it", "of", "on", "or", "the", "to", "was", "with")
HEADER_WORDS = (
    "education", "degrees", "training", "academic background", "qualifications",
    "positions", "appointments", "employment", "experience", "professional experience", "academic positions", "professional appointments", "work experience",
    "publications", "articles", "papers", "manuscripts", "peer-reviewed", "book chapters", "chapters", "books", "abstracts", "proceedings", "bibliography", "scholarly works", "research publications",
    "grants", "funding", "research support", "grant support", "sponsored research", "extramural funding", "intramural funding", "contracts",
    "teaching", "courses", "instruction", "lectures", "curriculum", "courses taught", "teaching experience",
    "mentoring", "mentorship", "supervision", "advisees", "students supervised", "graduate students", "postdoctoral", "trainees", "theses supervised",
    "presentations", "talks", "invited talks", "seminars", "conference presentations", "symposia", "keynote",
    "service", "committees", "leadership", "professional service", "editorial", "review", "reviewer", "ad hoc reviewer",
    "awards", "honors", "recognition", "prizes", "fellowships",
    "affiliations", "memberships", "professional affiliations", "professional memberships", "societies",
    "research", "research statement", "research interests", "patents", "intellectual property", "inventions", "media", "press", "outreach", "public engagement",
    "clinical", "clinical experience", "licensure", "certifications", "skills", "languages", "technical skills", "references", "personal", "contact", "curriculum vitae", "workshop", "participation", "travel",
)
HEADER_TENTHS = {"keyword": 4, "caps": 3, "title": 2, "colon": 1, "short": 1, "bare": 2}
HEADER_REJECTS = (
    r"\b\d{4}\s*[-–]\s*\d{4}\b", r"\b\d{4}\s*[-–]\s*present\b", r"\b\d{1,2}/\d{1,2}/\d{2,4}\b", r"\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{4}\b",
    r"\(\d{4}\)", r"\bet\s+al\.", r"\bpp?\.\s*\d+", r"\bvol\.\s*\d+", r"\bdoi:", r"\bpmid:",
)
QUOTES = ("‘’ʼ′“”„″", 4 * "'" + 4 * '"')
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"\+?[0-9]{1,3}[ .-]\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}"
IDENTIFIER = r"[0-9]{3}-[0-9]{2}-[0-9]{4}"
IPV4 = r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}"
YEAR_RANGE = r"((?:19|20)[0-9]{2}) ?- ?((?:19|20)[0-9]{2})"
YEAR = r"(?:19|20)[0-9]{2}"


def collapse(text: Column) -> Column:
    """Lower case, white space collapsed and trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[ \t\n\r]+", " "))


def dedupe_key(text: Column) -> Column:
    """Lower case without anything but letters, digits and underscores, in any script."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}_]", "")


def significant_words(text: Column) -> Column:
    """Distinct ASCII words of two characters or more that aren't stop words, sorted."""
    words = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), F.lit(1))
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: (F.length(w) > 1) & ~w.isin(*STOP_WORDS))))


def word_jaccard(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union == 0, 0.0).otherwise(both / union)


def containment(a: Column, b: Column) -> Column:
    """Shared words over the smaller set; null if either has none."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least)


def header_tenths(line: Column) -> Column:
    """Additive header signals in tenths, 10 at most; 0 for lines that are empty, over 100 characters, dated or cited."""
    line = F.trim(line)
    words, low = F.filter(F.split(line, r"\s+"), lambda w: w != ""), F.lower(line)
    n, t = F.size(words), HEADER_TENTHS
    keyword = low.rlike("|".join(HEADER_WORDS))
    capital = lambda x: (F.upper(x) == x) & (F.lower(x) != x)
    title = (n <= 6) & F.forall(words, lambda w: capital(F.substring(w, 1, 1)))
    add = lambda cond, w: F.when(cond, w).otherwise(0)
    score = add(keyword, t["keyword"]) + add(capital(line) & (F.length(line) > 3), t["caps"]) + add(title, t["title"]) + add(line.endswith(":"), t["colon"]) + add(n.between(1, 5), t["short"]) + add(keyword & (n <= 2), t["bare"])
    return F.when((F.length(line) > 100) | (n == 0) | low.rlike("|".join(HEADER_REJECTS)), 0).otherwise(F.least(score, F.lit(10)))


def fold_table() -> tuple[str, str]:
    """Accented letters of the Latin, Greek and Cyrillic blocks and their base letters, by their decompositions."""
    blocks = (range(0xC0, 0x250), range(0x370, 0x400), range(0x400, 0x530), range(0x1E00, 0x2000))
    found = []
    for c in (chr(i) for block in blocks for i in block):
        base = [x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)]
        if len(base) == 1 and base[0] != c and base[0].isalpha():
            found.append((c, base[0]))
    return "".join(c for c, _ in found), "".join(b for _, b in found)


def accent_fold(text: Column) -> Column:
    """Letters without their marks, whether composed or not. Other scripts keep theirs."""
    return F.regexp_replace(F.translate(text, *fold_table()), "[̀-ͯ]", "")


def quote_fold(text: Column) -> Column:
    return F.translate(text, *QUOTES)


def squash(text: Column) -> Column:
    """Lower case without white space; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\s  -  　]+", ""))


def header_key(text: Column) -> Column:
    """Lower case, punctuation as spaces, collapsed."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def header_match(expected: Column, line: Column, strict: bool = False) -> Column:
    """Equal keys; unless strict, also a line that begins with the header and goes on with a mark of punctuation."""
    same = header_key(expected) == header_key(line)
    rest = F.substr(F.trim(line), F.length(F.trim(expected)) + 1)
    return same if strict else same | (F.startswith(F.lower(F.trim(line)), F.lower(F.trim(expected))) & rest.rlike(r"^\s*[:(–—-]"))


def run_in(line: Column) -> Column:
    """struct(label, rest) of a heading that also holds the first record; nulls where it holds none."""
    p = r"^(\p{Lu}[\p{L} &]{2,40}):\s+(\S.*)$"
    ok = line.rlike(p)
    return F.struct(F.when(ok, F.regexp_extract(line, p, 1)).alias("label"), F.when(ok, F.regexp_extract(line, p, 2)).alias("rest"))


def is_word_run(short: Column, long: Column) -> Column:
    """Whether an array of words stands in another without a gap."""
    return F.contains(F.concat(F.lit(" "), F.array_join(long, " "), F.lit(" ")), F.concat(F.lit(" "), F.array_join(short, " "), F.lit(" ")))


def is_subsequence(short: Column, long: Column) -> Column:
    """The same, gaps allowed."""
    found = F.aggregate(long, F.lit(0), lambda i, w: F.when(F.coalesce(F.try_element_at(short, i + 1) == w, F.lit(False)), i + 1).otherwise(i))
    return found == F.size(short)


def edits_apart(a: Column, b: Column, most: int) -> Column:
    """Different, by at most so many insertions, deletions and substitutions."""
    return (a != b) & (F.levenshtein(a, b, most) >= 0)


def slip_apart(a: Column, b: Column) -> Column:
    """One edit, or two neighbouring letters swapped."""
    swap = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), F.substring(a, i + 1, F.lit(1)), F.substring(a, i, F.lit(1)), F.substring(a, i + 2, F.length(a)))
    swapped = (F.length(a) == F.length(b)) & (F.length(a) > 1) & (a != b) & F.exists(F.sequence(F.lit(1), F.greatest(F.length(a) - 1, F.lit(1))), lambda i: swap(i) == b)
    return edits_apart(a, b, 1) | swapped


def initials(names: Column) -> Column:
    """Capital letters of given names; up to four that stand together already are kept."""
    bare = F.regexp_replace(names, r"[.\s]", "")
    parts = F.filter(F.split(names, r"[\s.]+"), lambda p: p != "")
    return F.when(bare.rlike("^[A-Z]{1,4}$"), bare).otherwise(F.array_join(F.transform(parts, lambda p: F.upper(F.substring(p, 1, 1))), ""))


def vancouver(author: Column) -> Column:
    """'Last, First M.' and 'First M. Last' become 'Last FM'."""
    a = F.trim(author)
    comma = F.concat_ws(" ", F.trim(F.regexp_extract(a, r"^([^,]+),", 1)), initials(F.regexp_extract(a, r",(.*)$", 1)))
    spaced = F.concat_ws(" ", F.regexp_extract(a, r"(\S+)$", 1), initials(F.regexp_extract(a, r"^(.*)\s\S+$", 1)))
    written = F.regexp_replace(a, r"\.", "")
    return F.when(a.contains(","), comma).when(a.rlike(r"\s[A-Z]{1,3}\.?$") | ~a.contains(" "), written).otherwise(spaced)


def vancouver_list(authors: Column) -> Column:
    return F.array_join(F.transform(F.filter(F.split(authors, r"\s*;\s*|\s+and\s+"), lambda x: x != ""), vancouver), ", ")


def author_pairs(authors: Column) -> Column:
    """'Last, AB, Next, C' as 'Last AB, Next C', where every second token is initials; else as it is."""
    t = F.split(authors, r"\s*,\s*")
    odd, even = F.filter(t, lambda _, i: i % 2 == 1), F.filter(t, lambda _, i: i % 2 == 0)
    paired = (F.size(t) % 2 == 0) & F.forall(odd, lambda x: x.rlike(r"^[A-Z]{1,3}$"))
    return F.when(paired, F.array_join(F.zip_with(even, odd, lambda a, b: F.concat_ws(" ", a, b)), ", ")).otherwise(authors)


def citation(authors: Column, title: Column, journal: Column, year: Column, volume: Column, pages: Column) -> Column:
    """The parts that there are, in order."""
    some = lambda c: F.when(F.trim(c) != "", F.trim(c))
    at = F.concat_ws(":", F.concat_ws(";", some(year), some(volume)), some(pages))
    return F.concat(F.concat_ws(". ", some(authors), some(title), some(journal), some(at)), F.lit("."))


def collapse_repeats(text: Column) -> Column:
    """'a | a | A' becomes 'a', only if all segments are the same after collapsing."""
    parts = F.split(text, r"\s*\|\s*")
    return F.when((F.size(parts) > 1) & (F.size(F.array_distinct(F.transform(parts, collapse))) == 1), F.trim(parts[0])).otherwise(text)


def cut_spans(text: Column, spans: Column) -> Column:
    """The text without array<struct<start,end>> (from 0, end exclusive), in any order; spans may overlap."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("pos"))
    part = lambda s, x: F.when(x["start"] > s["pos"], F.substring(text, s["pos"] + 1, x["start"] - s["pos"])).otherwise("")
    at = F.aggregate(F.array_sort(spans), start, lambda s, x: F.struct(F.concat(s["out"], part(s, x)).alias("out"), F.greatest(s["pos"], x["end"]).alias("pos")))
    return F.concat(at["out"], F.substring(text, at["pos"] + 1, F.length(text)))


def first_span(text: Column, pattern: str) -> Column:
    """array of one struct(start, end), or of none."""
    at, found = F.regexp_instr(text, F.lit(f"({pattern})")), F.regexp_substr(text, F.lit(pattern))
    one = F.array(F.struct((at - 1).cast("int").alias("start"), (at - 1 + F.length(found)).cast("int").alias("end")))
    return F.when(at > 0, one).otherwise(F.array().cast("array<struct<start:int,end:int>>"))


def dea_digit_ok(token: Column) -> Column:
    """Two letters and seven digits, of which the last checks the others."""
    d = [F.substring(token, 3 + i, 1).try_cast("int") for i in range(7)]
    return F.coalesce(token.rlike("^[A-Za-z]{2}[0-9]{7}$") & (((d[0] + d[2] + d[4]) + 2 * (d[1] + d[3] + d[5])) % 10 == d[6]), F.lit(False))


def log_safe(line: Column) -> Column:
    """An error's type without its message."""
    return F.regexp_replace(line, r"\b(\w+(?:Error|Exception|Warning)): .*", "$1")


def model_name(model: Column) -> Column:
    return F.regexp_replace(model, r"^(?:us|eu|apac|global)\.", "")


def without_codes(text: Column) -> Column:
    """Without classification marks like [S1] or [M2A]."""
    return F.trim(F.regexp_replace(text, r"\s*\[[A-Z][0-9]{0,2}[A-Z]?\]", ""))


def redact(text: Column) -> Column:
    """Addresses and numbers masked by category, e-mail first."""
    for pattern, mask in ((EMAIL, "[EMAIL]"), (IDENTIFIER, "[ID]"), (PHONE, "[PHONE]"), (IPV4, "[IP]")):
        text = F.regexp_replace(text, pattern, mask)
    return text


def csv_guard(cell: Column) -> Column:
    """A quote before cells that a spreadsheet would evaluate."""
    return F.when(cell.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), cell)).otherwise(cell)
