"""Queries on protected personal data: all categories, all spans, by section."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import protected as P
from foliant.plans.registry import registry
from foliant.sources.tables import table

QUERIES, ORACLE, query = registry()

LABEL_TEXTS = (
    "Date of Birth", "D.O.B.", "birth-date", "PLACE OF BIRTH", "Birthplace", "SSN", "Social Security No.", "Passport number", "Alien registration no.", "Driver's License", "Employee ID", "Tax ID number", "Marital Status", "Name of spouse",
    "Wife's name", "Emergency Contact", "Visa status", "Immigration  status", "Salary", "Honorarium", "Born", "Children", "Names of children", "Family", "Family information", "Age", "Gender", "Religion", "Race/Ethnicity", "Ethnicity",
    "Veteran status", "Disability", "Health", "Blood type", "Home phone", "Home address", "Page", "Age group", "Citation", "Homepage", "The salary",
)
VALUES = ("private", "01/02/1970", "123-45-6789", "AB1234563 on file", "born 3 May 1971", "J-1 visa", "x.y@example.org", "212-555-0100", "10.0.0.1", "")
SEPARATORS = ("\n", " | ", "\t", "; ", "   ")
SECTIONS = ("personal", "body", "membership")


def _at(values, k):
    return F.element_at(F.array(*map(F.lit, values)), (k % len(values) + 1).cast("int"))


def _lines(spark, d):
    """Lines of three fragments of customers: a name, a labelled value and a bare one, in many spellings, and their section."""
    k = F.col("c_custkey")
    sep = _at(SEPARATORS, F.floor(k / 41))
    text = F.concat(F.lit("Name: "), "c_name", sep, _at(LABEL_TEXTS, k), F.when(k % 7 == 0, " :").otherwise(":"), F.lit(" "), _at(VALUES, F.floor(k / 3)), sep, F.lit("see "), _at(VALUES, F.floor(k / 5)))
    return table(spark, d, "customer").select("c_custkey", text.alias("text"), _at(SECTIONS, F.floor(k / 11)).alias("section"))


def _sql(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '") + "'" for v in values) + "]"


#: What each label names, and the sections that withhold it; written out for the labels as they stand in the lines.
MEANS = {
    "date of birth": ("body membership personal", ("date of birth", "d.o.b.", "birth-date")), "place of birth": ("body membership personal", ("place of birth", "birthplace")), "social security number": ("body membership personal", ("ssn", "social security no.")),
    "passport number": ("body membership personal", ("passport number",)), "alien registration number": ("body membership personal", ("alien registration no.",)), "driver's license": ("body membership personal", ("driver's license",)),
    "institutional ID number": ("body membership personal", ("employee id",)), "tax ID number": ("body membership personal", ("tax id number",)), "marital status": ("body membership personal", ("marital status",)), "spouse": ("body membership personal", ("name of spouse", "wife's name")),
    "emergency contact": ("body membership personal", ("emergency contact",)), "visa / immigration status": ("body membership personal", ("visa status", "immigration  status")), "salary / honorarium": ("body membership personal", ("salary", "honorarium")),
    "date or place of birth": ("personal", ("born",)), "children / dependents": ("personal", ("children", "names of children")), "family": ("personal", ("family", "family information")), "age": ("personal", ("age",)), "gender": ("personal", ("gender",)),
    "religion": ("membership personal", ("religion",)), "ethnicity": ("personal", ("race/ethnicity", "ethnicity")), "veteran status": ("personal", ("veteran status",)), "disability": ("personal", ("disability",)), "health": ("personal", ("health",)), "blood type": ("personal", ("blood type",)),
    "home address / phone": ("personal", ("home phone", "home address")),
}
#: What each bare value holds: where in it, how long, what, and where it is withheld.
HOLDS = {"123-45-6789": (0, 11, "social security number", "body membership personal"), "AB1234563 on file": (0, 9, "DEA number", "personal"), "born 3 May 1971": (0, 15, "date of birth", "body membership personal"), "J-1 visa": (0, 8, "visa / immigration status", "body membership personal"), "x.y@example.org": (0, 15, "third-party contact", "personal"), "212-555-0100": (0, 12, "third-party contact", "personal"), "10.0.0.1": (0, 8, "network address", "body membership personal")}
_quoted = lambda x: "'" + x.replace("'", "''") + "'"
_meaning = "CASE lower(label) " + " ".join(f"WHEN {_quoted(x)} THEN {_quoted(c + '#' + s)}" for c, (s, xs) in MEANS.items() for x in xs) + " END"
_holding = lambda v: f"CASE {v} " + " ".join(f"WHEN {_quoted(x)} THEN {{'ofs': {a}, 'n': {n}, 'means': {_quoted(c + '#' + s)}}}" for x, (a, n, c, s) in HOLDS.items()) + " END"
LINES = f"""SELECT c_custkey, 'Name: ' || c_name || sep || label || colon || ' ' || v1 || sep || 'see ' || v2 AS text, section, label, v1, v2, sep, length('Name: ' || c_name || sep) AS at1, length(label || colon || ' ') AS n, length('Name: ' || c_name || sep || label || colon || ' ' || v1 || sep || 'see ') AS at2
FROM (SELECT *, {_sql(LABEL_TEXTS)}[c_custkey % {len(LABEL_TEXTS)} + 1] AS label, CASE WHEN c_custkey % 7 = 0 THEN ' :' ELSE ':' END AS colon, {_sql(VALUES)}[(c_custkey // 3) % {len(VALUES)} + 1] AS v1, {_sql(VALUES)}[(c_custkey // 5) % {len(VALUES)} + 1] AS v2,
  {_sql(SEPARATORS)}[(c_custkey // 41) % {len(SEPARATORS)} + 1] AS sep, {_sql(SECTIONS)}[(c_custkey // 11) % {len(SECTIONS)} + 1] AS section FROM customer)"""
#: A labelled value reaches to the separator (a bar's and a clause's own blank apart), and begins with the blank that follows the separator before it.
FOUND = f"""SELECT c_custkey, text, section, s.start, s."end", string_split(s.means, '#')[1] AS category FROM (
SELECT *, unnest([CASE WHEN named THEN {{'start': at1 - CASE WHEN sep IN (' | ', '; ', '   ') THEN lead ELSE 0 END, 'end': at1 + n + length(v1) + CASE WHEN sep = ' | ' THEN 1 WHEN sep = '   ' AND v1 = '' THEN -1 ELSE 0 END, 'means': meaning}} END,
  CASE WHEN NOT named AND h1 IS NOT NULL THEN {{'start': at1 + n + h1.ofs, 'end': at1 + n + h1.ofs + h1.n, 'means': h1.means}} END, CASE WHEN h2 IS NOT NULL THEN {{'start': at2 + h2.ofs, 'end': at2 + h2.ofs + h2.n, 'means': h2.means}} END]) AS s
FROM (SELECT *, coalesce(list_contains(string_split(string_split(meaning, '#')[2], ' '), section), false) AS named, CASE WHEN sep IN (' | ', '; ') THEN 1 ELSE 0 END AS lead FROM (SELECT *, {_meaning} AS meaning, {_holding('v1')} AS h1, {_holding('v2')} AS h2 FROM ({LINES})))) WHERE s IS NOT NULL AND list_contains(string_split(string_split(s.means, '#')[2], ' '), section)"""


def _spans(spark, d):
    return _lines(spark, d).withColumn("spans", P.spans(F.col("text"), F.col("section")))


@query(f'SELECT c_custkey, start::INTEGER AS start, "end"::INTEGER AS "end", category FROM ({FOUND})')
def protected_spans(spark, d):
    """All categories and all of their places."""
    return _spans(spark, d).select("c_custkey", F.explode("spans").alias("s")).select("c_custkey", "s.*")


@query(f"""SELECT c_custkey, any_value(CASE WHEN s2 IS NULL THEN text[:s1.start] || text[s1."end" + 1:] ELSE text[:s1.start] || text[s1."end" + 1:s2.start] || text[s2."end" + 1:] END) AS text, any_value(names) AS notice FROM (
SELECT c_custkey, text, list({{'start': start, 'end': "end"}} ORDER BY start)[1] AS s1, list({{'start': start, 'end': "end"}} ORDER BY start)[2] AS s2, string_agg(DISTINCT category, '; ' ORDER BY category) AS names FROM ({FOUND}) GROUP BY c_custkey, text) GROUP BY c_custkey""")
def protected_withheld(spark, d):
    """What is left of a line, and which categories the notice names."""
    return _spans(spark, d).filter(F.size("spans") > 0).select("c_custkey", P.withheld(F.col("text"), F.col("spans")).alias("text"), P.notice(F.col("spans")).alias("notice"))


@query(f"SELECT section, category, count(*) AS spans, count(DISTINCT c_custkey) AS lines FROM ({FOUND}) GROUP BY ALL")
def protected_by_category(spark, d):
    found = _spans(spark, d).select("c_custkey", "section", F.explode("spans").alias("s"))
    return found.groupBy("section", F.col("s.category").alias("category")).agg(F.count(F.lit(1)).alias("spans"), F.countDistinct("c_custkey").alias("lines"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[\w.+-]+@[\w-]+(\.[\w-]+)+')) AS addresses FROM documents WHERE regexp_matches(text, '[\w.+-]+@[\w-]+(\.[\w-]+)+')""")
def protected_in_documents(spark, d):
    """Every e-mail address of every whole document, by the same policy; others' contact data are withheld in personal sections."""
    spans = P.spans(F.col("text"), F.lit("personal"))
    n = lambda s: F.size(F.filter(s, lambda x: (x["category"] == "third-party contact"))).cast("long")
    at = table(spark, d, "documents").filter(F.contains("text", F.lit("@"))).select("doc_id", "text", spans.alias("spans"))
    mail = F.size(F.filter("spans", lambda x: F.contains(F.substr("text", x["start"] + 1, x["end"] - x["start"]), F.lit("@")))).cast("long")
    return at.filter(n(F.col("spans")) > 0).select("doc_id", mail.alias("addresses")).filter("addresses > 0")
