"""Text, name and redaction queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import protected as P
from foliant.functions import text as T
from foliant.operators import segment
from foliant.plans.registry import registry
from foliant.sources.entries import ENTRIES, entries
from foliant.sources.tables import table

QUERIES, ORACLE, query = registry()

LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents"


@query("SELECT doc_id, strip_accents(text) AS folded FROM documents")
def accent_fold(spark, d):
    return table(spark, d, "documents").select("doc_id", T.accent_fold(F.col("text")).alias("folded"))


QUOTED = "'“' || replace(text, ',', '’') || '„'"


@query("SELECT item_id, '\"' || replace(text, ',', '''') || '\"' AS folded FROM benchmark")
def quote_fold(spark, d):
    curly = F.concat(F.lit("“"), F.regexp_replace("text", ",", "’"), F.lit("„"))
    return table(spark, d, "benchmark").select("item_id", T.quote_fold(curly).alias("folded"))


@query(r"SELECT doc_id, lower(regexp_replace(coalesce(text, ''), '[\s\x{00a0}\x{2000}-\x{200a}\x{202f}\x{3000}]+', '', 'g')) AS squashed FROM documents")
def squash(spark, d):
    return table(spark, d, "documents").select("doc_id", T.squash(F.col("text")).alias("squashed"))


@query(rf"SELECT doc_id, idx, trim(regexp_replace(regexp_replace(lower(line), '[^\p{{L}}\p{{N}}\s]', ' ', 'g'), '\s+', ' ', 'g'), ' ') AS key FROM ({LINES}) WHERE length(line) <= 60")
def header_normalise(spark, d):
    return segment.lines(table(spark, d, "documents")).filter(F.length("line") <= 60).select("doc_id", "idx", T.header_key(F.col("line")).alias("key"))


MATCHED = "SELECT entry_id, title, CASE entry_id % 4 WHEN 0 THEN upper(title) || '!' WHEN 1 THEN title || ' - continued' WHEN 2 THEN title || ' and more' ELSE '  ' || title END AS line FROM " + ENTRIES


def _headed(spark, d):
    k, t = F.col("entry_id") % 4, F.col("title")
    line = F.when(k == 0, F.concat(F.upper(t), F.lit("!"))).when(k == 1, F.concat(t, F.lit(" - continued"))).when(k == 2, F.concat(t, F.lit(" and more"))).otherwise(F.concat(F.lit("  "), t))
    return entries(spark, d).select("entry_id", "title", line.alias("line"))


@query(f"SELECT entry_id, entry_id % 4 IN (0, 3) AS strict, entry_id % 4 <> 2 AS loose FROM ({MATCHED})")
def header_match(spark, d):
    return _headed(spark, d).select("entry_id", T.header_match(F.col("title"), F.col("line"), True).alias("strict"), T.header_match(F.col("title"), F.col("line")).alias("loose"))


@query(f"SELECT entry_id, title AS label, dates AS rest FROM {ENTRIES} WHERE NOT contains(title, ',')")
def run_in_split(spark, d):
    line = F.concat(F.col("title"), F.lit(":  "), F.col("dates"))
    r = T.run_in(line)
    return entries(spark, d).select("entry_id", r["label"].alias("label"), r["rest"].alias("rest")).filter("label is not null")


WORDS = "string_split(regexp_replace(title, ',', '', 'g'), ' ')"


@query(f"SELECT entry_id, CASE entry_id % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE len(w) = 2 END AS is_run FROM (SELECT *, {WORDS} AS w FROM {ENTRIES})")
def ordered_word_run(spark, d):
    """The last two words of a title are a run of it; the first and the last of three or more aren't, in either order."""
    w, k = F.split(F.regexp_replace("title", ",", ""), " "), F.col("entry_id") % 3
    first, last = w[0], F.element_at(w, -1)
    short = F.when(k == 0, F.slice(w, -2, 2)).when(k == 1, F.array(last, first)).otherwise(F.array(first, last))
    return entries(spark, d).select("entry_id", T.is_word_run(short, w).alias("is_run"))


@query(f"""SELECT entry_id, regexp_full_match(array_to_string({WORDS}, ' '), '(.* )?' || s[1] || '( .* | )' || s[2] || '( .*)?') AS found FROM (SELECT *, CASE entry_id % 3 WHEN 0 THEN [{WORDS}[1], {WORDS}[3]] WHEN 1 THEN [{WORDS}[3], {WORDS}[1]] ELSE [{WORDS}[2], 'Nothing'] END AS s FROM {ENTRIES})""")
def subsequence(spark, d):
    w = F.split(F.regexp_replace("title", ",", ""), " ")
    k = F.col("entry_id") % 3
    short = F.when(k == 0, F.array(w[0], w[2])).when(k == 1, F.array(w[2], w[0])).otherwise(F.array(w[1], F.lit("Nothing")))
    return entries(spark, d).select("entry_id", T.is_subsequence(short, w).alias("found"))


@query("""SELECT a.c_custkey AS a, b.c_custkey AS b, levenshtein(a.c_name, b.c_name) <= 1 AS one_edit, levenshtein(a.c_name, b.c_name) <= 2 AS two_edits, damerau_levenshtein(a.c_name, b.c_name) <= 1 AS one_slip
FROM customer a JOIN customer b ON b.c_custkey IN (a.c_custkey + 1, a.c_custkey + 9, a.c_custkey + 90, a.c_custkey + 111)""")
def edit_distances(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_name")
    a = c.select(F.col("c_custkey").alias("a"), F.col("c_name").alias("x"), F.explode(F.array(*(F.col("c_custkey") + n for n in (1, 9, 90, 111)))).alias("b"))
    pairs = a.join(c.select(F.col("c_custkey").alias("b"), F.col("c_name").alias("y")), "b")
    x, y = F.col("x"), F.col("y")
    return pairs.select("a", "b", T.edits_apart(x, y, 1).alias("one_edit"), T.edits_apart(x, y, 2).alias("two_edits"), T.slip_apart(x, y).alias("one_slip"))


NAMED = "SELECT p_partkey, string_split(p_name, ' ')[1] AS w, string_split(p_name, ' ')[2] AS v FROM part"
CAP = "upper({0}[1]) || {0}[2:]"


def _named(spark, d):
    w = F.split("p_name", " ")
    return table(spark, d, "part").select("p_partkey", F.initcap(w[0]).alias("w"), F.initcap(w[1]).alias("v"))


@query(f"SELECT p_partkey, v || ' ' || w[1] || 'J, ' || v || ' ' || w[1] || 'A, ' || v || ' B' AS authors FROM (SELECT p_partkey, {CAP.format('w')} AS w, {CAP.format('v')} AS v FROM ({NAMED}))")
def vancouver_authors(spark, d):
    """'Last, First J.; First Ann Last and Last B.'"""
    authors = F.concat("v", F.lit(", "), "w", F.lit(" J.; "), "w", F.lit(" Ann "), "v", F.lit(" and "), "v", F.lit(" B."))
    return _named(spark, d).select("p_partkey", T.vancouver_list(authors).alias("authors"))


@query(f"SELECT p_partkey, w[1] || v[1] AS dotted, w[1] || v[1] AS full_names, 'JA' AS kept FROM (SELECT p_partkey, {CAP.format('w')} AS w, {CAP.format('v')} AS v FROM ({NAMED}))")
def initials(spark, d):
    one = lambda c: F.substring(c, 1, 1)
    dotted, full = F.concat(one("w"), F.lit(". "), one("v"), F.lit(".")), F.concat_ws(" ", "w", "v")
    return _named(spark, d).select("p_partkey", T.initials(dotted).alias("dotted"), T.initials(full).alias("full_names"), T.initials(F.lit("J.A.")).alias("kept"))


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN v || ' ' || w[1] || ', ' || w || ' AB' ELSE v || ', ' || w[1] || ', ' || w END AS authors FROM (SELECT p_partkey, {CAP.format('w')} AS w, {CAP.format('v')} AS v FROM ({NAMED}))")
def author_pairs(spark, d):
    tokens = F.concat_ws(", ", "v", F.substring("w", 1, 1), "w", F.when(F.col("p_partkey") % 2 == 0, "AB"))
    return _named(spark, d).select("p_partkey", T.author_pairs(tokens).alias("authors"))


@query(f"SELECT entry_id, concat_ws('. ', CASE WHEN owner % 3 > 0 THEN 'Ring SJ' END, title, CASE WHEN owner % 2 > 0 THEN place END, concat_ws(':', CASE WHEN span > 0 THEN y || ';' || span ELSE y::VARCHAR END, CASE WHEN m > 6 THEN m || '-' || (m + d) END)) || '.' AS cite FROM {ENTRIES}")
def citation_format(spark, d):
    part = lambda c, v: F.when(c, v).otherwise(F.lit(" "))
    cite = T.citation(part(F.col("owner") % 3 > 0, F.lit("Ring SJ")), F.col("title"), part(F.col("owner") % 2 > 0, F.col("place")), F.col("y").cast("string"), part(F.col("span") > 0, F.col("span").cast("string")), part(F.col("m") > 6, F.concat_ws("-", F.col("m").cast("string"), (F.col("m") + F.col("d")).cast("string"))))
    return entries(spark, d).select("entry_id", cite.alias("cite"))


@query("SELECT item_id, replace(text, ', ', chr(9)) AS cells FROM benchmark")
def row_cell_join(spark, d):
    return table(spark, d, "benchmark").select("item_id", F.array_join(F.split("text", ", "), "\t").alias("cells"))


@query(f"SELECT entry_id, unnest(a) AS first_cell, unnest(b) AS second_cell, generate_subscripts(a, 1) - 1 AS ord FROM (SELECT entry_id, string_split(title, ' ') AS a, CASE WHEN entry_id % 2 = 0 THEN string_split(title, ' ') ELSE string_split(place, ' ') END AS b FROM {ENTRIES}) WHERE len(a) = len(b)")
def split_merged_cells(spark, d):
    """Parallel cells of several lines become rows; cells of different heights stay whole, and aren't listed."""
    rows = entries(spark, d).select("entry_id", F.split("title", " ").alias("a"), F.when(F.col("entry_id") % 2 == 0, F.split("title", " ")).otherwise(F.split("place", " ")).alias("b"))
    out = rows.filter(F.size("a") == F.size("b")).select("entry_id", F.posexplode(F.arrays_zip("a", "b")).alias("ord", "c"))
    return out.select("entry_id", F.col("c.a").alias("first_cell"), F.col("c.b").alias("second_cell"), "ord")


@query(f"SELECT entry_id, CASE entry_id % 3 WHEN 0 THEN title WHEN 1 THEN title || ' | ' || upper(title) || ' | ' || place ELSE title END AS content FROM {ENTRIES}")
def repeated_content_collapse(spark, d):
    k, t = F.col("entry_id") % 3, F.col("title")
    content = F.when(k == 0, F.concat_ws(" | ", t, F.upper(t), F.concat_ws("  ", t))).when(k == 1, F.concat_ws(" | ", t, F.upper(t), "place")).otherwise(t)
    return entries(spark, d).select("entry_id", T.collapse_repeats(content).alias("content"))


@query(r"SELECT doc_id, regexp_replace(regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '', 'g'), '\b([0-9]{1,3}\.){3}[0-9]{1,3}\b', '', 'g') AS text FROM documents WHERE regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}|\b([0-9]{1,3}\.){3}[0-9]{1,3}\b')")
def pii_spans_cut(spark, d):
    """Every address of either kind is cut by its place."""
    t = F.col("text")
    place = lambda s: F.transform(s, lambda x: F.struct(x["start"], x["end"]))
    rows = table(spark, d, "documents").select("doc_id", "text", F.concat(place(P.found(t, T.EMAIL)), place(P.found(t, T.IPV4))).alias("spans"))
    return rows.filter(F.size("spans") > 0).select("doc_id", T.cut_spans(t, F.col("spans")).alias("text"))


TOKEN = "chr(65 + (c_custkey % 26)::INT) || 'B' || lpad((c_custkey * 7919 % 10000000)::VARCHAR, 7, '0')"


@query(f"SELECT c_custkey, token, (token[3]::INT + token[5]::INT + token[7]::INT + 2 * (token[4]::INT + token[6]::INT + token[8]::INT)) % 10 = token[9]::INT AS ok FROM (SELECT c_custkey, {TOKEN} AS token FROM customer)")
def dea_check_digit(spark, d):
    k = F.col("c_custkey")
    token = F.concat(F.char(65 + k % 26), F.lit("B"), F.lpad((k * 7919 % 10_000_000).cast("string"), 7, "0"))
    return table(spark, d, "customer").select("c_custkey", token.alias("token")).withColumn("ok", T.dea_digit_ok(F.col("token")))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'ValueError' ELSE event_type || ': user ' || user_id END AS line FROM events")
def log_redaction(spark, d):
    line = F.when(F.col("event_type") == "error", F.concat(F.lit("ValueError: could not read "), F.col("props"))).otherwise(F.concat(F.col("event_type"), F.lit(": user "), F.col("user_id").cast("string")))
    return table(spark, d, "events").select("event_id", T.log_safe(line).alias("line"))


@query("SELECT r_name, CASE WHEN r_regionkey % 2 = 0 THEN 'model-a' ELSE 'user.model-a' END AS model FROM region")
def model_id_prefix(spark, d):
    m = F.when(F.col("r_regionkey") % 2 == 0, "us.model-a").otherwise("user.model-a")
    return table(spark, d, "region").select("r_name", T.model_name(m).alias("model"))


@query(f"SELECT entry_id, title || ', [abc] end' AS text FROM {ENTRIES}")
def taxonomy_leak_strip(spark, d):
    return entries(spark, d).select("entry_id", T.without_codes(F.concat(F.col("title"), F.lit(" ["), F.col("code"), F.lit("], [abc] end"))).alias("text"))


# Categories, the scope each holds in, and what tells them. Scopes: every section, or the personal ones.
POLICY = (
    ("social security number", "all", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("e-mail", "personal", T.EMAIL),
    ("network address", "all", T.IPV4),
    ("date of birth", "all", r"(?i)\b(date of birth|birth date|dob)\s*:"),
    ("marital status", "personal", r"(?i)\bmarital status\s*:"),
    ("home address / phone", "personal", T.PHONE),
)
PERSONAL = ("en", "de")


@query("SELECT doc_id, unnest(list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, '{p}'){'' if s == 'all' else ' AND lang IN ' + str(PERSONAL)} THEN '{c}' END" for c, s, p in POLICY) + "], lambda x: x IS NOT NULL)) AS category FROM documents")
def pii_policy_hits(spark, d):
    """The policy table over every document; the language stands for the section, and names the scope."""
    fires = [F.when(F.col("text").rlike(p) & (F.lit(True) if s == "all" else F.col("lang").isin(*PERSONAL)), c) for c, s, p in POLICY]
    return table(spark, d, "documents").select("doc_id", F.explode(F.array_compact(F.array(*fires))).alias("category"))


@query("WITH h AS (" + ORACLE["pii_policy_hits"] + ") SELECT doc_id, CASE WHEN n >= 2 THEN 'withheld' ELSE 'masked' END AS action, categories FROM (SELECT doc_id, count(*) AS n, string_agg(category, '; ' ORDER BY category) AS categories FROM h GROUP BY doc_id)")
def pii_pass(spark, d):
    """Entries with several categories are withheld whole; of others the value is masked. The notice lists the categories."""
    hits = pii_policy_hits(spark, d).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("category")), "; ").alias("categories"))
    return hits.select("doc_id", F.when(F.col("n") >= 2, "withheld").otherwise("masked").alias("action"), "categories")


@query(f"SELECT doc_id, coalesce(len(regexp_extract_all(text, '{T.EMAIL}')), 0) AS emails, coalesce(len(regexp_extract_all(text, '{T.PHONE}')), 0) AS phones FROM documents")
def email_phone_detect(spark, d):
    n = lambda p: F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).alias
    return table(spark, d, "documents").select("doc_id", n(T.EMAIL)("emails"), n(T.PHONE)("phones"))
