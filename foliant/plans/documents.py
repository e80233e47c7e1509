"""Document queries: segmentation, text, duplicates, checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.functions import text as T
from foliant.functions.scores import clamp_confidence
from foliant.operators import dedup, lints, segment
from foliant.sources.tables import table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


LINES = "SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM documents"
KEYWORDS = "education|degrees|training|academic background|qualifications|positions|appointments|employment|experience|publications|articles|papers|manuscripts|peer-reviewed|chapters|books|abstracts|proceedings|bibliography|scholarly works|grants|funding|research support|grant support|contracts|teaching|courses|instruction|lectures|curriculum|mentoring|mentorship|supervision|advisees|students supervised|theses supervised|graduate students|postdoctoral|trainees|presentations|talks|seminars|symposia|keynote|service|committees|leadership|editorial|review|awards|honors|recognition|prizes|fellowships|affiliations|memberships|societies|research|patents|intellectual property|inventions|media|press|outreach|public engagement|clinical|licensure|certifications|skills|languages|references|personal|contact|workshop|participation|travel"
REJECTS = r"\b\d{4}\s*[-–]\s*(\d{4}|present)\b|\b\d{1,2}/\d{1,2}/\d{2,4}\b|\b(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\s+\d{4}\b|\(\d{4}\)|\bet\s+al\.|\bpp?\.\s*\d+|\bvol\.\s*\d+|\bdoi:|\bpmid:"
HEADERS = f"""
SELECT doc_id, idx, line, CASE WHEN length(t) > 100 OR regexp_matches(lower(t), '{REJECTS}') OR n = 0 THEN 0 ELSE least(10,
  CASE WHEN kw THEN 4 ELSE 0 END + CASE WHEN upper(t) = t AND lower(t) <> t AND length(t) > 3 THEN 3 ELSE 0 END
  + CASE WHEN n <= 6 AND list_bool_and(list_transform(words, lambda w: upper(w[1]) = w[1] AND lower(w[1]) <> w[1])) THEN 2 ELSE 0 END
  + CASE WHEN ends_with(t, ':') THEN 1 ELSE 0 END + CASE WHEN n BETWEEN 1 AND 5 THEN 1 ELSE 0 END + CASE WHEN kw AND n <= 2 THEN 2 ELSE 0 END) END AS tenths
FROM (SELECT *, len(words) AS n FROM (SELECT *, list_filter(regexp_split_to_array(t, '\\s+'), lambda x: x <> '') AS words, regexp_matches(lower(t), '{KEYWORDS}') AS kw FROM (SELECT *, trim(line, ' ') AS t FROM ({LINES}))))"""
COLLAPSE = r"trim(regexp_replace(lower({}), '[ \t\n\r]+', ' ', 'g'), ' ')"
KEY = r"regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_]', '', 'g')"


@query(f"SELECT doc_id, idx, line, length(line) AS n_chars FROM ({LINES})")
def doc_lines(spark, d):
    return segment.lines(table(spark, d, "documents")).withColumn("n_chars", F.length("line"))


@query(f"SELECT tenths, count(*) AS n, sum(length(line)) AS n_chars FROM ({HEADERS}) GROUP BY tenths")
def header_score(spark, d):
    return segment.scored_lines(table(spark, d, "documents")).groupBy("tenths").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("line")).alias("n_chars"))


@query(f"""SELECT doc_id, section, min(idx) AS start_idx, max(idx) AS end_idx, count(*) AS n_lines, max(CASE WHEN tenths >= 4 THEN line END) AS header
FROM (SELECT *, sum(CASE WHEN tenths >= 4 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY idx)::BIGINT AS section FROM ({HEADERS})) GROUP BY doc_id, section""")
def section_intervals(spark, d):
    return segment.sections(table(spark, d, "documents"))


@query(f"SELECT doc_id, idx // 15 AS batch, count(*) AS n_lines, min(idx) AS first_idx, sum(length(line)) AS n_chars FROM ({LINES}) GROUP BY 1, 2")
def batches_of_15(spark, d):
    return segment.batches(table(spark, d, "documents"))


@query(f"SELECT doc_id, {COLLAPSE.format('line')} AS key, min(idx) AS idx, count(*) AS n FROM ({LINES}) WHERE {COLLAPSE.format('line')} <> '' GROUP BY 1, 2")
def noise_filter(spark, d):
    return segment.without_noise(table(spark, d, "documents"))


HEADINGS = r"""SELECT page_id, ord, regexp_extract(tag, '^<h([1-6])', 1)::INT AS level, regexp_extract(tag, '>([^<]*)$', 1) AS title
FROM (SELECT page_id, unnest(t) AS tag, generate_subscripts(t, 1) - 1 AS ord FROM (SELECT page_id, regexp_extract_all(html, '<h[1-6][^>]*>[^<]*') AS t FROM pages))"""


@query(HEADINGS)
def html_headings(spark, d):
    return segment.headings(table(spark, d, "pages"))


@query(f"""SELECT page_id, ord, level, concat_ws(' > ', CASE WHEN level >= 1 THEN h1 END, CASE WHEN level >= 2 THEN h2 END, CASE WHEN level >= 3 THEN h3 END) AS path FROM (
SELECT *, {', '.join(f"last_value(CASE WHEN level = {k} THEN title END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY ord) AS h{k}" for k in (1, 2, 3))} FROM ({HEADINGS}))""")
def section_paths(spark, d):
    return segment.heading_paths(table(spark, d, "pages"))


@query(f"SELECT doc_id, {COLLAPSE.format('text')} AS norm FROM documents")
def norm_text(spark, d):
    return table(spark, d, "documents").select("doc_id", T.collapse(F.col("text")).alias("norm"))


STOPS = "'a', 'an', 'and', 'as', 'at', 'be', 'by', 'for', 'from', 'i', 'in', 'is', 'it', 'of', 'on', 'or', 'the', 'to', 'was', 'with'"


@query(f"SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({STOPS})))) AS words FROM documents")
def significant_words(spark, d):
    return table(spark, d, "documents").select("doc_id", T.significant_words(F.col("text")).alias("words"))


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{T.EMAIL}')) AS emails, len(regexp_extract_all(text, '{T.IPV4}')) AS addresses, len(regexp_extract_all(text, '{T.YEAR}')) AS years FROM documents")
def pattern_counts(spark, d):
    n = lambda p: F.regexp_count("text", F.lit(p))
    return table(spark, d, "documents").select("doc_id", n(T.EMAIL).alias("emails"), n(T.IPV4).alias("addresses"), n(T.YEAR).alias("years"))


_masked = "text"
for _p, _m in ((T.EMAIL, "[EMAIL]"), (T.IDENTIFIER, "[ID]"), (T.PHONE, "[PHONE]"), (T.IPV4, "[IP]")):
    _masked = f"regexp_replace({_masked}, '{_p}', '{_m}', 'g')"


@query(f"SELECT doc_id, {_masked} AS text FROM documents")
def pii_redact(spark, d):
    return table(spark, d, "documents").select("doc_id", T.redact(F.col("text")).alias("text"))


@query(f"SELECT lang, count(*) FILTER (regexp_matches(text, '{T.EMAIL}')) AS with_email, count(*) FILTER (regexp_matches(text, '{T.IPV4}')) AS with_address, count(*) FILTER (regexp_matches(text, '{T.PHONE}')) AS with_phone FROM documents GROUP BY lang")
def pii_category_counts(spark, d):
    has = lambda p: F.count_if(F.col("text").rlike(p))
    return table(spark, d, "documents").groupBy("lang").agg(has(T.EMAIL).alias("with_email"), has(T.IPV4).alias("with_address"), has(T.PHONE).alias("with_phone"))


@query(f"SELECT doc_id, idx, CASE WHEN regexp_matches(line, '^[=+@\\t\\r-]') THEN '''' || line ELSE line END AS cell FROM ({LINES})")
def csv_sanitize(spark, d):
    return segment.lines(table(spark, d, "documents")).select("doc_id", "idx", T.csv_guard(F.col("line")).alias("cell"))


@query(f"""WITH k AS (SELECT doc_id, {KEY.format('text')} AS key FROM documents WHERE length(text) >= 20),
f AS (SELECT key, min(doc_id) AS first_id FROM k WHERE key <> '' GROUP BY key) SELECT doc_id, first_id FROM k JOIN f USING (key) WHERE doc_id <> first_id""")
def exact_dup_docs(spark, d):
    return dedup.exact_duplicates(table(spark, d, "documents"))


@query(f"SELECT {COLLAPSE.format('line')} AS key, count(*) AS n, count(DISTINCT doc_id) AS docs, min(doc_id) AS first_doc FROM ({LINES}) WHERE length({COLLAPSE.format('line')}) > 0 GROUP BY 1 HAVING count(*) > 1")
def repeated_lines(spark, d):
    key = T.collapse(F.col("line"))
    return segment.lines(table(spark, d, "documents")).filter(F.length(key) > 0).groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"), F.min("doc_id").alias("first_doc")).filter("n > 1")


SETS = f"list_sort(list_distinct(list_filter(regexp_extract_all(lower({{}}), '[a-z0-9]+'), lambda w: length(w) > 1 AND w NOT IN ({STOPS}))))"
NEAR = f"""WITH s AS (SELECT p_partkey AS id, p_brand || p_size AS g, {SETS.format('p_name')} AS w FROM part), p AS (
SELECT a.g, a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS k, len(a.w) AS na, len(b.w) AS nb FROM s a JOIN s b ON a.g = b.g AND a.id < b.id)
SELECT g, a, b, round(k / (na + nb - k), 6) AS jaccard, round(k / least(na, nb), 6) AS containment FROM p WHERE k > 0 AND (k / (na + nb - k) >= 0.6 OR k / least(na, nb) >= 0.75)"""


def _parts(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.concat("p_brand", "p_size").alias("g"), "p_name")


@query(NEAR)
def near_dup_pairs(spark, d):
    return dedup.near_pairs(_parts(spark, d), "id", "g", "p_name")


@query(f"""SELECT g, unnest(gone) AS dropped FROM (SELECT g, list_reduce(list_prepend({{'a': 0, 'b': 0, 'd': false, 'gone': []::BIGINT[]}}, list({{'a': a, 'b': b, 'd': length(pa.p_name) >= length(pb.p_name), 'gone': []::BIGINT[]}} ORDER BY a, b)),
  lambda x, y: {{'a': 0, 'b': 0, 'd': false, 'gone': CASE WHEN list_contains(x.gone, y.a) OR list_contains(x.gone, y.b) THEN x.gone ELSE list_append(x.gone, CASE WHEN y.d THEN y.b ELSE y.a END) END}}).gone AS gone
FROM ({NEAR}) JOIN part pa ON pa.p_partkey = a JOIN part pb ON pb.p_partkey = b GROUP BY g)""")
def greedy_dedup(spark, d):
    return dedup.greedy_near(_parts(spark, d), "id", "g", "p_name")


_docs_titles = "string_split(text, chr(10))[1]"
BEST = f"""WITH a AS (SELECT doc_id AS id, {SETS.format(_docs_titles)} AS w FROM documents), b AS (SELECT item_id, {SETS.format(_docs_titles)} AS v FROM benchmark),
s AS (SELECT id, item_id, len(list_intersect(w, v)) / least(len(w), len(v)) AS overlap FROM a, b WHERE len(w) >= 4 AND len(v) >= 4)
SELECT id, arg_max(item_id, (overlap, -item_id)) AS item_id, round(max(overlap), 6) AS overlap, max(overlap) >= 0.8 AS by_title FROM s WHERE overlap >= 0.4 GROUP BY id"""


def _best(spark, d):
    title = F.split("text", "\n").getItem(0).alias("title")
    return dedup.best_overlap(table(spark, d, "documents").select(F.col("doc_id").alias("id"), title), table(spark, d, "benchmark").select("item_id", title), 0.4)


@query(BEST)
def title_overlap_best_match(spark, d):
    """0.4 is enough where an identifier led to the item, 0.8 where its title did."""
    return _best(spark, d).withColumn("by_title", F.col("overlap") >= 0.8)


@query(f"""WITH m AS ({BEST}), r AS (SELECT *, rank() OVER (PARTITION BY item_id ORDER BY overlap DESC) AS k FROM m)
SELECT id, item_id, overlap, k = 1 AND count(*) FILTER (k = 1) OVER (PARTITION BY item_id) = 1 AS kept FROM r""")
def one_to_one_release(spark, d):
    return dedup.strongest_only(_best(spark, d))


@query(f"""SELECT item_id, idx, line FROM (SELECT item_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS idx FROM benchmark) b
WHERE NOT EXISTS (SELECT 1 FROM ({LINES}) l WHERE {KEY.format('l.line')} = {KEY.format('b.line')})""")
def lost_line_antijoin(spark, d):
    items = table(spark, d, "benchmark").select("item_id", F.posexplode(F.split("text", "\n", -1)).alias("idx", "line"))
    have = segment.lines(table(spark, d, "documents")).select(T.dedupe_key(F.col("line")).alias("k"))
    return items.withColumn("k", T.dedupe_key(F.col("line"))).join(have, "k", "left_anti").select("item_id", "idx", "line")


@query("""SELECT doc_id, CASE WHEN regexp_matches(text, '[|]') THEN 'table' WHEN regexp_matches(text, '[#$%&*]{3}') THEN 'noise' WHEN regexp_matches(lower(text), 'licen[cs]e') THEN 'license'
WHEN length(text) < 80 THEN 'short' ELSE 'prose' END AS code FROM documents""")
def rule_classify(spark, d):
    t = F.col("text")
    code = F.when(t.rlike("[|]"), "table").when(t.rlike("[#$%&*]{3}"), "noise").when(F.lower(t).rlike("licen[cs]e"), "license").when(F.length(t) < 80, "short").otherwise("prose")
    return table(spark, d, "documents").select("doc_id", code.alias("code"))


@query(f"SELECT code, count(*) AS n FROM ({ORACLE['rule_classify']}) GROUP BY code ORDER BY n DESC, code LIMIT 10")
def code_distribution_top10(spark, d):
    return rule_classify(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code").limit(10)


@query("SELECT event_id, CASE WHEN x IS NULL OR isnan(x) THEN 0.0 ELSE greatest(0.0, least(1.0, x)) END AS confidence FROM (SELECT event_id, try_cast(json_extract_string(props, '$.k') AS DOUBLE) / 50 AS x FROM events)")
def confidence_clamp(spark, d):
    return table(spark, d, "events").select("event_id", clamp_confidence((F.get_json_object("props", "$.k").try_cast("double") / 50).cast("string")).alias("confidence"))


SHORTS = f"SELECT doc_id, idx, line, length(line) < 30 AS frag FROM ({LINES}) WHERE length(trim(line, ' ')) > 0"


@query(f"""SELECT doc_id, idx, up, down, CASE WHEN down IS NULL OR idx - up <= down - idx THEN up ELSE down END AS parent FROM (
SELECT *, last_value(CASE WHEN NOT frag THEN idx END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS up,
first_value(CASE WHEN NOT frag THEN idx END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS down FROM ({SHORTS})) WHERE frag""")
def fragment_parent(spark, d):
    """Short lines and the nearest full line, the one above at equal distance."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("idx")
    rows = segment.lines(table(spark, d, "documents")).filter(F.length(F.trim("line")) > 0).withColumn("frag", F.length("line") < 30)
    full = F.when(~F.col("frag"), F.col("idx"))
    at = rows.withColumn("up", F.last(full, True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("down", F.first(full, True).over(w.rowsBetween(1, Window.unboundedFollowing)))
    parent = F.when(F.col("down").isNull() | (F.col("idx") - F.col("up") <= F.col("down") - F.col("idx")), F.col("up")).otherwise(F.col("down"))
    return at.filter("frag").select("doc_id", "idx", "up", "down", parent.alias("parent"))


_n = lambda p: f"len(regexp_extract_all(text, '{p}'))"
_one = lambda c: f"CASE WHEN {c} THEN 1 ELSE 0 END"
LETTERS, UPPER = "length(regexp_replace(text, '[^A-Za-z]', '', 'g'))", "length(regexp_replace(text, '[^A-Z]', '', 'g'))"
CHECK_SQL = (
    ("protected_data", "ERROR", f"len(regexp_extract_all(text, '{T.EMAIL}')) + len(regexp_extract_all(text, '{T.IPV4}'))"), ("shouting", "WARN", _one(f"{LETTERS} >= 20 AND {UPPER} * 2 > {LETTERS}")), ("short_record", "INFO", _one("length(text) < 80")),
    ("date_only_lines", "WARN", _n(r"(?m)^ *(?:[0-9]{1,2}/)?(?:19|20)[0-9]{2} *(?:[-–] *(?:(?:19|20)[0-9]{2}|[Pp]resent) *)?$")), ("pipe_leaks", "WARN", _n("(?m)^.*[|].*[|].*$")), ("output_hygiene", "WARN", _n(r"\[[A-Z][0-9]{0,2}[A-Z]?\]")),
    ("python_repr_in_output", "WARN", _n(r"\{''[A-Za-z_]+'': |\[''")), ("llm_refusal_in_output", "WARN", _n("(?i)as an ai |i cannot (?:help|assist)|please provide (?:the|more)")), ("glyph_field", "WARN", _n(r"(?m)^[^A-Za-z0-9\s\x80-\x{10FFFF}]{1,3}$")),
    ("footer_in_record", "WARN", _n(r"(?i)\bpage [0-9]+(?: of [0-9]+)?\b")), ("etal_added", "WARN", _n(r"\bet al\.")), ("implausible_year", "WARN", _n(r"\b(?:1[0-8][0-9]{2}|20[4-9][0-9]|2[1-9][0-9]{2})\b")), ("journal_name_joined", "WARN", _n(r"\t")),
    ("shattered_prose", "WARN", _n(r"[a-z]\n[a-z]")), ("header_consumed_record", "WARN", _n("(?m)^[A-Z][A-Z ]{3,40}: [^ ]")), ("open_end_unsupported", "WARN", _n("-Present")), ("appointment_title_overlong", "INFO", _n("(?m)^.{301}")),
    ("pubmed_title_truncated", "INFO", _one(r"regexp_matches(text, '[A-Za-z]\s*\z')")), ("segmentation_collapse", "INFO", _one("length(text) > 2000 AND NOT contains(text, chr(10))")), ("licence_line", "INFO", _n("(?i)licen[cs]e")), ("bucket_status", "INFO", _n(r"(?i)\bstatus: *(?:pending|submitted)")),
)
FINDINGS = f"""
SELECT doc_id, 'duplicate_records' AS lint, 'WARN' AS severity, 1::BIGINT AS n FROM ({ORACLE['exact_dup_docs']})
UNION ALL SELECT doc_id, 'repeated_lines', 'WARN', sum(n)::BIGINT FROM ({ORACLE['noise_filter']}) WHERE n > 1 GROUP BY doc_id
UNION ALL """ + "\nUNION ALL ".join(f"SELECT doc_id, '{k}', '{s}', n::BIGINT FROM (SELECT doc_id, {e} AS n FROM documents) WHERE n > 0" for k, s, e in CHECK_SQL)


@query(FINDINGS)
def lint_findings(spark, d):
    return lints.findings(table(spark, d, "documents"))


PREVALENCE = f"""SELECT lint, docs, hits, round(share, 6) AS share, round(log2(1 / greatest(share, 0.001)), 6) AS surprise FROM (
SELECT lint, count(*) AS docs, sum(n)::BIGINT AS hits, count(*) / (SELECT count(*) FROM documents) AS share FROM ({FINDINGS}) GROUP BY lint)"""


@query(PREVALENCE)
def lint_prevalence(spark, d):
    docs = table(spark, d, "documents")
    return lints.prevalence(lints.findings(docs), docs)


@query(f"SELECT lint, row_number() OVER (ORDER BY surprise DESC, docs DESC, lint) AS place FROM ({PREVALENCE})")
def lint_surprise_rank(spark, d):
    from pyspark.sql import Window

    return lint_prevalence(spark, d).select("lint", F.row_number().over(Window.orderBy(F.desc("surprise"), F.desc("docs"), "lint")).cast("long").alias("place"))


PRICE = "CASE WHEN lint = 'protected_data' OR lint = 'llm_refusal_in_output' THEN 2.0 WHEN lint IN ('duplicate_records', 'python_repr_in_output', 'shattered_prose', 'header_consumed_record', 'segmentation_collapse') THEN 1.0 WHEN lint IN ('short_record', 'glyph_field', 'footer_in_record', 'appointment_title_overlong', 'pubmed_title_truncated', 'licence_line', 'bucket_status') THEN 0.25 ELSE 0.5 END"


@query(f"SELECT lint, sum(0.5 * ({PRICE})) AS minutes, count(*) AS docs FROM ({FINDINGS}) WHERE severity <> 'INFO' GROUP BY lint")
def cleanup_minutes(spark, d):
    return lints.findings(table(spark, d, "documents")).filter("severity <> 'INFO'").groupBy("lint").agg(F.sum(0.5 * lints.price()).alias("minutes"), F.count(F.lit(1)).alias("docs"))


@query(f"""WITH c AS (SELECT doc_id, sum(0.5 * ({PRICE})) AS minutes, bool_or(lint = 'protected_data') AS leak FROM ({FINDINGS}) WHERE severity <> 'INFO' GROUP BY doc_id),
s AS (SELECT source, count(*) AS n, coalesce(sum(minutes), 0.0) AS minutes, count(*) FILTER (leak) AS leaks, count(*) FILTER (coalesce(length(text), 0) = 0) AS empty FROM documents LEFT JOIN c USING (doc_id) GROUP BY source),
q AS (SELECT *, round_even(greatest(0.0, least(100 - 40 * (minutes::DOUBLE / n) / (minutes::DOUBLE / n + 0.02 * (40 - 15) / 15), CASE WHEN empty = n THEN 20.0 ELSE 100.0 END, CASE WHEN leaks * 20 > n THEN 25.0 ELSE 100.0 END, CASE WHEN n < 2 THEN 84.0 ELSE 100.0 END)), 0) AS score FROM s)
SELECT source, n, minutes, leaks, score, CASE WHEN score >= 85 THEN 'green' WHEN score >= 60 THEN 'yellow' ELSE 'red' END AS band FROM q""")
def quality_band(spark, d):
    return lints.scores(table(spark, d, "documents"))


@query(f"""SELECT lint, count(*) AS hits, count(quality) AS judged, count(*) FILTER (quality = 0) AS tp, CASE WHEN count(quality) > 0 THEN round(count(*) FILTER (quality = 0) / count(quality), 6) END AS prec
FROM ({FINDINGS}) LEFT JOIN labels USING (doc_id) GROUP BY lint""")
def precision_ledger(spark, d):
    out = lints.findings(table(spark, d, "documents")).join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left").groupBy("lint").agg(F.count(F.lit(1)).alias("hits"), F.count("quality").alias("judged"), F.count_if(F.col("quality") == 0).alias("tp"))
    return out.withColumn("prec", F.when(F.col("judged") > 0, F.round(F.col("tp") / F.col("judged"), 6)))


@query(f"""WITH f AS ({FINDINGS}), a AS (SELECT lint, n, count(*) AS c FROM f WHERE doc_id % 2 = 0 GROUP BY 1, 2), b AS (SELECT lint, n, count(*) AS c FROM f WHERE doc_id % 2 = 1 GROUP BY 1, 2)
SELECT lint, sum(coalesce(a.c, 0))::BIGINT AS delivered, sum(coalesce(b.c, 0))::BIGINT AS corrected, sum(least(coalesce(a.c, 0), coalesce(b.c, 0)))::BIGINT AS persisting FROM a FULL JOIN b USING (lint, n) GROUP BY lint""")
def doctor_compare(spark, d):
    """Two reports (here of even and odd ids, as a stand-in for two deliveries) by equal messages."""
    f = lints.findings(table(spark, d, "documents"))
    side = lambda k, name: f.filter(F.col("doc_id") % 2 == k).groupBy("lint", "n").agg(F.count(F.lit(1)).alias(name))
    both = side(0, "a").join(side(1, "b"), ["lint", "n"], "full").na.fill(0, ["a", "b"])
    return both.groupBy("lint").agg(F.sum("a").alias("delivered"), F.sum("b").alias("corrected"), F.sum(F.least("a", "b")).alias("persisting"))


@query("SELECT lint, status, count(*) AS docs FROM (SELECT unnest(["+ ", ".join(f"'{k}'" for k, _, _ in (("repeated_lines", "", ""), *CHECK_SQL)) + "]) AS lint, CASE WHEN text IS NULL THEN 'skipped' ELSE 'ran' END AS status FROM documents) GROUP BY ALL")
def lint_status(spark, d):
    """Documents that each check ran on, and those that it had to skip."""
    return lints.status(table(spark, d, "documents"))
