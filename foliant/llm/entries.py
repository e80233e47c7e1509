"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import os
import zlib

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, chat_format, decontaminate, divergence, line_dedup, near_dedup, periodic, quality_rules, quality_trees, recurrent_lm, secrets, token_store, toxicity
from foliant.llm.common import Scratch, cut, table

#: Where the public tokenizers' files are; never copied.
TOKENIZERS = os.environ.get("FOLIANT_TOKENIZERS") or os.path.dirname(public_tokenizers.path("word_bpe_49k.json"))

CONTROL = "\\### Assistant: </turn> ok"


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), near_dedup.NearDup(words=2))


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL).alias("text"))
    return chat_format.read_back(chat_format.expand(rows.unionByName(more)))


def op3_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as scratch:
        where = token_store.qualified(spark, scratch.path())
        cfg = token_store.TokenStore(f"{TOKENIZERS}/byte_bpe_50k.json")
        files = scratch.keep(token_store.write_tokens(table(spark, sf_dir, "documents"), where, cfg))
        return cut(token_store.read_tokens(files))


def op4_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_trees.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    out = found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/word_bpe_49k.json", ids=False)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judge(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", F.col("__n_lines").alias("n_lines"), F.col("__n_removed").alias("n_removed"), "text")


def planted_period(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's own repetition in every tenth document: from word a on, the words come round every p."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not words:
        return words
    g, n = h // 10, len(words)
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.detect(table(spark, sf_dir, "documents"), rewrite=planted_period)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recurrent_lm.fit_and_score(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_minhash_near_dedup, op2_chat_formatting, op3_token_binary, op4_secret_scan, op5_quality_classifier,
    op6_benchmark_decontamination, op7_bpe, op8_quality_rules, op9_line_dedup, op10_toxicity, op11_periodic_runs, op12_source_divergence,
    op13_lm_scoring,
)}

ORACLE = {
    "op2_chat_formatting": r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), w AS (
  SELECT *, row_number() OVER o AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(4 + length(role) + 2 + length(text) + 8
      + length(text) - length(replace(replace(replace(text, '\', ''), '<', ''), '#', ''))
      + length(role) - length(replace(replace(replace(replace(role, '\', ''), '<', ''), '#', ''), ':', ''))) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM t WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM w GROUP BY conv_id""",
    "op6_benchmark_decontamination": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), k AS (
  SELECT item_id, w, least(10, len(w)) AS k FROM bw WHERE len(w) > 0
), win AS (
  SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM k)
), ks AS (SELECT DISTINCT k FROM k
), hits AS (
  SELECT d.doc_id, d.i, d.k, win.item_id FROM (
    SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, ks)
  ) d JOIN win ON win.s = d.s AND win.k = d.k
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS names FROM hits GROUP BY doc_id
)
SELECT dw.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN covered USING (doc_id) LEFT JOIN named USING (doc_id)""",
    "op9_line_dedup": r"""
WITH l AS (
  SELECT doc_id, coalesce(source, '') AS site, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents
), b AS (
  SELECT trim(line, ' ') AS k, min((doc_id, pos)) AS first FROM l WHERE length(trim(line, ' ')) >= 20
  GROUP BY 1 HAVING count(DISTINCT site) >= 10
), k AS (
  SELECT l.doc_id, l.pos, l.line, b.k IS NOT NULL AND (l.doc_id, l.pos) <> b.first AS gone
  FROM l LEFT JOIN b ON b.k = trim(l.line, ' ')
), g AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone) AS text
  FROM k GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(g.text, '') END AS text
FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id""",
    "op11_periodic_runs": r"""
WITH h AS (
  SELECT row_number() OVER () AS id, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w, xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, 0, 0, 0, 0, 0, 0, 0]))),
    lambda a, v: xor(xor(a, v) >> 1, 3988292384 * (xor(a, v) & 1)))) AS h FROM documents
), g AS (
  SELECT *, len(w) AS n, h % 10 = 0 AND len(w) > 0 AS planted, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a, 3 + (h // 10) % 8 AS k FROM h
), t AS (
  SELECT id, n, i, CASE WHEN planted AND i >= a THEN w[a + (i - a) % (1 + (n - a) // k) + 1] ELSE w[i + 1] END AS w FROM (SELECT *, unnest(range(n)) AS i FROM g)
), same AS (
  SELECT x.id, x.i, x.i - y.i AS q FROM t x JOIN t y ON x.id = y.id AND x.w = y.w AND y.i < x.i AND (x.i - y.i) * 4 <= x.n
), island AS (
  SELECT id, q, min(i) - q AS s, count(*) + q AS len FROM (SELECT *, i - row_number() OVER (PARTITION BY id, q ORDER BY i) AS o FROM same) GROUP BY id, q, o HAVING count(*) + q >= greatest(6, 4 * q)
), r AS (
  SELECT * FROM island x WHERE NOT EXISTS (SELECT 1 FROM island y WHERE y.id = x.id AND y.q < x.q AND y.s <= x.s AND y.s + y.len >= x.s + x.len)
), best AS (
  SELECT id, count(*) AS n_runs, sha256(string_agg(s || ',' || len || ',' || q || chr(10), '' ORDER BY s, q)) AS listed FROM r GROUP BY id
), top AS (
  SELECT DISTINCT ON (id) id, s, len, q FROM r ORDER BY id, len / q DESC, s, q
), kept AS (
  SELECT t.id, string_agg(t.w, ' ' ORDER BY t.i) AS text FROM t WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.id = t.id AND t.i >= r.s + r.q AND t.i < r.s + r.len) GROUP BY t.id
)
SELECT g.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, len AS length, q AS period, (1000 * len) // q AS exponent_milli, coalesce(listed, sha256('')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM g LEFT JOIN best ON best.id = g.id LEFT JOIN top ON top.id = g.id LEFT JOIN kept ON kept.id = g.id""",
    "op12_source_divergence": r"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), c AS (
  SELECT lang, source, term, count(*) AS n, count(DISTINCT id) AS docs FROM (SELECT id, lang, source, unnest(w) AS term FROM d) GROUP BY ALL
), k AS (
  SELECT lang, term, sum(n)::BIGINT AS all_n FROM c GROUP BY ALL HAVING sum(docs) >= 10
), l AS (
  SELECT lang, count(*) AS kept, sum(all_n)::BIGINT AS all_total FROM k GROUP BY lang
), g AS (SELECT DISTINCT lang, source FROM d
), dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, k.all_n, l.kept, l.all_total, (sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source))::BIGINT AS total
  FROM g JOIN k ON k.lang = g.lang JOIN l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), p AS (
  SELECT *, 1 + (1000000000 * (n + 2)) // (total + 2 * kept) AS p, 1 + (1000000000 * (all_n + 2)) // (all_total + 2 * kept) AS q FROM dense
), sums AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p))::BIGINT AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
), found AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL SELECT lang, source, 'term', term, ((p - q) * (p - q)) // (p + q) FROM p WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM found) WHERE part = 'pair' OR rank <= 10""",
}
