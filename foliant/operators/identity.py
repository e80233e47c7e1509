"""Which entries of one person are the same: by identity keys, by words and titles, by dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.dates import dates_compatible
from foliant.functions.text import dedupe_key, significant_words
from foliant.operators.rounds import first_come, first_of_keys

# The least shares that make a duplicate, what vetoes one, and the codes whose dates must agree.
JACCARD, CONTAINMENT, TITLE = 0.6, 0.75, 0.8
TITLE_WORDS, APART, APART_WORDS = 4, 0.25, 3
DATED_CODES = ("D3", "M1", "N3A")
LEAST_CHARS = 20


def preferred_copies(entries: DataFrame) -> DataFrame:
    """entry_id, first_id, kept: every entry whose text has copies. The first stays, unless it is coded T* and the copies have an M*: then
    that one stays, if nothing but T* stands before it. Aggregates find the place of each rule, so no group is gathered."""
    keyed = entries.filter(F.length("text") >= LEAST_CHARS).select("entry_id", "code", F.sha2(dedupe_key(F.col("text")), 256).alias("key"))
    t, m = F.col("code").startswith("T"), F.col("code").startswith("M")
    of_key = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("entry_id").alias("first_id"), F.min(F.when(~t, F.col("entry_id"))).alias("other"), F.min(F.when(m, F.col("entry_id"))).alias("m")).filter("n > 1")
    stays = F.when((F.col("other") == F.col("first_id")) | F.col("m").isNull(), F.col("first_id")).when(F.col("other") == F.col("m"), F.col("m"))
    return keyed.join(of_key, "key").select("entry_id", "first_id", F.coalesce(F.col("entry_id") == stays, F.lit(False)).alias("kept"))


def title_words(text: Column) -> Column:
    """Of what stands before the first tab, else of the quoted parts, else of the first 100 characters."""
    quoted = F.regexp_extract_all(text, F.lit('["“](.+?)["”]'), F.lit(1))
    title = F.when(text.contains("\t"), F.split(text, "\t")[0]).when(F.size(quoted) > 0, F.array_join(quoted, " ")).otherwise(F.substring(text, 1, 100))
    return significant_words(title)


def similar(wa: Column, wb: Column, ta: Column, tb: Column) -> tuple[Column, Column, Column, Column]:
    """jaccard, containment, title containment, and whether they make a duplicate that no different titles veto."""
    ratio = lambda k, n: F.when(n > 0, k / n).otherwise(0.0)
    both, t_both = F.size(F.array_intersect(wa, wb)), F.size(F.array_intersect(ta, tb))
    j, c = ratio(both, F.size(wa) + F.size(wb) - both), ratio(both, F.least(F.size(wa), F.size(wb)))
    least = F.least(F.size(ta), F.size(tb))
    t = F.when(least >= TITLE_WORDS, t_both / least).otherwise(0.0)
    apart = (t < TITLE) & (least >= APART_WORDS) & (ratio(t_both, F.size(ta) + F.size(tb) - t_both) <= APART)
    return j, c, t, ((j >= JACCARD) | (c >= CONTAINMENT) | (t >= TITLE)) & ~apart


def near_decisions(entries: DataFrame) -> DataFrame:
    """person, code, a, b, the shares, and the longer text's side: pairs of one person and code that are duplicates. Groups are the entries of one
    person and code, small by nature. Dated codes need compatible dates."""
    sets = entries.select("person", "code", "entry_id", "text", significant_words(F.col("text")).alias("w"), title_words(F.col("text")).alias("t")).filter(F.size("w") > 0)
    side = lambda x: sets.select("person", "code", *(F.col(c).alias(f"{c}_{x}") for c in ("entry_id", "text", "w", "t")))
    pairs = side("a").join(side("b"), ["person", "code"]).filter("entry_id_a < entry_id_b")
    j, c, t, dup = similar(F.col("w_a"), F.col("w_b"), F.col("t_a"), F.col("t_b"))
    drops_b = F.length("text_a") >= F.length("text_b")
    dropped, kept = F.when(drops_b, F.col("text_b")).otherwise(F.col("text_a")), F.when(drops_b, F.col("text_a")).otherwise(F.col("text_b"))
    ok = dup & (~F.col("code").isin(*DATED_CODES) | dates_compatible(dropped, kept))
    out = pairs.filter(ok).select("person", "code", F.col("entry_id_a").alias("a"), F.col("entry_id_b").alias("b"), F.round(j, 6).alias("jaccard"), F.round(c, 6).alias("containment"), F.round(t, 6).alias("title"), drops_b.alias("drops_b"))
    return out


def left_to_right(pairs: DataFrame) -> DataFrame:
    """person, code, dropped: pairs in document order; a dropped entry drops none, and one that is dropped by a later entry stops looking."""
    return first_come(pairs, ["person", "code"]).drop("kept")


def first_holders(entries: DataFrame, keys: list[Column]) -> DataFrame:
    """person, entry_id, holder: entries that share an identity key with an earlier entry of the person that is no copy itself. Left to right, in one person's entries."""
    tagged = F.array(*(F.when(k.isNotNull(), F.concat(F.lit(f"{n}:"), k.cast("string"))) for n, k in enumerate(keys)))
    return first_of_keys(entries, ["person"], "entry_id", tagged)


def across_codes(entries: DataFrame, key: Column) -> DataFrame:
    """a, b, code_a, code_b: entries of one person with one identity key under two codes; only neighbours in document order pair, so a key with many entries makes no square."""
    from pyspark.sql import Window

    w = Window.partitionBy("person", "key").orderBy("entry_id")
    rows = entries.select("person", key.alias("key"), F.col("entry_id").alias("b"), F.col("code").alias("code_b")).filter("key is not null")
    seen = rows.select("person", "key", F.col("b").alias("entry_id"), "code_b").withColumn("a", F.lag("entry_id").over(w)).withColumn("code_a", F.lag("code_b").over(w))
    return seen.filter("a is not null and code_a <> code_b").select("a", F.col("entry_id").alias("b"), "code_a", "code_b")


def undated_inside(entries: DataFrame) -> DataFrame:
    """entry_id, inside: undated entries all of whose words stand in a dated one of the same person and title; the first such one."""
    rows = entries.withColumn("w", significant_words(F.col("text")))
    bare = rows.filter("kind = 6").select("person", "title", "entry_id", F.array_remove(F.col("w"), "undated").alias("w"))
    dated = rows.filter("kind <> 6").select("person", "title", F.col("entry_id").alias("other"), F.col("w").alias("v"))
    found = bare.join(dated, ["person", "title"]).filter(F.size(F.array_except("w", "v")) == 0)
    return found.groupBy("entry_id").agg(F.min("other").alias("inside"))


def code_twins(rows: DataFrame, keys: list[Column]) -> DataFrame:
    """person, record_id, twin, shared: records that share an identity key with a record of the person under another code, wherever it stands; the smallest such record, and how many there are, once for each key they share.

    Rows have person, record_id, code. Per key only the first record and the number of each code are gathered, so a key with many records makes no square. Null keys, persons and codes meet nothing."""
    tagged = F.array(*(F.when(k.isNotNull(), F.concat(F.lit(f"{n}:"), k.cast("string"))) for n, k in enumerate(keys)))
    at = rows.filter("code is not null").select("person", "record_id", "code", F.explode(F.array_compact(tagged)).alias("key"))
    of_code = at.groupBy("person", "key", "code").agg(F.min("record_id").alias("first"), F.count(F.lit(1)).alias("n"))
    of_key = of_code.groupBy("person", "key").agg(F.collect_list(F.struct("code", "first", "n")).alias("codes")).filter(F.size("codes") > 1)
    others = F.filter("codes", lambda c: c["code"] != F.col("code"))
    met = at.join(of_key, ["person", "key"]).select("person", "record_id", F.array_min(F.transform(others, lambda c: c["first"])).alias("first"), F.aggregate(others, F.lit(0).cast("long"), lambda a, c: a + c["n"]).alias("n"))
    return met.groupBy("person", "record_id").agg(F.min("first").alias("twin"), F.sum("n").alias("shared"))


def inside_dated(undated: DataFrame, dated: DataFrame) -> DataFrame:
    """record_id, inside: undated records all of whose words stand in one dated record of the person; the smallest such one.

    Both have person, record_id, words. Equal sets of a person are one. An undated set meets the dated ones on its word that fewest of them have, and has no match where a word of it is in none. Sets without words are inside nothing."""
    sets = lambda f: f.filter(F.size("words") > 0).select("person", "record_id", F.array_sort(F.array_distinct("words")).alias("w"))
    each = sets(undated)
    some, held = each.select("person", "w").distinct(), sets(dated).groupBy("person", F.col("w").alias("v")).agg(F.min("record_id").alias("inside"))
    index = held.select("person", F.explode("v").alias("t")).groupBy("person", "t").agg(F.count(F.lit(1)).alias("f"))
    terms = some.select("person", "w", F.explode("w").alias("t")).join(index, ["person", "t"]).groupBy("person", "w").agg(F.min(F.struct("f", "t"))["t"].alias("t"), F.count(F.lit(1)).alias("k"))
    rare = terms.filter(F.col("k") == F.size("w")).drop("k")
    pairs = rare.join(held.select("person", "v", "inside", F.explode("v").alias("t")), ["person", "t"]).filter(F.size(F.array_except("w", "v")) == 0)
    found = pairs.groupBy("person", "w").agg(F.min("inside").alias("inside"))
    return each.join(found, ["person", "w"]).select("record_id", "inside")
