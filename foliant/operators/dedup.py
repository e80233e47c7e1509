"""Identity and near duplicates of entries."""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heapify, heappop, heapreplace

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import dedupe_key, significant_words, word_jaccard
from foliant.operators.rounds import PAIRS_A_TASK, Tables, first_come

LEAST_CHARS = 20
ROWS_A_LIST = 1000


def exact_duplicates(docs: DataFrame, salts: int = 16) -> DataFrame:
    """Rows after the first of each key, with the first; short texts aren't candidates. Keys are computed once, behind a shuffle by key and salt that both the
    aggregate and the join read, so a key with many rows isn't gathered."""
    letters = dedupe_key(F.coalesce("text", F.lit("")))
    # a text without any letter is like no other; neither column can be null, so that no filter on them is pushed to one side of the join alone
    key = F.coalesce(F.when(letters == "", F.concat(F.lit("#"), F.col("doc_id").cast("string"))).otherwise(F.sha2(letters, 256)), F.lit(""))
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(salts)).cast("int"), F.lit(0))
    dealt = docs.filter((F.length("text") >= LEAST_CHARS) & F.col("doc_id").isNotNull()).select("doc_id", key.alias("key"), salt.alias("salt")).repartition("key", "salt")
    first = dealt.groupBy("key").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    many = first.select("key", "first_id", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    return dealt.join(many, ["key", "salt"]).filter("doc_id <> first_id").select("doc_id", "first_id")


def _members(rows: DataFrame, key: str, group: str, text: str) -> DataFrame:
    """id, g, s, n: rows with their words as one key (words have no spaces) and the length of their text; rows without words are like no other."""
    words = F.array_join(significant_words(F.col(text)), " ")
    return rows.select(F.col(key).alias("id"), F.col(group).alias("g"), words.alias("s"), F.length(F.col(text)).alias("n")).filter("s <> '' and id is not null and g is not null")


def _linked(classes: DataFrame, jaccard: float, contain: float) -> DataFrame:
    """g, sa, sb, jaccard, containment: different word sets of a group that are near one another. A pair shares a share of ``contain`` of the smaller set at least (a Jaccard share
    that is enough implies as much of it as ``jaccard``), so it shares one of the first words of either set, rarest first: only those are joined on."""
    sets = classes.select("g", "s", F.split("s", " ").alias("w"))
    least = min(jaccard, contain)
    often = sets.select("g", F.explode("w").alias("t")).groupBy("g", "t").agg(F.count(F.lit(1)).alias("f"))
    terms = sets.select("g", "s", F.size("w").alias("n"), F.explode("w").alias("t")).join(often, ["g", "t"])
    # the smaller set has its shared words among all of its words but those that may be missing
    rank = F.row_number().over(Window.partitionBy("g", "s").orderBy("f", "t"))
    first = terms.withColumn("k", rank).filter(F.col("k") <= F.col("n") - F.ceil(F.col("n") * least) + 1).select("g", "t", F.col("s").alias("a"))
    pairs = first.join(terms.select("g", "t", F.col("s").alias("b")), ["g", "t"]).filter("a <> b").select("g", F.least("a", "b").alias("sa"), F.greatest("a", "b").alias("sb")).distinct()
    at = pairs.withColumn("wa", F.split("sa", " ")).withColumn("wb", F.split("sb", " "))
    both = F.size(F.array_intersect("wa", "wb"))
    j, c = both / (F.size("wa") + F.size("wb") - both), both / F.least(F.size("wa"), F.size("wb"))
    return at.filter((j >= jaccard) | (c >= contain)).select("g", "sa", "sb", F.round(j, 6).alias("jaccard"), F.round(c, 6).alias("containment"))


def near_pairs(rows: DataFrame, key: str, group: str, text: str, jaccard: float = 0.6, contain: float = 0.75) -> DataFrame:
    """Pairs inside a group by shared words over the union, or over the smaller set. Only different word sets are compared; rows of one set, and of two that are near, are paired where they are written, from lists of some ``ROWS_A_LIST`` ids, so no pair of rows is shuffled."""
    rows = _members(rows, key, group, text)
    classes = rows.groupBy("g", "s").agg(F.count(F.lit(1)).alias("many"))
    dealt = rows.join(classes, ["g", "s"]).withColumn("k", F.pmod(F.xxhash64("id"), F.ceil(F.col("many") / ROWS_A_LIST)))
    lists = dealt.groupBy("g", "s", "k").agg(F.collect_list("id").alias("ids"))
    one = F.lit(1.0)
    links = _linked(classes, jaccard, contain).unionByName(classes.filter("many > 1").select("g", F.col("s").alias("sa"), F.col("s").alias("sb"), one.alias("jaccard"), one.alias("containment")))
    side = lambda x: lists.select("g", F.col("s").alias(f"s{x}"), F.col("k").alias(f"k{x}"), F.col("ids").alias(f"ids_{x}"))
    met = links.join(side("a"), ["g", "sa"]).join(side("b"), ["g", "sb"]).filter("sa <> sb or ka <= kb")
    met = met.withColumn("once", F.expr("sa = sb and ka = kb")).repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", "sa", "sb", "ka", "kb")
    each = met.select("g", "once", "jaccard", "containment", "ids_b", F.explode("ids_a").alias("x")).select("g", "once", "jaccard", "containment", "x", F.explode("ids_b").alias("y"))
    return each.filter("x < y or (x > y and not once)").select("g", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "jaccard", "containment")


def greedy_keep(pairs: DataFrame, lengths: DataFrame) -> DataFrame:
    """Order-dependent resolution inside a group, left to right: of a pair the longer text stays (tie: the earlier); a dropped
    row drops none."""
    n = lengths.select("id", "n")
    sized = pairs.join(n.toDF("a", "la"), "a").join(n.toDF("b", "lb"), "b")
    return first_come(sized.select("g", "a", "b", (F.col("lb") <= F.col("la")).alias("drops_b")), ["g"]).drop("kept")


def _resolved(near: dict, rows: list[tuple]) -> list:
    """What goes of a group's rows (id, set, length) in order of id, where those of one set and of near sets are pairs. No pair is made: a row looks for the next one that is still there in each near set, and either drops it or goes."""
    at: dict = {}
    for i, s, n in rows:
        ids, sizes = at.setdefault(s, ([], []))
        ids.append(i)
        sizes.append(n)
    later = {s: list(range(len(ids) + 1)) for s, (ids, _) in at.items()}  # from a place to the next that is still there
    begun, gone, out = dict.fromkeys(at, 0), set(), []

    def there(s, k: int) -> int:
        to, end = later[s], k
        while to[end] != end:
            end = to[end]
        while to[k] != end:
            to[k], k = end, to[k]
        return end

    for i, s, n in rows:
        if i in gone:
            continue
        heap = []
        for t in (s, *near.get(s, ())):
            ids, k = at[t][0], begun[t]
            while k < len(ids) and ids[k] <= i:
                k += 1
            begun[t] = k
            k = there(t, k)
            if k < len(ids):
                heap.append((ids[k], t, k))
        heapify(heap)
        while heap:
            j, t, k = heap[0]
            if at[t][1][k] > n:
                gone.add(i)
                out.append(i)
                break
            gone.add(j)
            out.append(j)
            later[t][k] = k + 1
            k = there(t, k + 1)
            if k < len(at[t][0]):
                heapreplace(heap, (at[t][0][k], t, k))
            else:
                heappop(heap)
    return out


def greedy_near(rows: DataFrame, key: str, group: str, text: str, jaccard: float = 0.6, contain: float = 0.75, rows_a_task: int = PAIRS_A_TASK) -> DataFrame:
    """g, dropped: ``greedy_keep`` of ``near_pairs``, without the pairs. Of a set that no other is near the first of the longest stays. Groups with near sets are resolved from their rows and links, each in a task; those with more than ``rows_a_task`` of them by their pairs."""
    tables = Tables(rows.sparkSession)
    of = tables.keep(_members(rows, key, group, text))
    links = tables.keep(_linked(of.select("g", "s").distinct(), jaccard, contain).select("g", "sa", "sb"))
    met = links.select("g", F.col("sa").alias("s")).union(links.select("g", F.col("sb").alias("s"))).distinct()
    alone = of.join(met, ["g", "s"], "left_anti")
    best = alone.groupBy("g", "s").agg(F.min(F.struct((-F.col("n")).alias("n"), "id")).alias("best")).select("g", "s", F.col("best.id").alias("kept"))
    out = alone.join(best, ["g", "s"]).filter("id <> kept").select("g", F.col("id").alias("dropped"))
    if links.isEmpty():
        return tables.done(out)
    within = of.join(met, ["g", "s"], "left_semi")
    mixed = links.select("g", F.lit(None).cast(of.schema["id"].dataType).alias("id"), F.col("sa").alias("s"), F.col("sb").alias("t"), F.lit(0).alias("n")).unionByName(within.select("g", "id", "s", F.lit(None).cast("string").alias("t"), "n"))
    large = mixed.groupBy("g").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > rows_a_task).select("g")
    schema = of.select("g", F.col("id").alias("dropped")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(g, near: dict, held: list[tuple]) -> pa.RecordBatch:
            out = _resolved(near, held)
            return pa.RecordBatch.from_arrays([pa.array([g] * len(out), kinds[0]), pa.array(out, kinds[1])], schema.names)

        at, near, held, kinds = None, {}, [], None
        for batch in batches:
            kinds = kinds or [batch.schema.field(c).type for c in ("g", "id")]
            for g, i, s, t, n in zip(*(batch.column(c).to_pylist() for c in ("g", "id", "s", "t", "n")), strict=True):
                if g != at:
                    if held:
                        yield told(at, near, held)
                    at, near, held = g, {}, []
                if i is None:
                    near.setdefault(s, []).append(t)
                    near.setdefault(t, []).append(s)
                else:
                    held.append((i, s, n))
        if held:
            yield told(at, near, held)

    # links stand before rows, as their id is null
    sure = mixed.join(large, "g", "left_anti").repartition("g").sortWithinPartitions("g", "id").select("g", "id", "s", "t", "n")
    out = out.unionByName(sure.mapInArrow(run, schema))
    if not large.isEmpty():
        some = rows.join(large.select(F.col("g").alias(group)), group, "left_semi")
        sizes = some.select(F.col(key).alias("id"), F.length(F.col(text)).alias("n"))
        # rows of sets that no other is near are settled above, and drop nothing else
        apart = greedy_keep(near_pairs(some, key, group, text, jaccard, contain), sizes)
        out = out.unionByName(apart.join(within.select("g", F.col("id").alias("dropped")), ["g", "dropped"], "left_semi"))
    return tables.done(out)


def best_overlap(rows: DataFrame, items: DataFrame, least: float = 0.8) -> DataFrame:
    """Each row's best item by title overlap (shared over the shorter); ties go to the smaller item id. Rows and items meet on an item's rarest words among items, as many as
    leave too few others for the share where the item is the shorter one, and on a row's where the row is."""
    a = rows.select("id", significant_words(F.col("title")).alias("w")).filter(F.size("w") >= 4)
    b = items.select("item_id", significant_words(F.col("title")).alias("v")).filter(F.size("v") >= 4)
    often = b.select(F.explode("v").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("f"))

    def first(sets: DataFrame, key: str, words: str) -> tuple[DataFrame, DataFrame]:
        """All terms that items have, and of each set those before the share could still be reached without them."""
        every = sets.select(key, F.size(words).alias("n"), F.explode(words).alias("t")).join(often, "t")
        rank = F.row_number().over(Window.partitionBy(key).orderBy("f", "t"))
        missing = F.col("n") - F.count(F.lit(1)).over(Window.partitionBy(key))
        near = every.withColumn("k", rank).withColumn("missing", missing).filter(F.col("k") <= F.col("n") - F.col("missing") - F.ceil(F.col("n") * least) + 1)
        return every.select(key, "n", "t"), near.select(key, "n", "t")

    a_all, a_near = first(a, "id", "w")
    b_all, b_near = first(b, "item_id", "v")
    shorter_row = a_near.join(b_all.withColumnRenamed("n", "m"), "t").filter("n <= m")
    shorter_item = a_all.join(b_near.withColumnRenamed("n", "m"), "t").filter("m <= n")
    pairs = shorter_row.select("id", "item_id").union(shorter_item.select("id", "item_id")).distinct()
    at = pairs.join(a, "id").join(b, "item_id")
    scored = at.select("id", "item_id", (F.size(F.array_intersect("w", "v")) / F.least(F.size("w"), F.size("v"))).alias("overlap")).filter(F.col("overlap") >= least)
    best = scored.groupBy("id").agg(F.max(F.struct("overlap", (-F.col("item_id")).alias("neg"))).alias("m"))
    return best.select("id", (-F.col("m.neg")).alias("item_id"), F.round("m.overlap", 6).alias("overlap"))


def strongest_only(matches: DataFrame) -> DataFrame:
    """An item ends on one row: the strongest match; where the strongest tie, all release it."""
    w = Window.partitionBy("item_id").orderBy(F.desc("overlap"))
    ranked = matches.withColumn("r", F.rank().over(w))
    tied = ranked.filter("r = 1").groupBy("item_id").agg(F.count(F.lit(1)).alias("ties"))
    return ranked.join(tied, "item_id").select("id", "item_id", "overlap", ((F.col("r") == 1) & (F.col("ties") == 1)).alias("kept"))


__all__ = ["best_overlap", "exact_duplicates", "greedy_keep", "greedy_near", "near_pairs", "strongest_only", "word_jaccard"]
