"""Headings, sections, spans and chains as windows and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = 6


def next_start(rows: DataFrame, part: str, start: str) -> DataFrame:
    """With ``next``: the smallest start of the part that is strictly greater; equal starts share it."""
    of = rows.select(part, start).distinct().withColumn("next", F.lead(start).over(Window.partitionBy(part).orderBy(start)))
    return rows.join(of, [part, start])


def clip_leaves(sections: DataFrame) -> DataFrame:
    """doc, start, end, leaf to the same with leaves that end before the next header."""
    at = next_start(sections, "doc", "start")
    return at.withColumn("end", F.when(F.col("leaf") & F.col("next").isNotNull(), F.least("end", F.col("next") - 1)).otherwise(F.col("end"))).drop("next")


def with_ancestors(nodes: DataFrame) -> DataFrame:
    """doc, ord, level to the same with ``above``: the ords of the open headings above, nearest last. A heading closes those of its own level and deeper."""
    w = Window.partitionBy("doc").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.last(F.when(F.col("level") == k, F.col("ord")), True).over(w) for k in range(1, LEVELS + 1)]
    out = nodes.withColumn("last", F.array(*last))
    # open: no heading of a smaller or equal level came after it
    open_ = F.transform(F.slice("last", 1, F.greatest(F.col("level") - 1, F.lit(0))), lambda x, i: F.when(~F.exists(F.slice(F.col("last"), 1, F.greatest(i, F.lit(0))), lambda y: y > x), x))
    return out.withColumn("above", F.array_compact(F.when(F.col("level") > 1, open_).otherwise(F.array().cast("array<int>")))).drop("last")


def ancestor_cover(nodes: DataFrame) -> DataFrame:
    """doc, ord, end: every heading's end covers those of all below it."""
    up = with_ancestors(nodes)
    each = up.select("doc", F.explode(F.concat(F.col("above"), F.array("ord"))).alias("ord"), "end")
    return each.groupBy("doc", "ord").agg(F.max("end").alias("end"))


def find_sequence(elements: DataFrame, sequence: tuple[str, ...]) -> DataFrame:
    """doc, at_0..at_k: the first place of each text after that of the one before; only documents with all of them. A join and a minimum for each text."""
    found = elements.filter(F.col("text") == sequence[0]).groupBy("doc").agg(F.min("idx").alias("at_0"))
    for k, text in enumerate(sequence[1:], 1):
        later = elements.filter(F.col("text") == text).select("doc", "idx").join(found.select("doc", f"at_{k - 1}"), "doc").filter(F.col("idx") > F.col(f"at_{k - 1}"))
        found = found.join(later.groupBy("doc").agg(F.min("idx").alias(f"at_{k}")), "doc")
    return found


def without_subsets(spans: DataFrame) -> DataFrame:
    """doc, id, start, end: without those that lie in another; of equal ones the first id stays."""
    w = Window.partitionBy("doc").orderBy("start", F.desc("end"), "id").rowsBetween(Window.unboundedPreceding, -1)
    return spans.withColumn("far", F.max("end").over(w)).filter("far is null or end > far").drop("far")


def opened_groups(rows: DataFrame, opens: Column, joins: Column, part: str, order: str) -> DataFrame:
    """With ``group``: rows that join follow the row before them; those before any opening row have none."""
    w = Window.partitionBy(part).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("group", F.sum(F.when(joins, 0).otherwise(1)).over(w)).withColumn("opened", F.max(F.when(opens, 1).otherwise(0)).over(Window.partitionBy(part, "group")))


def nearest(rows: DataFrame, mark: Column, part: list[str], order: str) -> DataFrame:
    """With ``before`` and ``after``: the order values of the nearest marked rows on either side."""
    w = Window.partitionBy(*part).orderBy(order)
    at = F.when(mark, F.col(order))
    return rows.withColumn("before", F.last(at, True).over(w.rowsBetween(Window.unboundedPreceding, -1))).withColumn("after", F.first(at, True).over(w.rowsBetween(1, Window.unboundedFollowing)))


def islands(rows: DataFrame, key: str, part: str, order: str) -> DataFrame:
    """With ``run``: maximal runs of equal keys."""
    w = Window.partitionBy(part).orderBy(order)
    fresh = F.when(F.lag(key).over(w) == F.col(key), 0).otherwise(1)
    return rows.withColumn("fresh", fresh).withColumn("run", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("fresh")


def follow(links: DataFrame) -> DataFrame:
    """node, target (null: none) to node, root: the end of each chain that goes in one direction; null where it turns back. Pointers double in every round until none moves, so a chain of a million links takes twenty."""
    spark = links.sparkSession
    now = links.select("node", F.col("target").alias("at"), F.when(F.col("target") > F.col("node"), 1).when(F.col("target") < F.col("node"), -1).when(F.col("target").isNotNull(), 0).alias("way"))
    while True:
        far = now.select(F.col("node").alias("at"), F.col("at").alias("next"), F.col("way").alias("next_way"))
        step = now.join(far, "at", "left")
        ok = F.col("next").isNull() | (F.col("next_way") == F.col("way"))
        now = step.select("node", F.when(F.col("way") == 0, F.col("at")).when(F.col("next").isNull(), F.col("at")).when(ok, F.col("next")).otherwise(F.col("at")).alias("at"), F.when(ok, F.col("way")).otherwise(0).alias("way"), (F.col("next").isNotNull() & ok & (F.col("way") != 0)).alias("moved"))
        now = checkpointed(spark, now)
        if now.filter("moved").isEmpty():
            break
        now = now.drop("moved")
    return now.filter("at is not null").select("node", F.when(F.col("way") != 0, F.col("at")).alias("root"))


def checkpointed(spark, frame: DataFrame) -> DataFrame:
    """Cuts the lineage in the shared folder that the cluster names."""
    from foliant.sources.tables import shared_dir

    shared_dir(spark)
    return frame.checkpoint()


def slots(rows: DataFrame, tie: list[str], order: str, start: str) -> DataFrame:
    """With ``place``: inside a tie the rows with a start go, latest first, to the places that such rows have; the others keep theirs."""
    w = Window.partitionBy(*tie)
    ranked = rows.withColumn("own", F.row_number().over(w.orderBy(order))).withColumn("readable", F.col(start).isNotNull())
    by = Window.partitionBy(*tie, "readable")
    ranked = ranked.withColumn("nth_start", F.row_number().over(by.orderBy(F.desc(start), order))).withColumn("nth_slot", F.row_number().over(by.orderBy("own")))
    place = ranked.filter("readable").select(*tie, F.col("nth_slot").alias("nth_start"), F.col("own").alias("slot"), F.lit(True).alias("readable"))
    return ranked.join(place, [*tie, "readable", "nth_start"], "left").withColumn("place", F.coalesce("slot", "own")).drop("own", "readable", "nth_start", "nth_slot", "slot")
