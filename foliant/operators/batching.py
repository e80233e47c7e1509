"""Rows to batches in order: by a token budget, by record, and a function over rows whose results keep their places."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pack(sizes: Column, budget: int) -> Column:
    """Greedy packing of an ordered array of sizes: the batch of each. A new one begins where the next would overflow one that isn't empty; a size over the budget has a batch of its own."""
    start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("batch"), F.array().cast("array<int>").alias("out"))

    def step(s: Column, x: Column) -> Column:
        full = (s["used"] > 0) & (s["used"] + x > budget)
        batch = F.when(full, s["batch"] + 1).otherwise(s["batch"])
        return F.struct(F.when(full, x).otherwise(s["used"] + x).alias("used"), batch.alias("batch"), F.concat(s["out"], F.array(batch)).alias("out"))

    return F.aggregate(F.transform(sizes, lambda x: x.cast("long")), start, step, lambda s: s["out"])


def chunks(lines: DataFrame, budget: int, size: Column) -> DataFrame:
    """doc_id, idx, line to the same with ``chunk``. The unit is a document: its line sizes, not its text, are folded in order."""
    sized = lines.withColumn("size", size)
    of = sized.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("idx", "size"))).alias("l"))
    at = of.select("doc_id", F.explode(F.arrays_zip(F.col("l.idx").alias("idx"), pack(F.col("l.size"), budget).alias("chunk"))).alias("x")).select("doc_id", "x.idx", "x.chunk")
    return lines.join(at, ["doc_id", "idx"])


def record_batches(lines: DataFrame, most: int, opens: Column) -> DataFrame:
    """doc_id, idx to the same with ``batch``: whole records, as many as fit; a record over ``most`` lines has a batch of its own."""
    from pyspark.sql import Window

    w = Window.partitionBy("doc_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    rec = lines.withColumn("record", F.sum(F.when(opens, 1).otherwise(0)).over(w))
    sizes = rec.groupBy("doc_id", "record").agg(F.count(F.lit(1)).alias("size"))
    of = sizes.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("record", "size"))).alias("l"))
    at = of.select("doc_id", F.explode(F.arrays_zip(F.col("l.record").alias("record"), pack(F.col("l.size"), most).alias("batch"))).alias("x")).select("doc_id", "x.record", "x.batch")
    return rec.join(at, ["doc_id", "record"]).select("doc_id", "idx", "record", "batch")


def map_texts(rows: DataFrame, fn: Callable[[str], str], keys: str, text: str = "text", out: str = "result") -> DataFrame:
    """A model, or any function of a text, over rows in parallel. The keys go along, so results can be put in order; one that fails ends the job."""
    names = [c.split()[0] for c in keys.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([None if x is None else fn(x) for x in b.column(text).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in names), found], [*names, out])

    return rows.select(*names, text).mapInArrow(run, f"{keys}, {out} string")
