"""Two versions of a document, block by block: what stayed, went, came and moved; and which entry a block belongs to."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOVE_RATIO = 0.8
OVERLAP = 0.5


def _best(text: str, came: list[int], matchers: dict[int, SequenceMatcher]) -> tuple[float, int]:
    """The greatest ratio and its first block, if it is enough for a move. The quick ratios are never below the ratio, so most blocks are ruled out by them."""
    best, at = 0.0, 0
    for j in came:
        m = matchers[j]
        m.set_seq1(text)
        least = max(best, MOVE_RATIO)
        if m.real_quick_ratio() < least or m.quick_ratio() < least:
            continue
        ratio = m.ratio()
        if ratio > best:
            best, at = ratio, j
    return best, at


def _changes(before: list[tuple], after: list[tuple]) -> list[tuple]:
    """change, before_idx, after_idx, text of one document's blocks (idx, text)."""
    x, y = [t for _, t in before], [t for _, t in after]
    rows, gone, came = [], [], []
    for op, i1, i2, j1, j2 in SequenceMatcher(None, x, y, autojunk=False).get_opcodes():
        if op == "equal":
            rows += [("equal", before[i][0], after[j][0], x[i]) for i, j in zip(range(i1, i2), range(j1, j2), strict=True)]
        else:
            gone += range(i1, i2)
            came += range(j1, j2)
    matchers = {j: SequenceMatcher(None, "", y[j]) for j in came} if gone else {}
    for i in gone:
        ratio, j = _best(x[i], came, matchers)
        if ratio >= MOVE_RATIO:
            came.remove(j)
            rows.append(("moved", before[i][0], after[j][0], x[i]))
        else:
            rows.append(("deleted", before[i][0], None, x[i]))
    return [*rows, *(("added", None, after[j][0], y[j]) for j in came)]


def aligned(before: DataFrame, after: DataFrame) -> DataFrame:
    """(doc, idx, text) twice to (doc, change, before_idx, after_idx, text): equal, deleted, added and moved blocks. The order decides, so a document is aligned as a
    whole, in one task; documents are the unit. A deleted block is moved if an added one is much like it; the best goes first, and each is used once."""

    schema = "doc long, change string, before_idx long, after_idx long, text string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        for batch in batches:
            for k in range(batch.num_rows):
                doc, first, second = (batch.column(c)[k].as_py() for c in ("doc", "x", "y"))
                rows = _changes(*([tuple(r.values()) for r in side] for side in (first, second)))
                yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(([doc] * len(rows), *(list(c) for c in zip(*rows, strict=True))) if rows else [[]] * 5, kinds, strict=True)], ["doc", "change", "before_idx", "after_idx", "text"])

    tagged = lambda f, old: f.select(F.col("doc").cast("long").alias("doc"), F.struct(F.col("idx").cast("long").alias("idx"), "text").alias("r"), F.lit(old).alias("old"))
    both = tagged(before, True).unionByName(tagged(after, False))
    of = lambda old: F.sort_array(F.collect_list(F.when(F.col("old") == old, F.col("r"))))
    return both.groupBy("doc").agg(of(True).alias("x"), of(False).alias("y")).mapInArrow(run, schema)


def attributed(blocks: DataFrame, entries: DataFrame) -> DataFrame:
    """(doc, block, words) and (doc, entry, words) to (block, entry): the entry of the document with the best word Jaccard among those that hold enough of the block; null on a tie or where there is none."""
    pairs = blocks.join(entries.withColumnRenamed("words", "held"), "doc")
    both = F.size(F.array_intersect("words", "held"))
    scored = pairs.filter((F.size("words") > 0) & (both >= OVERLAP * F.size("words"))).select("doc", "block", "entry", (both / F.size(F.array_union("words", "held"))).alias("j"))
    rank = F.rank().over(Window.partitionBy("doc", "block").orderBy(F.desc("j")))
    best = scored.withColumn("r", rank).filter("r = 1").groupBy("doc", "block").agg(F.min("entry").alias("entry"), F.count(F.lit(1)).alias("ties"))
    return blocks.select("doc", "block").join(best, ["doc", "block"], "left").select("doc", "block", F.when(F.col("ties") == 1, F.col("entry")).alias("entry"))
