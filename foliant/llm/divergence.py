"""Source divergence audit: how the word use of each source differs from that of its language's other sources and of the language as a whole.

Terms are the runs of ASCII letters and non-ASCII characters, A-Z lower-cased. A language keeps the terms of ``least_docs`` or more of its documents.

1. **Sketch.** Tasks count, for each (language, term), the documents that have it, into the cells of a count-min sketch, and send the cells they touched, each
   held at ``least_docs`` at most. Cells merge by sums. An estimate is never under the true count: where a cell's sum is short of ``least_docs``, so is every term's of that cell.
   The cells that reach it make one bitmap a row of the sketch, of ``cells`` bits: that, and nothing else, is broadcast.
2. **Exact counts.** Tasks count (language, source, term), leave out the terms that the bitmaps rule out, and only then shuffle. Survivors are counted exactly, and those of too few documents go.
3. **Pairs.** With smoothed shares p and q in billionths, f(p, q) = floor((p - q)^2 / (p + q)). The sum over all kept terms of a language is split: what two sources would have if each had none of the terms, what either adds alone
   (from the histogram of its counts), and a correction for the terms that both have. So the join on terms pairs present terms alone.
   Its rows are summed before they are shuffled. All of it is in integers.

The sketch's width grows with the number of documents up to ``most_cells`` bits a row (16 MB); beyond that it rules out less, and nothing else changes.

Defined results. Null language, source and text are ''. A row is a document, so repeated rows count each. Groups without terms have rows of part ``pair``; a language with one source has none. Ties in value are ranked by the item's bytes.
An empty table gives an empty result. Very long texts are counted whole, one at a time. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, cut, held, mix64, raw

#: Bytes to what splitting sees: letters in lower case and all of non-ASCII; the rest is a space.
PLAIN = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Cells of a block of the sketch: what one group of the merge holds for each task.
BLOCK = 1 << 16
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)


@dataclass(frozen=True)
class Audit:
    """least_docs: documents of a language that a kept term stands in. top: terms listed for a group. rows: of the sketch. cells_a_doc, most_cells: a row's width. held: document-term pairs that a task holds."""

    least_docs: int = 10
    top: int = 10
    rows: int = 3
    cells_a_doc: int = 64
    most_cells: int = 1 << 27
    held: int = 2_000_000
    scale: int = 1_000_000_000
    smooth: int = 2


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(PLAIN).split()


class Numbers(dict):
    """Words by first appearance."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self)
        return n


@dataclass
class Part:
    """Counts of some documents: group and term numbers, occurrences and documents; the groups' names and the terms."""

    groups: list[tuple[str, str]]
    terms: list[bytes]
    group: np.ndarray
    term: np.ndarray
    count: np.ndarray
    docs: np.ndarray

    def hashes(self) -> np.ndarray:
        """Of language and term, for each count."""
        lang = np.array([xxhash.xxh3_64_intdigest(lang.encode()) for lang, _ in self.groups] or [0], np.uint64)
        term = np.array([xxhash.xxh3_64_intdigest(t) for t in self.terms] or [0], np.uint64)
        with np.errstate(over="ignore"):
            return mix64(lang[self.group] * ODD[3] ^ term[self.term])


def partial_counts(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Part]:
    """Of the rows (lang, source, text) of a task; a part whenever ``most`` document-term pairs are held."""
    number, groups, held_pairs, size = Numbers(), {}, [], 0

    def part() -> Part:
        key, count = np.concatenate([k for k, _ in held_pairs]), np.concatenate([n for _, n in held_pairs])
        order = np.argsort(key, kind="stable")
        key, count = key[order], count[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        docs = np.diff(np.append(starts, len(key)))
        return Part(list(groups), list(number), (key[starts] >> 32).astype(np.int32), (key[starts] & 0xFFFFFFFF).astype(np.int32), np.add.reduceat(count, starts), docs)

    for batch in batches:
        for lang, source, text in zip(batch.column("lang").to_pylist(), batch.column("source").to_pylist(), raw(batch.column("text")), strict=True):
            g = groups.setdefault((lang, source), len(groups))
            words = terms_of(text)
            if not words:
                continue
            ids, n = np.unique(np.fromiter(map(number.__getitem__, words), np.int64, len(words)), return_counts=True)
            held_pairs.append((ids | g << 32, n))
            size += len(ids)
            if size >= most:
                yield part()
                number, groups, held_pairs, size = Numbers(), {}, [], 0
    if size:
        yield part()


def cells_of(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix64(h + ODD[row % 4] * np.uint64(row + 1)) >> np.uint64(64 - bits)).astype(np.int64)


def sketch(rows: DataFrame, cfg: Audit, bits: int) -> DataFrame:
    """(row, block, bitmap): which cells reach least_docs. Tasks send, for each block they touched, its cells and their counts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        for part in partial_counts(batches, cfg.held):
            h = part.hashes()
            for r in range(cfg.rows):
                cell, at = np.unique(cells_of(h, r, bits), return_inverse=True)
                n = np.minimum(np.bincount(at, part.docs), cfg.least_docs).astype(np.uint8 if cfg.least_docs < 256 else np.int64)
                block, starts = np.unique(cell // BLOCK, return_index=True)
                ends, low = np.append(starts[1:], len(cell)), (cell % BLOCK).astype("<u2")
                yield pa.record_batch({
                    "row": pa.array([r] * len(block), pa.int32()), "block": pa.array(block, pa.int64()),
                    "cells": pa.array([low[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                    "counts": pa.array([n[a:b].astype("<i8").tobytes() if n.dtype != np.uint8 else n[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary()),
                })

    def merge(key: tuple, rows: pa.Table) -> pa.Table:
        total = np.zeros(BLOCK, np.int64)
        for cells, counts in zip(rows.column("cells"), rows.column("counts"), strict=True):
            total[np.frombuffer(cells.as_py(), "<u2")] += np.frombuffer(counts.as_py(), np.uint8 if cfg.least_docs < 256 else "<i8")
        return pa.table({"row": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int64()), "bitmap": pa.array([np.packbits(total >= cfg.least_docs).tobytes()], pa.binary())})

    sent = rows.mapInArrow(count, "row int, block long, cells binary, counts binary")
    return sent.groupBy("row", "block").applyInArrow(merge, "row int, block long, bitmap binary")


def bitmaps(found: DataFrame, cfg: Audit, bits: int) -> np.ndarray:
    """One bitmap a row of the sketch: rows x cells / 8 bytes, at most rows x most_cells / 8."""
    out = np.zeros((cfg.rows, max(1 << bits, BLOCK) // 8), np.uint8)
    for r in found.toLocalIterator():
        out[r.row, r.block * (BLOCK // 8) : (r.block + 1) * (BLOCK // 8)] = np.frombuffer(r.bitmap, np.uint8)
    return out


def possible(maps: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """Whether the terms may reach least_docs."""
    ok = np.ones(len(h), bool)
    for r, bitmap in enumerate(maps):
        cell = cells_of(h, r, bits)
        ok &= (bitmap[cell >> 3] >> (7 - (cell & 7)).astype(np.uint8) & 1).astype(bool)
    return ok


def counts_of(rows: DataFrame, maps, cfg: Audit, bits: int) -> DataFrame:
    """(lang, source, term, n, docs) by task, of terms that the sketch doesn't rule out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held(None)
        for part in partial_counts(batches, cfg.held):
            at = np.flatnonzero(possible(maps.value, part.hashes(), bits))
            for some in np.array_split(at, max(1, -(-len(at) // 50_000))):
                g, t = pa.array(part.group[some]), pa.array(part.term[some])
                lang, source = (pa.array([name[k] for name in part.groups], pa.string()).take(g) for k in (0, 1))
                yield pa.record_batch({"lang": lang, "source": source, "term": pa.array([part.terms[i] for i in t.to_pylist()], pa.binary()).cast(pa.string()), "n": pa.array(part.count[some], pa.int64()), "docs": pa.array(part.docs[some], pa.int64())})

    return rows.mapInArrow(count, "lang string, source string, term string, n long, docs long")


def share(count: Column, total: Column, kept: Column, cfg: Audit) -> Column:
    """1 + floor(scale * (count + smooth) / (total + smooth * kept)), exactly: counts may be past what a product of 64-bit integers holds."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", F.lit(cfg.scale).cast("decimal(10,0)") * wide(count + cfg.smooth), wide(total + kept * cfg.smooth)) + 1


def apart(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def audit(docs: DataFrame, cfg: Audit = Audit()) -> DataFrame:
    """lang, source, part, item, value, rank."""
    spark = docs.sparkSession
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")))
    bits = int(min(cfg.most_cells, max(BLOCK, cfg.cells_a_doc * docs.count()))).bit_length()
    bits = min(bits, cfg.most_cells.bit_length() - 1)
    with Scratch(spark) as scratch:
        maps = spark.sparkContext.broadcast(bitmaps(sketch(rows, cfg, bits), cfg, bits))
        groups = scratch.keep(rows.select("lang", "source").distinct())
        counted = scratch.keep(counts_of(rows, maps, cfg, bits).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
        terms = scratch.keep(counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("all_n")).filter(F.col("docs") >= cfg.least_docs).select("lang", "term", "all_n"))
        of_lang = terms.groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("all_n").alias("all_total"))
        kept = counted.join(terms, ["lang", "term"]).select("lang", "source", "term", "n", "all_n")
        sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
        none = lambda c: F.coalesce(c, F.lit(0).cast("long"))
        # of every group: its total, its language's, and the share of a term that it doesn't have
        about = groups.join(of_lang, "lang", "left").join(sizes, ["lang", "source"], "left").select("lang", "source", none(F.col("kept")).alias("kept"), none(F.col("all_total")).alias("all_total"), none(F.col("total")).alias("total"))
        about = scratch.keep(about.withColumn("zero", F.when(F.col("kept") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("kept"), cfg))))
        shares = scratch.keep(kept.join(about, ["lang", "source"]).select("lang", "source", "term", "n", "zero", share(F.col("n"), F.col("total"), F.col("kept"), cfg).alias("p"), share(F.col("all_n"), F.col("all_total"), F.col("kept"), cfg).alias("q")))
        of_term = ranked(shares.filter("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), apart(F.col("p"), F.col("q")).alias("value"))).filter(F.col("rank") <= cfg.top)
        of_pair = ranked(pairs(scratch, shares, about))
        return cut(of_term.unionByName(of_pair))


def pairs(scratch: Scratch, shares: DataFrame, about: DataFrame) -> DataFrame:
    """Every ordered pair of a language's sources, with the sum over all kept terms."""
    two = about.select("lang", F.col("source").alias("a"), "kept", F.col("zero").alias("za")).join(about.select("lang", F.col("source").alias("b"), F.col("zero").alias("zb")), "lang")
    two = two.filter("a <> b")
    f = lambda p, q: apart(F.col(p), F.col(q))
    # what the terms of a alone would add against a source that has none of them: by count, not by term
    alone = shares.groupBy("lang", F.col("source").alias("a"), "p", F.col("zero").alias("za")).agg(F.count(F.lit(1)).alias("terms"))
    zeros = about.filter("kept > 0").groupBy("lang", F.col("zero").alias("zb")).agg(F.count(F.lit(1)).alias("sources"))
    adds = alone.join(zeros, "lang").groupBy("lang", "a", "zb").agg(F.sum(F.col("terms") * (f("p", "zb") - f("za", "zb"))).alias("adds"))
    adds = scratch.keep(adds)
    one, other = (shares.select("lang", "term", F.col("source").alias(x), F.col("p").alias(f"p{x}"), F.col("zero").alias(f"z{x}")) for x in ("a", "b"))
    met = one.join(other, ["lang", "term"]).filter("a < b").groupBy("lang", "a", "b").agg(F.sum(f("pa", "pb") - f("pa", "zb") - f("za", "pb") + f("za", "zb")).alias("both"))
    met = scratch.keep(met)
    both = met.unionByName(met.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "both"))
    zero = F.lit(0).cast("long")
    out = two.join(adds, ["lang", "a", "zb"], "left").join(adds.select("lang", F.col("a").alias("b"), F.col("zb").alias("za"), F.col("adds").alias("adds_b")), ["lang", "b", "za"], "left").join(both, ["lang", "a", "b"], "left")
    value = F.when(F.col("kept") > 0, F.col("kept") * f("za", "zb") + F.coalesce("adds", zero) + F.coalesce("adds_b", zero) + F.coalesce("both", zero)).otherwise(zero)
    return out.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), value.alias("value"))


def ranked(rows: DataFrame) -> DataFrame:
    w = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(w))
