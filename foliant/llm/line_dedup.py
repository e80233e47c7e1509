"""Cross-site boilerplate removal by distinct-site spread. Built-in functions only.

A line's key is a pair of 64-bit hashes of the trimmed line. HyperLogLog sketches of the sites, and the first place, are built for each key on
the map side and merge by aggregation, so no task sees all places of a common line. Keys whose estimate is clearly over the threshold are settled by it;
keys within the error band get an exact distinct count, over (line, site) pairs that were made distinct before the shuffle. Lines meet the keys in a join that is
salted: each key stands in ``salts`` copies and a line goes to one of them.
The first occurrence of a boilerplate line in the corpus stays; the others go.

Defined results. Null text stays null, with no lines. A null site counts as one site. Lines under
``min_chars`` code points when trimmed are never boilerplate. First means least doc_id (null last), then
text hash, then position; identical repeated rows share that place, and keep their line each. Very long texts are read whole, a line at a time. An empty table gives an empty result.
Other columns are kept; one named like the two that are added is replaced by it, whatever else they are called.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import Scratch, cut


@dataclass(frozen=True)
class LineSpread:
    """min_sites: distinct sites from which a line is boilerplate. lg_k: of the sketches (1.04 / sqrt(2^lg_k) relative
    error). sigmas: half width of the band that is counted exactly. salts: copies of a key in joins."""

    min_sites: int = 10
    min_chars: int = 20
    lg_k: int = 12
    sigmas: float = 3.0
    salts: int = 16

    @property
    def band(self) -> int:
        return max(1, math.ceil(self.sigmas * 1.04 / math.sqrt(2**self.lg_k) * self.min_sites))


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def line_table(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, tk, site, pos, h1, h2): one row for each line that is long enough."""
    # hashed and split before lines are made: no line's row carries the text
    split = docs.select(F.col("doc_id").alias("doc_id"), text_key(F.col("text")).alias("tk"), F.coalesce("source", F.lit("")).alias("site"), F.split("text", "\n", -1).alias("lines"))
    lines = split.select("doc_id", "tk", "site", F.posexplode("lines").alias("pos", "line"))
    line = F.trim("line")
    return lines.filter(F.length(line) >= min_chars).select("doc_id", "tk", "site", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit("second"), line).alias("h2"))


def place() -> Column:
    return F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "tk", "pos")


def salted(lines: DataFrame, keys: DataFrame, salts: int, how: str = "inner") -> DataFrame:
    """lines joined with one row for each (h1, h2), no key in one task."""
    on = ["h1", "h2", "salt"]
    many = keys.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return lines.withColumn("salt", F.pmod(F.xxhash64("doc_id", "tk", "pos"), F.lit(salts)).cast("int")).join(many, on, how).drop("salt")


def removals(docs: DataFrame, cfg: LineSpread) -> DataFrame:
    """(doc_id, tk, gone): the positions of the lines that go, for each document that has any."""
    lines, t = line_table(docs, cfg.min_chars), cfg.min_sites
    with Scratch(docs.sparkSession) as scratch:
        spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", cfg.lg_k)).alias("sites"), F.min(place()).alias("first")).filter(F.col("sites") >= t - cfg.band)
        seen = scratch.keep(salted(lines, scratch.keep(spread), cfg.salts))
        near = seen.filter(F.col("sites") <= t + cfg.band)
        exact = near.select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= t).select("h1", "h2")
        spots = seen.filter(F.col("sites") > t + cfg.band).unionByName(salted(near, exact, cfg.salts))
        gone = spots.filter(place() != F.col("first")).select("doc_id", "tk", "pos").distinct()
        return cut(gone.groupBy("doc_id", "tk").agg(F.sort_array(F.collect_list("pos")).alias("gone")))


def dedup_lines(docs: DataFrame, cfg: LineSpread = LineSpread()) -> DataFrame:
    """The given columns with boilerplate lines out of ``text``, and __n_lines and __n_removed."""
    own = [c for c in docs.columns if c not in ("__n_lines", "__n_removed")]
    i, tk, gone, held = (f"__{x}_{uuid.uuid4().hex}" for x in ("id", "tk", "gone", "lines"))
    found = removals(docs.select("doc_id", "text", "source"), cfg).select(F.col("doc_id").alias(i), F.col("tk").alias(tk), F.col("gone").alias(gone))
    # the same join at every size: texts are dealt by hash once, however small the other side
    out = docs.select(*own).join(found.hint("merge"), docs["doc_id"].eqNullSafe(F.col(i)) & (text_key(docs["text"]) == F.col(tk)), "left")
    # texts are split once, in a column of their own; the places that stay come from a hashed difference, so that a long text takes time by its lines
    out = out.withColumn(held, F.split("text", "\n", -1))
    lines = F.col(held)
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    rest = F.array_join(F.transform(stay, lambda k: F.get(lines, k)), "\n")
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    n_removed = F.when(F.col(gone).isNull(), 0).otherwise(F.size(gone)).cast("long")
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(rest)
    return out.select(*(text.alias(c) if c == "text" else F.col(c) for c in own), n_lines.alias("__n_lines"), n_removed.alias("__n_removed"))


def strip_boilerplate(docs: DataFrame, cfg: LineSpread = LineSpread()) -> DataFrame:
    """The documents without boilerplate lines; those that lost every worded line go, as each stays elsewhere."""
    out = dedup_lines(docs, cfg)
    return out.filter((F.col("__n_removed") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*docs.columns)
