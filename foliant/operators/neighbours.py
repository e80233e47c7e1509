"""Names within a few edits of one another, as a search: a deletion-neighbourhood index, and candidates verified by distance.

Two names within d insertions, deletions and substitutions share a string that either becomes by d deletions at most. So every name gives its strings of up to d deletions as keys, names meet on a key, and only those that meet are compared. Neighbouring letters that were swapped are two edits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def less_one(word: Column) -> Column:
    """The strings that are left when one letter goes."""
    at = F.sequence(F.lit(1), F.greatest(F.length(word), F.lit(1)))
    return F.transform(at, lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))


def deletions(word: Column, most: int) -> Column:
    """The word and what is left of it after up to so many deletions, each once."""
    out = level = F.array(word)
    for _ in range(most):
        level = F.array_distinct(F.flatten(F.transform(level, less_one)))
        out = F.array_union(out, level)
    return out


def near_names(rows: DataFrame, queries: DataFrame, key: str, name: str, most: int = 2, least: int = 3) -> DataFrame:
    """query, other, distance: for every query's name the other names within ``most`` edits, itself apart. Names are compared once for each spelling, however many rows have it; null names and names of fewer than ``least`` letters, which are within two edits of most others, meet nothing."""
    index = rows.filter(F.length(name) >= least).groupBy(F.col(name).alias("other")).agg(F.count(F.lit(1)).alias("rows"))
    asked = queries.filter(F.length(name) >= least).select(F.col(name).alias("query")).distinct()
    given = index.select("other", "rows", F.explode(deletions(F.col("other"), most)).alias("k"))
    met = asked.select("query", F.explode(deletions(F.col("query"), most)).alias("k")).join(given, "k").select("query", "other", "rows").distinct()
    distance = F.levenshtein("query", "other", most)
    return met.withColumn("distance", distance).filter("distance > 0").select("query", "other", "rows", "distance")
