"""Scores as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RARE = 0.001
HALF = 0.02 * (40 - 15) / 15
GREEN, YELLOW = 85, 60


def surprise(prevalence: Column) -> Column:
    return F.log2(1 / F.greatest(prevalence, F.lit(RARE)))


def quality_score(minutes: Column, manual: Column, cap: Column) -> Column:
    """100 less a saturating penalty, below the cap, half-even."""
    share = F.when(manual > 0, minutes / manual)
    return F.bround(F.greatest(F.lit(0.0), F.least(100 - 40 * share / (share + F.lit(HALF)), cap)))


def band(score: Column) -> Column:
    return F.when(score.isNull(), None).when(score >= GREEN, "green").when(score >= YELLOW, "yellow").otherwise("red")


def clamp_confidence(text: Column) -> Column:
    """Anything to a number in [0, 1]; what isn't one is 0."""
    x = text.try_cast("double")
    return F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))
