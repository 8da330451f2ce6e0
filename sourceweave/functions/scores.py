"""Numeric score expressions of a verification report."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAKAGE_WEIGHT = 1.5
CONFLICT_FACTOR = 0.9
SCORE_DIGITS = 3


def _whole(total: Column) -> Column:
    return F.greatest(F.lit(1), total).cast("double")


def pass_rate(supported: Column, gaps: Column, total: Column) -> Column:
    """Share of claims that hold; may exceed 1 when a declared total is too small."""
    return (supported + gaps).cast("double") / _whole(total)


def confidence(supported: Column, gaps: Column, leakage: Column, conflicts: Column, total: Column) -> Column:
    base = pass_rate(supported, gaps, total)
    leak = F.when(
        leakage > 0, F.greatest(F.lit(0.0), 1.0 - (leakage.cast("double") / _whole(total)) * LEAKAGE_WEIGHT)
    ).otherwise(1.0)
    clash = F.when(conflicts > 0, CONFLICT_FACTOR).otherwise(1.0)
    return F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), base * leak * clash)), SCORE_DIGITS)


def clamp(c: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), c))
