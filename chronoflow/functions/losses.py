"""Losses of a score (logit or guess) against the truth, as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def bce(z: Column, y: Column) -> Column:
    """Binary cross-entropy of a logit, in the form that never overflows."""
    return F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))


def hinge(z: Column, y: Column, margin: float = 1.0) -> Column:
    return F.greatest(F.lit(0.0), margin - (2 * y - 1) * z)


def huber(guess: Column, truth: Column, delta: float = 1.0) -> Column:
    gap = F.abs(guess - truth)
    return F.when(gap <= delta, 0.5 * gap * gap).otherwise(delta * (gap - 0.5 * delta))
