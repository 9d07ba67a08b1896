"""Scalar and array functions of features."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NEVER = -1e9


def ln1(x: Column) -> Column:
    """ln(1 + x), written so that engines agree to the last rounded digit."""
    return F.ln(F.lit(1.0) + x)


def time_encoding(dt: Column, dim: int) -> Column:
    """cos(dt * w) for frequencies w from 1 down to 1e-4, evenly spaced in the exponent."""
    w = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.pow(F.lit(10.0), -4.0 * i / max(dim - 1, 1)))
    return F.transform(w, lambda x: F.cos(dt * x))


def negated_recency(now: Column, last: Column) -> Column:
    """Days since ``last``, negated so that larger is more recent; ``NEVER`` without one."""
    return F.coalesce((last - now).cast("double"), F.lit(NEVER))


def logsumexp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.ln(F.aggregate(values, F.lit(0.0), lambda a, x: a + F.exp(x - top)))
