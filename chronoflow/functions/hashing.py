"""Hash-based draws that every engine with md5 reproduces."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def joined(*parts) -> Column:
    return F.concat_ws("|", *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])


def hash_key(*parts) -> Column:
    """The md5 of the parts in hex: a shuffling order that a seed decides."""
    return F.md5(joined(*parts))


def hash_int(*parts) -> Column:
    """An integer in [0, 2**32) from the parts."""
    return F.conv(F.substring(F.md5(joined(*parts)), 1, 8), 16, 10).cast("long")


def unit(*parts) -> Column:
    """A number in [0, 1) from the parts."""
    return hash_int(*parts) / F.lit(float(1 << 32))
