"""Index arithmetic between the labelled box ("inner") and the whole image ("outer")."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def row_of(flat: Column, width: Column | int) -> Column:
    return F.floor(flat / width).cast("bigint")


def col_of(flat: Column, width: Column | int) -> Column:
    return F.pmod(flat, F.lit(width) if isinstance(width, int) else width).cast("bigint")


def flat_of(r: Column, c: Column, width: Column | int) -> Column:
    return r * width + c


def inner_to_outer(inner: Column, inner_width, r0, c0, outer_width) -> Column:
    return flat_of(row_of(inner, inner_width) + r0, col_of(inner, inner_width) + c0, outer_width)


def outer_to_inner(outer: Column, outer_width, r0, c0, inner_width) -> Column:
    return flat_of(row_of(outer, outer_width) - r0, col_of(outer, outer_width) - c0, inner_width)


def reflect(index: Column, size: Column | int) -> Column:
    """Mirror an index into [0, size) with the edge sample repeated."""
    period = size * 2
    folded = F.pmod(index, F.lit(period) if isinstance(period, int) else period)
    return F.when(folded >= size, period - 1 - folded).otherwise(folded)


def gray(value: Column) -> Column:
    """A value in [0, 1] as an 8-bit gray level, truncated and clamped."""
    return F.least(F.lit(255), F.greatest(F.lit(0), (value * 255).cast("int")))
