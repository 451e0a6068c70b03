"""Column helpers for code that was written for pandas: every one is a native expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.row import embedding_size, hashed


def str_slice(c: Column, start: int, stop: int) -> Column:
    """Series.str.slice with non-negative bounds."""
    return F.substring(c, start + 1, stop - start)


def str_replace(c: Column, old: str, new: str) -> Column:
    """Series.str.replace of plain text."""
    return F.replace(c, F.lit(old), F.lit(new))


def where(condition: Column, a: object, b: object) -> Column:
    """numpy.where: a null condition counts as false."""
    return F.when(condition, a).otherwise(b)


def isnull(c: Column) -> Column:
    """Series.isnull of a column that is not a float one."""
    return c.isNull()


def digitize(c: Column, boundaries: list) -> Column:
    """numpy.digitize with ascending boundaries."""
    total = F.lit(0)
    for b in boundaries:
        total = total + (c >= b).cast("int")
    return total


__all__ = ["digitize", "embedding_size", "hashed", "isnull", "str_replace", "str_slice", "where"]
