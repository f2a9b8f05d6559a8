"""Numeric helper."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c: str | Column) -> Column:
    return F.col(f"`{c}`") if isinstance(c, str) else c


def floor_amount(x: str | Column, floor: float = 0.01) -> Column:
    """NULL or below ``floor`` -> ``floor``."""
    return F.greatest(F.coalesce(_c(x), F.lit(floor)), F.lit(floor))
