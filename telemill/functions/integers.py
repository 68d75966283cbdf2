"""Exact integer arithmetic on longs; nanosecond times do not fit a double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(a, b) -> Column:
    """a // b on longs, rounding down for negative a as well; b > 0."""
    a = F.col(a) if isinstance(a, str) else a
    b = F.lit(b) if isinstance(b, int) else b
    return F.call_function("div", a - F.pmod(a, b), b)
