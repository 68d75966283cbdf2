"""Column expressions for scores, saturation and identifiers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAD_SCALE = 1.4826


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def finite(v) -> Column:
    v = _c(v)
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def robust_z(v, median="median", mad="mad") -> Column:
    """(v - median) / (1.4826 MAD); 0 for a zero MAD or a value that is not finite."""
    v, median, mad = _c(v), _c(median), _c(mad)
    return F.when((mad > 0) & finite(v), (v - median) / (F.lit(MAD_SCALE) * mad)).otherwise(F.lit(0.0))


def plain_z(v, mean="mean", std="std") -> Column:
    """D3"""
    v, mean, std = _c(v), _c(mean), _c(std)
    return F.when((std > 0) & finite(v), (v - mean) / std).otherwise(F.lit(0.0))


def sigmoid(z, scale: float = 1.0) -> Column:
    """D3: stable on both sides."""
    x = F.lit(scale) * _c(z)
    e = F.exp(-F.abs(x))
    return F.when(x >= 0, F.lit(1.0) / (F.lit(1.0) + e)).otherwise(e / (F.lit(1.0) + e))


def incident_id(start, end, entity, hint) -> Column:
    """D23"""
    start, end, entity, hint = (_c(x) for x in (start, end, entity, hint))
    s, e = start.cast("string"), end.cast("string")
    digest = F.substring(F.sha1(F.concat_ws(":", s, e, entity).cast("binary")), 1, 8)
    return F.concat_ws("-", F.lit("inc"), s, e, hint, digest)


def array_median(a: Column) -> Column:
    """Median of a small array."""
    s = F.array_sort(a)
    n = F.size(a)
    lo = F.get(s, F.floor((n - 1) / 2).cast("int"))
    hi = F.get(s, F.floor(n / 2).cast("int"))
    return (lo + hi) / 2
