"""Latency histograms: bins, building, merging, percentiles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE4_BINS, LOG2_BINS = 13, 64


def _bits(v: Column) -> Column:
    """Length of the binary form: floor(log2 v) + 1 for v > 0, exactly."""
    return F.length(F.bin(v))


def base4_bin(ns) -> Column:
    """Bin i covers [256 * 4^i, 256 * 4^(i+1)) ns; below is 0, above is 12."""
    ns = F.col(ns) if isinstance(ns, str) else ns
    i = F.floor((_bits(F.shiftright(ns, 8)) - 1) / 2).cast("int")
    return F.when(ns < 256, F.lit(0)).otherwise(F.least(F.lit(BASE4_BINS - 1), i))


def log2_bin(v) -> Column:
    """P20: floor(log2 v), 0 below 2."""
    v = F.col(v) if isinstance(v, str) else v
    return F.when(v < 2, F.lit(0)).otherwise(_bits(v) - 1)


KINDS = {"base4": (base4_bin, BASE4_BINS), "log2": (log2_bin, LOG2_BINS)}


def latency_stats(df: DataFrame, keys: Sequence[str], lat: str, kind: str = "base4", sums: dict[str, Column] | None = None) -> DataFrame:
    """count, lat_sum, histogram array and further sums per key.

    Rows shrink to one per (key, bin) in the map-side aggregate; a histogram
    then has at most 64 parts.
    """
    make, bins = KINDS[kind]
    sums = sums or {}
    cells = df.groupBy(*keys, make(lat).alias("__bin")).agg(
        F.count(F.lit(1)).alias("__n"), F.sum(lat).alias("__lat"), *[F.sum(c).alias(f"__s_{n}") for n, c in sums.items()]
    )
    parts = F.map_from_entries(F.collect_list(F.struct("__bin", "__n")))
    out = cells.groupBy(*keys).agg(
        F.sum("__n").alias("count"), F.sum("__lat").alias("lat_sum"), parts.alias("__m"), *[F.sum(f"__s_{n}").alias(n) for n in sums]
    )
    hist = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("__m", i), F.lit(0).cast("long")))
    return out.withColumn("hist", hist).drop("__m")


def hist_percentile_us(hist, q: float, kind: str = "base4") -> Column:
    """Lower edge, in microseconds, of the first bin that reaches max(1, trunc(total * q)); 0 when empty."""
    hist = F.col(hist) if isinstance(hist, str) else hist
    base, factor = (256, 4) if kind == "base4" else (1, 2)
    total = F.aggregate(hist, F.lit(0).cast("long"), lambda s, v: s + v)
    target = F.greatest(F.lit(1).cast("long"), F.floor(total * F.lit(q)).cast("long"))
    # number of leading bins whose running count stays below the target
    start = F.struct(F.lit(0).cast("long").alias("acc"), F.lit(0).alias("i"))
    walk = F.aggregate(
        hist, start,
        lambda s, v: F.struct((s["acc"] + v).alias("acc"), (s["i"] + F.when(s["acc"] + v < target, 1).otherwise(0)).alias("i")),
        lambda s: s["i"],
    )
    return F.when(total == 0, F.lit(0.0)).otherwise(F.lit(float(base)) * F.pow(F.lit(float(factor)), walk) / 1000.0)
