"""Robust statistics and thresholds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.scores import robust_z
from telemill.operators.quantile import exact_quantiles, median_and_mad

SERIES = ("entity_id", "metric_id")


def fit_stats(df: DataFrame, keys: Sequence[str] = SERIES) -> DataFrame:
    """Robust and plain statistics per series, from observed non-null values only."""
    keys = list(keys)
    used = (F.col("quality") == "observed") & F.col("value").isNotNull()
    v = F.when(used, F.col("value").cast("double"))
    plain = df.groupBy(*keys).agg(
        F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.count(v).alias("count"), F.min(v).alias("min"), F.max(v).alias("max"),
        (F.count_if(~used | used.isNull()) / F.count(F.lit(1))).alias("non_observed_frac"),
    ).where(F.col("count") > 0)
    robust = median_and_mad(df.where(used), keys, "value")
    return robust.join(plain, keys)


def save_stats(stats: DataFrame, path: str) -> None:
    """The statistics as a table."""
    stats.write.mode("overwrite").parquet(path)


def stats_to_map(stats: DataFrame) -> DataFrame:
    """Series name ``entity::metric`` with its statistics."""
    fields = ("median", "mad", "mean", "std", "count", "min", "max", "non_observed_frac")
    return stats.select(
        F.concat_ws("::", *SERIES).alias("series"),
        F.map_from_arrays(F.array(*[F.lit(f) for f in fields]), F.array(*[F.col(f).cast("double") for f in fields])).alias("stats"),
    )


def map_to_stats(maps: DataFrame) -> DataFrame:
    """The reverse of :func:`stats_to_map`."""
    get = lambda f: F.col("stats")[f]
    at = F.instr("series", "::")
    return maps.select(
        F.expr("left(series, instr(series, '::') - 1)").alias("entity_id"),
        F.expr("substr(series, instr(series, '::') + 2)").alias("metric_id"),
        *[get(f).alias(f) for f in ("median", "mad", "mean", "std")], get("count").cast("long").alias("count"),
        get("min").alias("min"), get("max").alias("max"), F.coalesce(get("non_observed_frac"), F.lit(0.0)).alias("non_observed_frac"),
    ).where(at > 0)


def pot_thresholds(
    stats: DataFrame, calibration: DataFrame, quantile: float = 0.99, multiplier: float = 1.5, flat_value: float = 1.0, keys: Sequence[str] = SERIES
) -> DataFrame:
    """Threshold per fitted series from the calibration points (validation, or train where there is none).

    ``flat_value`` stands for series with zero MAD: 1.0 in the streaming
    detector, 1.5 in the event ring.
    """
    keys = list(keys)
    cal = calibration.where((F.col("quality") == "observed") & F.col("value").isNotNull())
    z = cal.join(stats.select(*keys, "median", "mad"), keys).select(*keys, F.abs(robust_z("value")).alias("z"))
    q = exact_quantiles(z, keys, "z", {"q": quantile})
    thr = (
        F.when(F.col("mad") <= 0, F.lit(flat_value)).when(F.col("q").isNull(), F.lit(4.0))
        .otherwise(F.greatest(F.lit(1.5), F.col("q") * multiplier))
    )
    return stats.select(*keys, "mad").join(q, keys, "left").select(*keys, thr.alias("threshold"))


def apply_adjustments(thresholds: DataFrame, adjustments: DataFrame) -> DataFrame:
    """Threshold * loosen / tighten per metric; ``adjustments`` holds (metric_id, loosen, tighten)."""
    one = F.lit(1.0)
    adj = thresholds.join(adjustments, "metric_id", "left")
    value = F.col("threshold") * F.coalesce("loosen", one) / F.coalesce("tighten", one)
    return adj.withColumn("threshold", value).drop("loosen", "tighten")
