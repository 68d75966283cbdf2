"""Time windows, grid alignment and splits (W family)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.functions.integers import floor_div
from telemill.operators import ordered


def _floor_to(col: Column, step: int) -> Column:
    return col - F.pmod(col, F.lit(step))


def sliding_windows(df: DataFrame, window_ns: int, stride_ns: int, ts: str = "ts_ns") -> DataFrame:
    """One row per point and window [w_start, w_end) that covers it.

    Starts lie on the stride grid, the first one at the floor of the smallest
    timestamp; empty windows do not appear.
    """
    t = F.col(ts)
    origin = df.agg(_floor_to(F.min(ts), stride_ns)).scalar()
    last = _floor_to(t, stride_ns)
    first = F.greatest(_floor_to(t - window_ns, stride_ns) + stride_ns, origin)
    starts = F.when(first <= last, F.sequence(first, last, F.lit(stride_ns)))
    out = df.withColumn("w_start", F.explode(starts))
    return out.withColumn("w_end", F.col("w_start") + window_ns)


def align_grid(
    windowed: DataFrame,
    interval_ns: int,
    keys: Sequence[str] = ("entity_id", "metric_id"),
    order: Sequence[str] | None = None,
) -> DataFrame:
    """Long grid (w_start, w_end, keys, cell_ts, value, observed).

    The last non-null value of a cell wins, by time, then ``seq`` where there is one, then value. A metric present in a window gets
    every cell of it; cells without a point have a null value. The cells of
    one window are bounded by window/interval, so they travel as one map.
    """
    group = ["w_start", "w_end", *keys]
    order = order or [c for c in ("ts_ns", "seq", "value") if c in windowed.columns]
    cell = F.col("ts_ns") - F.pmod(F.col("ts_ns"), F.lit(interval_ns))
    payload = F.struct(F.col("value").cast("double").alias("v"), (F.col("quality") == "observed").alias("o"))
    won = (
        windowed.withColumn("cell_ts", cell)
        .groupBy(*group, "cell_ts")
        .agg(F.max_by(payload, F.when(F.col("value").isNotNull(), F.struct(*order))).alias("c"))
    )
    packed = won.groupBy(*group).agg(
        F.map_from_entries(F.collect_list(F.when(F.col("c").isNotNull(), F.struct("cell_ts", "c")))).alias("m")
    )
    start = F.col("w_start") - F.pmod(F.col("w_start"), F.lit(interval_ns))
    cells = F.sequence(start, F.col("w_end") - 1, F.lit(interval_ns))
    return packed.withColumn("cell_ts", F.explode(cells)).select(
        *group,
        "cell_ts",
        F.try_element_at("m", F.col("cell_ts"))["v"].alias("value"),
        F.coalesce(F.try_element_at("m", F.col("cell_ts"))["o"], F.lit(False)).alias("observed"),
    )


def infer_interval(df: DataFrame, chunk: Column | None = None, ts: str = "ts_ns") -> DataFrame:
    """Most common gap between distinct timestamps (ties: the gap seen first), as one row ``gap``."""
    distinct = df.select(F.col(ts).alias("ts_ns")).distinct()
    gaps = ordered.previous(distinct, [], ["ts_ns"], {"p": "ts_ns"}, chunk if chunk is not None else ordered.by_time())
    counted = (
        gaps.where(F.col("p").isNotNull())
        .groupBy((F.col("ts_ns") - F.col("p")).alias("gap"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("ts_ns").alias("first_ts"))
    )
    return counted.agg(F.max_by("gap", F.struct("n", -F.col("first_ts"))).alias("gap"))


def split_by_time(df: DataFrame, train: float, val: float, ts: str = "ts_ns") -> DataFrame:
    """Add ``split``; the cuts depend on the time range only, never on labels."""
    lo, hi = F.min(ts), F.max(ts)
    span = (hi - lo).cast("double")
    cuts = df.agg(
        F.struct(
            (lo + (span * train).cast("long")).alias("c1"), (lo + (span * (train + val)).cast("long")).alias("c2")
        )
    ).scalar()
    cuts_col = df.withColumn("__c", cuts)
    label = F.when(F.col(ts) <= F.col("__c.c1"), "train").when(F.col(ts) <= F.col("__c.c2"), "val").otherwise("test")
    return cuts_col.withColumn("split", label).drop("__c")


def decimate(df: DataFrame, n: int, keys: list[str], order: list[str], chunk: Column) -> DataFrame:
    """Every n-th row by position."""
    idx = ordered.with_index(df, keys, order, chunk, "__i")
    return idx.where(F.col("__i") % n == 0).drop("__i")


def label_incident(df: DataFrame, inject_s: int | Column, ts: str = "ts_ns") -> DataFrame:
    """Baseline before the injection second, incident from it on."""
    sec = floor_div(F.col(ts), F.lit(1_000_000_000))
    return df.withColumn("phase", F.when(sec < inject_s, "baseline").otherwise("incident"))


def range_join(
    spans: DataFrame, points: DataFrame, start: str, end: str, ts: str, bucket: int, on: Sequence[str] = ()
) -> DataFrame:
    """Rows of ``points`` with start <= ts <= end, via an equi-join on time buckets.

    A span is copied once per bucket it touches; the bucket width should match
    the usual span length. A bucket that holds very many points is split by
    the adaptive skew join.
    """
    b = lambda c: floor_div(F.col(c), F.lit(bucket))
    left = spans.withColumn("__b", F.explode(F.sequence(b(start), b(end))))
    right = points.withColumn("__b", b(ts))
    joined = left.join(right, [*on, "__b"])
    return joined.where(F.col(ts).between(F.col(start), F.col(end))).drop("__b")


def extract_around(episodes: DataFrame, series: DataFrame, pre_ns: int, bucket: int, on: Sequence[str] = ()) -> DataFrame:
    """Records from ``pre_ns`` before the episode start up to its end."""
    spans = episodes.withColumns({"__lo": F.col("start_ns") - pre_ns, "__hi": F.col("end_ns")})
    return range_join(spans, series, "__lo", "__hi", "ts_ns", bucket, on).drop("__lo", "__hi")


def merge_slices(
    df: DataFrame,
    interval_ns: int,
    sums: Sequence[str],
    hists: Sequence[str],
    bins: int = 13,
    flags: str | None = None,
    identity: Sequence[str] = (),
    key: str = "tid",
) -> DataFrame:
    """One record per (tid, interval): summed counters and histograms, newest ts, ORed flags, first identity."""
    bucket = floor_div(F.col("ts_ns"), F.lit(interval_ns))
    aggs = [F.max("ts_ns").alias("last_ts")]
    aggs += [F.sum(c).alias(c) for c in sums]
    for h in hists:
        aggs.append(F.array(*[F.coalesce(F.sum(F.get(h, F.lit(i))), F.lit(0)) for i in range(bins)]).alias(h))
    if flags:
        aggs.append(F.bit_or(flags).alias(flags))
    aggs += [F.min_by(c, F.struct("ts_ns", "seq")).alias(c) for c in identity]
    return df.groupBy(key, bucket.alias("bucket")).agg(*aggs).withColumnRenamed("last_ts", "ts_ns")


def retain(df: DataFrame, warmup_ns: int, window_ns: int) -> DataFrame:
    """Keep the last warm-up plus two windows."""
    newest = df.agg(F.max("ts_ns")).scalar()
    return df.where(F.col("ts_ns") >= newest - (warmup_ns + 2 * window_ns))


def ring_gaps(df: DataFrame, keys: list[str], capacity: int, chunk: Column) -> DataFrame:
    """Drains whose head moved by at least the ring capacity less 64."""
    prev = ordered.previous(df, keys, ["ts_ns"], {"from_head": "head"}, chunk)
    return prev.where(F.col("head") - F.col("from_head") >= capacity - 64).select(
        *keys, "ts_ns", "from_head", F.col("head").alias("to_head")
    )


def last_and_trailing_mean(df: DataFrame, keys: Sequence[str], x: str = "x", y: str = "y", span: float = 60) -> DataFrame:
    """Last non-null value and the mean of the last ``span`` units of x."""
    ends = df.groupBy(*keys).agg(
        F.max(x).alias("__hi"),
        F.min(x).alias("__lo"),
        F.max_by(y, F.when(F.col(y).isNotNull(), F.col(x))).alias("last"),
    )
    inside = df.join(ends, list(keys)).where(F.col(x) >= F.greatest(F.col("__hi") - span, F.col("__lo")))
    return inside.groupBy(*keys).agg(F.max("last").alias("last"), F.avg(y).alias("mean"))


def decimate_min_max(df: DataFrame, keys: Sequence[str], lo: Column, hi: Column, width: int, x: str = "x", y: str = "y") -> DataFrame:
    """Per pixel bucket the extremes, count and last point; what is drawn is min and max for more than two points, else the last."""
    fx, fy = F.col(x), F.col(y)
    finite = fy.isNotNull() & ~F.isnan(fy) & (F.abs(fy) < F.lit(float("inf")))
    px = F.floor((fx - lo) / (hi - lo) * F.lit(width))
    bucket = F.greatest(F.lit(0), F.least(F.lit(width - 1), px)).cast("long")
    kept = df.where(finite & fx.between(lo, hi))
    return kept.groupBy(*keys, bucket.alias("bucket")).agg(
        F.min(y).alias("mn"), F.max(y).alias("mx"), F.count(F.lit(1)).alias("n"),
        F.max(x).alias("last_x"), F.max_by(y, x).alias("last_y"),
    ).withColumns({
        "draw_lo": F.when(F.col("n") > 2, F.col("mn")).otherwise(F.col("last_y")),
        "draw_hi": F.when(F.col("n") > 2, F.col("mx")).otherwise(F.col("last_y")),
    })


def relative_time(df: DataFrame, host: DataFrame, anomaly: DataFrame) -> DataFrame:
    """X in seconds since the first host sample, else the first anomaly sample, else 0."""
    t0 = F.coalesce(host.agg(F.min("ts_ns")).scalar(), anomaly.agg(F.min("ts_ns")).scalar(), F.lit(0))
    return df.withColumn("x", (F.col("ts_ns") - t0) / F.lit(1e9))
