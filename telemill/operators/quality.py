"""Validation and quality control (Q family)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telemill.operators import ordered
from telemill.schemas import ENTITY_TYPES, POINT_KEY, QUALITIES, SOURCES


def validate_points(df: DataFrame) -> DataFrame:
    """Q1: add ``reason`` (null when valid)."""
    reason = (
        F.when(F.col("ts_ns").isNull() | (F.col("ts_ns") < 0), "bad_ts")
        .when(~F.coalesce(F.col("entity_type").isin(*ENTITY_TYPES), F.lit(False)), "bad_entity_type")
        .when(~F.coalesce(F.col("source").isin(*SOURCES), F.lit(False)), "bad_source")
        .when(~F.coalesce(F.col("quality").isin(*QUALITIES), F.lit(False)), "bad_quality")
        .when(F.col("sample_interval_ns") <= 0, "bad_interval")
    )
    return df.withColumn("reason", reason)


def split_rejects(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return df.where(F.col("reason").isNull()).drop("reason"), df.where(F.col("reason").isNotNull())


def validate_spans(df: DataFrame) -> DataFrame:
    """Q2: blank ids, end before start, repeated (trace_id, span_id)."""
    repeats = (
        df.groupBy("trace_id", "span_id").agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > 1)
    )
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    reason = (
        F.when(blank("trace_id") | blank("span_id"), "blank_id")
        .when(F.col("end_ts_ns") < F.col("start_ts_ns"), "end_before_start")
        .when(F.col("__n") > 1, "duplicate")
    )
    return df.join(repeats, ["trace_id", "span_id"], "left").withColumn("reason", reason).drop("__n")


def find_duplicates(df: DataFrame, key: Sequence[str] = POINT_KEY) -> DataFrame:
    """Q3"""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def partition_quality(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Q4"""
    observed = F.col("quality") == "observed"
    return df.where(observed), df.where(~observed)


def summarize_quality(df: DataFrame) -> DataFrame:
    """Q5"""
    return df.groupBy("quality").agg(F.count(F.lit(1)).alias("n"))


def slice_window(df: DataFrame, start_ns: int, end_ns: int) -> DataFrame:
    """Q6: closed at both ends."""
    return df.where(F.col("ts_ns").between(start_ns, end_ns))


def entity_metrics(df: DataFrame) -> DataFrame:
    """Q7"""
    return df.select("entity_id", "metric_id").distinct()


def out_of_order(
    df: DataFrame,
    arrival: str,
    chunk: Column,
    tolerance_ns: int = 5_000_000_000,
    source: Sequence[str] = (),
    key: Sequence[str] = POINT_KEY,
) -> DataFrame:
    """Q8: label each arriving row ``accepted``, ``late`` or ``duplicate``.

    A rejected row never moves the newest time (it lies behind it), so the
    running maximum over all earlier arrivals equals that over accepted ones.
    """
    keys = list(source)
    seen = ordered.running(df, keys, [arrival], {"__newest": ("max", F.col("ts_ns"))}, chunk, include_current=False)
    late = F.col("__newest").isNotNull() & (F.col("ts_ns") < F.col("__newest") - tolerance_ns)
    seen = seen.withColumn("__late", late)
    firsts = (
        seen.where(~F.col("__late")).groupBy(*keys, *key).agg(F.min(arrival).alias("__first"))
    )
    status = (
        F.when(F.col("__late"), "late").when(F.col(arrival) > F.col("__first"), "duplicate").otherwise("accepted")
    )
    return (
        seen.join(firsts, [*keys, *key], "left").withColumn("status", status).drop("__newest", "__late", "__first")
    )


def real_mid_stream_gap(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Q9: per window, is the first unobserved cell between observed ones.

    ``cells`` holds the aligned grid (keys, cell_ts, observed) over all metrics.
    """
    per_cell = cells.groupBy(*keys, "cell_ts").agg(F.max(F.col("observed").cast("int")).alias("__o"))
    agg = per_cell.groupBy(*keys).agg(
        F.min(F.when(F.col("__o") == 0, F.col("cell_ts"))).alias("__miss"),
        F.min(F.when(F.col("__o") == 1, F.col("cell_ts"))).alias("__first"),
        F.max(F.when(F.col("__o") == 1, F.col("cell_ts"))).alias("__last"),
    )
    gap = (F.col("__first") < F.col("__miss")) & (F.col("__last") > F.col("__miss"))
    return agg.withColumn("gap", F.coalesce(gap, F.lit(False))).select(*keys, "gap")


def run_id_on_reuse(df: DataFrame, keys: list[str], order: list[str], start_time: str, chunk: Column) -> DataFrame:
    """Q10: number the lifetimes of a reused pid; counters must not be compared across runs."""
    df = ordered.previous(df, keys, order, {"__st": start_time}, chunk)
    new = F.coalesce(F.col("__st") != F.col(start_time), F.lit(False))
    return ordered.islands(df, keys, order, new, chunk, "run").drop("__st")


def gate_valid(df: DataFrame, flag: str = "valid") -> DataFrame:
    """Q11"""
    return df.where(F.col(flag) == 1)


def metric_coverage(df: DataFrame, required: DataFrame) -> DataFrame:
    """Q12: required (layer, metric_id) pairs that an entity never reported."""
    have = df.select("entity_id", "metric_id").distinct()
    layers = required.groupBy("layer").agg(F.collect_set("metric_id").alias("__need"))
    packed = layers.agg(F.collect_list(F.struct("layer", "__need")).alias("__all")).scalar()
    want = (
        df.select("entity_id").distinct()
        .withColumn("__l", F.explode(packed))
        .select("entity_id", "__l.layer", F.explode("__l.__need").alias("metric_id"))
    )
    return want.join(have, ["entity_id", "metric_id"], "left_anti")
