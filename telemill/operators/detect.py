"""Anomaly detectors over sliding windows and merged incidents (D family)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.functions.integers import floor_div
from telemill.functions.scores import MAD_SCALE, array_median, finite, incident_id, robust_z
from telemill.operators import ordered, stats as st, windows
from telemill.operators.quality import real_mid_stream_gap
from telemill.operators.quantile import exact_quantiles, median_and_mad
from telemill.session import cut

WIN = ["w_start", "w_end", "entity_id"]


def _observed(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("observed") & finite("value"))


def _direction(col: Column, pivot) -> Column:
    return F.when(col > pivot, "up").otherwise("down")


# ---- streaming robust detector ----


def score_windows_streaming(
    cells: DataFrame, stats: DataFrame, thresholds: DataFrame, alpha: float = 0.2, min_observed_frac: float = 0.5, state_metrics: DataFrame | None = None
) -> DataFrame:
    """Rows (window, entity, metric_id, score, direction) of anomalous windows.

    The EWMA of the robust z restarts in every window; a window's cells are
    bounded by its grid, so they are folded as an array. ``_quality`` stands
    for a real mid-stream gap; other windows that miss too much are dropped.
    ``state_metrics`` holds (w_start, metric_id) handled by the state branch.
    """
    fraction = cells.groupBy(*WIN).agg((1 - F.count_if("observed") / F.count(F.lit(1))).alias("missing"))
    gap = real_mid_stream_gap(cells, WIN)
    quality = fraction.join(gap, WIN).withColumn("thin", F.col("missing") > min_observed_frac)
    numeric = cells
    if state_metrics is not None:
        numeric = cells.join(state_metrics, ["w_start", "metric_id"], "left_anti")
    series = (
        _observed(numeric).groupBy(*WIN, "metric_id").agg(F.array_sort(F.collect_list(F.struct("cell_ts", "value"))).alias("a"))
    )
    j = series.join(stats.select(*st.SERIES, "median", "mad"), list(st.SERIES)).join(thresholds, list(st.SERIES), "left")
    thr = F.coalesce("threshold", F.lit(4.0))
    zs = F.transform("a", lambda c: robust_z(c["value"]))
    ew = F.aggregate(F.slice(zs, 2, F.size(zs)), F.get(zs, F.lit(0)), lambda y, z: F.lit(alpha) * z + F.lit(1 - alpha) * y)
    scored = j.withColumn("e", ew).where(F.abs("e") > thr)
    scored = scored.select(*WIN, "metric_id", F.least(F.lit(1.0), F.abs("e") / F.greatest(thr, F.lit(1e-9))).alias("score"), _direction(F.col("e"), 0).alias("direction"))
    kept = scored.join(quality.where("thin AND NOT gap").select(*WIN), WIN, "left_anti")
    holes = quality.where("thin AND gap").select(
        *WIN, F.lit("_quality").alias("metric_id"), F.col("missing").alias("score"), F.lit("missing").alias("direction")
    )
    return kept.unionByName(holes)


def observe_points(points: DataFrame, stats: DataFrame, thresholds: DataFrame, order: list[str], chunk: Column, alpha: float = 0.2) -> DataFrame:
    """D8 in batch: EWMA of the robust z over the whole series, one row per observed point."""
    obs = points.where((F.col("quality") == "observed") & F.col("value").isNotNull())
    z = obs.join(stats.select(*st.SERIES, "median", "mad"), list(st.SERIES)).withColumn("z", robust_z("value"))
    e = ordered.ewma(z, list(st.SERIES), order, "z", alpha, chunk)
    j = e.join(thresholds, list(st.SERIES), "left")
    thr = F.coalesce("threshold", F.lit(4.0))
    hit = F.abs("ewma") > thr
    return j.withColumns({
        "anomaly": hit,
        "score": F.when(hit, F.least(F.lit(1.0), F.abs("ewma") / F.greatest(thr, F.lit(1e-9)))),
        "direction": F.when(hit, _direction(F.col("ewma"), 0)),
    }).drop("z", "median", "mad", "threshold")


def merge_incidents(scored: DataFrame, rule: str = "streaming", window_chunk: int = 32 * ordered.DAY_NS) -> DataFrame:
    """Merge overlapping or touching windows of an entity into incidents.

    ``streaming``: a later "down" never replaces a direction. ``first``: the
    first direction stays. ``cascade``: as ``first``, the status rises to
    anomaly, and an uncertain incident keeps 0.6 of its severity.
    """
    scored = cut(scored)
    spans = scored.groupBy(*WIN).agg(F.max("status").alias("st")) if rule == "cascade" else scored.select(*WIN).distinct()
    groups = ordered.merge_spans(spans, ["entity_id"], "w_start", "w_end", ordered.by_time("w_start", window_chunk))
    groups = cut(groups)
    rows = scored.drop("status").join(groups, WIN)
    if rule in ("first", "cascade"):
        direction = F.min_by("direction", "w_start")
    else:
        direction = F.coalesce(F.max_by(F.col("direction"), F.when(F.col("direction") != "down", F.col("w_start"))), F.lit("down"))
    per_metric = rows.groupBy("entity_id", "island", "metric_id").agg(
        F.max("score").alias("score"), direction.alias("direction"), F.min("w_start").alias("first_w")
    )
    rank = F.struct(-F.col("score"), F.col("first_w"), (F.col("metric_id") == "_quality").cast("int"), F.col("metric_id"))
    merged = per_metric.groupBy("entity_id", "island").agg(
        F.max("score").alias("top"), F.min_by("metric_id", rank).alias("hint"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric_id", "score")))).alias("metric_scores"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric_id", "direction")))).alias("directions"),
    )
    span_aggs = [F.min("w_start").alias("start_ts_ns"), F.max("w_end").alias("end_ts_ns")]
    if rule == "cascade":
        span_aggs.append(F.min("st").alias("status"))  # "anomaly" sorts before "uncertain"
    extent = groups.groupBy("entity_id", "island").agg(*span_aggs)
    out = merged.join(extent, ["entity_id", "island"])
    status = F.col("status") if rule == "cascade" else F.lit("anomaly")
    severity = F.least(F.lit(1.0), F.col("top"))
    if rule == "cascade":
        severity = F.when(F.col("status") == "uncertain", severity * 0.6).otherwise(severity)
    return out.select(
        "entity_id", incident_id("start_ts_ns", "end_ts_ns", "entity_id", "hint").alias("incident_id"), "start_ts_ns", "end_ts_ns",
        status.alias("status"), severity.alias("severity"), "metric_scores", "directions",
    )


def suppress(incidents: DataFrame, rejected: DataFrame) -> DataFrame:
    """D25"""
    return incidents.join(rejected.select("incident_id").distinct(), "incident_id", "left_anti")


# ---- event ring ----


def event_scores(cells: DataFrame, stats: DataFrame, thresholds: DataFrame) -> DataFrame:
    """Max |z| against the threshold; a fitted metric without any observed cell is ``_quality``."""
    agg = (
        cells.withColumn("v", F.when(F.col("observed") & finite("value"), F.col("value")))
        .join(stats.select(*st.SERIES, "median", "mad"), list(st.SERIES))
        .groupBy(*WIN, "metric_id")
        .agg(F.max(F.abs(robust_z("v"))).alias("z0"), F.count("v").alias("n"), F.avg("v").alias("m"), F.first("median").alias("median"))
        .join(thresholds, list(st.SERIES), "left")
    )
    thr = F.coalesce("threshold", F.lit(4.0))
    hits = agg.where((F.col("n") > 0) & (F.col("z0") > thr)).select(
        *WIN, "metric_id", F.least(F.lit(1.0), F.col("z0") / F.greatest(thr, F.lit(1e-9))).alias("score"), _direction(F.col("m"), F.col("median")).alias("direction")
    )
    empty = agg.where("n = 0").select(*WIN).distinct().select(*WIN, F.lit("_quality").alias("metric_id"), F.lit(1.0).alias("score"), F.lit("missing").alias("direction"))
    return hits.unionByName(empty)


def event_ring(cells: DataFrame, stats: DataFrame, band: int = 3) -> DataFrame:
    """Per window and entity, residual, change point, band energy, missing fraction, confidence and direction."""
    seen = F.when(F.col("observed") & finite("value"), F.struct("cell_ts", "value"))
    per = cells.groupBy(*WIN, "metric_id").agg(F.array_sort(F.collect_list(seen)).alias("a"), F.count(F.lit(1)).alias("cells"))
    per = per.join(stats.select(*st.SERIES, "median", "mad"), list(st.SERIES), "left")
    per = per.withColumn("x", F.transform("a", lambda c: c["value"])).withColumn("n", F.size("x"))
    count = F.nullif(F.col("n"), F.lit(0))
    per = per.withColumn("mu", F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / count)
    std = F.sqrt(F.aggregate("x", F.lit(0.0), lambda s, v: s + (v - F.col("mu")) * (v - F.col("mu"))) / count)
    per = per.withColumn("sd", std)
    z = F.when(F.col("median").isNotNull(), F.transform("x", lambda v: robust_z(v))).otherwise(
        F.transform("x", lambda v: (v - F.col("mu")) / (F.col("sd") + 1e-9))
    )
    diffs = F.zip_with(F.slice("x", 2, F.greatest(F.col("n") - 1, F.lit(0))), F.slice("x", 1, F.greatest(F.col("n") - 1, F.lit(0))), lambda b, a: b - a)
    per = per.withColumns({"z": z, "d": diffs})
    per = per.withColumn("md", array_median(F.col("d")))
    per = per.withColumn("ad", array_median(F.transform("d", lambda d: F.abs(d - F.col("md")))) + 1e-9)
    change = F.when(F.col("n") >= 3, F.array_max(F.transform("d", lambda d: F.abs(d - F.col("md")) / F.col("ad"))))

    def energy(i):
        w = F.slice("d", i, band)
        m = F.aggregate(w, F.lit(0.0), lambda s, v: s + v) / band
        return F.aggregate(w, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / band

    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("d") - (band - 1)))
    bands = F.when(F.col("n") >= band + 2, F.array_max(F.transform(starts, energy)))
    total = lambda f: F.aggregate("z", F.lit(0.0), f)
    per = per.select(
        *WIN, "metric_id", "n", "cells", change.alias("cp"), bands.alias("be"), F.array_max(F.transform("z", F.abs)).alias("mz"),
        total(lambda s, v: s + F.abs(v)).alias("sz"),
        F.exists("z", lambda v: v > 2.0).alias("pos"), F.exists("z", lambda v: v < -2.0).alias("neg"),
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    ring = per.groupBy(*WIN).agg(
        zero(F.max("mz")).alias("max_residual_z"),
        F.when(F.sum("n") > 0, F.sum("sz") / F.sum("n")).otherwise(0.0).alias("mean_residual_z"),
        zero(F.max("cp")).alias("max_change_point"), zero(F.max("be")).alias("max_band_energy"),
        (1 - F.sum("n") / F.sum("cells")).alias("missing_frac"), F.count(F.lit(1)).alias("n_metrics"), F.sum("n").alias("n_observed"),
        F.max("pos").alias("pos"), F.max("neg").alias("neg"),
    )
    signal = F.when(F.col("max_residual_z") > 0.5, F.least(F.lit(1.0), F.col("max_residual_z") / 8.0)).otherwise(0.3)
    return ring.withColumns({
        "confidence": 0.7 * (1 - F.col("missing_frac")) + 0.3 * signal,
        "direction": F.when(F.col("pos") & F.col("neg"), "mixed").when(F.col("pos"), "up").when(F.col("neg"), "down").otherwise("flat"),
    }).drop("pos", "neg")


def trend_gate(ring: DataFrame, events: DataFrame, cells: DataFrame, max_missing: float = 0.5, confidence: float = 0.6, drift_z: float = 1.5) -> DataFrame:
    """Per window, keep/drop and whether the trend branch must run.

    A window that misses more than ``max_missing`` is dropped unless it has a
    real gap, which is a quality trigger.
    """
    ev = events.groupBy(*WIN).agg(F.count(F.lit(1)).alias("n_ev"), F.max((F.col("metric_id") == "_quality").cast("int")).alias("q_ev"))
    g = ring.join(ev, WIN, "left").join(real_mid_stream_gap(cells, WIN), WIN)
    thin = F.col("missing_frac") > max_missing
    g = g.where(~thin | F.col("gap")).withColumn("thin", thin)
    quality = F.col("thin") | (F.coalesce("q_ev", F.lit(0)) == 1)
    g = g.withColumn("quality_trigger", quality)
    g = g.withColumn("event_trigger", (F.coalesce("n_ev", F.lit(0)) > 0) & ~F.col("quality_trigger"))
    drift = (F.col("mean_residual_z") > drift_z) & ~F.col("event_trigger")
    need = F.col("event_trigger") | (F.col("confidence") < confidence) | drift | F.col("quality_trigger")
    return g.withColumn("need_trend", need).withColumn(
        "quality_score", F.when(F.col("thin"), F.least(F.lit(1.0), F.col("missing_frac"))).when(F.col("quality_trigger"), F.lit(1.0))
    ).select(*WIN, "missing_frac", "confidence", "event_trigger", "quality_trigger", "quality_score", "need_trend")


def consistency_gate(events: DataFrame, trends: DataFrame, gate: DataFrame) -> DataFrame:
    """Rows (window, entity, metric_id, score, direction, status) of the windows that report.

    A metric both rings flag in one direction is strong. Windows with a strong
    metric are anomalies; else quality alone, else single-ring metrics, make
    the window uncertain.
    """
    e = events.where("metric_id <> '_quality'").select(*WIN, "metric_id", F.col("score").alias("e_s"), F.col("direction").alias("e_d"))
    t = trends.select(*WIN, "metric_id", F.col("score").alias("t_s"), F.col("direction").alias("t_d"))
    both = e.join(t, [*WIN, "metric_id"], "full").join(gate.select(*WIN, "quality_trigger", "quality_score"), WIN)
    both = both.withColumn("strong", F.coalesce(F.col("e_d") == F.col("t_d"), F.lit(False)))
    both = both.withColumns({"score": F.greatest("e_s", "t_s"), "direction": F.coalesce("e_d", "t_d")})
    any_strong = both.groupBy(*WIN).agg(F.max("strong").alias("any_strong"))
    both = both.join(any_strong, WIN)
    metrics = both.where(F.col("any_strong") | ~F.col("quality_trigger")).withColumn("status", F.when(F.col("any_strong"), "anomaly").otherwise("uncertain"))
    holes = gate.where("quality_trigger").join(any_strong, WIN, "left").select(
        *WIN, F.lit("_quality").alias("metric_id"), F.col("quality_score").alias("score"), F.lit("missing").alias("direction"),
        F.when(F.coalesce("any_strong", F.lit(False)), "anomaly").otherwise("uncertain").alias("status"),
    )
    return metrics.select(*WIN, "metric_id", "score", "direction", "status").unionByName(holes)


def fit_state_memory(points: DataFrame) -> DataFrame:
    """Per state series and state id, median and MAD of the id itself (so always the id and 0)."""
    sid = F.bround("value", 0).cast("long")
    s = points.where(F.col("is_state") & F.col("value").isNotNull()).select(*st.SERIES, sid.alias("state_id"))
    return s.groupBy(*st.SERIES, "state_id").agg(F.count(F.lit(1)).alias("n")).withColumns(
        {"median": F.col("state_id").cast("double"), "mad": F.lit(0.0)}
    )


def state_branch(scored: DataFrame, cells: DataFrame, memory: DataFrame, state_series: DataFrame) -> DataFrame:
    """Halve a metric's score when its last value lies in the band of the window's known state.

    ``state_series`` lists the (entity_id, metric_id) state series; the last
    observed value of one names the state. An unknown state changes nothing.
    """
    obs = _observed(cells)
    last = obs.groupBy(*WIN, "metric_id").agg(F.max_by("value", "cell_ts").alias("last"))
    state = last.join(state_series, list(st.SERIES)).withColumn("state_id", F.bround("last", 0).cast("long"))
    known = state.join(memory, [*st.SERIES, "state_id"]).groupBy(*WIN).agg(F.collect_list(F.struct("median", "mad")).alias("bands"))
    j = scored.join(last, [*WIN, "metric_id"], "left").join(known, WIN, "left")
    hits = F.size(F.filter("bands", lambda b: F.abs(F.col("last") - b["median"]) <= 2.0 * (b["mad"] + 1e-9)))
    factor = F.when(F.col("bands").isNotNull() & F.col("last").isNotNull(), F.pow(F.lit(0.5), hits)).otherwise(1.0)
    return j.withColumn("score", F.col("score") * factor).drop("last", "bands")


def gate_statistics(gate: DataFrame, state_windows: DataFrame | None = None) -> DataFrame:
    """Windows, trend runs, windows with a state metric."""
    g = gate.agg(F.count(F.lit(1)).alias("windows"), F.count_if("need_trend").alias("trend_run"))
    seen = state_windows.select(*WIN).distinct().agg(F.count(F.lit(1))).scalar() if state_windows is not None else F.lit(0)
    return g.withColumn("state_seen", seen)


# ---- fused detector on a channel matrix ----


def channel_values(points: DataFrame, group: list[str], keep: Sequence[str] = (), **more: Column) -> DataFrame:
    """Points reduced to one stored row per (group, tick, channel), with all that the channels' ticks, list and values need.

    ``keep`` names columns that depend on the others, ``more`` further aggregates.
    The points are read once; parts are combined in map tasks by hash.
    """
    observed = F.col("quality") == "observed"
    order = F.when(observed & F.col("value").isNotNull(), F.col("seq" if "seq" in points.columns else "value"))
    last = {"value": F.max_by("value", order)} | ({"seq": F.max(order)} if "seq" in points.columns else {})
    rows = points.groupBy(*group, "ts_ns", *st.SERIES, *keep).agg(
        *[c.alias(name) for name, c in last.items()], F.max(F.coalesce(observed, F.lit(False))).alias("__seen"), *[c.alias(name) for name, c in more.items()]
    )
    return cut(rows.withColumn("quality", F.when(F.col("__seen"), "observed").otherwise("missing")).drop("__seen"))


def channel_matrix(points: DataFrame, group: list[str], chunk: Column, channels: DataFrame | None = None) -> DataFrame:
    """Long matrix (group, ts_ns, entity_id, metric_id, value): every timestamp times every channel,
    forward filled, 0 before the first value.

    ``channels`` are those of the fit; by default the observed channels here.
    The channel list of a group is small and travels as one array per row.
    """
    observed = F.col("quality") == "observed"
    if channels is None:
        channels = points.where(observed).select(*group, *st.SERIES).distinct()
    packed = channels.groupBy(*group).agg(F.array_sort(F.collect_set(F.struct(*st.SERIES))).alias("__ch"))
    ticks = points.select(*group, "ts_ns").distinct()
    if group:
        ticks = ticks.join(packed, group)
    else:
        ticks = ticks.withColumn("__ch", packed.scalar())
    frame = ticks.select(*group, "ts_ns", F.inline("__ch"))
    vals = points.where(observed & F.col("value").isNotNull())
    vals = vals.groupBy(*group, "ts_ns", *st.SERIES).agg(F.max_by("value", "seq" if "seq" in points.columns else "value").alias("value"))
    keys = [*group, *st.SERIES]
    filled = ordered.fill_forward(frame.join(vals, [*keys, "ts_ns"], "left"), keys, ["ts_ns"], ["value"], chunk)
    return filled.withColumn("value", F.coalesce("value", F.lit(0.0)))


def _channel_z(median="median", mad="mad") -> Column:
    return F.abs(F.col("value") - F.col(median)) / (F.lit(MAD_SCALE) * F.greatest(F.col(mad), F.lit(1e-8)))


BLOCK = 4096  # ticks swept in one task


@dataclass(frozen=True)
class ChannelRuns:
    """The channel matrix as runs: a channel keeps its value from one observation to the next.

    ``ticks`` is (group, ts_ns, idx), ``runs`` (group, channel, start, until, value)
    over positions of ticks. There are as many runs as observations, and one
    more per channel that is not observed at the first tick, with value 0.
    """

    group: list[str]
    ticks: DataFrame
    runs: DataFrame

    @property
    def keys(self) -> list[str]:
        return [*self.group, *st.SERIES]

    def of(self, groups: DataFrame) -> ChannelRuns:
        """Those of ``groups`` only."""
        return ChannelRuns(self.group, self.ticks.join(groups, self.group, "left_semi"), self.runs.join(groups, self.group, "left_semi"))

    def first(self, last: DataFrame) -> ChannelRuns:
        """What would be known at tick time ``c`` of each group in ``last`` (group, c); all channels stay."""
        ends = cut(self.ticks.join(last, self.group).where("ts_ns <= c").groupBy(*self.group).agg(F.count(F.lit(1)).alias("t")))
        ticks = self.ticks.join(ends, self.group).where("idx < t").drop("t")
        runs = self.runs.join(ends, self.group).where("start < t").withColumn("until", F.least("until", "t")).drop("t")
        return ChannelRuns(self.group, ticks, runs)

    def sizes(self) -> DataFrame:
        return self.ticks.groupBy(*self.group).agg(F.count(F.lit(1)).alias("t"))

    def at(self, wanted: DataFrame) -> DataFrame:
        """Channel values (group, ``wanted``'s columns, channel, value) at the ticks of ``wanted``."""
        block = floor_div(F.col("idx"), F.lit(BLOCK)).alias("__block")
        here = wanted.join(self.ticks, [*self.group, "ts_ns"]).select("*", block)
        met = here.join(_in_blocks(self.runs), [*self.group, "__block"])
        return met.where((F.col("idx") >= F.col("start")) & (F.col("idx") < F.col("until"))).drop("__block", "idx", "start", "until")


def channel_runs(points: DataFrame, group: list[str], chunk: Column, channels: DataFrame | None = None) -> ChannelRuns:
    """D17 without the matrix. ``channels`` are those of the fit; by default the observed channels here."""
    keys = [*group, *st.SERIES]
    observed = F.col("quality") == "observed"
    ticks = cut(ordered.with_index(points.select(*group, "ts_ns").distinct(), group, ["ts_ns"], chunk, "idx"))
    if channels is None:
        channels = points.where(observed).select(*keys).distinct()
    order = "seq" if "seq" in points.columns else "value"
    vals = points.where(observed & F.col("value").isNotNull()).groupBy(*group, "ts_ns", *st.SERIES).agg(F.max_by("value", order).alias("value"))
    vals = vals.join(channels.select(*keys), keys, "left_semi").join(ticks, [*group, "ts_ns"]).withColumn("__back", -F.col("idx"))
    size = ticks.groupBy(*group).agg(F.count(F.lit(1)).alias("t"))
    with_size = lambda df: df.join(size, group) if group else df.withColumn("t", size.scalar())
    # the next observation is the one before in reverse order
    seen = with_size(cut(ordered.previous(vals, keys, ["__back"], {"__next": "idx"}, -chunk)))
    runs = seen.select(*keys, F.col("idx").alias("start"), F.coalesce("__next", "t").alias("until"), F.col("value").cast("double").alias("value"))
    first = seen.groupBy(*keys).agg(F.min("idx").alias("__first"))
    heads = with_size(channels.select(*keys).distinct().join(first, keys, "left")).withColumn("until", F.coalesce("__first", "t")).where("until > 0")
    return ChannelRuns(group, ticks, cut(runs.unionByName(heads.select(*keys, F.lit(0).cast("long").alias("start"), "until", F.lit(0.0).alias("value")))))


def _in_blocks(runs: DataFrame) -> DataFrame:
    """Runs cut at block bounds, with ``__block``."""
    first, last = (floor_div(c, F.lit(BLOCK)) for c in (F.col("start"), F.col("until") - 1))
    cut_up = runs.withColumn("__block", F.explode(F.sequence(first, last)))
    return cut_up.withColumns({"start": F.greatest("start", F.col("__block") * BLOCK), "until": F.least("until", (F.col("__block") + 1) * BLOCK)})


def fit_channels(train: ChannelRuns) -> tuple[DataFrame, DataFrame]:
    """(median and MAD per channel, q99 of the per-tick maximum z per group); a run counts once per tick."""
    model = cut(median_and_mad(train.runs, train.keys, "value", F.col("until") - F.col("start")))
    q = exact_quantiles(max_channel_z(train, model), train.group, "z", {"q99": 0.99})
    return model, q.withColumn("q99", F.greatest(F.col("q99"), F.lit(1e-8)))


def max_channel_z(channels: ChannelRuns, model: DataFrame) -> DataFrame:
    """(group, ts_ns, z), the largest z of all channels at each tick.

    A run of z values inside a block is covered by two ranges whose length is a
    power of two. Their maxima per (length, place) are made in map tasks, at most
    12 per tick of the block however many channels there are, and halved down
    to single ticks in the block's task.
    """
    group = channels.group
    z = _in_blocks(channels.runs.join(model, channels.keys).select(*group, "start", "until", _channel_z().alias("z")))
    level = F.floor(F.log2(F.col("until") - F.col("start") + 0.5)).cast("int")
    place = F.explode(F.array_distinct(F.array(F.col("start"), F.col("until") - F.expr("shiftleft(1L, __level)"))))
    ranges = z.withColumn("__level", level).withColumn("__at", place)
    tops = ranges.groupBy(*group, "__block", "__level", (F.col("__at") - F.col("__block") * BLOCK).alias("__at")).agg(F.max("z").alias("z"))
    fields = [tops.schema[g] for g in group]
    schema = T.StructType([*fields, T.StructField("idx", T.LongType()), T.StructField("z", T.DoubleType())])

    def swept(pdf: pd.DataFrame) -> pd.DataFrame:
        most = np.full((int(pdf["__level"].max()) + 1, BLOCK), -np.inf)
        most[pdf["__level"].to_numpy(), pdf["__at"].to_numpy()] = pdf["z"].to_numpy()
        for k in range(len(most) - 1, 0, -1):
            half = 1 << (k - 1)
            np.fmax(most[k - 1], most[k], out=most[k - 1])
            np.fmax(most[k - 1][half:], most[k][:-half], out=most[k - 1][half:])
        live = np.flatnonzero(most[0] > -np.inf)
        out = pd.DataFrame({"idx": live + int(pdf["__block"].iloc[0]) * BLOCK, "z": most[0][live]})
        return out.assign(**{g: pdf[g].iloc[0] for g in group})[schema.names]

    return tops.groupBy(*group, "__block").applyInPandas(swept, schema).join(channels.ticks, [*group, "idx"]).select(*group, "ts_ns", "z")


def fuse(scored: DataFrame, w: float = 0.3, raw: str = "raw", z: str = "z", q99: str = "q99") -> DataFrame:
    """(1 - w) raw + w min(1, z / q99)."""
    zn = F.least(F.lit(1.0), F.col(z) / F.col(q99))
    return scored.withColumn("zn", zn).withColumn("fused", F.lit(1.0 - w) * F.col(raw) + F.lit(w) * F.col("zn"))


def median_filter(df: DataFrame, group: list[str], order: list[str], cols: dict[str, str], size: int, chunk: Column) -> DataFrame:
    """Centred median of ``size`` rows with reflected edges, for several columns at once."""
    half = size // 2
    idx = ordered.with_index(df, group, order, chunk, "__idx")
    n = idx.groupBy(*group).agg((F.max("__idx") + 1).alias("__n"))
    idx = idx.join(n, group) if group else idx.withColumn("__n", n.scalar())
    blocks = ordered.with_halo(idx, group, "__idx", half, half)
    w = Window.partitionBy(*group, "block").orderBy("__idx")
    beside = lambda c, o: F.lag(c, -o).over(w) if o < 0 else F.lead(c, o).over(w) if o else F.col(c)
    offsets = range(-half, half + 1)
    near = {f"__near_{c}": F.array(*[beside(c, o) for o in offsets]) for c in set(cols.values())}
    blocks = blocks.withColumns(near).where("NOT is_halo")

    def reflected(offset: int) -> Column:
        """Place among the neighbours of what stands for the row at ``offset``; never further away than ``half``."""
        m = F.pmod(F.col("__idx") + offset, 2 * F.col("__n"))
        return (F.when(m < F.col("__n"), m).otherwise(2 * F.col("__n") - 1 - m) - F.col("__idx") + half).cast("int")

    places = F.array(*[reflected(o) for o in offsets])
    med = lambda c: F.get(F.array_sort(F.transform("__places", lambda p: F.get(f"__near_{c}", p))), F.lit(half))
    out = blocks.withColumn("__places", places).withColumns({new: med(c) for new, c in cols.items()})
    return out.drop("__idx", "__n", "__places", *near, "block", "is_halo")


def flag_and_segment(
    smooth: DataFrame, channels: ChannelRuns, model: DataFrame, chunk: Column, threshold: float = 0.5, zn_threshold: float = 0.95
) -> tuple[DataFrame, DataFrame]:
    """(segments, per-channel share and direction at each segment's peak).

    ``smooth`` holds (group, ts_ns, smooth, zn_smooth).
    """
    group = channels.group
    flag = (F.col("smooth") > threshold) | (F.col("zn_smooth") > zn_threshold)
    f = smooth.withColumn("flag", flag).withColumn("severity", F.greatest("smooth", "zn_smooth"))
    f = ordered.previous(f, group, ["ts_ns"], {"was": "flag"}, chunk)
    f = ordered.islands(f, group, ["ts_ns"], F.col("flag") & ~F.coalesce("was", F.lit(False)), chunk, "run").where("flag")
    seg = f.groupBy(*group, "run").agg(
        F.min("ts_ns").alias("start_ts_ns"), F.max("ts_ns").alias("end_ts_ns"),
        F.max("severity").alias("sev"), F.max_by("ts_ns", F.struct(F.col("severity"), -F.col("ts_ns"))).alias("peak_ts"),
    )
    sev = F.least(F.lit(1.0), F.col("sev"))
    seg = seg.withColumn("severity", sev).withColumn("status", F.when(F.col("severity") >= 0.5, "anomaly").otherwise("uncertain"))
    seg = seg.withColumn("incident_id", incident_id("start_ts_ns", "end_ts_ns", F.concat_ws("/", *[F.col(g).cast("string") for g in group]) if group else F.lit("host"), F.lit("fuse"))).drop("sev")
    at_peak = channels.at(seg.select(*group, "run", F.col("peak_ts").alias("ts_ns"))).join(model, [*group, *st.SERIES])
    at_peak = at_peak.withColumn("zc", _channel_z())
    total = at_peak.groupBy(*group, "run").agg(F.sum("zc").alias("zsum"))
    share = F.col("zc") / F.when(F.col("zsum") == 0, F.lit(1.0)).otherwise(F.col("zsum"))
    parts = at_peak.where("zc > 0").join(total, [*group, "run"]).select(
        *group, "run", *st.SERIES, share.alias("share"), _direction(F.col("value"), F.col("median")).alias("direction")
    )
    return seg, parts


def anomaly_type(parts: DataFrame, key: list[str], metric_group: str = "grp", score: str = "score") -> DataFrame:
    """Indicator scores per channel group and the strongest group."""
    sums = parts.groupBy(*key, metric_group).agg(F.sum(score).alias("s"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.round("s", 4)).alias("neg"), F.col(metric_group).alias("type"))))
    out = sums.groupBy(*key).agg(
        F.max_by(F.col(metric_group), F.struct(F.col("s"), F.col(metric_group))).alias("type"), ranked.alias("r")
    )
    return out.withColumn("indicators", F.transform("r", lambda e: F.struct(e["type"].alias("type"), (-e["neg"]).alias("confidence")))).drop("r")
