"""Detectors as fit/score pairs over DataFrames.

Every pair has the same form: ``fit(train, val, params) -> model`` and
``score(model, points, params, adjustments, suppressed, raw) -> incidents``.
``adjustments`` changes thresholds, ``suppressed`` holds rejected incident ids and
``raw`` the scores of an outside model; a detector ignores what it has no use for.
Fitting and scoring run jobs, because thresholds are needed as tables.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telemill.operators import detect, ordered, spectral, stats as st, windows
from telemill.session import cut

MINUTE = 60_000_000_000


@dataclass(frozen=True)
class Params:
    """Defaults of the detectors; all times in nanoseconds."""

    window_ns: int = MINUTE
    stride_ns: int = MINUTE // 2
    interval_ns: int | None = None
    alpha: float = 0.2
    quantile: float = 0.99
    multiplier: float = 1.5
    min_observed_frac: float = 0.5
    low_freq: int = 6
    n_fft: int = 64
    confidence: float = 0.6
    drift_z: float = 1.5
    fuse_w: float = 0.3
    threshold: float = 0.5
    zn_threshold: float = 0.95
    median_k: int = 5
    min_rows: int = 16  # ticks that the fused detector needs to fit and to score a group
    group: tuple[str, ...] = ()  # columns that name a group of the fused detector; none is one group for all
    state_metrics: tuple[str, ...] = ()  # metrics whose value names a state; so does ``attrs['role'] = 'state'``


Model = dict[str, DataFrame | int | None]


def _interval(train: DataFrame, p: Params) -> int:
    if p.interval_ns is not None:
        return p.interval_ns
    row = windows.infer_interval(train).first()  # one row
    return row["gap"] or 10_000_000_000


def _cells(points: DataFrame, p: Params, interval: int) -> DataFrame:
    return windows.align_grid(windows.sliding_windows(points, p.window_ns, p.stride_ns), interval)


def _base(train: DataFrame, val: DataFrame | None, p: Params, flat: float) -> Model:
    stats = cut(st.fit_stats(train))
    thr = cut(st.pot_thresholds(stats, val if val is not None else train, p.quantile, p.multiplier, flat))
    return {"stats": stats, "thresholds": thr, "interval": _interval(train, p)}


def fit_streaming(train: DataFrame, val: DataFrame | None, p: Params) -> Model:
    return _base(train, val, p, 1.0)


def _adjusted(thr: DataFrame, adjustments: DataFrame | None) -> DataFrame:
    return thr if adjustments is None else st.apply_adjustments(thr, adjustments)


def _kept(incidents: DataFrame, suppressed: DataFrame | None) -> DataFrame:
    return incidents if suppressed is None else detect.suppress(incidents, suppressed)


def _is_state(points: DataFrame, p: Params) -> Column:
    named = F.col("metric_id").isin(*p.state_metrics) if p.state_metrics else F.lit(False)
    if "attrs" in points.columns:
        named = named | F.coalesce(F.try_element_at("attrs", F.lit("role")) == "state", F.lit(False))
    return named


def score_streaming(
    model: Model, points: DataFrame, p: Params, adjustments: DataFrame | None = None, suppressed: DataFrame | None = None, raw: DataFrame | None = None
) -> DataFrame:
    cells = cut(_cells(points, p, model["interval"]))
    rows = detect.score_windows_streaming(cells, model["stats"], _adjusted(model["thresholds"], adjustments), p.alpha, p.min_observed_frac)
    return _kept(detect.merge_incidents(rows, "streaming"), suppressed)


def _fit_trend(train: DataFrame, val: DataFrame | None, p: Params, interval: int) -> Model:
    size = p.low_freq + 4
    chunk = 1024 * p.stride_ns
    win = cut(spectral.collect_windows(_cells(train, p, interval), size))
    trend = cut(spectral.fit(win, p.low_freq, p.n_fft, chunk))
    cal_win = win if val is None else spectral.collect_windows(_cells(val, p, interval), size)
    cal = spectral.score(cal_win, trend, p.low_freq, p.n_fft, chunk)
    return {"trend": trend, "trend_thresholds": cut(spectral.thresholds(trend, cal, p.quantile, p.multiplier))}


def fit_fits(train: DataFrame, val: DataFrame | None, p: Params) -> Model:
    interval = _interval(train, p)
    return {"interval": interval, **_fit_trend(train, val, p, interval)}


def score_fits(
    model: Model, points: DataFrame, p: Params, adjustments: DataFrame | None = None, suppressed: DataFrame | None = None, raw: DataFrame | None = None
) -> DataFrame:
    cells = cut(_cells(points, p, model["interval"]))
    win = spectral.collect_windows(cells, p.low_freq + 4)
    scores = spectral.score(win, model["trend"], p.low_freq, p.n_fft, 1024 * p.stride_ns)
    hits = spectral.flagged(scores, _adjusted(model["trend_thresholds"], adjustments))
    seen = cells.join(model["trend"].select(*st.SERIES), list(st.SERIES), "left_semi")
    empty = seen.groupBy(*detect.WIN, "metric_id").agg(F.max("observed").alias("o")).where("NOT o").select(*detect.WIN).distinct()
    holes = empty.select(*detect.WIN, F.lit("_quality").alias("metric_id"), F.lit(1.0).alias("score"), F.lit("missing").alias("direction"))
    return _kept(detect.merge_incidents(hits.unionByName(holes), "first"), suppressed)


def fit_cascade(train: DataFrame, val: DataFrame | None, p: Params) -> Model:
    """Numeric series get thresholds and a trend, state series a memory of their states."""
    marked = train.withColumn("is_state", _is_state(train, p))
    states = cut(marked.where("is_state").select(*st.SERIES).distinct())
    numeric = lambda df: df.join(states, list(st.SERIES), "left_anti")
    known = None if val is None else numeric(val)
    base = _base(numeric(train), known, p, 1.5)
    memory = cut(detect.fit_state_memory(marked))
    return {**base, **_fit_trend(numeric(train), known, p, base["interval"]), "memory": memory, "states": states}


def cascade_rows(model: Model, points: DataFrame, p: Params, adjustments: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(reported metric rows with status, gate) of the cascade before merging.

    State series are no part of the numeric rings; where one names a known
    state, scores that fit it are halved.
    """
    every = cut(_cells(points, p, model["interval"]))
    cells = every.join(model["states"], list(st.SERIES), "left_anti")
    events = cut(detect.event_scores(cells, model["stats"], _adjusted(model["thresholds"], adjustments)))
    ring = detect.event_ring(cells, model["stats"])
    gate = cut(detect.trend_gate(ring, events, cells, p.min_observed_frac, p.confidence, p.drift_z))
    # conditional computation: only gated windows reach the spectral model
    win = spectral.collect_windows(cells.join(gate.where("need_trend").select(*detect.WIN), detect.WIN, "left_semi"), p.low_freq + 4)
    scores = spectral.score(win, model["trend"], p.low_freq, p.n_fft, 1024 * p.stride_ns)
    trends = spectral.flagged(scores, _adjusted(model["trend_thresholds"], adjustments))
    rows = detect.consistency_gate(events, trends, gate)
    return detect.state_branch(rows, every, model["memory"], model["states"]).select(*rows.columns), gate


def score_cascade(
    model: Model, points: DataFrame, p: Params, adjustments: DataFrame | None = None, suppressed: DataFrame | None = None, raw: DataFrame | None = None
) -> DataFrame:
    return _kept(detect.merge_incidents(cascade_rows(model, points, p, adjustments)[0], "cascade"), suppressed)


def _enough(channels: detect.ChannelRuns, p: Params) -> detect.ChannelRuns:
    """Those of the groups that have at least ``min_rows`` ticks."""
    large = cut(channels.sizes().where(F.col("t") >= p.min_rows))
    if channels.group:
        return channels.of(large.select(*channels.group))
    some = large.agg(F.count(F.lit(1)) > 0).scalar()
    return detect.ChannelRuns([], channels.ticks.where(some), channels.runs.where(some))


def fit_fuse(train: DataFrame, val: DataFrame | None, p: Params) -> Model:
    channels, q99 = detect.fit_channels(_enough(detect.channel_runs(detect.channel_values(train, list(p.group)), list(p.group), ordered.by_time()), p))
    return {"channels": cut(channels), "q99": cut(q99)}


def fuse_segments(model: Model, points: DataFrame, p: Params, raw: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(segments, channel shares) of the fused score. ``raw`` holds (group, ts_ns, raw); ticks without one count as 0."""
    group = list(p.group)
    m = _enough(detect.channel_runs(detect.channel_values(points, group), group, ordered.by_time(), model["channels"].select(*group, *st.SERIES)), p)
    z = detect.max_channel_z(m, model["channels"])
    z = z.join(model["q99"], group) if group else z.withColumn("q99", model["q99"].scalar())
    if raw is None:
        z = z.withColumn("raw", F.lit(0.0))
    else:
        z = z.join(raw, [*group, "ts_ns"], "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    fused = cut(detect.fuse(z, p.fuse_w))
    smooth = detect.median_filter(fused, group, ["ts_ns"], {"smooth": "fused", "zn_smooth": "zn"}, p.median_k, ordered.by_time())
    return detect.flag_and_segment(cut(smooth), m, model["channels"], ordered.by_time(), p.threshold, p.zn_threshold)


def score_fuse(
    model: Model, points: DataFrame, p: Params, adjustments: DataFrame | None = None, suppressed: DataFrame | None = None, raw: DataFrame | None = None
) -> DataFrame:
    """Segments as incidents; metrics are named ``entity/metric`` and scored by their share at the peak."""
    group = list(p.group)
    segments, shares = (cut(x) for x in fuse_segments(model, points, p, raw))
    name = F.concat_ws("/", *st.SERIES)
    entries = lambda c: F.map_from_entries(F.array_sort(F.collect_list(F.struct(name.alias("k"), F.col(c).alias("v")))))
    per = shares.groupBy(*group, "run").agg(entries("share").alias("metric_scores"), entries("direction").alias("directions"))
    out = segments.join(per, [*group, "run"], "left")
    entity = F.concat_ws("/", *[F.col(g).cast("string") for g in group]) if group else F.lit("host")
    return _kept(out.select(entity.alias("entity_id"), "incident_id", "start_ts_ns", "end_ts_ns", "status", "severity", "metric_scores", "directions"), suppressed)


REGISTRY: dict[str, tuple[Callable, Callable]] = {
    "streaming": (fit_streaming, score_streaming),
    "shesd": (fit_streaming, score_streaming),
    "fits": (fit_fits, score_fits),
    "edge_cascade": (fit_cascade, score_cascade),
    "time_rcd_fuse": (fit_fuse, score_fuse),
}


def get(name: str) -> tuple[Callable, Callable]:
    """The (fit, score) pair registered under ``name``."""
    if name not in REGISTRY:
        raise ValueError(f"no detector is called {name!r}; there are: {', '.join(REGISTRY)}")
    return REGISTRY[name]


def detect_points(points: DataFrame, name: str = "edge_cascade", params: Params | None = None, train: float = 0.6, val: float = 0.2):
    """Split by time, fit on train, calibrate on validation, score everything."""
    p = params or Params()
    fit, score = get(name)
    lab = windows.split_by_time(points, train, val)
    return score(fit(lab.where("split = 'train'"), lab.where("split = 'val'"), p), points, p)
