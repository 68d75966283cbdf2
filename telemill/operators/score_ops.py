"""Post-processing of anomaly score series (X family).

A score series is a DataFrame with key columns, a total order and a score
column; every function returns the rows with a new column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.functions.integers import floor_div
from telemill.functions.scores import sigmoid
from telemill.operators import detect, ordered
from telemill.operators.quantile import exact_quantiles
from telemill.session import cut


BLOCK = 512  # rows of a sum at a time, which keeps its rounding small


def _cusum_path(d: np.ndarray, h: float, s: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Statistic and alarm per row of the drifts ``d`` from state ``s``, and the end state; a NaN restarts at 0."""
    n = len(d)
    stat, alarm = np.zeros(n), np.zeros(n, np.int32)
    gaps = np.append(np.flatnonzero(np.isnan(d)), n)
    i = g = 0
    while i < n:
        if i == gaps[g]:
            s, i, g = 0.0, i + 1, g + 1
            continue
        a = np.cumsum(d[i : min(i + BLOCK, gaps[g])])
        x = np.maximum(s + a, a - np.minimum(np.minimum.accumulate(a), 0.0))
        hits = np.flatnonzero(x > h)
        end = i + (int(hits[0]) + 1 if len(hits) else len(a))
        stat[i:end] = x[: end - i]
        if len(hits):
            alarm[end - 1], s = 1, 0.0
        else:
            s = float(x[-1])
        i = end
    return stat, alarm, s


def cusum(df: DataFrame, keys: list[str], order: list[str], score: str, chunk: Column) -> DataFrame:
    """s = max(0, s + x - k); alarm and restart at 0 when s > h. Rows carry their series' ``k`` and ``h``.

    From a start state s the rows of a chunk give max(s + a, b) with the sums a
    and the statistic b from 0, until the first alarm: the first row where b > h
    or a > h - s. So a chunk is the rows at which a reaches a new height, each
    with the end state after a restart there, and the last a and b.
    """
    schema = T.StructType([*df.schema.fields, T.StructField("stat", T.DoubleType()), T.StructField("alarm", T.IntegerType())])

    def parts(rows: pd.DataFrame) -> tuple[np.ndarray, float]:
        return rows[score].to_numpy(dtype=float) - float(rows["k"].iloc[0]), float(rows["h"].iloc[0])

    def summarise(rows: pd.DataFrame):
        d, h = parts(rows)
        stat, alarm, end = _cusum_path(d, h, 0.0)
        rest = alarm.astype(bool) | np.isnan(d)
        stop = int(np.argmax(rest)) if rest.any() else len(d)  # here every start meets the path from 0
        a = np.cumsum(d[:stop])
        top = np.maximum.accumulate(np.append(0.0, a))
        heights = []
        for i in np.flatnonzero(a > top[:-1]).tolist():
            again = _cusum_path(d[i + 1 :], h, 0.0)[2]
            if heights and heights[-1][1] == again:
                heights[-1][0] = float(a[i])
            else:
                heights.append([float(a[i]), again])
        return {"h": h, "heights": heights, "sum": float(a[-1]) if stop == len(d) else None, "end": end}

    def through(s: float, x) -> float:
        for height, end in x["heights"]:
            if height > x["h"] - s:
                return end
        return x["end"] if x["sum"] is None else max(s + x["sum"], x["end"])

    def replay(rows: pd.DataFrame, s: float) -> pd.DataFrame:
        d, h = parts(rows)
        stat, alarm, _ = _cusum_path(d, h, s)
        return rows.assign(stat=stat, alarm=alarm)

    return ordered.scan(df, keys, order, chunk, summarise, through, replay, 0.0, schema)


def cusum_limits(train: DataFrame, keys: list[str], score: str) -> DataFrame:
    """k = 0.5 and h = 4 standard deviations of the train scores."""
    sd = F.stddev_pop(score)
    return train.groupBy(*keys).agg((0.5 * sd).alias("k"), (4.0 * sd).alias("h"))


def temperature(logit, t: float) -> Column:
    """X2"""
    return sigmoid(F.col(logit) / t if isinstance(logit, str) else logit / t)


def quantile_threshold(train: DataFrame, keys: list[str], score: str, q: float) -> DataFrame:
    """X3"""
    return exact_quantiles(train, keys, score, {"threshold": q})


def fit_gpd(excess: DataFrame, keys: list[str], value: str = "x", grid: int = 32, tolerance: float = 1e-12) -> DataFrame:
    """Maximum likelihood of the generalised Pareto distribution with location 0: (keys, n, mean, top, shape, theta).

    With theta = shape / scale the likelihood has one free parameter and its
    derivative needs two sums, of log(1 + theta x) and of x / (1 + theta x). A
    grid over exp(u) = 1 + theta max(x) brackets the highest maximum; the grid
    moves on while that lies at its edge. Newton steps on the derivative, halving
    where a step leaves the bracket, then go on until they are below the
    tolerance. Every round is one aggregate over the excesses; only sums move.
    """
    rows = excess.select(*keys, F.col(value).cast("double").alias("__x"))
    x = F.col("__x")
    base = cut(rows.groupBy(*keys).agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.max(x).alias("top"), F.avg(x * x).alias("__second")))
    known = ["n", "mean", "top", "__second"]
    open_ = base.select(*keys, *known, F.lit(-7.0).alias("__a"), F.lit(7.0).alias("__b"))
    found = None
    while True:
        us = F.transform(F.sequence(F.lit(0), F.lit(grid)), lambda g: F.struct(g.alias("__g"), (F.col("__a") + (F.col("__b") - F.col("__a")) * g / grid).alias("__u")))
        terms = rows.join(open_.select(*keys, "top", us.alias("__us")), keys).select(*keys, "top", "__x", F.inline("__us"))
        theta = F.expm1("__u") / F.col("top")
        shapes = terms.groupBy(*keys, "__g", "__u").agg(F.avg(F.log1p(theta * x)).alias("shape"), F.first("top").alias("top"))
        # shapes at or below -1 have no maximum; at theta = 0 the scale is the mean
        scale = F.when(F.abs("__u") < 1e-12, F.lit(None)).otherwise(F.col("shape") / theta)
        like = shapes.join(base.select(*keys, "mean"), keys).withColumn("__like", F.when(F.col("shape") > -1, -(F.ln(F.coalesce(scale, F.col("mean"))) + F.col("shape") + 1)))
        best = like.groupBy(*keys).agg(F.max_by(F.struct("__g", "__u"), "__like").alias("__m"))
        step = (F.col("__b") - F.col("__a")) / grid
        now = cut(open_.join(best, keys).withColumn("__step", step))
        edge = F.col("__m.__g").isin(0, grid) & (F.abs("__m.__u") < 500)
        inside = now.where(~edge).select(*keys, *known, *[(F.expm1(u) / F.col("top")).alias(n) for n, u in (("__lo", F.col("__m.__u") - F.col("__step")), ("theta", F.col("__m.__u")), ("__hi", F.col("__m.__u") + F.col("__step")))])
        found = inside if found is None else found.unionByName(inside)
        if not now.where(edge).limit(1).count():
            break
        width = F.col("__b") - F.col("__a")
        left = F.col("__m.__g") == 0
        open_ = now.where(edge).select(*keys, *known, F.when(left, F.col("__a") - 2 * width).otherwise(F.col("__b") - F.col("__step")).alias("__a"), F.when(left, F.col("__a") + F.col("__step")).otherwise(F.col("__b") + 2 * width).alias("__b"))
    state = cut(found.withColumn("__done", F.lit(False)))
    ratio = x / (1 + F.col("theta") * x)
    while state.where("NOT __done").limit(1).count():
        at = rows.join(state.where("NOT __done").select(*keys, "theta"), keys)
        sums = at.groupBy(*keys).agg(F.avg(F.log1p(F.col("theta") * x)).alias("__k"), F.avg(ratio).alias("__d1"), F.avg(ratio * ratio).alias("__d2"))
        j = state.where("NOT __done").join(sums, keys)
        t, k, d1, d2 = (F.col(c) for c in ("theta", "__k", "__d1", "__d2"))
        near = F.abs(t * F.col("top")) < 1e-6  # the derivative's value at 0
        slope = F.when(near, F.col("__second") / (2 * F.col("mean")) - F.col("mean")).otherwise(1 / t - d1 * (1 + 1 / k))
        bend = F.when(~near, -1 / (t * t) + d2 * (1 + 1 / k) + d1 * d1 / (k * k))
        j = j.withColumns({"__s": slope, "__c": bend})
        rising = (k <= -1) | (F.col("__s") > 0)
        j = j.withColumns({"__lo": F.when(rising, t).otherwise(F.col("__lo")), "__hi": F.when(rising, F.col("__hi")).otherwise(t)})
        newton = t - F.col("__s") / F.col("__c")
        use = (F.col("__c") < 0) & (newton > F.col("__lo")) & (newton < F.col("__hi"))
        j = j.withColumn("__next", F.when(F.coalesce(use, F.lit(False)), newton).otherwise((F.col("__lo") + F.col("__hi")) / 2))
        small = F.lit(tolerance) * (F.abs(t) + 1 / F.col("top"))
        done = (F.abs(F.col("__next") - t) <= small) | (F.col("__hi") - F.col("__lo") <= small)
        moved = j.select(*keys, *known, "__lo", F.col("__next").alias("theta"), "__hi", done.alias("__done"))
        state = cut(state.where("__done").unionByName(moved))
    shape = rows.join(state.select(*keys, "theta"), keys).groupBy(*keys).agg(F.avg(F.log1p(F.col("theta") * x)).alias("shape"))
    return state.join(shape, keys).select(*keys, "n", "mean", "top", "shape", "theta")


def pot_gpd(train: DataFrame, keys: list[str], order: list[str], score: str, chunk: Column, alpha: float = 0.2, level: float = 0.999) -> DataFrame:
    """Threshold (keys, threshold, failed) from the tail of the smoothed train scores."""
    smooth = cut(ordered.ewma(train, keys, order, score, alpha, chunk, "smooth"))
    q = cut(exact_quantiles(smooth, keys, "smooth", {"z": 0.99, "fallback": 0.995}))
    excess = cut(smooth.join(q, keys).where(F.col("smooth") > F.col("z")).select(*keys, (F.col("smooth") - F.col("z")).alias("x")))
    spread = excess.groupBy(*keys).agg(F.count("x").alias("m"), F.stddev_pop("x").alias("sd"))
    good = spread.where((F.col("m") >= 4) & (F.col("sd") >= 1e-4)).select(*keys)
    fit = fit_gpd(excess.join(good, keys, "left_semi"), keys)
    flat = F.abs("theta") * F.col("top") < 1e-9
    tail = F.when(flat, -F.ln(F.lit(1 - level)) * F.col("mean")).otherwise((F.pow(F.lit(1 - level), -F.col("shape")) - 1) / F.col("theta"))
    j = q.join(fit.select(*keys, tail.alias("tail")), keys, "left")
    thr = F.when(F.col("tail").isNotNull(), F.greatest("z", F.col("z") + F.col("tail"))).otherwise(F.col("fallback"))
    return j.select(*keys, thr.alias("threshold"), F.col("tail").isNull().alias("failed"))


def conformal_threshold(train: DataFrame, keys: list[str], idx: str, score: str, tau: float, alpha: float, value_chunk: Column) -> DataFrame:
    """Smallest score whose cumulative weight reaches 1 - alpha; weights decay with age by ``tau``.

    ``idx`` is the position in time, ``value_chunk`` a Column rising with the
    score along which the ordered sum is cut.
    """
    last = train.groupBy(*keys).agg(F.max(idx).alias("__last"))
    w = train.join(last, keys).withColumn("__w", F.exp(-(F.col("__last") - F.col(idx)) / F.lit(float(tau))))
    total = w.groupBy(*keys).agg(F.sum("__w").alias("__total"))
    run = ordered.running(w, keys, [score, idx], {"__cum": ("sum", F.col("__w"))}, value_chunk).join(total, keys)
    hit = run.where(F.col("__cum") / F.col("__total") >= 1 - alpha)
    found = hit.groupBy(*keys).agg(F.min(score).alias("__hit"))
    top = train.groupBy(*keys).agg(F.max(score).alias("__max"))
    return top.join(found, keys, "left").select(*keys, F.coalesce("__hit", "__max").alias("threshold"))


def minmax01(df: DataFrame, keys: list[str], cols: Sequence[str]) -> DataFrame:
    """Scale to 0..1 per series; a flat series is 0."""
    aggs = [f(c).alias(f"__{n}_{c}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))]
    j = df.join(df.groupBy(*keys).agg(*aggs), keys)
    lo, hi = (lambda c: F.col(f"__lo_{c}")), (lambda c: F.col(f"__hi_{c}"))
    scaled = {c: F.when(hi(c) - lo(c) < 1e-12, F.lit(0.0)).otherwise((F.col(c) - lo(c)) / (hi(c) - lo(c))) for c in cols}
    return j.withColumns(scaled).drop(*[f"__{n}_{c}" for c in cols for n in ("lo", "hi")])


def fuse_channels(df: DataFrame, keys: list[str], score: str, mode: str | dict[str, str] = "max") -> DataFrame:
    """Channel scores of one time fused by ``max`` or ``mean``; several modes, by output column, in one pass."""
    modes = {score: mode} if isinstance(mode, str) else mode
    return df.groupBy(*keys).agg(*[(F.max if m == "max" else F.avg)(score).alias(name) for name, m in modes.items()])


def multiscale(df: DataFrame, keys: list[str], a: str, b: str, out: str = "score") -> DataFrame:
    """X8"""
    return minmax01(df, keys, [a, b]).withColumn(out, 0.5 * (F.col(a) + F.col(b)))


def overlap_average(first: DataFrame, shifted: DataFrame, keys: list[str], offset: int, idx: str = "idx", score: str = "score") -> DataFrame:
    """Mean of both passes where the shifted pass (position 0 at ``offset``) covers, else the first."""
    b = shifted.select(*keys, (F.col(idx) + offset).alias(idx), F.col(score).alias("__b"))
    j = first.join(b, [*keys, idx], "left")
    return j.withColumn(score, F.when(F.col("__b").isNotNull(), 0.5 * (F.col(score) + F.col("__b"))).otherwise(F.col(score))).drop("__b")


def robust_fusion(train: detect.ChannelRuns, test: detect.ChannelRuns, scores: DataFrame, w: float = 0.3) -> DataFrame:
    """Scores (group, ts_ns, raw) fused with the robust channel deviation."""
    group = test.group
    model, q = detect.fit_channels(train)
    z = detect.max_channel_z(test, model)
    z = z.join(cut(q), group) if group else z.withColumn("q99", q.scalar())
    return detect.fuse(z.join(scores, [*group, "ts_ns"]), w)


def cascade_gate(
    train_z: DataFrame, test_z: DataFrame, scores: DataFrame, keys: list[str], block: int, q: float, idx: str = "idx", z: str = "z", score: str = "score"
) -> tuple[DataFrame, DataFrame]:
    """X11: (scores zeroed outside passing blocks, pass rate and gate per series).

    A block of ``block`` rows passes when its largest z exceeds the q-quantile
    of the train blocks.
    """
    b = floor_div(F.col(idx), F.lit(block)).alias("__b")
    peak = lambda d: d.groupBy(*keys, b).agg(F.max(z).alias("__wm"))
    gate = exact_quantiles(peak(train_z), keys, "__wm", {"gate": q})
    passed = peak(test_z).join(gate, keys).withColumn("__pass", F.col("__wm") > F.col("gate"))
    rate = passed.groupBy(*keys).agg(F.avg(F.col("__pass").cast("double")).alias("pass_rate"), F.max("gate").alias("gate"))
    j = scores.withColumn("__b", floor_div(F.col(idx), F.lit(block))).join(passed.select(*keys, "__b", "__pass"), [*keys, "__b"])
    return j.withColumn(score, F.when(F.col("__pass"), F.col(score)).otherwise(0.0)).drop("__b", "__pass"), rate


def _median_stage(size: int):
    def run(df, keys, order, score, chunk):
        return detect.median_filter(df, keys, order, {score: score}, size, chunk)

    return run


def _ewma_stage(alpha: float):
    def run(df, keys, order, score, chunk):
        return ordered.ewma(df, keys, order, score, alpha, chunk, "__e").withColumn(score, F.col("__e")).drop("__e")

    return run


def _temperature_stage(t: float):
    def run(df, keys, order, score, chunk):
        return df.withColumn(score, temperature("logit", t))

    return run


def _fusion_stage(w: float):
    def run(df, keys, order, score, chunk):
        return detect.fuse(df, w, raw=score).withColumn(score, F.col("fused")).drop("fused", "zn")

    return run


# The fusion stages read the columns z and q99, the temperature stages the column logit.
STAGES: dict[str, Callable] = {
    "median-k3": _median_stage(3), "median-k5": _median_stage(5),
    "ewma-a02": _ewma_stage(0.2), "ewma-a05": _ewma_stage(0.5),
    "temp-15": _temperature_stage(1.5), "temp-20": _temperature_stage(2.0),
    "fusion-robust-03": _fusion_stage(0.3), "fusion-robust-05": _fusion_stage(0.5),
}


def combo(df: DataFrame, stages: Sequence[str], keys: list[str], order: list[str], score: str, chunk: Column) -> DataFrame:
    """Stages applied in the given order.

    A temperature stage rescales the logit of the outside model, so it can only come first.
    """
    late = [s for s in stages[1:] if s.startswith("temp-")]
    if late:
        raise ValueError(f"{late[0]} would discard the stages before it; temperature stages come first")
    for i, name in enumerate(stages):
        if name not in STAGES:
            raise ValueError(f"unknown stage {name!r}; available: {sorted(STAGES)}")
        df = STAGES[name](cut(df) if i else df, keys, order, score, chunk)
    return df


def combo_quantile(train: DataFrame, test: DataFrame, stage: str, q: float, keys: list[str], order: list[str], score: str, chunk: Column) -> DataFrame:
    """One stage and a train quantile as threshold; rows of ``test`` with ``threshold``."""
    thr = quantile_threshold(combo(train, [stage], keys, order, score, chunk), keys, score, q)
    out = combo(test, [stage], keys, order, score, chunk)
    return out.join(thr, keys) if keys else out.withColumn("threshold", thr.scalar())
