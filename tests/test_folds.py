"""Order-dependent folds in two passes against plain loops, with chunks far smaller than the dependence reaches."""

import math
import random

import pytest
from pyspark.sql import functions as F

from telemill.operators import episodes, feedback, ordered, pairing, score_ops
from telemill.operators.quantile import exact_quantiles, median_and_mad


IDLE = [None, None, None, 0]


def advance(state, ticks, post_ns, debounce):
    start, end, first, normal = state
    closed = []
    for ts, bad, final in ticks:
        ts = int(ts)
        if start is None:
            if bad:
                start, end, first, normal = ts, None, None, 0
        elif bad:
            first, normal = None, 0
        else:
            first = ts if normal == 0 else first
            normal += 1
            if normal >= debounce and end is None:
                end = first
        if start is not None and (ts >= start + post_ns or final):
            closed.append((start, ts if end is None else end, start + post_ns, ts))
            start, end, first, normal = IDLE
    return closed, [start, end, first, normal]


def cusum_loop(xs, k, h):
    s, out = 0.0, []
    for x in xs:
        s = max(0.0, s + x - k)
        out.append((s, int(s > h)))
        if s > h:
            s = 0.0
    return out


@pytest.mark.parametrize("seed,chunk", [(0, 3), (1, 7), (2, 50), (3, 1)])
def test_cusum(spark, seed, chunk):
    r = random.Random(seed)
    rows = []
    for key, drift in (("a", 0.0), ("b", 0.4), ("c", -0.5), ("d", 3.0)):
        xs = [r.gauss(drift, 1.0) for _ in range(200)]
        if key == "b":
            xs[50] = float("nan")
        rows += [(key, i, x, 0.3, 4.0) for i, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "key string, t long, x double, k double, h double")
    got = {(g["key"], g["t"]): (g["stat"], g["alarm"]) for g in score_ops.cusum(df, ["key"], ["t"], "x", ordered.by_time("t", chunk)).collect()}
    for key in "abcd":
        for i, (s, a) in enumerate(cusum_loop([x for k, _, x, *_ in rows if k == key], 0.3, 4.0)):
            assert math.isclose(got[key, i][0], s, abs_tol=1e-9) and got[key, i][1] == a, (key, i)


def test_cusum_paths_in_blocks(monkeypatch):
    monkeypatch.setattr(score_ops, "BLOCK", 4)
    r = random.Random(5)
    import numpy as np

    d = np.array([r.gauss(0.1, 1) for _ in range(300)])
    stat, alarm, end = score_ops._cusum_path(d, 3.0, 2.0)
    s = 2.0
    for x, got, hit in zip(d, stat, alarm):
        s = max(0.0, s + x)
        assert math.isclose(s, got, abs_tol=1e-9) and hit == (s > 3.0)
        s = 0.0 if s > 3.0 else s
    assert math.isclose(s, end, abs_tol=1e-9)


@pytest.mark.parametrize("chunk", [5, 40, 1000])
@pytest.mark.parametrize("rate", [1_000_000_000, 90_000_000, 20_000_000, 0])
def test_rate_limit(spark, chunk, rate):
    r = random.Random(chunk)
    stamps = sorted(r.randrange(600) for _ in range(300))
    df = spark.createDataFrame([("k", i, t) for i, t in enumerate(stamps)] + [("one", 0, 5)], "key string, i long, ts_ns long")
    got = sorted(x["i"] for x in pairing.rate_limit(df, ["key"], ["ts_ns", "i"], rate, ordered.by_time("ts_ns", chunk)).where("key = 'k'").collect())
    last, want = None, []
    for i, t in enumerate(stamps):
        if last is None or (t - last) * rate >= 1_000_000_000:
            last = t
            want.append(i)
    assert got == want


@pytest.mark.parametrize("chunk,post,debounce", [(4, 13, 2), (10, 3, 3), (100, 25, 1), (7, 60, 3), (3, 0, 2)])
def test_episodes(spark, chunk, post, debounce):
    rows, want = [], []
    for host in range(4):
        r = random.Random(100 * host + post)
        stamps = sorted(r.sample(range(300), 120))
        ticks = [(t, r.random() < (0.05, 0.2, 0.6, 0.0)[host]) for t in stamps]
        rows += [(host, t, a) for t, a in ticks]
        closed, _ = advance(IDLE, ((t, a, t == stamps[-1]) for t, a in ticks), post, debounce)
        want += [(host, *c) for c in closed]
    df = spark.createDataFrame(rows + [(0, rows[0][1], None)], "host int, ts_ns long, is_anomaly boolean")
    got = episodes.episodes(df, "host", ordered.by_time("ts_ns", chunk), post, debounce).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_threshold_drift_over_several_levels(spark):
    r = random.Random(2)
    labels = [r.choice(["false_positive", "true_positive", "true_positive", "noise"]) for _ in range(400)] + ["true_positive"] * 80 + [list(feedback.NEGATIVE)[0]] * 90
    rows = [(f"f{i:04}", x, 1000 * i) for i, x in enumerate(labels)]
    df = spark.createDataFrame(rows, "feedback_id string, label string, created_at_ns long")
    down, up = F.col("label").isin(*feedback.NEGATIVE), F.col("label") == "true_positive"
    shift = F.when(down, 0.02).when(up, -0.01).otherwise(0.0)
    walk = ordered.clamped_walk(df, [], ["created_at_ns"], F.lit(0.5), shift, F.when(up, 0.2), F.when(down, 0.95), ordered.by_time("created_at_ns", 50_000), "t", block=6)
    got = {x["feedback_id"]: x["t"] for x in walk.collect()}
    same = {x["feedback_id"]: x["threshold"] for x in feedback.threshold_drift(df, 0.5, ordered.by_time("created_at_ns", 50_000)).collect()}
    t = 0.5
    for i, x, _ in rows:
        t = min(0.95, t + 0.02) if x in feedback.NEGATIVE else max(0.2, t - 0.01) if x == "true_positive" else t
        assert math.isclose(got[i], t, abs_tol=1e-12) and math.isclose(same[i], t, abs_tol=1e-12)


def test_walk_by_key_and_empty(spark):
    df = spark.createDataFrame([(k, i, float(i % 5 - 2 + k)) for k in range(3) for i in range(50)], "k long, i long, a double")
    walk = lambda d: ordered.clamped_walk(d, ["k"], ["i"], F.lit(1.0), F.col("a"), F.lit(0.0), F.lit(9.0), ordered.by_time("i", 8), "x", block=4)
    got = {(x["k"], x["i"]): x["x"] for x in walk(df).collect()}
    for k in range(3):
        x = 1.0
        for i in range(50):
            x = min(9.0, max(0.0, x + i % 5 - 2 + k))
            assert got[k, i] == x
    assert walk(df.limit(0)).count() == 0


def linear(values, q):
    s, rank = sorted(values), q * (len(values) - 1)
    lo = math.floor(rank)
    return s[lo] + (s[math.ceil(rank)] - s[lo]) * (rank - lo)


@pytest.mark.parametrize("small", [1, 1024])
def test_quantiles(spark, monkeypatch, small):
    from telemill.operators import quantile

    monkeypatch.setattr(quantile, "SORTED", small)  # every bin is narrowed to one value
    r = random.Random(4)
    data = {
        "n": [r.gauss(0, 1) for _ in range(3000)], "c": [3.0] * 50, "w": [r.choice([-1, 1]) * math.exp(r.gauss(0, 200)) for _ in range(800)],
        "k": [1e9 + r.randrange(50) * 1e-6 for _ in range(500)], "i": [math.inf, -math.inf, 0.0, 1.0, 2.0], "one": [-7.5], "tiny": [r.randrange(-9, 9) * 5e-324 for _ in range(99)],
    }
    df = spark.createDataFrame([(k, v) for k, vs in data.items() for v in vs] + [("n", None), (None, 1.0)], "k string, v double")
    qs = {"a": 0.0, "b": 0.01, "m": 0.5, "p": 0.995, "z": 1.0}
    got = {x["k"]: x for x in exact_quantiles(df, ["k"], "v", qs).collect()}
    assert set(got) == set(data)
    for k, vs in data.items():
        for name, q in qs.items():
            want = linear(vs, q)
            assert got[k][name] == want or (math.isnan(want) and math.isnan(got[k][name]))
    both = exact_quantiles(df.where("k = 'n'"), [], "v", {"m": 0.5}).first()
    mad = median_and_mad(df.where("k = 'n'"), [], "v").first()
    assert both["m"] == mad["median"] == linear(data["n"], 0.5)
    assert mad["mad"] == linear([abs(v - mad["median"]) for v in data["n"]], 0.5)
    assert exact_quantiles(df.limit(0), ["k"], "v", qs).count() == 0


@pytest.mark.parametrize("alpha", [0.2, 0.5, 0.97, 1.0, 0.01])
def test_ewma_equals_the_recurrence(spark, alpha):
    r = random.Random(9)
    xs = {"a": [r.gauss(0, 1) for _ in range(6000)], "b": [1e12] + [1e-9] * 3000, "c": [7.0]}
    df = spark.createDataFrame([(k, i, x) for k, v in xs.items() for i, x in enumerate(v)], "k string, t long, x double")
    got = {(g["k"], g["t"]): g["ewma"] for g in ordered.ewma(df, ["k"], ["t"], "x", alpha, ordered.by_time("t", 700)).collect()}
    for k, v in xs.items():
        y = None
        for i, x in enumerate(v):
            y = x if y is None else alpha * x + (1 - alpha) * y
            assert math.isclose(got[k, i], y, rel_tol=1e-10, abs_tol=1e-12), (k, i)
    whole = ordered.ewma(df.where("k = 'a'").drop("k"), [], ["t"], "x", alpha, ordered.by_time("t", 700)).collect()
    assert all(math.isclose(g["ewma"], got["a", g["t"]], rel_tol=1e-12, abs_tol=1e-14) for g in whole)
