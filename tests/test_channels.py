"""Channel maxima from runs against the dense matrix."""

import random

import pytest
from pyspark.sql import functions as F

from telemill.functions.scores import MAD_SCALE
from telemill.operators import detect, ordered
from tests.test_folds import linear


def data(seed, ticks=60, groups=2, channels=5):
    r = random.Random(seed)
    rows = []
    for g in range(groups):
        for c in range(channels):
            for t in sorted(r.sample(range(ticks), r.choice([1, 3, ticks // 2, ticks]))):
                rows.append((g, t, t, "e", f"m{c}", None if r.random() < 0.1 else r.choice([r.gauss(5, 2), 5.0]), r.choice(["observed", "observed", "stale"])))
    return rows + [(g, t, 1000 + t, "e", "m0", 1.0, "missing") for g in range(groups) for t in range(0, ticks, 7)]


SCHEMA = "g int, ts_ns long, seq long, entity_id string, metric_id string, value double, quality string"


def dense(rows, g, names=None):
    ticks = sorted({r[1] for r in rows if r[0] == g})
    names = names if names is not None else sorted({r[4] for r in rows if r[0] == g and r[6] == "observed"})
    out = {}
    for m in names:
        seen = {r[1]: r[5] for r in sorted(rows, key=lambda r: r[2]) if r[0] == g and r[4] == m and r[6] == "observed" and r[5] is not None}
        last, col = 0.0, []
        for t in ticks:
            last = seen.get(t, last)
            col.append(last)
        out[m] = col
    return ticks, out


@pytest.mark.parametrize("block", [4, 16, 4096])
def test_maxima_equal_the_matrix(spark, monkeypatch, block):
    monkeypatch.setattr(detect, "BLOCK", block)
    rows = data(block)
    points = spark.createDataFrame(rows, SCHEMA)
    runs = detect.channel_runs(points, ["g"], ordered.by_time("ts_ns", 9))
    model, q = detect.fit_channels(runs)
    fitted = {(r["g"], r["metric_id"]): (r["median"], r["mad"]) for r in model.collect()}
    got = {(r["g"], r["ts_ns"]): r["z"] for r in detect.max_channel_z(runs, model).collect()}
    q99 = {r["g"]: r["q99"] for r in q.collect()}
    ask = spark.createDataFrame([(g, t, "here") for g in (0, 1) for t in (0, 13, 30)], "g int, ts_ns long, tag string")
    looked = {(r["g"], r["ts_ns"], r["metric_id"]): r["value"] for r in runs.at(ask).collect()}
    for g in (0, 1):
        ticks, cols = dense(rows, g)
        zs = []
        for m, col in cols.items():
            med = linear(col, 0.5)
            assert fitted[g, m] == (med, linear([abs(v - med) for v in col], 0.5))
        for i, t in enumerate(ticks):
            zs.append(max(abs(col[i] - fitted[g, m][0]) / (MAD_SCALE * max(fitted[g, m][1], 1e-8)) for m, col in cols.items()))
            assert abs(got[g, t] - zs[-1]) <= 1e-9 * max(1.0, zs[-1])
            for m, col in cols.items():
                if t in (0, 13, 30):
                    assert looked[g, t, m] == col[i]
        assert abs(q99[g] - max(linear(zs, 0.99), 1e-8)) <= 1e-9 * max(1.0, q99[g])
    assert len(got) == sum(len(dense(rows, g)[0]) for g in (0, 1))


def test_runs_of_given_channels_and_no_group(spark):
    rows = [r for r in data(3) if r[0] == 0]
    points = spark.createDataFrame(rows, SCHEMA).drop("g")
    names = ["m0", "m1", "never"]
    wanted = spark.createDataFrame([("e", n) for n in names], "entity_id string, metric_id string")
    runs = detect.channel_runs(points, [], ordered.by_time("ts_ns", 9), wanted)
    model = spark.createDataFrame([("e", n, 1.0, 2.0) for n in names], "entity_id string, metric_id string, median double, mad double")
    got = {r["ts_ns"]: r["z"] for r in detect.max_channel_z(runs, model).collect()}
    ticks, cols = dense(rows, 0, names)
    want = {t: max(abs(cols[m][i] - 1.0) / (MAD_SCALE * 2.0) for m in names) for i, t in enumerate(ticks)}
    assert got.keys() == want.keys() and all(abs(got[t] - want[t]) < 1e-12 for t in want)
    # there are as many runs as observations, and one more where a channel starts late
    assert runs.runs.count() <= sum(r[6] == "observed" and r[5] is not None and r[4] in names for r in rows) + 3


@pytest.mark.parametrize("n,size", [(1, 3), (2, 5), (3, 5), (40, 5), (20000, 3)])
def test_median_filter(spark, n, size):
    r = random.Random(n)
    xs = [r.random() for _ in range(n)]
    df = spark.createDataFrame([("k", i, x) for i, x in enumerate(xs)], "k string, t long, x double")
    got = {g["t"]: g["y"] for g in detect.median_filter(df, ["k"], ["t"], {"y": "x"}, size, ordered.by_time("t", 5000)).collect()}
    half = size // 2
    for i in range(n):
        picks = [((i + o) % (2 * n)) for o in range(-half, half + 1)]
        assert got[i] == sorted(xs[p] if p < n else xs[2 * n - 1 - p] for p in picks)[half]
    assert detect.median_filter(df.limit(0), ["k"], ["t"], {"y": "x"}, size, F.lit(0)).count() == 0


def test_reduced_points_and_a_prefix_give_the_same_runs(spark):
    points = spark.createDataFrame(data(8), SCHEMA)
    chunk = ordered.by_time("ts_ns", 9)
    rows = lambda r: (sorted(map(tuple, r.ticks.select("g", "ts_ns", "idx").collect())), sorted(map(tuple, r.runs.select("g", "metric_id", "start", "until", "value").collect())))
    once = detect.channel_values(points, ["g"])
    assert once.count() == points.select("g", "ts_ns", "entity_id", "metric_id").distinct().count()
    whole = detect.channel_runs(once, ["g"], chunk)
    assert rows(whole) == rows(detect.channel_runs(points, ["g"], chunk))
    channels = points.where("quality = 'observed'").select("g", "entity_id", "metric_id").distinct()
    early = detect.channel_runs(points.where("ts_ns <= 20 + g"), ["g"], chunk, channels)
    assert rows(whole.first(spark.createDataFrame([(0, 20), (1, 21)], "g int, c long"))) == rows(early)
