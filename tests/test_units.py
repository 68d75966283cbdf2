"""Hand values, brute force and invariants."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from telemill.functions import numerics
from telemill.functions.histograms import base4_bin, hist_percentile_us, log2_bin
from telemill.functions.scores import robust_z, sigmoid
from telemill.operators import detect, episodes, evaluate, ordered, pairing, rates, rca, score_ops, spectral, topk, windows
from telemill.operators.quantile import exact_quantiles, median_and_mad
from telemill.sources import points as src, sessions


def df_of(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def walk(spark):
    rng = np.random.default_rng(3)
    # one key holds most of the rows
    rows = [(("hot" if rng.random() < 0.8 else f"k{rng.integers(3)}"), int(t), float(v)) for t, v in enumerate(rng.normal(size=600))]
    return pd.DataFrame(rows, columns=["key", "t", "v"]), spark.createDataFrame(rows, "key string, t long, v double")


@pytest.mark.parametrize("width", [1, 7, 100, 10_000])
def test_ordered_steps_do_not_depend_on_chunks(walk, width):
    pdf, df = walk
    chunk = ordered.by_time("t", width)
    g = pdf.groupby("key")["v"]
    want = pdf.assign(prev=g.shift(), run=g.cumsum(), top=g.cummax(), idx=g.cumcount(), e=g.transform(lambda s: s.ewm(alpha=0.2, adjust=False).mean()))
    out = ordered.previous(df, ["key"], ["t"], {"prev": "v"}, chunk)
    out = ordered.running(out, ["key"], ["t"], {"run": ("sum", F.col("v")), "top": ("max", F.col("v"))}, chunk)
    out = ordered.with_index(out, ["key"], ["t"], chunk)
    got = ordered.ewma(out, ["key"], ["t"], "v", 0.2, chunk, "e").toPandas().sort_values("t").reset_index(drop=True)
    for c in ("prev", "run", "top", "idx", "e"):
        np.testing.assert_allclose(got[c].astype(float), want[c].astype(float), atol=1e-9, equal_nan=True)


@pytest.mark.parametrize("width", [5, 60, 10_000])
def test_fold_equals_sequential_cusum(walk, width):
    pdf, df = walk
    k, h = 0.1, 1.5
    want = {}
    for key, g in pdf.groupby("key"):
        s = 0.0
        for t, x in zip(g["t"], g["v"]):
            s = max(0.0, s + x - k)
            want[t] = (s, int(s > h))
            s = 0.0 if s > h else s
    rows = df.withColumns({"k": F.lit(k), "h": F.lit(h)})
    got = score_ops.cusum(rows, ["key"], ["t"], "v", ordered.by_time("t", width)).collect()
    assert len(got) == len(pdf)
    for r in got:
        assert (r["alarm"], round(r["stat"], 9)) == (want[r["t"]][1], round(want[r["t"]][0], 9))


def test_exact_quantiles(spark):
    rng = np.random.default_rng(0)
    v = np.round(rng.lognormal(size=60_000), 3)
    df = spark.createDataFrame(pd.DataFrame({"g": np.where(np.arange(60_000) < 50_000, "a", "b"), "v": v}))
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", {"m": 0.5, "t": 0.99}, accuracy=1000).collect()}
    for g, x in (("a", v[:50_000]), ("b", v[50_000:])):
        assert got[g]["m"] == pytest.approx(np.quantile(x, 0.5)) and got[g]["t"] == pytest.approx(np.quantile(x, 0.99))
    one = median_and_mad(df, [], "v").first()
    assert one["mad"] == pytest.approx(np.median(np.abs(v - np.median(v))))


def test_histogram_bins_and_percentile(spark):
    vals = [0, 1, 2, 255, 256, 1023, 1024, 4096, 256 * 4**11, 256 * 4**12, 2**62]
    rows = df_of(spark, [(v,) for v in vals], "v long").select("v", base4_bin("v").alias("b"), log2_bin("v").alias("l")).collect()
    for r in rows:
        v, b = r["v"] >> 8, 0
        while v >= 4 and b < 12:
            v, b = v >> 2, b + 1
        assert r["b"] == (0 if r["v"] < 256 else b)
        assert r["l"] == (0 if r["v"] < 2 else r["v"].bit_length() - 1)
    h = df_of(spark, [([0, 5, 0, 5] + [0] * 9,), ([0] * 13,)], "h array<long>").select(hist_percentile_us("h", 0.5).alias("a"), hist_percentile_us("h", 0.99).alias("b")).collect()
    assert [tuple(r) for r in h] == [(1.024, 16.384), (0.0, 0.0)]


def test_scores(spark):
    r = df_of(spark, [(3.0,), (float("nan"),)], "v double").select(
        robust_z("v", F.lit(1.0), F.lit(1.0)).alias("z"), robust_z("v", F.lit(1.0), F.lit(0.0)).alias("flat"), sigmoid(F.lit(-800.0)).alias("s")
    ).collect()
    assert r[0]["z"] == pytest.approx(2 / 1.4826) and r[1]["z"] == 0 and r[0]["flat"] == 0 and r[0]["s"] == pytest.approx(0)


def test_group_rates_by_thread_and_process(spark):
    # cumulative on-CPU time of tids 100 and 101 (process 7) and 200 (process 9) at three ticks
    s = 1_000_000_000
    rows = [(100, 7, 0, 0), (101, 7, 0, 0), (200, 9, 0, 0), (100, 7, s, 10 * s), (101, 7, s, 5 * s), (200, 9, s, s), (100, 7, 2 * s, 30 * s), (101, 7, 2 * s, 20 * s), (200, 9, 2 * s, 3 * s)]
    df = df_of(spark, rows, "tid long, tgid long, ts_ns long, on_cpu_ns long")
    m = rates.deep_metrics(["on_cpu_ns"])
    got = rates.group_aggregate(df, "pid", m, ["on_cpu_ns"], ordered.by_time(), sel=[7]).orderBy("ts_ns").collect()
    assert [r["y"] for r in got] == [1500.0, 3500.0]
    top = rates.group_aggregate(df, "top", m, ["on_cpu_ns"], ordered.by_time(), n=3)
    assert {r["tgid"] for r in top.collect()} == {7, 9}


def test_lock_latency_averages(spark):
    s = 1_000_000_000
    df = df_of(spark, [(1, 0, 0, 0), (1, s, 10, 800_000_000), (2, 0, 0, 0), (2, s, 5, 500_000_000)], "tid long, ts_ns long, lock_waits long, lock_lat_ns long")
    got = rates.derive(df, ["tid"], rates.deep_metrics(["lock_waits", "lock_lat_ns"]), ["lock_waits", "lock_lat_ns"], ordered.by_time())
    assert {r["tid"]: r["y"] for r in got.where("mid = 'lock_avg_ms'").collect()} == {1: 80.0, 2: 100.0}


def test_severity_and_rollups(spark):
    rows = [("c", side, "a", i, v) for side, v in (("normal", 0.0), ("anomal", 1.0)) for i in range(3)]
    sev = rca.severity(df_of(spark, rows, "case string, side string, col string, sec long, v double")).collect()
    assert [(r["col"], r["score"]) for r in sev] == [("a", 1.0)]
    ranks = df_of(spark, [("c", "adservice_cpu", 0.2), ("c", "adservice_mem", 0.3), ("c", "cartservice_cpu", 0.5)], "case string, col string, score double")
    assert {r["service"]: round(r["score"], 9) for r in rca.rollup_sum(ranks).collect()} == {"adservice": 0.5, "cartservice": 0.5}
    hi = df_of(spark, [("c", "adservice_cpu", 0.2), ("c", "adservice_mem", 0.8), ("c", "cartservice_cpu", 0.5)], "case string, col string, score double")
    assert {r["service"]: round(r["score"] * 1.3, 9) for r in rca.rollup_max(hi).collect()} == {"adservice": 0.8, "cartservice": 0.5}


def test_planted_cause_ranks_first(spark):
    rng = np.random.default_rng(1)
    pts = [("c", f"{svc}", t * 1_000_000_000, m, float(rng.normal() + (2 * (t >= 300) * 4 if (svc, m) == ("adservice", "cpu") else 0)), "observed")
           for t in range(600) for svc in ("adservice", "cartservice", "checkoutservice") for m in ("cpu", "mem")]
    points = df_of(spark, pts, "case string, entity_id string, ts_ns long, metric_id string, value double, quality string")
    table = rca.with_side(rca.decimate_rows(rca.metric_table(points), 5), df_of(spark, [("c", 300)], "case string, inject_s long"))
    sided = rca.drop_constant(table)
    top = rca.rollup_sum(rca.severity(sided)).orderBy(F.desc("score")).first()
    assert top["service"] == "adservice"
    rows = rca.sample_rows(rca.discretise(sided, rca.kbins_edges(sided)))
    found = rca.multi_phase(rows, sided.select("case", "col").distinct()).orderBy("pos").collect()
    assert found[0]["col"] == "adservice_cpu"
    kept, removed = rca.local_skeleton(rows, sided.select("case", "col").distinct(), 0.01, max_depth=1)
    assert [r["y"] for r in kept.collect()] == ["adservice_cpu"] and removed.count() == 5


def test_gamma_tail_and_mixture():
    # 5 % points of the chi-square distribution
    p = numerics.chi2_tail(np.array([3.841458820694124, 11.070497693516351, 124.34211340400407, 5.0]), np.array([1, 5, 100, 0]))
    np.testing.assert_allclose(p, [0.05, 0.05, 0.05, 1.0], rtol=1e-9)
    x = np.vstack([np.random.default_rng(0).normal(size=(20, 2)) * 0.1, np.random.default_rng(1).normal(size=(20, 2)) * 0.1 + 5])
    labels = numerics.best_mixture(x, 4)
    assert not set(labels[:20]) & set(labels[20:])


def test_chi_square_batch_equals_dense_table(spark):
    rng = np.random.default_rng(5)
    a, b, s = rng.integers(0, 3, 300), rng.integers(0, 2, 300), rng.integers(0, 2, 300)
    rows = df_of(spark, [("c", "n", i, {"a": int(x), "b": int(y), "s": int(z)}) for i, (x, y, z) in enumerate(zip(a, b, s))], "case string, side string, sec long, bins map<string,int>")
    tests = df_of(spark, [("c", 1, "a", "b", []), ("c", 2, "a", "b", ["s"])], "case string, test_id long, x string, y string, given array<string>")
    got = {r["test_id"]: r["p"] for r in rca.chi_square_ci(rows, tests).collect()}
    cells = np.column_stack([a, b, s])
    w = np.ones(300)
    assert got[1] == pytest.approx(numerics.weighted_ci(cells, w, 0, 1, ())) and got[2] == pytest.approx(numerics.weighted_ci(cells, w, 0, 1, (2,)))


def test_gpd_recovers_parameters(spark):
    rng = np.random.default_rng(2)
    shape, scale = 0.2, 1.5
    x = scale / shape * ((1 - rng.random(20_000)) ** -shape - 1)
    fit = score_ops.fit_gpd(spark.createDataFrame(pd.DataFrame({"g": "a", "x": x})), ["g"]).first()
    assert fit["shape"] == pytest.approx(shape, abs=0.03) and fit["shape"] / fit["theta"] == pytest.approx(scale, rel=0.05)


def test_spectral_fit_equals_least_squares(spark):
    rng = np.random.default_rng(4)
    low, n = 2, 16
    wins = [np.cumsum(rng.normal(size=int(rng.integers(8, 13)))) for _ in range(40)]
    df = spark.createDataFrame([(i * 10, i * 10 + 10, "e", "m", [float(v) for v in w]) for i, w in enumerate(wins)], "w_start long, w_end long, entity_id string, metric_id string, x array<double>")
    model = spectral.fit(df, low, n, 70)
    got = {r["w_start"]: r["score"] for r in spectral.score(df, model, low, n, 70).collect()}
    spec = np.vstack([np.fft.rfft(w, n=n) for w in wins])
    lo, hi = spec[:, :low], spec[:, low:]
    r = np.zeros(len(wins))
    predicted = np.zeros_like(hi)
    for k in range(hi.shape[1]):  # one high bin at a time: its real part as a sum of the low bins' parts and a constant
        inputs = np.array([[*z.real, *z.imag, 1.0] for z in lo])
        real, *_ = np.linalg.lstsq(inputs, hi[:, k].real, rcond=None)
        imag, *_ = np.linalg.lstsq(inputs, hi[:, k].imag, rcond=None)
        predicted[:, k] = lo @ (real[:low] + 1j * real[low : 2 * low]) + complex(real[-1], imag[-1])
    for i, x in enumerate(wins):
        rebuilt = np.fft.irfft(np.concatenate([lo[i], predicted[i]]), n=n)[: len(x)]
        r[i] = np.std(x - rebuilt)
    z = np.maximum(0, (r - np.median(r)) / (1.4826 * np.median(np.abs(r - np.median(r))) + 1e-9))
    np.testing.assert_allclose([got[i * 10] for i in range(40)], z, rtol=1e-6, atol=1e-8)


@pytest.mark.parametrize("width", [10**9, 4 * 10**9, 10**13])
def test_hysteresis_is_chunk_independent_and_never_empty(spark, width):
    rng = np.random.default_rng(9)
    rows = [("h", t * 10**9, int(g), int(r) + 1) for t in range(20) for r, g in enumerate(rng.permutation(12))]
    df = df_of(spark, rows, "host string, ts_ns long, tgid long, rank int")
    got = topk.hysteresis(df, "host", ordered.by_time("ts_ns", width), 3, 6, 2, 1, 2).toPandas()
    assert (got.groupby("ts_ns").size() <= 2).all() and got["ts_ns"].nunique() == 20
    whole = topk.hysteresis(df, "host", ordered.by_time("ts_ns", 10**15), 3, 6, 2, 1, 2).toPandas()
    key = ["ts_ns", "tgid"]
    pd.testing.assert_frame_equal(got.sort_values(key).reset_index(drop=True), whole.sort_values(key).reset_index(drop=True))


def test_thresholds_do_not_see_test_data(spark):
    rng = np.random.default_rng(6)
    base = [("e", "m", t, float(v), "observed") for t, v in enumerate(rng.normal(size=300))]
    schema = "entity_id string, metric_id string, ts_ns long, value double, quality string"

    def thr(level):
        pts = df_of(spark, base + [("e", "m", 300 + i, level, "observed") for i in range(40)], schema)
        from telemill.operators import stats as st

        tr, va = pts.where("ts_ns < 200"), pts.where("ts_ns BETWEEN 200 AND 299")
        s = st.fit_stats(tr)
        return st.pot_thresholds(s, va).first()["threshold"]

    assert thr(50.0) == thr(5000.0)


def test_median_filter_reflects(spark):
    v = [5.0, 1.0, 4.0, 2.0, 3.0, 9.0]
    df = df_of(spark, [(i, x) for i, x in enumerate(v)], "ts_ns long, v double")
    got = detect.median_filter(df, [], ["ts_ns"], {"m": "v"}, 5, ordered.by_time("ts_ns", 2)).orderBy("ts_ns").collect()
    pad = np.array(v[1::-1] + v + v[:-3:-1])
    assert [r["m"] for r in got] == [float(np.median(pad[i : i + 5])) for i in range(6)]


def test_sources(spark):
    good, bad = src.parse_points_jsonl(df_of(spark, [('{"ts_ns": 1, "entity_id": "a", "entity_type": "host", "metric_id": "m", "value": true}',), ("nope",), ("  ",)], "value string"))
    assert [(r["value"], r["quality"], r["source"]) for r in good.collect()] == [(1.0, "observed", "replay")]
    assert [r["reason"] for r in bad.collect()] == ["bad_json"]
    with pytest.raises(ValueError):
        src.csv_rows_to_points(df_of(spark, [("1",)], "ts_ns string"))
    with pytest.raises(ValueError):
        src.read_points(spark, "/tmp/x.bin")
    lines = df_of(spark, [("p:1234/myapp;t:1240/w;f;/lib/x.so+0x12 5",), ("a;b;c 7",), ("x -1",)], "line string")
    p = sessions.parse_folded(lines)
    assert p.agg(F.sum("value")).first()[0] == 12 and [r["tgid"] for r in sessions.folded_totals(p, "tgid").collect()] == [1234]


def test_windows_and_splits(spark):
    pts = df_of(spark, [(t, i, "e", "m", 1.0, "observed") for i, t in enumerate([10, 35, 70])], "ts_ns long, seq long, entity_id string, metric_id string, value double, quality string")
    w = windows.sliding_windows(pts, 60, 30)
    assert sorted((r["ts_ns"], r["w_start"]) for r in w.collect()) == [(10, 0), (35, 0), (35, 30), (70, 30), (70, 60)]
    s = windows.split_by_time(pts, 0.6, 0.2)
    assert {r["ts_ns"]: r["split"] for r in s.collect()} == {10: "train", 35: "train", 70: "test"}
    assert s.count() == pts.count()


def test_episode_ends_at_first_of_three_normals(spark):
    s = 1_000_000_000
    bad = [0, 1, 1, 0, 0, 0, 1, 0, 0, 1, 0]
    df = df_of(spark, [("h", i * s, bool(b)) for i, b in enumerate(bad)], "host string, ts_ns long, is_anomaly boolean")
    for width in (2 * s, 100 * s):
        got = episodes.episodes(df, "host", ordered.by_time("ts_ns", width), post_ns=6 * s).orderBy("start_ns").collect()
        assert [(r["start_ns"] // s, r["end_ns"] // s, r["closed_ns"] // s) for r in got] == [(1, 3, 7), (9, 10, 10)]


def test_rate_limit(spark):
    ts = [0, 4, 9, 10, 11, 19, 20, 35]
    df = df_of(spark, [("k", t * 100_000_000) for t in ts], "key string, ts_ns long")
    got = pairing.rate_limit(df, ["key"], ["ts_ns"], 1, ordered.by_time("ts_ns", 700_000_000)).collect()
    assert sorted(r["ts_ns"] // 100_000_000 for r in got) == [0, 10, 20, 35]


def test_segment_recall_may_exceed_one(spark):
    rows = [("s", i, p, l) for i, (p, l) in enumerate(zip([1, 0, 1, 0, 1], [1, 1, 1, 1, 1]))]
    r = evaluate.segment_f1(df_of(spark, rows, "k string, ts_ns long, pred int, label int"), ["k"], ["ts_ns"], ordered.by_time("ts_ns", 2)).first()
    assert (r["seg_precision"], r["seg_recall"]) == (1.0, 3.0)
