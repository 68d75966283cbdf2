"""Fits by distributed sums and factors against dense counterparts."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from telemill.operators import score_ops, spectral


def profile(theta, xs):
    k = float(np.mean(np.log1p(theta * xs)))
    if abs(theta) * xs.max() < 1e-9:
        return -(math.log(xs.mean()) + 1)
    return -(math.log(k / theta) + k + 1) if k > -1 else -math.inf


def best_theta(xs):
    """The highest maximum on a fine grid, sharpened by golden section."""
    us = np.linspace(-30, 30, 6001)
    like = [profile(math.expm1(u) / xs.max(), xs) for u in us]
    i = int(np.argmax(like))
    a, b = us[max(i - 1, 0)], us[min(i + 1, len(us) - 1)]
    for _ in range(200):
        c, d = b - (b - a) * 0.6180339887498949, a + (b - a) * 0.6180339887498949
        if profile(math.expm1(c) / xs.max(), xs) > profile(math.expm1(d) / xs.max(), xs):
            b = d
        else:
            a = c
    return math.expm1((a + b) / 2) / xs.max()


def test_tail_fit_finds_the_maximum(spark):
    r = random.Random(3)
    gpd = lambda shape, scale, n: [scale / shape * ((1 - r.random()) ** -shape - 1) for _ in range(n)]
    data = {"heavy": gpd(0.6, 2.0, 3000), "light": gpd(-0.3, 5.0, 3000), "small": gpd(0.2, 1e-3, 40), "very": gpd(3.0, 1.0, 500), "exp": [r.expovariate(0.5) for _ in range(2000)]}
    df = spark.createDataFrame([(k, x) for k, xs in data.items() for x in xs], "k string, x double")
    got = {g["k"]: g for g in score_ops.fit_gpd(df, ["k"]).collect()}
    for k, xs in data.items():
        xs = np.array(xs)
        theta, want = got[k]["theta"], best_theta(xs)
        assert profile(theta, xs) >= profile(want, xs) - 1e-12, k
        assert math.isclose(got[k]["shape"], float(np.mean(np.log1p(theta * xs))), rel_tol=1e-9, abs_tol=1e-12)
        eps = 1e-6 / xs.max()
        assert profile(theta, xs) >= max(profile(theta - eps, xs), profile(theta + eps, xs)) - 1e-13, k


def test_tail_fit_beyond_the_first_grid(spark):
    xs = np.array([1e-9] * 400 + [1e-3, 1.0, 1e3])  # the maximum lies far out
    df = spark.createDataFrame([("k", float(x)) for x in xs], "k string, x double")
    theta = score_ops.fit_gpd(df, ["k"]).first()["theta"]
    assert theta * xs.max() > math.exp(7) and profile(theta, xs) >= profile(best_theta(xs), xs) - 1e-12


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_factors_merge_to_least_squares(parts):
    r = np.random.default_rng(parts)
    a = r.normal(size=(400, 5))
    a[:, 4] = a[:, 3] + 1e-7 * r.normal(size=400)  # nearly collinear: a Gram matrix would lose it
    b = a @ r.normal(size=(5, 3)) + 1e-3 * r.normal(size=(400, 3))
    factors = [spectral._factor(x, y) for x, y in zip(np.array_split(a, parts), np.array_split(b, parts))]
    while len(factors) > 1:
        factors = [spectral._merged(factors[i : i + 4], 5) for i in range(0, len(factors), 4)]
    got = np.linalg.lstsq(factors[0][:, :5], factors[0][:, 5:], rcond=5 * np.finfo(float).eps)[0]
    want = np.linalg.lstsq(a, b, rcond=None)[0]
    assert np.abs(a @ got - a @ want).max() < 1e-8 and np.abs(got - want).max() < 1e-8 * np.abs(want).max()


def test_spectral_weights_do_not_depend_on_chunks(spark):
    r = random.Random(1)
    rows = [("e", "m", i * 100, i * 100 + 99, [math.sin(0.3 * j * (1 + i % 3)) + r.gauss(0, 0.2) for j in range(32)]) for i in range(200)]
    df = spark.createDataFrame(rows, "entity_id string, metric_id string, w_start long, w_end long, x array<double>")
    whole, cut_up = (spectral.fit(df, 4, 32, c).first() for c in (10**9, 300))
    for c in ("w_re", "w_im", "b_re", "b_im"):
        assert np.allclose(whole[c], cut_up[c], rtol=1e-9, atol=1e-9)
    assert math.isclose(whole["r_med"], cut_up["r_med"], rel_tol=1e-9)
    assert df.where(F.size("x") > 0).count() == 200
