"""Low-pass spectral reconstruction model.

A window is rebuilt from its low frequencies: the high ones are predicted by a
linear map fitted per series. The windows of a series are reduced chunk by chunk
to one triangular factor each, and factors are merged in a tree; no series is
ever gathered in one task, and the data's condition is never squared.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telemill.functions.integers import floor_div
from telemill.operators.quantile import exact_quantiles, median_and_mad
from telemill.session import cut

SERIES = ("entity_id", "metric_id")
_KEYS = T.StructType([T.StructField(k, T.StringType()) for k in SERIES])
CHUNK = "__chunk"


def collect_windows(cells: DataFrame, min_points: int) -> DataFrame:
    """Observed values of each (window, series) in time order; bounded by the window's grid."""
    seen = F.when(F.col("observed") & F.col("value").isNotNull() & ~F.isnan("value"), F.struct("cell_ts", "value"))
    w = cells.groupBy("w_start", "w_end", *SERIES).agg(F.array_sort(F.collect_list(seen)).alias("a"))
    return w.select("w_start", "w_end", *SERIES, F.transform("a", lambda c: c["value"]).alias("x")).where(F.size("x") >= min_points)


def _with_length(windows: DataFrame, n_fft: int) -> DataFrame:
    ratio = F.size("x") / F.lit(n_fft)
    doublings = F.greatest(F.lit(0.0), F.ceil(F.log2(ratio)))
    return windows.withColumn("n", (F.lit(n_fft) * F.pow(F.lit(2.0), doublings)).cast("int"))


def _chunked(windows: DataFrame, chunk_ns: int) -> DataFrame:
    return windows.withColumn(CHUNK, floor_div(F.col("w_start"), F.lit(chunk_ns)))


def _bands(windows, n: int, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cosine and sine coefficients of windows padded to ``n``: of the low bins, then of the high ones."""
    spectrum = np.array([np.fft.rfft(np.asarray(x), n=n) for x in windows])
    c, s = spectrum.real, spectrum.imag
    return c[:, :low], s[:, :low], c[:, low:], s[:, low:]


def _factor(inputs: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """[R, Q'targets] of the QR decomposition of ``inputs``, padded to square: what least squares needs of any rows."""
    q, r = np.linalg.qr(inputs)
    out = np.hstack([r, q.T @ targets])
    return np.vstack([out, np.zeros((inputs.shape[1] - len(out), out.shape[1]))])


def _chunk_factor(windows, n: int, low: int) -> np.ndarray:
    """Factor of [low cosines, low sines, 1] against the high bins."""
    c, s, hc, hs = _bands(windows, n, low)
    return _factor(np.hstack([c, s, np.ones((len(c), 1))]), np.hstack([hc, hs]))


def _merged(factors: list[np.ndarray], size: int) -> np.ndarray:
    both = np.vstack(factors)
    return _factor(both[:, :size], both[:, size:])


def _coefficients(factor: np.ndarray, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maps (high x low) of the low cosines and sines, and the high bins' constant parts.

    Least squares of least norm. The model has one complex map, so both of its
    real maps come from the fit of the high cosines; of the fit of the high
    sines only the constant is used.
    """
    size = 2 * low + 1
    high = (factor.shape[1] - size) // 2
    fitted = np.linalg.lstsq(factor[:, :size], factor[:, size:], rcond=size * np.finfo(float).eps)[0]
    return fitted[:low, :high].T, fitted[low : 2 * low, :high].T, fitted[-1, :high], fitted[-1, high:]


def _unexplained(windows: list[np.ndarray], n: int, low: int, model: tuple[np.ndarray, ...]) -> list[float]:
    """Deviation of each window's part that the model does not predict; the low bins are given, so only high ones err."""
    by_cos, by_sin, const_c, const_s = model
    c, s, hc, hs = _bands(windows, n, low)
    miss_c = hc - (c @ by_cos.T - s @ by_sin.T + const_c)
    miss_s = hs - (s @ by_cos.T + c @ by_sin.T + const_s)
    wave = np.fft.irfft(np.hstack([np.zeros((len(c), low)), miss_c + 1j * miss_s]), n=n, axis=1)
    return [float(np.std(w[: len(x)])) for w, x in zip(wave, windows)]


_MODEL = T.StructType(
    [*_KEYS.fields, *[T.StructField(c, T.ArrayType(T.DoubleType())) for c in ("w_re", "w_im", "b_re", "b_im")]]
)


FAN = 16  # factors merged at a time


def _fit_weights(windows: DataFrame, low: int, chunk_ns: int) -> DataFrame:
    size = 2 * low + 1
    schema = T.StructType([*_KEYS.fields, T.StructField("part", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("f", T.ArrayType(T.DoubleType()))])
    names = [f.name for f in schema]

    def chunk_factor(pdf: pd.DataFrame) -> pd.DataFrame:
        f = _chunk_factor(pdf["x"], int(pdf["n"].iloc[0]), low).ravel()
        return pd.DataFrame([[*pdf.loc[pdf.index[0], list(SERIES)], 0, len(pdf), f]], columns=names)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        f = _merged([np.asarray(x).reshape(size, -1) for x in pdf.sort_values("part")["f"]], size).ravel()
        return pd.DataFrame([[*pdf.loc[pdf.index[0], list(SERIES)], int(pdf["up"].iloc[0]), int(pdf["rows"].sum()), f]], columns=names)

    by_chunk = windows.groupBy(*SERIES, CHUNK).applyInPandas(chunk_factor, schema)
    numbered = F.row_number().over(Window.partitionBy(*SERIES).orderBy("rows", F.hash("f"))) - 1  # one row per chunk
    level = cut(by_chunk.withColumn("part", numbered.cast("long")))
    while level.where("part > 0").limit(1).count():
        level = cut(level.withColumn("up", floor_div(F.col("part"), F.lit(FAN))).groupBy(*SERIES, "up").applyInPandas(merge, schema))

    def finish(batches):
        for pdf in batches:
            out = []
            for *series, f in pdf.itertuples(index=False):
                by_cos, by_sin, const_c, const_s = _coefficients(np.asarray(f).reshape(size, -1), low)
                out.append([*series, by_cos.ravel(), by_sin.ravel(), const_c, const_s])
            yield pd.DataFrame(out, columns=[f.name for f in _MODEL])

    return level.where("rows >= 2").select(*SERIES, "f").mapInPandas(finish, _MODEL)


def residuals(windows: DataFrame, weights: DataFrame, low: int, n_fft: int, chunk_ns: int) -> DataFrame:
    """Residual deviation of each window under its series' model; model copies go to chunks, not to rows."""
    w = _chunked(_with_length(windows, n_fft), chunk_ns)
    chunks = cut(w.select(*SERIES, CHUNK).distinct().join(weights, list(SERIES)))
    out_schema = T.StructType([*_KEYS.fields, T.StructField("w_start", T.LongType()), T.StructField("w_end", T.LongType()), T.StructField("r", T.DoubleType())])
    names = [f.name for f in out_schema]

    def run(win: pd.DataFrame, model: pd.DataFrame) -> pd.DataFrame:
        if model.empty or win.empty:
            return pd.DataFrame(columns=names)
        m = model.iloc[0]
        const_c, const_s = np.asarray(m["b_re"]), np.asarray(m["b_im"])
        maps = (*(np.asarray(m[c]).reshape(len(const_c), low) for c in ("w_re", "w_im")), const_c, const_s)
        r = pd.Series(0.0, win.index)
        for n, part in win.groupby("n"):
            r[part.index] = _unexplained(list(part["x"]), int(n), low, maps)
        return win[[*SERIES, "w_start", "w_end"]].assign(r=r)[names]

    by = [*SERIES, CHUNK]
    return w.groupBy(*by).cogroup(chunks.groupBy(*by)).applyInPandas(run, out_schema)


def fit(windows: DataFrame, low: int = 6, n_fft: int = 64, chunk_ns: int = 1024 * 30_000_000_000) -> DataFrame:
    """Model per series: weights, residual median and MAD, value median; series with fewer than two windows have none.

    ``windows`` comes from :func:`collect_windows` with ``min_points = low + 4``.
    """
    sized = _with_length(windows, n_fft)
    fixed = sized.groupBy(*SERIES).agg(F.min_by("n", "w_start").alias("n"))
    same = _chunked(sized.join(fixed, [*SERIES, "n"]), chunk_ns)
    weights = cut(_fit_weights(same, low, chunk_ns))
    r = cut(residuals(windows, weights, low, n_fft, chunk_ns))
    spread = median_and_mad(r, list(SERIES), "r").select(
        *SERIES, F.col("median").alias("r_med"), F.when(F.col("mad") == 0, F.lit(1.0)).otherwise(F.col("mad")).alias("r_mad")
    )
    med = exact_quantiles(windows.select(*SERIES, F.explode("x").alias("v")), list(SERIES), "v", {"median": 0.5})
    return weights.join(spread, list(SERIES)).join(med, list(SERIES))


def score(windows: DataFrame, model: DataFrame, low: int = 6, n_fft: int = 64, chunk_ns: int = 1024 * 30_000_000_000) -> DataFrame:
    """Rows (series, window, score, mean): how far a window's residual lies above the usual one."""
    weights = model.select(*SERIES, "w_re", "w_im", "b_re", "b_im")
    r = residuals(windows, weights, low, n_fft, chunk_ns)
    means = windows.select(*SERIES, "w_start", (F.aggregate("x", F.lit(0.0), lambda s, v: s + v) / F.size("x")).alias("mean"))
    j = r.join(model.select(*SERIES, "r_med", "r_mad", "median"), list(SERIES)).join(means, [*SERIES, "w_start"])
    z = (F.col("r") - F.col("r_med")) / (1.4826 * F.col("r_mad") + 1e-9)
    return j.select("w_start", "w_end", *SERIES, F.greatest(F.lit(0.0), z).alias("score"), "mean", "median")


def thresholds(model: DataFrame, calibration: DataFrame, quantile: float = 0.99, multiplier: float = 1.5) -> DataFrame:
    """Threshold per modelled series from calibration scores; 2.0 without any."""
    q = exact_quantiles(calibration, list(SERIES), "score", {"q": quantile})
    value = F.coalesce(F.greatest(F.lit(0.5), F.col("q") * multiplier + 1e-6), F.lit(2.0))
    return model.select(*SERIES).join(q, list(SERIES), "left").select(*SERIES, value.alias("threshold"))


def flagged(scores: DataFrame, thr: DataFrame, keep: Sequence[str] = ("w_start", "w_end", "entity_id", "metric_id")) -> DataFrame:
    """Windows above their threshold as (window, series, score, direction)."""
    j = scores.join(thr, list(SERIES)).where(F.col("score") > F.col("threshold"))
    return j.select(
        *keep, F.least(F.lit(1.0), F.col("score") / F.greatest(F.col("threshold"), F.lit(1e-9))).alias("score"),
        F.when(F.col("mean") > F.col("median"), "up").otherwise("down").alias("direction"),
    )
