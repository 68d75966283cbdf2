"""Whitening vectors by incremental eigendecomposition (operator 13).

1. Every partition keeps the spectrum of its scatter matrix and adds vector after
   vector as a centred rank-one update: components that the update does not
   reach, and equal eigenvalues, are deflated; the others are the roots of the
   secular equation, found all at once between their poles.
2. Spectra are combined in a tree: the eigenpairs of one are rank-one updates of
   the other, as is the difference of their means.
3. The basis so found is refined by one distributed Rayleigh-Ritz step: the
   covariance, centred by the exact mean, is summed in that basis and its small
   eigenproblem solved, which gives components to double precision.

Sizes that pass through a task or the driver depend on the dimension only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telemill.session import cut

EPS = np.finfo(float).eps
FAN = 8  # spectra combined in one task
FURTHEST = 1 << 40  # larger scaled entries count as this
BLOCK = 4096  # vectors at a time


def secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Roots m of 1 + rho * sum z^2 / (d - m) for rising poles ``d`` and z without zeros, rho > 0.

    Returns the roots and the differences ``d[j] - m[i]``, exact to the last
    digits because each root is sought as a distance from its nearer pole.
    """
    k, w = len(d), rho * z * z
    upper = np.append(d[1:], d[-1] + w.sum())
    gap = upper - d
    rows = np.arange(k)
    value = lambda diff: 1.0 + (w[:, None] / diff).sum(axis=0)
    mid = value(d[:, None] - (d + 0.5 * gap)[None, :])
    left = (mid >= 0) | (rows == k - 1)  # the root is in the left half; the last interval ends at no pole
    origin = np.where(left, d, upper)
    base = d[:, None] - origin[None, :]
    lo = np.where(left, 0.0, -0.5 * gap)
    hi = np.where(left, np.where(rows == k - 1, gap, 0.5 * gap), 0.0)
    tau = 0.5 * (lo + hi)
    below = np.tril(np.ones((k, k), bool)).T  # poles j <= i of root i
    for _ in range(100):
        diff = base - tau[None, :]
        with np.errstate(divide="ignore", invalid="ignore", over="ignore"):
            t = w[:, None] / diff
            f = 1.0 + t.sum(axis=0)
            s = t / diff
            # the two neighbouring poles with weights fitted to both halves of the sum
            psi, phi = np.where(below, s, 0.0).sum(axis=0), np.where(below, 0.0, s).sum(axis=0)
            a1, a2 = d - origin - tau, upper - origin - tau
            c = f - a1 * psi - a2 * phi
            a = (a1 + a2) * f - a1 * a2 * (psi + phi)
            b = a1 * a2 * f
            root = np.sqrt(np.maximum(a * a - 4.0 * b * c, 0.0))
            step = np.where(a <= 0, (a - root) / (2.0 * c), 2.0 * b / (a + root))
        done = np.abs(f) <= 8.0 * EPS * k * (1.0 + np.abs(t).sum(axis=0))
        lo, hi = np.where(f < 0, tau, lo), np.where(f >= 0, tau, hi)
        done |= hi - lo <= 2.0 * EPS * np.maximum(np.abs(lo), np.abs(hi))
        if done.all():
            break
        new = tau + step
        ok = np.isfinite(new) & (new > lo) & (new < hi)
        tau = np.where(done, tau, np.where(ok, new, 0.5 * (lo + hi)))
    return origin + tau, base - tau[None, :]


def rank_one(values: np.ndarray, basis: np.ndarray, v: np.ndarray, rho: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Rising eigenvalues and eigenvectors (columns) of basis diag(values) basis' + rho v v', rho > 0."""
    z = basis.T @ v
    norm = np.sqrt(z @ z)
    if norm == 0.0:
        return values, basis
    tol = 8.0 * EPS * max(np.abs(values).max(), rho * norm * norm)
    # equal eigenvalues: one reflection turns the update into one of their directions
    edges = np.flatnonzero(np.diff(values) > tol) + 1
    if len(edges) + 1 < len(values):
        basis = basis.copy()
        for part in np.split(np.arange(len(values)), edges):
            if len(part) > 1:
                u = z[part].copy()
                size = np.sqrt(u @ u)
                if size > 0.0:
                    u[-1] += np.copysign(size, u[-1])
                    u /= np.sqrt(u @ u)
                    basis[:, part] -= 2.0 * np.outer(basis[:, part] @ u, u)
                    z[part] = 0.0
                    z[part[-1]] = -np.copysign(size, u[-1])
    live = rho * np.abs(z) * norm > tol
    if not live.any():
        return values, basis
    d, zl = values[live], z[live]
    roots, diff = secular_roots(d, zl, rho)
    # z for which the roots are exact: eigenvectors stay orthogonal
    poles = d[:, None] - d[None, :]
    np.fill_diagonal(poles, 1.0)
    exact = np.copysign(np.exp(0.5 * (np.log(np.abs(diff)).sum(axis=1) - np.log(np.abs(poles)).sum(axis=1))), zl)
    u = exact[:, None] / diff
    u /= np.sqrt((u * u).sum(axis=0))
    values, basis = values.copy(), basis.copy()
    values[live], basis[:, live] = roots, basis[:, live] @ u
    order = np.argsort(values, kind="stable")
    return values[order], basis[:, order]


class Spectrum:
    """Count, mean and eigenpairs of the scatter of the vectors seen."""

    def __init__(self, width: int):
        self.n, self.mean, self.values, self.basis = 0, np.zeros(width), np.zeros(width), np.eye(width)

    def add(self, x: np.ndarray) -> None:
        off = x - self.mean
        self.values, self.basis = rank_one(self.values, self.basis, off, self.n / (self.n + 1.0)) if self.n else (self.values, self.basis)
        self.n += 1
        self.mean = self.mean + off / self.n

    def merge(self, other: Spectrum) -> None:
        if not other.n or not self.n:
            if other.n:
                self.n, self.mean, self.values, self.basis = other.n, other.mean, other.values, other.basis
            return
        for e, q in zip(other.values, other.basis.T, strict=True):
            if e > 0.0:
                self.values, self.basis = rank_one(self.values, self.basis, q, e)
        off, n = other.mean - self.mean, self.n + other.n
        self.values, self.basis = rank_one(self.values, self.basis, off, self.n * (other.n / n))
        self.mean, self.n = self.mean + off * (other.n / n), n

    def row(self) -> tuple:
        return self.n, self.mean.tobytes(), self.values.tobytes(), self.basis.tobytes()

    @classmethod
    def of(cls, n: int, mean: bytes, values: bytes, basis: bytes) -> Spectrum:
        out = cls(0)
        out.n, out.mean, out.values = int(n), np.frombuffer(mean), np.frombuffer(values)
        out.basis = np.frombuffer(basis).reshape(len(out.mean), -1)
        return out


def _scaled(column: pa.Array, width: int, scale: float, shift: int) -> tuple[np.ndarray, np.ndarray]:
    """floor(scale * c) + shift of the valid rows, and which rows these are."""
    column = column.cast(pa.list_(pa.float64()))
    valid = np.asarray(column.is_valid()).astype(bool)
    starts, flat = column.offsets.to_numpy(), column.values
    value = np.nan_to_num(flat.fill_null(np.nan).to_numpy(zero_copy_only=False), nan=np.nan, posinf=np.nan, neginf=np.nan)
    bad = np.append(0, np.cumsum(~np.isfinite(value)))
    valid &= bad[starts[1:]] == bad[starts[:-1]]
    rows = np.flatnonzero(valid)
    out = np.full((len(rows), width), shift, np.int64)  # a shorter vector goes on with zeros
    with np.errstate(over="ignore"):
        x = np.clip(np.floor(scale * np.nan_to_num(value)), -FURTHEST, FURTHEST).astype(np.int64) + shift
    for i, r in enumerate(rows):
        part = x[starts[r] : starts[r + 1]]
        out[i, : len(part)] = part
    return out, rows


def _combined(spectra: DataFrame) -> Spectrum | None:
    """All spectra in one, ``FAN`` at a time."""
    level = cut(spectra)
    while (count := level.count()) > 1:
        groups = -(-count // FAN)

        def join(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("part")
            out = Spectrum.of(*pdf.iloc[0][["n", "mean", "vals", "basis"]])
            for r in pdf.iloc[1:].itertuples():
                out.merge(Spectrum.of(r.n, r.mean, r.vals, r.basis))
            return pd.DataFrame([(int(pdf["grp"].iloc[0]), *out.row())], columns=["part", "n", "mean", "vals", "basis"])

        level = cut(level.withColumn("grp", F.col("part") % groups).groupBy("grp").applyInPandas(join, "part long, n long, mean binary, vals binary, basis binary"))
    row = level.first()
    return row and Spectrum.of(row["n"], row["mean"], row["vals"], row["basis"])


def _summed(parts: DataFrame, size: int) -> np.ndarray:
    """Sum of the binary double arrays ``m`` of all rows, entry by entry."""
    each = parts.mapInArrow(
        lambda batches: (
            pa.RecordBatch.from_arrays([pa.array(np.arange(size)), pa.array(np.frombuffer(m.as_py()))], ["i", "v"]) for b in batches for m in b.column(0)
        ),
        "i long, v double",
    )
    out = np.zeros(size)
    for i, v in each.groupBy("i").agg(F.sum("v")).collect():  # as many rows as the matrix has entries
        out[i] = v
    return out


def whiten(
    vectors: DataFrame, components: int | None = None, scale: float = 1024.0, shift: int = 100_000, id_col: str = "vec_id", vector_col: str = "embedding",
) -> DataFrame:
    """Per vector and component: ``vec_id, component, n, deviation, whitened, explained, identity_error``.

    Entries c become x = floor(scale * c) + shift; those beyond 2^40 count as
    2^40. Vectors that are null or hold null or non-finite entries are left out;
    shorter ones go on with zeros. Components are numbered from 1 by falling
    eigenvalue, with their largest entry positive; those without variance (at
    most d * epsilon of the largest eigenvalue) are none, so equal vectors, one
    vector or none give no rows. ``deviation`` is null where it passes the range
    of a long. Ids may repeat or be null; other columns are not read.
    """
    src = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("v").isNotNull())
    width = max(1, src.agg(F.max(F.size("v"))).first()[0] or 0)
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                x, rows = _scaled(pa.concat_arrays([part.column(1)]), width, scale, shift)
                if len(rows):
                    yield part.column(0).take(pa.array(rows)), x

    def spectrum(batches):
        out, sums = Spectrum(width), [0] * width
        for _, x in blocks(batches):
            sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0), strict=True)]
            for row in x.astype(float):
                out.add(row)
        if out.n:
            names = ["part", "n", "mean", "vals", "basis", "sums"]
            yield pa.RecordBatch.from_arrays([pa.array([0]), *[pa.array([c]) for c in out.row()], pa.array([[str(s) for s in sums]])], names)

    first = src.mapInArrow(spectrum, "part long, n long, mean binary, vals binary, basis binary, sums array<string>")
    first = cut(first.withColumn("part", F.spark_partition_id().cast("long")))
    exact = first.select("n", F.posexplode("sums")).groupBy("pos").agg(F.sum("n").alias("n"), F.sum(F.col("col").cast("decimal(38,0)")).alias("s")).collect()
    if not exact:
        return vectors.sparkSession.createDataFrame([], schema)
    n = int(exact[0]["n"])
    total = [0] * width
    for r in exact:
        total[r["pos"]] = int(r["s"])
    mean = np.array([s // n for s in total], np.int64)  # whole part and rest of the exact mean
    rest = np.array([s % n / n for s in total])
    centred = lambda x: (x - mean) - rest
    basis = np.linalg.qr(_combined(first.drop("sums")).basis)[0]

    def sums_of(project) -> np.ndarray:
        """Sum of y'y over all vectors, y = project(centred vectors)."""

        def run(batches):
            out = 0.0
            for _, x in blocks(batches):
                y = project(centred(x))
                out = out + y.T @ y
            if not np.isscalar(out):
                yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()])], ["m"])

        k = project(np.zeros((1, width))).shape[1]
        return _summed(src.mapInArrow(run, "m binary"), k * k).reshape(k, k) / n

    ritz = sums_of(lambda c: c @ basis)
    values, turn = np.linalg.eigh((ritz + ritz.T) / 2)
    values, axes = values[::-1], basis @ turn[:, ::-1]
    kept = int((values > width * EPS * max(values[0], 0.0)).sum()) if values[0] > 0 else 0
    kept = min(kept, components or width)
    if not kept:
        return vectors.sparkSession.createDataFrame([], schema)
    axes = axes[:, :kept]
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), np.arange(kept)])
    turned = axes / np.sqrt(values[:kept])
    error = float(np.abs(sums_of(lambda c: c @ turned) - np.eye(kept)).max())
    explained = values[:kept] / np.trace(ritz)

    def deviations(x: np.ndarray) -> list:
        off = (x - mean).astype(object) * n - np.array([s % n for s in total], object) if np.abs(x - mean).max() * n >= 1 << 62 else None
        if off is None:
            off = (x - mean) * n - np.array([s % n for s in total])
            if float((off.astype(float) ** 2).sum(axis=1).max()) < 9e18:
                return (off * off).sum(axis=1).tolist()
            off = off.astype(object)
        return [d if d < 1 << 63 else None for d in (off * off).sum(axis=1)]

    def whitened(batches):
        for ids, x in blocks(batches):
            w, k = centred(x) @ turned, len(x)
            each = pa.array(np.repeat(np.arange(k), kept))
            yield pa.RecordBatch.from_arrays(
                [ids.take(each), pa.array(np.tile(np.arange(1, kept + 1, dtype=np.int32), k)), pa.array(np.full(k * kept, n)), pa.array(deviations(x), pa.int64()).take(each),
                 pa.array(w.ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * kept, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return src.mapInArrow(whitened, schema)
