"""Small numpy helpers used inside tasks: gamma tail, Gaussian mixture, ordering of causes."""

from __future__ import annotations

from itertools import combinations
from math import lgamma

import numpy as np

_lgamma = np.vectorize(lgamma, otypes=[float])


def gamma_q(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function, by series below a + 1 and continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(a.shape)
    front = np.exp(-x + a * np.log(np.where(x > 0, x, 1.0)) - _lgamma(a))
    low = (x > 0) & (x < a + 1)
    if low.any():
        al, xl = a[low], x[low]
        term = 1.0 / al
        total, n = term.copy(), al.copy()
        for _ in range(10_000):
            n += 1
            term = term * xl / n
            total += term
            if np.all(term < total * 1e-16):
                break
        out[low] = 1.0 - front[low] * total
    high = x >= a + 1
    if high.any():
        ah, xh = a[high], x[high]
        tiny = 1e-300
        b = xh + 1 - ah
        c = np.full(b.shape, 1 / tiny)
        d = 1 / b
        h = d.copy()
        for i in range(1, 10_000):
            an = -i * (i - ah)
            b = b + 2
            d = an * d + b
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = b + an / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            step = d * c
            h = h * step
            if np.all(np.abs(step - 1) < 1e-15):
                break
        out[high] = front[high] * h
    return np.clip(out, 0.0, 1.0)


def chi2_tail(stat: np.ndarray, dof: np.ndarray) -> np.ndarray:
    """P(chi2 >= stat); 1 without degrees of freedom."""
    dof = np.asarray(dof, float)
    p = gamma_q(np.where(dof > 0, dof / 2, 1.0), np.asarray(stat, float) / 2)
    return np.where(dof > 0, p, 1.0)


# ---- Gaussian mixture with full covariances ----


def _log_density(x: np.ndarray, means: np.ndarray, covs: np.ndarray) -> np.ndarray:
    n, d = x.shape
    out = np.empty((n, len(means)))
    for j, (m, c) in enumerate(zip(means, covs)):
        chol = np.linalg.cholesky(c)
        y = np.linalg.solve(chol, (x - m).T)
        out[:, j] = -0.5 * (d * np.log(2 * np.pi) + (y**2).sum(axis=0)) - np.log(np.diag(chol)).sum()
    return out


def fit_mixture(x: np.ndarray, k: int, reg: float = 1e-6, tol: float = 1e-3) -> tuple[np.ndarray, float]:
    """(labels, BIC) of a k-component mixture; starts from farthest points, so it is deterministic."""
    n, d = x.shape
    centre = [int(np.argmax(((x - x.mean(axis=0)) ** 2).sum(axis=1)))]
    while len(centre) < k:
        dist = np.min([((x - x[c]) ** 2).sum(axis=1) for c in centre], axis=0)
        centre.append(int(np.argmax(dist)))
    resp = np.zeros((n, k))
    resp[np.arange(n), np.argmin(((x[:, None, :] - x[centre][None]) ** 2).sum(axis=2), axis=1)] = 1.0
    last = -np.inf
    while True:  # the likelihood only rises, so the steps end
        weight = resp.sum(axis=0) + 10 * np.finfo(float).eps
        means = resp.T @ x / weight[:, None]
        covs = np.stack([(resp[:, j, None] * (x - means[j])).T @ (x - means[j]) / weight[j] + reg * np.eye(d) for j in range(k)])
        logp = _log_density(x, means, covs) + np.log(weight / n)
        top = logp.max(axis=1, keepdims=True)
        norm = top[:, 0] + np.log(np.exp(logp - top).sum(axis=1))
        resp = np.exp(logp - norm[:, None])
        if abs(norm.mean() - last) < tol:
            break
        last = norm.mean()
    free = k * d * (d + 1) / 2 + k * d + k - 1
    return np.argmax(resp, axis=1), float(-2 * norm.sum() + free * np.log(n))


def best_mixture(x: np.ndarray, max_components: int | None = None) -> np.ndarray:
    """Labels of the mixture with the smallest BIC over 1..N components."""
    top = len(x) if max_components is None else min(len(x), max_components)
    fits = [fit_mixture(x, k) for k in range(1, top + 1)]
    return min(fits, key=lambda f: f[1])[0]


# ---- neighbours of the failure indicator, on weighted distinct rows ----


def weighted_ci(cells: np.ndarray, weight: np.ndarray, x: int, y: int, given: tuple[int, ...]) -> float:
    """Chi-square test of columns x and y in the strata of ``given``; ``cells`` are distinct rows with counts."""
    if given:
        _, stratum = np.unique(cells[:, list(given)], axis=0, return_inverse=True)
        stratum = stratum.ravel()
    else:
        stratum = np.zeros(len(cells), dtype=int)
    table = np.zeros((stratum.max() + 1, cells[:, x].max() + 1, cells[:, y].max() + 1))
    np.add.at(table, (stratum, cells[:, x], cells[:, y]), weight)
    rows, cols, total = table.sum(axis=2), table.sum(axis=1), table.sum(axis=(1, 2))
    expected = rows[:, :, None] * cols[:, None, :] / total[:, None, None]
    ok = expected > 0
    stat = float((((table - expected) ** 2)[ok] / expected[ok]).sum())
    dof = int((((rows > 0).sum(axis=1) - 1) * ((cols > 0).sum(axis=1) - 1)).sum())
    return float(chi2_tail(stat, dof))


class CauseSearch:
    """Neighbours of one indicator column at growing significance levels.

    Tests are shared between levels: a p-value does not depend on alpha. Sets
    grow until no column has enough neighbours left, whatever the width.
    """

    def __init__(self, cells: np.ndarray, weight: np.ndarray, indicator: int):
        self.cells, self.weight, self.f = cells, weight, indicator
        self._seen: dict[tuple, float] = {}

    def p(self, y: int, given: tuple[int, ...]) -> float:
        key = (y, given)
        if key not in self._seen:
            self._seen[key] = weighted_ci(self.cells, self.weight, self.f, y, given)
        return self._seen[key]

    def neighbours(self, alpha: float) -> dict[int, float]:
        """Columns that stay adjacent to the indicator, with the last p-value seen for each."""
        near = [c for c in range(self.cells.shape[1]) if c != self.f]
        last: dict[int, float] = {}
        depth = 0
        while True:
            for y in list(near):
                others = [c for c in near if c != y]
                for given in combinations(others, depth):
                    p = self.p(y, given)
                    if p > alpha:
                        near.remove(y)
                        break
                    last[y] = p
            depth += 1
            if depth > len(near) - 1:
                return {y: last.get(y, 0.0) for y in near}

    def ranking(self, start: float, min_nodes: int, step: float = 0.1, limit: float = 1.0) -> list[int]:
        """Columns in the order in which rising alpha admits them; one level's newcomers by ascending p."""
        found: list[int] = []
        want = self.cells.shape[1] - 1 if min_nodes < 0 else min_nodes
        for alpha in np.arange(start, limit, step):
            new = {y: p for y, p in self.neighbours(float(alpha)).items() if y not in found}
            found += sorted(new, key=lambda y: (new[y], y))
            if new and len(found) == want:
                break
        return found
