"""Clusters of data sets from their pair correlations: small matrices, one row a data set, on the driver.

The matrix comes from merging.pair_correlations, which is distributed; its size is the square of the number of
data sets, which is bounded by what is asked for and not by the number of observations.
"""

from __future__ import annotations

import numpy as np


def correlation_matrix(rows, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Symmetric matrices of correlations and weights (rescaled to add up to the pair count) from (a, b, cc, n_eff)."""
    cc, w = np.eye(n), np.zeros((n, n))
    for a, b, c, e in rows:
        cc[a, b] = cc[b, a] = c
        w[a, b] = w[b, a] = e
    pairs = np.count_nonzero(np.triu(w, 1))
    return cc, w * (pairs / w[np.triu_indices(n, 1)].sum()) if pairs else w


def cosym_coordinates(cc: np.ndarray, w: np.ndarray, dim: int, seed: int = 0, iterations: int = 500) -> tuple[np.ndarray, float]:
    """Points whose dot products fit the correlations, by L-BFGS with backtracking; (points, value)."""
    n = len(cc)
    off = w * (1 - np.eye(n))

    def value(x: np.ndarray) -> tuple[float, np.ndarray]:
        p = x.reshape(n, dim)
        e = p @ p.T - cc
        return 0.5 * float((off * e * e).sum()), (2 * (off * e) @ p).ravel()

    x = np.random.default_rng(seed).uniform(0, 1, n * dim)
    f, g = value(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(iterations):
        q, alphas = g.copy(), []
        for s, y in reversed(steps):
            a = (s @ q) / (y @ s)
            alphas.append(a)
            q -= a * y
        if steps:
            s, y = steps[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(alphas), strict=True):
            q += s * (a - (y @ q) / (y @ s))
        t = 1.0 if steps else min(1.0, 1 / (np.abs(g).sum() + 1e-12))
        while True:
            new_f, new_g = value(x - t * q)
            if new_f <= f - 1e-4 * t * (g @ q) or t < 1e-12:
                break
            t /= 2
        s, y = -t * q, new_g - g
        x, done = x + s, abs(f - new_f) < 1e-12 * max(1, abs(f))
        f, g = new_f, new_g
        if s @ y > 1e-12:
            steps = [*steps, (s, y)][-8:]
        if done or np.abs(g).max() < 1e-9:
            break
    return x.reshape(n, dim), f


def elbow(x: np.ndarray, y: np.ndarray) -> int:
    """The point of a curve furthest from the line between its ends."""
    x, y = np.asarray(x, dtype=float), np.asarray(y, dtype=float)
    line = np.array([x[-1] - x[0], y[-1] - y[0]])
    line /= np.linalg.norm(line) or 1
    off = np.stack([x - x[0], y - y[0]], axis=1)
    return int(np.abs(off[:, 0] * line[1] - off[:, 1] * line[0]).argmax())


def ward_linkage(distance: np.ndarray) -> np.ndarray:
    """Merges (a, b, height, size) by Ward's criterion, by the Lance-Williams update."""
    n = len(distance)
    d = np.full((2 * n - 1, 2 * n - 1), np.inf)
    d[:n, :n] = np.asarray(distance, dtype=float) ** 2
    np.fill_diagonal(d, np.inf)
    size, live, out = np.ones(2 * n - 1), list(range(n)), []
    for new in range(n, 2 * n - 1):
        own = d[np.ix_(live, live)]
        i, j = divmod(int(own.argmin()), len(live))
        a, b = sorted((live[i], live[j]))
        h = d[a, b]
        rest = [c for c in live if c not in (a, b)]
        for c in rest:
            t = size[a] + size[b] + size[c]
            d[new, c] = d[c, new] = ((size[a] + size[c]) * d[a, c] + (size[b] + size[c]) * d[b, c] - size[c] * h) / t
        size[new] = size[a] + size[b]
        out.append((a, b, np.sqrt(h), size[new]))
        live = [*rest, new]
    return np.array(out)


def optics(points: np.ndarray, min_samples: int, max_eps: float = np.inf) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, reachability, core distance) of density-based ordering."""
    n = len(points)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    core = np.sort(d, axis=1)[:, min_samples - 1]
    core[core > max_eps] = np.inf
    reach, seen, order = np.full(n, np.inf), np.zeros(n, dtype=bool), []
    for start in range(n):
        at = start
        while not seen[at]:
            seen[at] = True
            order.append(at)
            if np.isfinite(core[at]):
                near = ~seen & (d[at] <= max_eps)
                reach[near] = np.minimum(reach[near], np.maximum(core[at], d[at][near]))
            left = np.where(seen, np.inf, reach)
            if not np.isfinite(left.min()):
                break
            at = int(left.argmin())
    return np.array(order), reach, core


def silhouette(points: np.ndarray, labels: np.ndarray) -> float:
    """Mean silhouette of labelled points; noise (-1) is left out and lowers the score by its part."""
    labels = np.asarray(labels)
    own = labels >= 0
    names = np.unique(labels[own])
    if len(names) < 2:
        return 0.0
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    scores = []
    for i in np.flatnonzero(own):
        same = own & (labels == labels[i])
        a = d[i][same].sum() / max(1, same.sum() - 1)
        b = min(d[i][labels == c].mean() for c in names if c != labels[i])
        scores.append((b - a) / max(a, b) if same.sum() > 1 and max(a, b) > 0 else 0.0)
    return float(np.mean(scores) * own.mean())
