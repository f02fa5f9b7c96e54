"""How far the data reach: CC half against resolution, on the driver over a table of bins."""

from __future__ import annotations

import numpy as np

from rotaframe.functions.stats import student_t_quantile


def critical_cc(n: int, p: float = 0.01) -> float:
    """The correlation of n pairs that chance exceeds with probability p."""
    if n < 3:
        return 1.0
    t = student_t_quantile(1 - p, n - 2)
    return t / np.sqrt(n - 2 + t * t)


def tanh_fit(s: np.ndarray, cc: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Least squares of cc = (1 - tanh((s - r) / s0)) / 2 in s = 1 / d^2, by damped Gauss-Newton; (r, s0)."""
    r, s0, damping = float(np.median(s)), float(np.ptp(s) or 1) / 4, 1e-3

    def residual(r: float, s0: float) -> np.ndarray:
        return np.sqrt(weight) * (0.5 * (1 - np.tanh((s - r) / s0)) - cc)

    e = residual(r, s0)
    for _ in range(200):
        sech2 = 1 / np.cosh(np.clip((s - r) / s0, -300, 300)) ** 2
        j = np.stack([0.5 * sech2 / s0, 0.5 * sech2 * (s - r) / s0**2], axis=1) * np.sqrt(weight)[:, None]
        a = j.T @ j
        step = np.linalg.solve(a + damping * np.diag(np.diag(a) + 1e-12), -j.T @ e)
        new = residual(r + step[0], abs(s0 + step[1]) or s0)
        if new @ new < e @ e:
            r, s0, damping = r + step[0], abs(s0 + step[1]) or s0, damping / 4
            if abs(e @ e - new @ new) < 1e-14:
                break
            e = new
        else:
            damping *= 4
            if damping > 1e12:
                break
    return float(r), float(s0)


def estimate_resolution(d: list[float], cc: list[float], n: list[int], limit: float = 0.3) -> float | None:
    """Where a tanh through CC half falls to the limit; None if it stays above it in the data's range."""
    s = 1 / np.array(d) ** 2
    r, s0 = tanh_fit(s, np.array(cc), np.array(n, dtype=float))
    at = r + s0 * np.arctanh(1 - 2 * limit)
    return None if at > s.max() or at <= 0 else float(1 / np.sqrt(at))
