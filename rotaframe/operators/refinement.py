"""Crystal models against observations: each round is one aggregation of small sums, solved on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Which of a*2, b*2, c*2, b*c*, a*c*, a*b* (in 1/d^2) are equal, free or zero in a crystal system.
SYSTEMS = {
    "triclinic": [(1, 0, 0, 0, 0, 0), (0, 1, 0, 0, 0, 0), (0, 0, 1, 0, 0, 0), (0, 0, 0, 1, 0, 0), (0, 0, 0, 0, 1, 0), (0, 0, 0, 0, 0, 1)],
    "monoclinic": [(1, 0, 0, 0, 0, 0), (0, 1, 0, 0, 0, 0), (0, 0, 1, 0, 0, 0), (0, 0, 0, 0, 1, 0)],
    "orthorhombic": [(1, 0, 0, 0, 0, 0), (0, 1, 0, 0, 0, 0), (0, 0, 1, 0, 0, 0)],
    "tetragonal": [(1, 1, 0, 0, 0, 0), (0, 0, 1, 0, 0, 0)],
    "hexagonal": [(1, 1, 0, 0, 0, 1), (0, 0, 1, 0, 0, 0)],
    "cubic": [(1, 1, 1, 0, 0, 0)],
}


def _sums(rows: DataFrame, left: list[Column], right: list[Column], weight: Column) -> tuple[np.ndarray, np.ndarray, int]:
    """(sum w l l^T, sum w l r^T, rows): one row comes back."""
    each = [F.sum(weight * a * b) for a in left for b in left] + [F.sum(weight * a * b) for a in left for b in right]
    got = rows.agg(F.count("*").alias("n"), *(c.alias(f"_{i}") for i, c in enumerate(each))).first()
    values = np.array([float(x or 0) for x in got[1:]])
    k = len(left) ** 2
    return values[:k].reshape(len(left), len(left)), values[k:].reshape(len(left), len(right)), got["n"]


def refine_matrix(points: DataFrame, rounds: int = 5, sigmas: float = 4.0) -> tuple[np.ndarray, int]:
    """The setting matrix A of p = A h from indexed points (x, y, z, h, k, l), outliers beyond robust sigmas left out; (A, points used)."""
    h, p = [F.col(c).cast("double") for c in "hkl"], [F.col(c) for c in "xyz"]
    live = points
    matrix, n = np.eye(3), 0
    for _ in range(rounds):
        a, b, n = _sums(live, h, p, F.lit(1.0))
        matrix = np.linalg.solve(a, b).T
        off = F.lit(0.0)
        for i, c in enumerate(p):
            d = c - sum((F.lit(float(matrix[i, j])) * h[j] for j in range(3)), F.lit(0.0))
            off = off + d * d
        middle = points.select(F.percentile(F.sqrt(off), 0.5).alias("m")).first()["m"]
        live = points.filter(F.sqrt(off) <= sigmas * 1.4826 * max(float(middle), 1e-12))
    return matrix, n


def refine_cell(rows: DataFrame, system: str, wavelength: float) -> tuple[np.ndarray, np.ndarray]:
    """Cell (a, b, c, alpha, beta, gamma) and its e.s.d.s from h, k, l and two theta (degrees), under the system's constraints.

    1/d^2 is linear in the products of reciprocal axes, so one pass of sums and one small solve do.
    """
    h, k, l = (F.col(c).cast("double") for c in "hkl")  # noqa: E741
    terms = [h * h, k * k, l * l, k * l, h * l, h * k]
    basis = SYSTEMS[system]
    left = []
    for row in basis:
        used = [terms[i] * float(x) for i, x in enumerate(row) if x]
        left.append(sum(used[1:], used[0]))
    s = 2 * F.sin(F.radians(F.col("two_theta")) / 2) / wavelength
    a, b, n = _sums(rows, [*left, s * s], [s * s], F.lit(1.0))
    m = len(left)
    normal, right, total = a[:m, :m], a[:m, m], a[m, m]
    x = np.linalg.solve(normal, right)
    variance = max(total - right @ x, 0) / max(n - m, 1)
    covariance = np.linalg.inv(normal) * variance
    cell = cell_of(np.array(basis, dtype=float).T @ x)
    slope = np.array([(cell_of(np.array(basis, dtype=float).T @ (x + e)) - cell) / np.abs(e).max() for e in np.diag(np.abs(x) * 1e-5 + 1e-12)])
    return cell, np.sqrt(np.maximum(np.einsum("ki,kl,lj->ij", slope, covariance, slope).diagonal(), 0))


def cell_of(products: np.ndarray) -> np.ndarray:
    """The direct cell from a*2, b*2, c*2 and the factors of kl, hl, hk in 1/d^2."""
    aa, bb, cc, bc, ac, ab = products
    metric = np.linalg.inv(np.array([[aa, ab / 2, ac / 2], [ab / 2, bb, bc / 2], [ac / 2, bc / 2, cc]]))
    lengths = np.sqrt(np.diag(metric))
    angle = lambda i, j: np.degrees(np.arccos(np.clip(metric[i, j] / (lengths[i] * lengths[j]), -1, 1)))
    return np.array([*lengths, angle(1, 2), angle(0, 2), angle(0, 1)])


def spline(points: np.ndarray, t: np.ndarray) -> np.ndarray:
    """A clamped uniform cubic B-spline over control points (rows) at t from 0 to 1, by de Boor's recursion."""
    points = np.asarray(points, dtype=float)
    n, degree = len(points), min(3, len(points) - 1)
    knots = np.concatenate([np.zeros(degree), np.linspace(0, 1, n - degree + 1), np.ones(degree)])
    t = np.clip(np.asarray(t, dtype=float), 0, 1)
    span = np.clip(np.searchsorted(knots, t, side="right") - 1, degree, n - 1)
    d = np.stack([points[span - degree + j] for j in range(degree + 1)])
    shape = (-1,) + (1,) * (points.ndim - 1)
    for r in range(1, degree + 1):
        for j in range(degree, r - 1, -1):
            low, high = knots[span - degree + j], knots[span + 1 + j - r]
            f = ((t - low) / np.where(high > low, high - low, 1)).reshape(shape)
            d[j] = (1 - f) * d[j - 1] + f * d[j]
    return d[degree]
