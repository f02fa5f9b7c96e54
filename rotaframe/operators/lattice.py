"""Lattices from spots: candidate vectors, reduction, indices, and the rotation angles at which reflections appear."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def max_cell(distances: DataFrame, column: str = "distance") -> float:
    """1.3 / the near edge of the distances: the longest hundredth of cell estimates is dropped, about five a bin, and the far edge of the last bin above a quarter of the tallest is taken."""
    n = distances.count()
    if not n:
        raise ValueError("no neighbours")
    cells = distances.select((1 / F.col(column)).alias("x"))
    top = cells.select(F.percentile("x", 0.99).alias("t")).first()["t"]
    low = cells.agg(F.min("x")).first()[0]
    bins = max(2, int(n / 5))
    width = (top - low) / bins or 1.0
    counts = {r.b: r.n for r in cells.filter(F.col("x") <= top).groupBy(F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1)).alias("b")).agg(F.count("*").alias("n")).collect()}
    tallest = max(counts.values())
    return 1.3 * (low + (max(b for b, c in counts.items() if c > tallest / 4) + 1) * width)


def grid_nodes(points: DataFrame, step: float, n: int) -> DataFrame:
    """Reciprocal points (x, y, z) counted on the nearest nodes of a grid of n a side: the size of the grid bounds what comes back."""
    at = [F.round(F.col(c) / step).cast("int") for c in "xyz"]
    inside = at[0].between(-n // 2, n // 2 - 1) & at[1].between(-n // 2, n // 2 - 1) & at[2].between(-n // 2, n // 2 - 1)
    return points.filter(inside).groupBy(*(a.alias(c) for a, c in zip(at, "xyz", strict=True))).agg(F.count("*").alias("n"))


def hemisphere(step: float) -> np.ndarray:
    """Directions about `step` degrees apart, evenly over half a sphere: a Fibonacci lattice."""
    n = max(64, int(2 * np.pi / np.radians(step) ** 2))
    k = np.arange(n)
    z = 1 - (k + 0.5) / n
    r, turn = np.sqrt(np.maximum(0, 1 - z * z)), np.pi * (3 - np.sqrt(5)) * k
    return np.stack([r * np.cos(turn), r * np.sin(turn), z], axis=1)


def grid_vectors(points: DataFrame, lengths: list[float], step: float = 1.0, keep: int = 30, collinear: float = 5.0) -> list[tuple[np.ndarray, float]]:
    """Candidate vectors of known lengths: of all directions of a grid and all lengths, those along which the points (x, y, z) lie best in planes.

    The score of a vector is the sum over points of cos(2 pi r.v). Each task adds up its points for all vectors in
    blocks, and only such sums, as many as the grid has vectors, are added by a shuffle and reach the driver, where
    vectors within `collinear` degrees of a better one are passed over.
    """
    own = [v for k, v in enumerate(lengths) if not any(abs(v - u) < 0.01 * u for u in lengths[:k])]
    directions = hemisphere(step)
    n = len(directions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(own), n))
        for batch in batches:
            at = np.stack([batch.column(c).to_numpy() for c in "xyz"], axis=1)
            for low in range(0, len(at), 256):
                along = 2 * np.pi * (at[low : low + 256] @ directions.T)
                for k, length in enumerate(own):
                    total[k] += np.cos(along * length).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["vector", "score"])

    known = points.select(*(F.col(c).cast("double").alias(c) for c in "xyz")).dropna()
    sums = known.mapInArrow(run, "vector long, score double").groupBy("vector").agg(F.sum("score").alias("score")).orderBy(F.desc("score"), "vector").toArrow()  # of the grid's size
    limit, kept = np.cos(np.radians(collinear)), []
    units = np.zeros((0, 3))
    for vector, score in zip(sums.column("vector").to_numpy().tolist(), sums.column("score").to_numpy().tolist(), strict=True):
        if len(kept) == keep:
            break
        u = directions[vector % n]
        if not (np.abs(units @ u) > limit).any():
            units = np.vstack([units, u])
            kept.append((u * own[vector // n], score))
    return kept


def fft_vectors(nodes: np.ndarray, counts: np.ndarray, step: float, n: int, longest: float, shortest: float = 3.0, most: int = 30) -> list[tuple[np.ndarray, float]]:
    """Peaks of the Fourier transform of spots on a grid: candidate vectors and their heights, strongest first."""
    grid = np.zeros((n, n, n), dtype=np.float32)
    grid[tuple((nodes % n).T)] = counts
    power = np.abs(np.fft.fftn(grid))
    # a node of the transform is 1 / (n step) apart
    unit = 1 / (n * step)
    peak = np.ones_like(power, dtype=bool)
    for axis in range(3):
        for shift in (1, -1):
            peak &= power >= np.roll(power, shift, axis)
    at = np.argwhere(peak & (power > 0.15 * power[0, 0, 0]))
    signed = np.where(at >= n // 2, at - n, at)
    found = []
    for place, index in zip(signed, at, strict=True):
        # the centroid of the peak and its neighbours
        near = np.array(np.meshgrid(*[[-1, 0, 1]] * 3, indexing="ij")).reshape(3, -1).T
        w = power[tuple(((index + near) % n).T)]
        v = (place + (near * w[:, None]).sum(axis=0) / w.sum()) * unit
        if shortest <= np.linalg.norm(v) <= longest:
            found.append((v, float(power[tuple(index)])))
    found.sort(key=lambda f: (-round(f[1], 3), np.linalg.norm(f[0])))
    kept: list[tuple[np.ndarray, float]] = []
    for v, height in found:
        if len(kept) == most:
            break
        if all(not _multiple(v, u) for u, _ in kept):
            kept.append((v, height))
    return kept


def _multiple(v: np.ndarray, u: np.ndarray, angle: float = 5.0, part: float = 0.1) -> bool:
    """Whether v is about a whole multiple of u, or its opposite."""
    cos = abs(v @ u) / (np.linalg.norm(v) * np.linalg.norm(u))
    ratio = np.linalg.norm(v) / np.linalg.norm(u)
    return bool(np.degrees(np.arccos(min(1.0, cos))) < angle and round(ratio) >= 1 and abs(ratio - round(ratio)) < part)


def reduced(basis: np.ndarray) -> np.ndarray:
    """Buerger reduction: no basis vector (a row) gets shorter by adding others."""
    b = np.array(basis, dtype=float)
    for _ in range(200):
        b = b[np.argsort((b * b).sum(axis=1), kind="stable")]
        before = (b * b).sum()
        for i, j in ((1, 0), (2, 0), (2, 1)):
            b[i] -= round((b[i] @ b[j]) / (b[j] @ b[j])) * b[j]
        corner = min((b[2] + x * b[0] + y * b[1] for x in (-1, 0, 1) for y in (-1, 0, 1)), key=lambda v: v @ v)
        b[2] = corner
        if (b * b).sum() >= before - 1e-9:
            break
    return b if np.linalg.det(b) > 0 else -b


def same_lattice(a: np.ndarray, b: np.ndarray, tolerance: float = 0.1) -> bool:
    """Whether two bases (rows) are related by an integer matrix of determinant 1 or -1."""
    m = a @ np.linalg.inv(b)
    whole = np.round(m)
    return bool(np.abs(m - whole).max() <= tolerance and abs(abs(np.linalg.det(whole)) - 1) < 0.5)


def indexed(points: DataFrame, basis: np.ndarray, tolerance: float = 0.3) -> DataFrame:
    """h, k, l of reciprocal points (x, y, z) for a direct basis (rows): whole numbers within the tolerance on all axes, else null."""
    out = points
    near = F.lit(True)
    for name, row in zip("hkl", np.asarray(basis, dtype=float), strict=True):
        part = F.col("x") * float(row[0]) + F.col("y") * float(row[1]) + F.col("z") * float(row[2])
        near = near & (F.abs(part - F.round(part)) <= tolerance)
        out = out.withColumn(f"_{name}", F.round(part).cast("int"))
    return out.withColumn("_near", near).withColumns({n: F.when(F.col("_near"), F.col(f"_{n}")) for n in "hkl"}).drop("_near", *(f"_{n}" for n in "hkl"))


def choose_basis(points: np.ndarray, vectors: list[np.ndarray], tolerance: float = 0.3, least_volume: float = 20.0, flattest: float = 0.1) -> np.ndarray | None:
    """The reduced basis, of three candidate vectors, that indexes most points; the smaller volume of equals.

    Three vectors nearly in a plane (volume under `flattest` of the product of their lengths) make no basis.
    """
    best = None
    for i in range(len(vectors)):
        for j in range(i + 1, len(vectors)):
            for k in range(j + 1, len(vectors)):
                b = np.array([vectors[i], vectors[j], vectors[k]])
                volume = abs(np.linalg.det(b))
                if volume < max(least_volume, flattest * np.prod(np.linalg.norm(b, axis=1))):
                    continue
                part = points @ b.T
                n = int((np.abs(part - np.round(part)).max(axis=1) <= tolerance).sum())
                key = (-n, round(volume, 3))
                if best is None or key < best[0]:
                    best = (key, b)
    return None if best is None else reduced(best[1])


def crossing_angles(h: np.ndarray, matrix: np.ndarray, axis: np.ndarray, s0: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both angles at which each reflection (rows of h) meets the sphere: the roots of B cos phi + C sin phi + A = 0; NaN where it never does."""
    r = h @ matrix.T
    along = np.outer(r @ axis, axis)
    across = r - along
    a = 2 * (along @ s0) + (r * r).sum(axis=1)
    b, c = 2 * (across @ s0), 2 * (np.cross(axis, across) @ s0)
    size = np.hypot(b, c)
    with np.errstate(invalid="ignore", divide="ignore"):
        middle, half = np.arctan2(c, b), np.arccos(-a / size)
    return middle - half, middle + half


def predicted(indices: DataFrame, matrix: np.ndarray, axis: np.ndarray, s0: np.ndarray, phi_low: float, phi_high: float) -> DataFrame:
    """(h, k, l, phi, entering, s1x, s1y, s1z) of reflections crossing within the scan; angles in radians."""
    axis = np.asarray(axis, dtype=float) / np.linalg.norm(axis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = np.stack([batch.column(c).to_numpy().astype(float) for c in "hkl"], axis=1)
            parts = []
            for phi in crossing_angles(h, matrix, axis, s0):
                turns = np.ceil((phi_low - phi) / (2 * np.pi))
                at = phi + turns * 2 * np.pi
                while (go := at < phi_high).any():
                    r = h[go] @ matrix.T
                    p = at[go][:, None]
                    s1 = r * np.cos(p) + np.cross(axis, r) * np.sin(p) + np.outer(r @ axis, axis) * (1 - np.cos(p)) + s0
                    entering = (np.cross(axis, s1 - s0) * s0).sum(axis=1) < 0
                    parts.append((h[go].astype(np.int32), at[go], entering, s1))
                    at = np.where(go, at + 2 * np.pi, np.inf)
            if parts:
                index, phi, entering, s1 = (np.concatenate([p[k] for p in parts]) for k in range(4))
                yield pa.RecordBatch.from_arrays([*(pa.array(index[:, k]) for k in range(3)), pa.array(phi), pa.array(entering), *(pa.array(s1[:, k]) for k in range(3))], names=["h", "k", "l", "phi", "entering", "s1x", "s1y", "s1z"])

    return indices.select(*(F.col(c).cast("int") for c in "hkl")).mapInArrow(run, "h int, k int, l int, phi double, entering boolean, s1x double, s1y double, s1z double")
