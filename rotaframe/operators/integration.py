"""Intensities from boxes of pixels: a robust background, summation, profiles learned and fitted.

A box is a row (box, region, pixels array<double>, foreground array<boolean>, valid array<boolean>). Boxes are
independent, so they are worked on in Arrow batches without a shuffle; only profile learning groups them, by
detector region, and adds up arrays of a fixed size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def glm_background(values: np.ndarray, tuning: float = 1.345, rounds: int = 100) -> float:
    """A Poisson mean by iteratively reweighted estimation with Huber's weights, so that a few bright pixels don't count."""
    if not len(values):
        return 0.0
    mu = max(float(np.median(values)), 0.05)
    for _ in range(rounds):
        r = (values - mu) / np.sqrt(mu)
        w = np.where(np.abs(r) <= tuning, 1.0, tuning / np.maximum(np.abs(r), 1e-12))
        # what the weights take from a Poisson variable of this mean on average
        k = np.arange(0, int(mu + 12 * np.sqrt(mu) + 12))
        p = np.exp(k * np.log(mu) - mu - np.cumsum(np.log(np.maximum(k, 1))))
        rk = (k - mu) / np.sqrt(mu)
        bias = float((p * np.clip(rk, -tuning, tuning)).sum())
        slope = float((p * np.clip(rk, -tuning, tuning) * rk).sum())
        step = float((w * r).mean() - bias) / max(slope, 1e-6) * np.sqrt(mu)
        new = max(mu + step, 1e-4)
        if abs(new - mu) < 1e-6 * max(mu, 1):
            return new
        mu = new
    return mu


def summed(pixels: np.ndarray, foreground: np.ndarray, valid: np.ndarray, background: float, gain: float = 1.0) -> tuple[float, float, bool]:
    """(intensity, variance, whether all of the foreground was valid); the background's own uncertainty is in the variance."""
    use = foreground & valid
    m, n = int(use.sum()), int((~foreground & valid).sum())
    total = float((pixels[use] - background).sum())
    bg = m * background
    return total, gain * (abs(total) + bg * (1 + m / n if n else 1)), bool((valid | ~foreground).all())


def fitted(pixels: np.ndarray, profile: np.ndarray, background: float, use: np.ndarray, rounds: int = 10) -> tuple[float, float, float]:
    """(intensity, variance, correlation) of I p + b against pixels, by weighted least squares with the model's own variances."""
    c, p = pixels[use], profile[use]
    if not len(c) or p.sum() <= 0:
        return 0.0, -1.0, 0.0
    intensity = max(float((c - background).sum()), 0.0)
    for _ in range(rounds):
        v = np.maximum(background + np.maximum(intensity, 0) * p, 1e-3)
        new = float((p * (c - background) / v).sum() / (p * p / v).sum())
        if abs(new - intensity) < 1e-3 * np.sqrt(max(new, 1)):
            intensity = new
            break
        intensity = new
    v = np.maximum(background + np.maximum(intensity, 0) * p, 1e-3)
    spread = c.std() * p.std()
    return intensity, float(1 / (p * p / v).sum()), float(((c - c.mean()) * (p - p.mean())).mean() / spread) if spread > 0 else 0.0


def integrated(boxes: DataFrame, profiles: dict[int, list[float]] | None = None) -> DataFrame:
    """(box, background, i_sum, v_sum, complete, i_prf, v_prf, correlation). profiles: by region, a bounded table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                pixels, fg, ok = np.array(row["pixels"], dtype=float), np.array(row["foreground"], dtype=bool), np.array(row["valid"], dtype=bool)
                background = glm_background(pixels[~fg & ok])
                total, variance, complete = summed(pixels, fg, ok, background)
                profile = (profiles or {}).get(row["region"])
                fit = fitted(pixels, np.array(profile), background, fg & ok) if profile is not None else (None, None, None)
                out.append((row["box"], background, total, variance, complete, *fit))
            if out:
                names, types = ["box", "background", "i_sum", "v_sum", "complete", "i_prf", "v_prf", "correlation"], [pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.float64(), pa.float64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    return boxes.mapInArrow(run, "box long, background double, i_sum double, v_sum double, complete boolean, i_prf double, v_prf double, correlation double")


def reference_profiles(boxes: DataFrame, least_signal: float = 5.0) -> DataFrame:
    """(region, profile): the mean of strong boxes' normalised foregrounds. Each partition adds up arrays before the shuffle."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for row in batch.to_pylist():
                pixels, fg, ok = np.array(row["pixels"], dtype=float), np.array(row["foreground"], dtype=bool), np.array(row["valid"], dtype=bool)
                background = glm_background(pixels[~fg & ok])
                total, variance, complete = summed(pixels, fg, ok, background)
                if complete and total > least_signal * np.sqrt(variance):
                    own = np.where(fg, pixels - background, 0) / total
                    sums[row["region"]] = sums.get(row["region"], 0) + own
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), type=pa.int64()), pa.array([x.tolist() for x in sums.values()], type=pa.list_(pa.float64()))], names=["region", "sums"])

    parts = boxes.mapInArrow(partial, "region long, sums array<double>")
    places = parts.select("region", F.posexplode("sums").alias("place", "x")).groupBy("region", "place").agg(F.sum("x").alias("x"))
    arrays = places.groupBy("region").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("p"), F.sum(F.greatest("x", F.lit(0.0))).alias("total"))
    return arrays.filter("total > 0").select("region", F.transform("p", lambda e: F.greatest(e["x"], F.lit(0.0)) / F.col("total")).alias("profile"))
