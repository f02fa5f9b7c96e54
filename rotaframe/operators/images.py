"""Spots on detector frames: a local dispersion threshold, components across frames, and their measurement.

Frames are rows (sweep, frame, height, width, pixels array<int>); each is thresholded by itself in an Arrow
batch. Components are found by Spark from pixels that touch, so no sweep has to fit in one task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .joins import connected_components


@dataclass(frozen=True)
class Threshold:
    first_radius: int = 3
    erosion: int = 2
    second_radius: int = 5
    background_sigmas: float = 6.0
    signal_sigmas: float = 3.0
    largest: int = 65535


def box_sums(x: np.ndarray, radius: int) -> np.ndarray:
    """Sums over squares of side 2 radius + 1, cut at the edges, from a summed-area table."""
    table = np.zeros((x.shape[0] + 1, x.shape[1] + 1), dtype=np.float64)
    np.cumsum(np.cumsum(x, axis=0, dtype=np.float64), axis=1, out=table[1:, 1:])
    y0, x0 = (np.maximum(np.arange(n) - radius, 0) for n in x.shape)
    y1, x1 = (np.minimum(np.arange(n) + radius + 1, n) for n in x.shape)
    return table[y1][:, x1] - table[y0][:, x1] - table[y1][:, x0] + table[y0][:, x0]


def signal(image: np.ndarray, mask: np.ndarray | None = None, t: Threshold = Threshold()) -> np.ndarray:  # noqa: B008
    """Signal pixels of one frame: too dispersed against their neighbourhood, and bright against the background without them."""
    valid = image < t.largest - 1
    if mask is not None:
        valid &= mask
    x = np.where(valid, image, 0).astype(np.float64)
    n, s, s2 = box_sums(valid, t.first_radius), box_sums(x, t.first_radius), box_sums(x * x, t.first_radius)
    dispersed = valid & (n >= 2) & (n * s2 - s * s - s * (n - 1) > t.background_sigmas * s * np.sqrt(2 * np.maximum(n - 1, 0)))
    # eroded: the whole square is dispersed or masked
    side = np.full(image.shape, True)
    around = box_sums(dispersed | ~valid, t.erosion)
    eroded = dispersed & (around == box_sums(side, t.erosion))
    quiet = valid & ~eroded
    n, s = box_sums(quiet, t.second_radius), box_sums(np.where(quiet, x, 0), t.second_radius)
    mean = np.where(n >= 2, s / np.maximum(n, 1), 0)
    return dispersed & (x > 0) & (x >= mean + t.signal_sigmas * np.sqrt(mean))


def signal_pixels(frames: DataFrame, masked: list[int] | None = None, t: Threshold = Threshold()) -> DataFrame:  # noqa: B008
    """(sweep, frame, y, x, value) of signal pixels. masked: flat indices of pixels never to be used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                image = np.array(row["pixels"], dtype=np.int64).reshape(row["height"], row["width"])
                mask = None
                if masked:
                    mask = np.ones(image.size, dtype=bool)
                    mask[masked] = False
                    mask = mask.reshape(image.shape)
                y, x = np.nonzero(signal(image, mask, t))
                n = len(y)
                yield pa.RecordBatch.from_arrays([pa.array([row["sweep"]] * n, type=pa.int64()), pa.array([row["frame"]] * n, type=pa.int32()), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(image[y, x])], names=["sweep", "frame", "y", "x", "value"])

    return frames.select("sweep", "frame", "height", "width", "pixels").mapInArrow(run, "sweep long, frame int, y int, x int, value long")


def pixel_components(pixels: DataFrame) -> DataFrame:
    """Pixels with the id of their component: neighbours in x, y or frame touch. Edges are equi joins on the next place."""
    node = F.xxhash64("sweep", "frame", "y", "x")
    own = pixels.withColumn("node", node)
    here = own.select("sweep", "frame", "y", "x", "node")
    edges = None
    for axis in ("frame", "y", "x"):
        next_to = here.select(*(F.col(c) - 1 if c == axis else F.col(c) for c in ("sweep", "frame", "y", "x")), F.col("node").alias("other")).toDF("sweep", "frame", "y", "x", "other")
        found = here.join(next_to, ["sweep", "frame", "y", "x"]).select("node", "other")
        edges = found if edges is None else edges.unionByName(found)
    labels = connected_components(edges, "node", "other")
    return own.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")).drop("node")


def measure_spots(pixels: DataFrame, least: int = 3, most: int | None = 1000, peak_distance: float | None = 2.0) -> DataFrame:
    """Bounding box, weighted centroid (pixel centres at 0.5) with its variance, sum and peak of each component.

    Components of fewer than `least` or over `most` pixels, or with the peak farther from the centroid, are no spots
    and left out; with None there is no such limit, and with least=1 and both None every component comes out.
    """
    w = F.col("value").cast("double")
    place = {"x": F.col("x") + 0.5, "y": F.col("y") + 0.5, "z": F.col("frame") - 0.5}
    sums = [F.sum(w).alias("total"), F.count("*").alias("n_signal"), F.min(F.struct(-F.col("value"), F.col("frame"), F.col("y"), F.col("x"))).alias("peak")]
    for name, c in place.items():
        sums += [F.sum(w * c).alias(f"s_{name}"), F.sum(w * c * c).alias(f"ss_{name}")]
    for name, c in (("x", F.col("x")), ("y", F.col("y")), ("z", F.col("frame") - 1)):
        sums += [F.min(c).alias(f"{name}0"), (F.max(c) + 1).alias(f"{name}1")]
    out = pixels.groupBy("sweep", "component").agg(*sums)
    for name in place:
        out = out.withColumn(f"c_{name}", F.col(f"s_{name}") / F.col("total"))
        spread = F.greatest(F.col(f"ss_{name}") / F.col("total") - F.col(f"c_{name}") * F.col(f"c_{name}"), F.lit(0.0))
        out = out.withColumn(f"var_{name}", spread / F.col("total") + 1 / 12)
    far = F.sqrt(F.pow(F.col("peak.x") + 0.5 - F.col("c_x"), 2) + F.pow(F.col("peak.y") + 0.5 - F.col("c_y"), 2) + F.pow(F.col("peak.frame") - 0.5 - F.col("c_z"), 2))
    keep = out.filter(F.col("n_signal") >= least)
    if most is not None:
        keep = keep.filter(F.col("n_signal") <= most)
    if peak_distance is not None:
        keep = keep.filter(far <= peak_distance)
    return keep.select("sweep", "component", "n_signal", "total", *(f"{p}_{n}" for p in ("c", "var") for n in "xyz"), *(f"{n}{e}" for n in "xyz" for e in "01"))


def untrusted_pixels(height: int, width: int, rectangles=(), circles=(), polygons=(), pixels=()) -> np.ndarray:
    """Flat indices of pixels in regions not to be used. rectangles: (x0, x1, y0, y1), upper ends left out; circles: (x, y, radius)."""
    y, x = np.mgrid[:height, :width]
    out = np.zeros((height, width), dtype=bool)
    for x0, x1, y0, y1 in rectangles:
        out[y0:y1, x0:x1] = True
    for cx, cy, r in circles:
        out |= (x + 0.5 - cx) ** 2 + (y + 0.5 - cy) ** 2 <= r * r
    for polygon in polygons:
        inside = np.zeros_like(out)
        for (xa, ya), (xb, yb) in zip(polygon, [*polygon[1:], polygon[0]], strict=True):
            if ya != yb:
                crosses = ((ya > y + 0.5) != (yb > y + 0.5)) & (x + 0.5 < (xb - xa) * (y + 0.5 - ya) / (yb - ya) + xa)
                inside ^= crosses
        out |= inside
    for px, py in pixels:
        out[py, px] = True
    return np.flatnonzero(out)
