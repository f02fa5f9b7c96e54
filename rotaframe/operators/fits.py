"""Profile-fitted intensities: reflections alone in Arrow batches, and those whose foregrounds touch in one system.

A box is a row (row_id, keys such as the panel, x0 to z1, pixels, background and profile: arrays of doubles, z slowest,
and a mask as shoeboxes.masks gives it). Both ways find the scale of the profile by least squares, weighted by what the
model expects of each pixel, in a few rounds: an intensity is the scale times the profile's sum over the whole
foreground, measured or not, so a reflection half in a gap isn't made half as strong.

Reflections that touch are solved together. Where their boxes meet, voxels of foregrounds become rows, and Spark finds the
sets of reflections that touch and deals the boxes of whole sets to tasks. A task takes many sets at once: products of all pairs that share
a voxel are summed to a block for each set, and blocks of one size are solved as one array.

Failures are named: a foreground without a measured voxel, a profile that has nothing on the foreground, a singular system.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .joins import connected_components, overlaps
from .shoeboxes import BACKGROUND, BOX, FOREGROUND, VALID

# The least expected counts that a weight and a variance are reckoned with.
WEIGHT_FLOOR, LEAST_VARIANCE = 0.05, 0.001
MASKED, OFF_PROFILE, SINGULAR = "foreground masked", "profile off the foreground", "singular"
#: Reflections that touch in one set, at most. More have no room between them, and are an error.
MOST = 4096
OUT = "intensity double, variance double, correlation double, measured double, failure string"
OUT_NAMES = ["intensity", "variance", "correlation", "measured", "failure"]


def _flat(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(column).flatten().to_numpy(zero_copy_only=False).astype(float)


def fitted_alone(boxes: DataFrame, gain: float = 1.0, rounds: int = 3) -> DataFrame:
    """(row_id, intensity, variance, correlation, measured, failure) of each box by itself; all boxes of a batch are worked on at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            sizes = pa.compute.list_value_length(batch.column("pixels")).to_numpy()
            of = np.repeat(np.arange(n), sizes)
            data, back, profile = (_flat(batch, c) for c in ("pixels", "background", "profile"))
            mask = np.frombuffer(b"".join(batch.column("mask").to_pylist()), dtype=np.uint8)
            if not len(mask) == len(data) == len(back) == len(profile):
                raise ValueError("arrays of a box that differ in size")

            def total(values: np.ndarray, of: np.ndarray = of, n: int = n) -> np.ndarray:
                return np.bincount(of, weights=values, minlength=n)

            front, valid = (mask & FOREGROUND) > 0, (mask & VALID) > 0
            use, empty = front & valid, (mask & BACKGROUND > 0) & valid & ~front
            whole, seen, n_use = total(profile * front), total(profile * use), total(use)
            failure = np.select([n_use == 0, whole <= 0, seen <= 0], [MASKED, OFF_PROFILE, MASKED], "").astype(object)
            p, residual = profile * use, (data - back) * use
            with np.errstate(divide="ignore", invalid="ignore"):
                scale = total(residual) / whole
                for _ in range(max(rounds, 1)):
                    expected = gain * (back + np.maximum(np.nan_to_num(scale), 0)[of] * profile)
                    w, v = 1 / np.maximum(expected, gain * WEIGHT_FLOOR), np.maximum(expected, gain * LEAST_VARIANCE)
                    weight, square = total(p * w), total(p * p * w)
                    scale = total(p * residual * w) / square
                failure[(failure == "") & ~(square > 0)] = SINGULAR
                variance = total(p * p * w * w * v) / square**2 * whole**2
                n_back, mean_back = total(empty), total(back * use) / n_use
                carried = whole * weight / square
                variance = variance + np.where(n_back > 0, gain * mean_back / np.maximum(n_back, 1) * carried**2, 0)
                means = total(p) / n_use, total(residual) / n_use
                spreads = total(p * p) / n_use - means[0] ** 2, total(residual**2) / n_use - means[1] ** 2
                correlation = np.where((spreads[0] > 0) & (spreads[1] > 0), (total(p * residual) / n_use - means[0] * means[1]) / np.sqrt(spreads[0] * spreads[1]), 0.0)
                measured = np.where(whole > 0, seen / whole, 0.0)
            bad = failure != ""
            columns = [pa.array(np.nan_to_num(x), mask=bad) for x in (scale * whole, variance, correlation)]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), *columns, pa.array(measured), pa.array(failure, type=pa.string(), mask=~bad)], names=["row_id", *OUT_NAMES])

    kind = boxes.select("row_id").schema[0].dataType.simpleString()
    return boxes.select("row_id", "pixels", "background", "profile", "mask").mapInArrow(run, f"row_id {kind}, {OUT}")


def _places(batch: pa.RecordBatch) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """For all voxels of a batch's boxes, one box after another: their box, x, y and z, and their mask."""
    box = np.stack([batch.column(c).to_numpy() for c in BOX], axis=1).astype(np.int64)
    size = box[:, 1::2] - box[:, ::2]
    n = size.prod(axis=1)
    of = np.repeat(np.arange(len(n)), n)
    at = np.arange(len(of)) - (np.cumsum(n) - n)[of]
    place = [at % size[of, 0], at // size[of, 0] % size[of, 1], at // (size[of, 0] * size[of, 1])]
    return of, [p + box[of, 2 * k] for k, p in enumerate(place)], np.frombuffer(b"".join(batch.column("mask").to_pylist()), dtype=np.uint8)


def touching(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(row_id, component) of boxes whose foregrounds share a voxel, directly or through others."""
    place = [*keys, "x", "y", "z"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, at, mask = _places(batch)
            front = np.flatnonzero(mask & FOREGROUND)
            rows = pa.array(of[front])
            yield pa.RecordBatch.from_arrays([*(batch.column(k).take(rows) for k in (*keys, "row_id")), *(pa.array(p[front].astype(np.int32)) for p in at)], names=[*keys, "row_id", "x", "y", "z"])

    own = boxes.select(*keys, "row_id", *BOX, "mask")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in boxes.select(*keys, "row_id").schema)
    front = own.mapInArrow(run, f"{kinds}, x int, y int, z int")
    # of the foregrounds on a voxel, each is tied to the least: as connected as all pairs, and one row each; a voxel's rows meet once, sorted
    first = F.min("row_id").over(Window.partitionBy(*place))
    edges = front.withColumn("other", first).filter(F.col("row_id") != F.col("other")).select("row_id", "other").distinct()
    return connected_components(edges, "row_id", "other").withColumnRenamed("node", "row_id")


class _Touching:
    """Whole sets of touching boxes, worked on at once: their voxels as arrays, sums of pairs that share a voxel, and a block for each set."""

    def __init__(self, columns: dict[str, np.ndarray]) -> None:
        self.rows, self.box = np.unique(columns["row_id"], return_inverse=True)
        self.set = np.zeros(len(self.rows), dtype=np.int64)
        _, sets = np.unique(columns["component"], return_inverse=True)
        self.set[self.box] = sets
        self.data, self.back, self.profile = (columns[c] for c in ("data", "background", "profile"))
        bits = columns["bits"]
        self.front, self.use = (bits & FOREGROUND) > 0, (bits & (FOREGROUND | VALID)) == (FOREGROUND | VALID)
        self.empty = ((bits & (BACKGROUND | VALID)) == (BACKGROUND | VALID)) & ~self.front
        place = sets  # boxes of one set share their keys
        for c in "zyx":
            at = columns[c].astype(np.int64)
            place = place * (int(at.max() - at.min()) + 1) + (at - at.min())
        _, self.voxel = np.unique(place, return_inverse=True)

    def _of_boxes(self, values: np.ndarray) -> np.ndarray:
        return np.bincount(self.box, weights=values, minlength=len(self.rows))

    def _pairs(self, voxel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of all ordered pairs of rows that share a voxel; rows are in the order of voxels."""
        size = np.bincount(voxel)
        many = size[voxel]
        first = (np.cumsum(size) - size)[voxel]
        a = np.repeat(np.arange(len(voxel)), many)
        return a, first[a] + np.arange(len(a)) - (np.cumsum(many) - many)[a]

    def _blocks(self, box_a: np.ndarray, box_b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """For sets of each size: the boxes of each, and where the entries of pairs go: which of them, their set, row and column."""
        order = np.argsort(self.set, kind="stable")
        size = np.bincount(self.set)
        if size.max() > MOST:
            raise ValueError(f"{size.max()} reflections touch one another: more than {MOST}")
        rank = np.empty(len(order), dtype=np.int64)
        rank[order] = np.arange(len(order)) - (np.cumsum(size) - size)[self.set[order]]
        for n in np.unique(size).tolist():
            sets = np.flatnonzero(size == n)
            boxes = order[np.isin(self.set[order], sets)].reshape(len(sets), n)
            which = np.flatnonzero(size[self.set[box_a]] == n)
            yield boxes, which, np.searchsorted(sets, self.set[box_a[which]]), rank[box_a[which]] * n + rank[box_b[which]]

    def fit(self, gain: float, rounds: int) -> dict[str, np.ndarray]:
        of = self._of_boxes
        whole, seen, n_use, n_back = of(self.profile * self.front), of(self.profile * self.use), of(self.use), of(self.empty)
        residual = (self.data - self.back) * self.use
        # one box that can't be fitted takes its whole set with it
        own = np.select([n_use == 0, whole <= 0, seen <= 0], [2, 1, 2], 0)
        worst = np.zeros(self.set.max() + 1, dtype=np.int64)
        np.maximum.at(worst, self.set, own)
        failure = np.array(["", OFF_PROFILE, MASKED], dtype=object)[worst[self.set]]
        with np.errstate(divide="ignore", invalid="ignore"):
            noise = np.where(n_back > 0, gain * of(self.back * self.use) / n_use / np.maximum(n_back, 1), 0.0)
            scale = np.nan_to_num(of(residual) / whole)
        # the voxels that some member measured in its foreground, with all boxes that hold them
        held = np.flatnonzero(np.bincount(self.voxel, weights=self.use)[self.voxel] > 0)
        held = held[np.argsort(self.voxel[held], kind="stable")]
        _, voxel = np.unique(self.voxel[held], return_inverse=True)
        share = 1 / np.bincount(voxel)
        data, back = (np.bincount(voxel, weights=v[held]) * share for v in (self.data, self.back))
        q, box = self.profile[held], self.box[held]
        a, b = self._pairs(voxel)
        keys, entry = np.unique(box[a] * len(self.rows) + box[b], return_inverse=True)
        box_a, box_b = keys // len(self.rows), keys % len(self.rows)
        variance, from_back = np.zeros(len(self.rows)), np.zeros(len(self.rows))
        for _ in range(max(rounds, 1)):
            expected = back + np.bincount(voxel, weights=np.maximum(scale, 0)[box] * q)
            w = 1 / np.maximum(gain * expected, gain * WEIGHT_FLOOR)
            v = np.maximum(gain * expected, gain * LEAST_VARIANCE)
            right = np.bincount(box, weights=q * (data - back)[voxel] * w[voxel], minlength=len(self.rows))
            sums = [np.bincount(entry, weights=x) for x in (q[a] * q[b] * w[voxel[a]], q[a] * q[b] * (w * w * v)[voxel[a]], q[a] * (w * share)[voxel[a]])]
            for boxes, which, at, cell in self._blocks(box_a, box_b):
                count, n = boxes.shape
                normal, noisy, moved = (np.zeros((count, n * n)) for _ in range(3))
                for matrix, values in zip((normal, noisy, moved), sums, strict=True):
                    matrix[at, cell] = values[which]
                normal, noisy, moved = (m.reshape(count, n, n) for m in (normal, noisy, moved))
                root = np.sqrt(np.maximum(normal.diagonal(axis1=1, axis2=2), 1e-300))
                unit = normal / (root[:, :, None] * root[:, None, :])
                bad = (normal.diagonal(axis1=1, axis2=2) <= 0).any(axis=1) | (np.linalg.matrix_rank(unit, tol=1e-10) < n)
                unit[bad] = np.eye(n)
                failure[boxes[bad].ravel()] = np.where(failure[boxes[bad].ravel()] == "", SINGULAR, failure[boxes[bad].ravel()])
                inverse = np.linalg.inv(unit) / (root[:, :, None] * root[:, None, :])
                scale[boxes] = np.einsum("sij,sj->si", inverse, right[boxes])
                variance[boxes] = np.einsum("sij,sjk,sik->si", inverse, noisy, inverse, optimize=True)
                from_back[boxes] = np.einsum("sij,sj->si", (inverse @ moved) ** 2, noise[boxes])
        with np.errstate(divide="ignore", invalid="ignore"):
            means = seen / n_use, of(residual) / n_use
            p = self.profile * self.use
            spread = (of(p * p) / n_use - means[0] ** 2) * (of(residual * residual) / n_use - means[1] ** 2)
            correlation = np.where(spread > 0, (of(p * residual) / n_use - means[0] * means[1]) / np.sqrt(np.maximum(spread, 1e-300)), 0.0)
            measured = np.where(whole > 0, seen / whole, 0.0)
        return {"intensity": scale * whole, "variance": (variance + from_back) * whole * whole, "correlation": correlation, "measured": measured, "failure": failure}


#: Voxels of whole sets worked on at a time, or one set's.
AT_ONCE = 1 << 19


def _whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """Voxels of some whole sets at a time, as columns, from boxes in the order of sets."""
    held: list[pa.RecordBatch] = []
    n = 0

    def columns(boxes: pa.Table) -> dict[str, np.ndarray]:
        (batch,) = boxes.combine_chunks().to_batches()
        of, at, mask = _places(batch)
        ids = {c: batch.column(c).to_numpy()[of] for c in ("component", "row_id")}
        return ids | dict(zip("xyz", at, strict=True)) | {c: _flat(batch, of_box) for c, of_box in (("data", "pixels"), ("background", "background"), ("profile", "profile"))} | {"bits": mask.astype(np.int32)}

    for whole in batches:
        # a batch may hold more than is worked on at once
        voxels = np.cumsum(pa.compute.binary_length(whole.column("mask")).to_numpy().astype(np.int64))
        cuts = [0, *(np.flatnonzero(np.diff(voxels // AT_ONCE)) + 1).tolist(), whole.num_rows]
        for low, high in zip(cuts[:-1], cuts[1:], strict=True):
            if low == high:
                continue
            held.append(whole.slice(low, high - low))
            n += int(voxels[high - 1] - (voxels[low - 1] if low else 0))
            if n >= AT_ONCE:
                table = pa.Table.from_batches(held)
                last = table.column("component").to_numpy()
                cut = int(np.searchsorted(last, last[-1], side="left"))
                if cut:
                    yield columns(table.slice(0, cut))
                    table = table.slice(cut)
                    held, n = table.to_batches(), int(pa.compute.sum(pa.compute.binary_length(table.column("mask"))).as_py())
    if held:
        yield columns(pa.Table.from_batches(held))


def fitted_together(boxes: DataFrame, components: DataFrame, gain: float = 1.0, rounds: int = 3) -> DataFrame:
    """(row_id, intensity, variance, correlation, measured, failure, component) of boxes that touch, and components as touching() finds them.

    Boxes of whole sets go to a task, one set after another, and become voxels there; a set is held whole, and is bounded by MOST.
    Row ids and components are whole numbers.
    """
    own = boxes.join(components, "row_id").select(*(F.col(c).cast("long") for c in ("component", "row_id")), *BOX, "pixels", "background", "profile", "mask")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in _whole_sets(batches):
            work = _Touching(columns)
            found = work.fit(gain, rounds)
            bad = found["failure"] != ""
            values = [pa.array(found[c], mask=bad) for c in OUT_NAMES[:3]]
            _, first = np.unique(columns["row_id"], return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(work.rows), *values, pa.array(found["measured"]), pa.array(found["failure"], type=pa.string(), mask=~bad), pa.array(columns["component"][first])], names=["row_id", *OUT_NAMES, "component"])

    return own.repartition("component").sortWithinPartitions("component").mapInArrow(run, f"row_id long, {OUT}, component long")


def fitted_intensities(boxes: DataFrame, keys: list[str] | None = None, tiles: tuple[int, int, int] = (32, 32, 8), gain: float = 1.0, rounds: int = 3) -> DataFrame:
    """(row_id, intensity, variance, correlation, measured, failure, component) of all boxes; component is null where a reflection stands alone.

    keys: what the boxes of touching reflections must share, the panel unless given. boxes are read several times, so they should be stored.
    """
    from .storage import written

    keys = keys or ["panel"]
    pairs = overlaps(boxes.select("row_id", *keys, *BOX), "row_id", [("x0", "x1"), ("y0", "y1"), ("z0", "z1")], list(tiles), keys)
    near = pairs.select(F.explode(F.array("a", "b")).alias("row_id")).distinct()
    components = written(touching(boxes.join(near, "row_id", "left_semi"), keys))
    alone = fitted_alone(boxes.join(components.hint("merge"), "row_id", "left_anti"), gain, rounds)
    together = fitted_together(boxes, components.hint("merge"), gain, rounds)
    kind = components.schema["component"].dataType
    return alone.withColumn("component", F.lit(None).cast(kind)).unionByName(together.withColumns({c: F.col(c).cast(boxes.schema["row_id"].dataType) for c in ("row_id", "component")}))
