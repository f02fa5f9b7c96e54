"""Where a reflection lies on the frames: boxes, foreground masks, neighbours' foregrounds, and the widths that set them.

A reflection is a row (row_id, id of its experiment, panel, s1_x, s1_y, s1_z, phi in radians). In its own frame (e1 and e2
across the beam, a rotation by zeta along it) its foreground is an ellipsoid of n_sigma sigmas, sigma_d across and
sigma_m along; its box is what holds that. Geometry is worked on in Arrow batches of many reflections: all pixels of
all boxes of a batch are one array. Experiments and their panels are given as Python values; they are few and shared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Mapping
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StringType, StructField, StructType

from rotaframe.functions.geometry import TAIL_BOTTOM, TAIL_TOP

# Bits of a voxel's mask.
VALID, BACKGROUND, FOREGROUND, OVERLAPPED = 1, 2, 4, 32
#: Why a reflection has no box, in the order in which it is asked.
NO_PANEL, NO_FRAME, SMALL_ZETA, MISSES, MANY_IMAGES, OUTSIDE = "no such panel", "no frame", "small zeta", "a corner misses the panel's plane", "too many images", "outside the panel or the scan"
#: Voxels worked on at a time.
VOXELS = 1 << 21


@dataclass(frozen=True)
class Panel:
    """Millimetres and pixels; mu and thickness of the sensor, 0 for no parallax."""

    origin: tuple[float, float, float]
    fast: tuple[float, float, float]
    slow: tuple[float, float, float]
    pixel: tuple[float, float]
    size: tuple[int, int]
    mu: float = 0.0
    thickness: float = 0.0

    def _shift(self, rays: np.ndarray) -> np.ndarray:
        """Millimetres along fast and slow by which absorption moves the spot of unit rays."""
        along = np.stack([rays @ np.array(self.fast), rays @ np.array(self.slow)], axis=-1)
        if not (self.mu > 0 and self.thickness > 0):
            return np.zeros_like(along)
        path = self.thickness / np.abs(rays @ np.cross(self.fast, self.slow))
        return along * (1 / self.mu - (path + 1 / self.mu) * np.exp(-self.mu * path))[..., None]

    def pixels(self, s: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """x, y where rays meet the panel's plane, and whether they do so in front of it."""
        normal = np.cross(self.fast, self.slow)
        with np.errstate(divide="ignore", invalid="ignore"):
            far = (np.array(self.origin) @ normal) / (s @ normal)
            off = s * far[..., None] - np.array(self.origin)
            rays = s / np.linalg.norm(s, axis=-1, keepdims=True)
            mm = np.stack([off @ np.array(self.fast), off @ np.array(self.slow)], axis=-1) + self._shift(rays)
        met = np.isfinite(far) & (far > 0)
        return mm[..., 0] / self.pixel[0], mm[..., 1] / self.pixel[1], met

    def rays(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Unit rays through places in pixels."""
        place = lambda u, v: np.array(self.origin) + u[..., None] * np.array(self.fast) + v[..., None] * np.array(self.slow)
        u, v = x * self.pixel[0], y * self.pixel[1]
        lab = place(u, v)
        if self.mu > 0 and self.thickness > 0:
            shift = self._shift(lab / np.linalg.norm(lab, axis=-1, keepdims=True))
            lab = place(u - shift[..., 0], v - shift[..., 1])
        return lab / np.linalg.norm(lab, axis=-1, keepdims=True)


@dataclass(frozen=True)
class Experiment:
    """s0 of length 1 / wavelength, the axis of rotation, panels, and a scan in degrees; image n spans z in [n - 1, n]."""

    s0: tuple[float, float, float]
    axis: tuple[float, float, float]
    panels: tuple[Panel, ...]
    first_image: int
    images: int
    start: float
    width: float

    def z(self, phi: np.ndarray) -> np.ndarray:
        return (np.degrees(phi) - self.start) / self.width + (self.first_image - 1)

    def phi(self, z: np.ndarray) -> np.ndarray:
        return np.radians(self.start + (z - (self.first_image - 1)) * self.width)


@dataclass(frozen=True)
class Widths:
    """sigma_d and sigma_m in degrees; a box is box_scale wider across than the foreground, to hold background."""

    sigma_d: float
    sigma_m: float
    n_sigma: float = 3.0
    box_scale: float = 1.0
    min_zeta: float = 0.05
    max_images: int = 100


@dataclass
class Frames:
    """The reflections' own frames."""

    s1: np.ndarray
    e1: np.ndarray
    e2: np.ndarray
    zeta: np.ndarray
    length: np.ndarray
    valid: np.ndarray

    @classmethod
    def of(cls, s1: np.ndarray, e: Experiment) -> Frames:
        s0 = np.array(e.s0)
        with np.errstate(divide="ignore", invalid="ignore"):
            e1 = np.cross(s1, s0)
            e1 = e1 / np.linalg.norm(e1, axis=1, keepdims=True)
            e2 = np.cross(s1, e1)
            e2 = e2 / np.linalg.norm(e2, axis=1, keepdims=True)
        valid = np.isfinite(e1).all(axis=1) & np.isfinite(e2).all(axis=1) & (np.linalg.norm(s1 + s0, axis=1) > 0)
        return cls(s1, e1, e2, e1 @ np.array(e.axis), np.linalg.norm(s1, axis=1), valid)

    def across(self, of: np.ndarray, rays: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Degrees along e1 and e2 of rays, each in the frame of the reflection it is `of`."""
        off = rays - self.s1[of] / self.length[of][:, None]
        return tuple(np.degrees((axis[of] * off).sum(axis=1)) for axis in (self.e1, self.e2))


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For groups of these sizes, one after another: each member's group, its place there, and where groups begin."""
    first = np.cumsum(counts) - counts
    of = np.repeat(np.arange(len(counts)), counts)
    return of, np.arange(len(of)) - first[of], first


def _box_of(e: Experiment, panel: int, s1: np.ndarray, phi: np.ndarray, w: Widths) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boxes (n, 6: x, y, z from and to), zeta, and the reason there is none or ''."""
    n = len(s1)
    box, why = np.zeros((n, 6), dtype=np.int64), np.full(n, "", dtype=object)
    if not 0 <= panel < len(e.panels):
        return box, np.full(n, np.nan), np.full(n, NO_PANEL, dtype=object)
    p, f = e.panels[panel], Frames.of(s1, e)
    t = math.radians(w.n_sigma * w.sigma_d) * max(w.box_scale, 1.0)

    def refuse(which: np.ndarray, reason: str) -> None:
        why[which & (why == "")] = reason

    refuse(~f.valid | ~np.isfinite(phi) | (t <= 0), NO_FRAME)
    refuse(np.abs(f.zeta) < w.min_zeta, SMALL_ZETA)
    corners = [p.pixels(s1 + (f.e1 * a + f.e2 * b) * f.length[:, None]) for a in (-t, t) for b in (-t, t)]
    refuse(~np.all([met for *_, met in corners], axis=0), MISSES)
    with np.errstate(divide="ignore", invalid="ignore"):
        half = np.radians(w.n_sigma * w.sigma_m) / np.abs(f.zeta)
    ends = [np.stack([x for x, *_ in corners]), np.stack([y for _, y, _ in corners]), np.stack([e.z(phi - half), e.z(phi + half)])]
    limits = [(0, p.size[0]), (0, p.size[1]), (e.first_image - 1, e.first_image - 1 + e.images)]
    good = why == ""
    for k, (values, (low, high)) in enumerate(zip(ends, limits, strict=True)):
        bounds = np.floor(values.min(axis=0)), np.ceil(values.max(axis=0))
        if k == 2:
            refuse(good & (bounds[1] - bounds[0] > w.max_images), MANY_IMAGES)
        box[good, 2 * k] = np.maximum(bounds[0][good], low).astype(np.int64)
        box[good, 2 * k + 1] = np.minimum(bounds[1][good], high).astype(np.int64)
    refuse((box[:, 1::2] <= box[:, ::2]).any(axis=1), OUTSIDE)
    return box, f.zeta, why


def _inside(e: Experiment, panel: int, s1: np.ndarray, phi: np.ndarray, w: Widths, box: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which voxels of each box are in the foreground of its reflection: z slowest, x fastest, boxes one after another; with each voxel's box and place in it."""
    size = box[:, 1::2] - box[:, ::2]
    nx, face, nz = size[:, 0], size[:, 0] * size[:, 1], size[:, 2]
    f = Frames.of(s1, e)
    of, at, first_face = _spread(face)  # the detector's part depends on the pixel alone, the rotation's on the image
    x, y = box[of, 0] + at % nx[of] + 0.5, box[of, 2] + at // nx[of] + 0.5
    u, v = f.across(of, e.panels[panel].rays(x, y))
    flat = (u * u + v * v) / w.sigma_d**2
    of, at, first_image = _spread(nz)
    turn = np.degrees(f.zeta[of] * (e.phi(box[of, 4] + at + 0.5) - phi[of])) / w.sigma_m
    of, at, _ = _spread(face * nz)
    far = flat[first_face[of] + at % face[of]] + (turn * turn)[first_image[of] + at // face[of]]
    return far <= w.n_sigma**2, of, at


Experiments = Mapping[int, Experiment]
S1 = ["s1_x", "s1_y", "s1_z"]
BOX = ["x0", "x1", "y0", "y1", "z0", "z1"]


def _kinds(ids: np.ndarray, panels: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """Experiment, panel and rows of each pair that a batch has."""
    pairs, of = np.unique(np.stack([ids, panels], axis=1), axis=0, return_inverse=True)
    for k, (i, p) in enumerate(pairs.tolist()):
        yield i, p, np.flatnonzero(of.reshape(-1) == k)


def _widths(widths: Widths | Mapping[int, Widths], i: int) -> Widths:
    return widths if isinstance(widths, Widths) else widths[i]


def _columns(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in names], axis=1)


def reflection_boxes(predictions: DataFrame, experiments: Experiments, widths: Widths | Mapping[int, Widths]) -> DataFrame:
    """predictions with zeta, the box (x0 to z1, upper ends left out; null where there is none) and the reason it has none (null where it has one)."""
    more = [*((c, IntegerType()) for c in BOX), ("zeta", DoubleType()), ("reason", StringType())]
    out_schema = StructType([*predictions.schema.fields, *(StructField(c, kind) for c, kind in more)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            box, zeta, why = np.zeros((n, 6), dtype=np.int64), np.full(n, np.nan), np.full(n, NO_PANEL, dtype=object)
            s1, phi = _columns(batch, S1).astype(float), batch.column("phi").to_numpy(zero_copy_only=False).astype(float)
            for i, p, rows in _kinds(batch.column("id").to_numpy(), batch.column("panel").to_numpy()):
                if i not in experiments:
                    raise ValueError(f"no experiment {i}")
                box[rows], zeta[rows], why[rows] = _box_of(experiments[i], p, s1[rows], phi[rows], _widths(widths, i))
            refused = why != ""
            ends = [pa.array(box[:, k].astype(np.int32), mask=refused) for k in range(6)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *ends, pa.array(zeta, mask=np.isnan(zeta)), pa.array(why, type=pa.string(), mask=~refused)], names=[*batch.schema.names, *BOX, "zeta", "reason"])

    return predictions.mapInArrow(run, out_schema)


def _parts(voxels: np.ndarray) -> Iterator[np.ndarray]:
    """Runs of rows with about VOXELS voxels, or one row."""
    ends, at = np.cumsum(voxels), 0
    while at < len(voxels):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + VOXELS, side="right")))
        yield np.arange(at, to)
        at = to


def masks(boxes: DataFrame, experiments: Experiments, widths: Widths | Mapping[int, Widths]) -> DataFrame:
    """(row_id, mask) of the rows that have a box: a byte a voxel, z slowest, valid and in the foreground or the background."""
    rows = boxes.filter(F.col("x0").isNotNull()).select("row_id", "id", "panel", *S1, "phi", *BOX)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            box = _columns(batch, BOX).astype(np.int64)
            for part in _parts((box[:, 1::2] - box[:, ::2]).prod(axis=1)):
                for own, inside, _, _ in _inside_of(batch, part, box, experiments, widths):
                    yield _as_masks(batch, own, box, inside, None)

    kind = boxes.select("row_id").schema[0].dataType.simpleString()
    return rows.mapInArrow(run, f"row_id {kind}, mask binary")


def _inside_of(batch: pa.RecordBatch, part: np.ndarray, box: np.ndarray, experiments: Experiments, widths: Widths | Mapping[int, Widths]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For some rows of a batch, in parts of one experiment and panel: the rows, and of all voxels of their boxes whether they are inside, their row and place."""
    s1, phi = _columns(batch, S1).astype(float), batch.column("phi").to_numpy().astype(float)
    for i, p, own in _kinds(batch.column("id").to_numpy()[part], batch.column("panel").to_numpy()[part]):
        rows = part[own]
        inside, of, at = _inside(experiments[i], p, s1[rows], phi[rows], _widths(widths, i), box[rows])
        yield rows, inside, rows[of], at


def _as_masks(batch: pa.RecordBatch, rows: np.ndarray, box: np.ndarray, inside: np.ndarray, over: np.ndarray | None) -> pa.RecordBatch:
    mask = np.where(inside, VALID | FOREGROUND, VALID | BACKGROUND).astype(np.uint8)
    if over is not None:
        mask[over] |= OVERLAPPED
    ends = np.cumsum((box[rows, 1::2] - box[rows, ::2]).prod(axis=1))
    return pa.RecordBatch.from_arrays([batch.column("row_id").take(pa.array(rows)), pa.array([piece.tobytes() for piece in np.split(mask, ends[:-1])], type=pa.binary())], names=["row_id", "mask"])


def _whole_tiles(batches: Iterator[pa.RecordBatch], groups: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Rows of some whole tiles at a time, with each row's number of its tile, from rows in the order of tiles; a missing key is like no other."""
    held: list[pa.RecordBatch] = []
    n, enough = 0, VOXELS

    def numbered(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), dtype=bool)
        for c in groups:
            column = table.column(c).combine_chunks()
            new[1:] |= pa.compute.fill_null(pa.compute.not_equal(column[1:], column[:-1]), True).to_numpy(zero_copy_only=False)
        return np.cumsum(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        box = _columns(batch, BOX).astype(np.int64)
        n += int((box[:, 1::2] - box[:, ::2]).prod(axis=1).sum())
        if n >= enough:
            table = pa.Table.from_batches(held).combine_chunks()
            tile = numbered(table)
            cut = int(np.searchsorted(tile, tile[-1], side="left"))
            enough = 2 * n  # of one large tile, seldom asked again
            if cut:
                yield table.slice(0, cut).to_batches()[0], tile[:cut]
                held, n, enough = table.slice(cut).to_batches(), 0, VOXELS
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table.to_batches()[0], numbered(table)


def neighbour_masks(boxes: DataFrame, experiments: Experiments, widths: Widths | Mapping[int, Widths], tiles: tuple[int, int, int] = (256, 256, 256), keys: list[str] | None = None) -> DataFrame:
    """(row_id, mask) as masks, with the voxels in the foreground of other reflections marked as overlapped.

    A box is at home in the tile of its lowest voxel, and goes as well to the tiles whose boxes it can meet (keys: what else
    two of them must share, the panel unless given). There a voxel's foregrounds are counted, so pairs of boxes are never
    made and the work grows with the boxes, however many lie in one place. boxes are read twice, so they should be stored.
    """
    keys = keys or ["panel"]
    kept = boxes.filter(F.col("x0").isNotNull()).select("row_id", "id", "panel", *(k for k in keys if k not in ("id", "panel")), *S1, "phi", *BOX)
    largest = kept.agg(*(F.coalesce(F.max(F.col(high) - F.col(low)), F.lit(1)) for low, high in zip(BOX[::2], BOX[1::2], strict=True))).first()
    at = ["_t0", "_t1", "_t2"]
    dealt = kept
    for t, low, high, size, most in zip(at, BOX[::2], BOX[1::2], tiles, largest, strict=True):
        dealt = dealt.withColumn(t, F.explode(F.sequence(F.floor((F.col(low) - (most - 1)) / size).cast("int"), F.floor((F.col(high) - 1) / size).cast("int"))))
    side, reach = np.array(tiles, dtype=np.int64), np.array(tiles, dtype=np.int64) + np.array(list(largest), dtype=np.int64) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, tile in _whole_tiles(batches, [*keys, *at]):
            box, place = _columns(batch, BOX).astype(np.int64), _columns(batch, at).astype(np.int64)
            home = (box[:, ::2] // side == place).all(axis=1)
            first = place * side
            met = np.empty_like(box)  # what of a box lies within reach of the tile's own boxes; those of them wholly
            met[:, ::2], met[:, 1::2] = np.maximum(box[:, ::2], first), np.minimum(box[:, 1::2], first + reach)

            def named(of: np.ndarray, at: np.ndarray, met: np.ndarray = met, first: np.ndarray = first, tile: np.ndarray = tile) -> np.ndarray:
                """A number for each voxel of the tiles."""
                size = (met[:, 1::2] - met[:, ::2])[of]
                x, y, z = at % size[:, 0], at // size[:, 0] % size[:, 1], at // (size[:, 0] * size[:, 1])
                x, y, z = (v + (met[:, 2 * k] - first[:, k])[of] for k, v in enumerate((x, y, z)))
                return ((tile[of] * reach[2] + z) * reach[1] + y) * reach[0] + x

            volume = np.maximum(met[:, 1::2] - met[:, ::2], 0).prod(axis=1)
            some = np.flatnonzero(volume)
            voxels, counts = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
            for part in _parts(volume[some]):
                for _, inside, of, there in _inside_of(batch, some[part], met, experiments, widths):
                    both = np.concatenate([voxels, named(of[inside], there[inside])])
                    voxels, back = np.unique(both, return_inverse=True)
                    counts = np.bincount(back, weights=np.concatenate([counts, np.ones(len(both) - len(counts))]), minlength=len(voxels)).astype(np.int64)
            own = np.flatnonzero(home)
            for part in _parts(volume[own]):
                for rows, inside, of, there in _inside_of(batch, own[part], met, experiments, widths):
                    name = named(of, there)
                    found = np.minimum(np.searchsorted(voxels, name), max(len(voxels) - 1, 0))
                    covered = np.where(voxels[found] == name, counts[found], 0) if len(voxels) else np.zeros(len(name), dtype=np.int64)
                    yield _as_masks(batch, rows, met, inside, covered > inside)

    kind = boxes.select("row_id").schema[0].dataType.simpleString()
    return dealt.repartition(*keys, *at).sortWithinPartitions(*keys, *at).mapInArrow(run, f"row_id {kind}, mask binary")


def unobservable(predictions: DataFrame, masked: DataFrame, x: Column, y: Column, width: Column, height: Column, panel: str = "panel") -> DataFrame:
    """predictions with `unobservable`: whether the pixel they fall on is masked (panel, x, y) or off the panel. An equi join on the pixel."""
    bad = masked.select(F.col(panel), F.col("x").cast("long").alias("_px"), F.col("y").cast("long").alias("_py")).distinct().withColumn("_bad", F.lit(True))
    own = predictions.withColumns({"_px": F.floor(x), "_py": F.floor(y), "_off": F.coalesce((x < 0) | (y < 0) | (x >= width) | (y >= height), F.lit(True))})
    out = own.join(bad, [panel, "_px", "_py"], "left")
    return out.select(*predictions.columns, (F.col("_off") | F.coalesce("_bad", F.lit(False))).alias("unobservable"))


def spot_variances(spots: DataFrame, experiments: Experiments) -> DataFrame:
    """(row_id, id, variance): mean square angle in radians of a spot's counts about its s1; null with one count or less.

    spots: reflections with a box, pixels, background (arrays, z slowest) and mask.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            box = _columns(batch, BOX).astype(np.int64)
            size = box[:, 1::2] - box[:, ::2]
            s1 = _columns(batch, S1).astype(float)
            weight, moment = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            counts, valid = _counts(batch)
            of, at, _ = _spread(size.prod(axis=1))
            counts = np.where(valid & (counts > 0), counts, 0.0)
            ids, panels = batch.column("id").to_numpy(), batch.column("panel").to_numpy()
            for i, p, rows in _kinds(ids, panels):
                use = np.flatnonzero(np.isin(of, rows) & (counts > 0))
                o, a = of[use], at[use]
                x, y = box[o, 0] + a % size[o, 0] + 0.5, box[o, 2] + a // size[o, 0] % size[o, 1] + 0.5
                cosine = (experiments[i].panels[p].rays(x, y) * (s1[o] / np.linalg.norm(s1[o], axis=1, keepdims=True))).sum(axis=1)
                angle = np.arccos(np.clip(cosine, -1, 1))
                weight += np.bincount(o, weights=counts[use], minlength=batch.num_rows)
                moment += np.bincount(o, weights=counts[use] * angle**2, minlength=batch.num_rows)
            known = weight > 1
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("id"), pa.array(np.where(known, moment / np.where(known, weight - 1, 1), np.nan), mask=~known)], names=["row_id", "id", "variance"])

    kinds = [f.dataType.simpleString() for f in spots.select("row_id", "id").schema]
    return spots.select("row_id", "id", "panel", *S1, *BOX, "pixels", "background", "mask").mapInArrow(run, f"row_id {kinds[0]}, id {kinds[1]}, variance double")


def _counts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Counts above the background of all voxels of a batch, and whether they are valid."""
    flat = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(float)
    mask = np.frombuffer(b"".join(batch.column("mask").to_pylist()), dtype=np.uint8)
    return flat("pixels") - flat("background"), (mask & VALID) > 0


def beam_divergence(spots: DataFrame, experiments: Experiments) -> DataFrame:
    """(id, n_spots, sigma_d): the root of the spots' mean variance, in degrees."""
    variances = spot_variances(spots, experiments).filter("variance IS NOT NULL")
    return variances.groupBy("id").agg(F.count("*").alias("n_spots"), F.degrees(F.sqrt(F.avg("variance"))).alias("sigma_d"))


def range_samples(spots: DataFrame, experiments: Experiments) -> DataFrame:
    """(row_id, id, delta, zeta, counts): for each image on which a spot has valid foreground, phi from that of the image's middle, in radians, and its counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            box = _columns(batch, BOX).astype(np.int64)
            size = box[:, 1::2] - box[:, ::2]
            counts, _ = _counts(batch)
            mask = np.frombuffer(b"".join(batch.column("mask").to_pylist()), dtype=np.uint8)
            of, at, _ = _spread(size.prod(axis=1))
            row, image, first = _spread(size[:, 2])
            slot = first[of] + at // (size[of, 0] * size[of, 1])
            use = (mask & (VALID | FOREGROUND)) == (VALID | FOREGROUND)
            total = np.bincount(slot[use], weights=np.maximum(counts[use], 0), minlength=len(row))
            met = np.bincount(slot[use], minlength=len(row)) > 0
            s1, phi = _columns(batch, S1).astype(float), batch.column("phi").to_numpy().astype(float)
            delta, zeta = np.zeros(len(row)), np.zeros(batch.num_rows)
            for i, _, rows in _kinds(batch.column("id").to_numpy(), batch.column("panel").to_numpy()):
                e = experiments[i]
                zeta[rows] = Frames.of(s1[rows], e).zeta
                own = np.isin(row, rows)
                delta[own] = phi[row[own]] - e.phi(box[row[own], 4] + image[own] + 0.5)
            keep = np.flatnonzero(met)
            where = pa.array(row[keep])
            yield pa.RecordBatch.from_arrays([batch.column("row_id").take(where), batch.column("id").take(where), pa.array(delta[keep]), pa.array(zeta[row[keep]]), pa.array(total[keep])], names=["row_id", "id", "delta", "zeta", "counts"])

    kinds = [f.dataType.simpleString() for f in spots.select("row_id", "id").schema]
    return spots.select("row_id", "id", "panel", *S1, "phi", *BOX, "pixels", "background", "mask").mapInArrow(run, f"row_id {kinds[0]}, id {kinds[1]}, delta double, zeta double, counts double")


def normal_cdf(x: np.ndarray) -> np.ndarray:
    """The normal distribution function, as functions.geometry has it for columns."""
    far = np.minimum(np.abs(x), 38.0)
    near = np.minimum(far, 7.07)
    tail = np.exp(far * far / -2) * np.polyval(TAIL_TOP, near) / np.polyval(TAIL_BOTTOM, near)
    return np.where(x > 0, 1 - tail, tail)


def range_likelihoods(samples: DataFrame, oscillation: float, widths: list[float], min_zeta: float = 0.05, weighted: bool = False) -> DataFrame:
    """(nth, log_likelihood) of each of the widths sigma_m in degrees, for images of `oscillation` degrees.

    A sample's density is the part of a normal distribution of width sigma_m / |zeta| that its image records, over the
    image's width. All widths are tried in one pass, of which a task sends only its sums.
    """
    step, tried = math.radians(oscillation), np.radians(widths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(tried))
        for batch in batches:
            delta, zeta, counts = (batch.column(c).to_numpy() for c in ("delta", "zeta", "counts"))
            for k, sigma in enumerate(tried):
                scale = np.abs(zeta) / sigma
                part = (normal_cdf((delta + step / 2) * scale) - normal_cdf((delta - step / 2) * scale)) / step
                total[k] += (counts * np.log(np.maximum(part, 1e-300))).sum()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(tried), dtype=np.int32)), pa.array(total)], names=["nth", "log_likelihood"])

    own = samples.filter(F.abs("zeta") >= min_zeta).select("delta", "zeta", (F.col("counts") if weighted else F.lit(1.0)).alias("counts"))
    return own.mapInArrow(run, "nth int, log_likelihood double").groupBy("nth").agg(F.sum("log_likelihood").alias("log_likelihood"))


def reflecting_range(samples: DataFrame, oscillation: float, min_zeta: float = 0.05, weighted: bool = False, low: float = 0.001, high: float = 2.0, at_once: int = 32, tolerance: float = 1e-9) -> float | None:
    """sigma_m in degrees of greatest likelihood, for images of `oscillation` degrees; None with fewer than two samples.

    Each pass tries `at_once` widths between the ends, and the next lies between the neighbours of the best: the
    likelihood has one peak. samples are read in each pass, so they should be stored.
    """
    if samples.filter(F.abs("zeta") >= min_zeta).limit(2).count() < 2:
        return None
    while high - low > tolerance:
        ends = np.linspace(low, high, at_once + 2)
        found = range_likelihoods(samples, oscillation, ends[1:-1].tolist(), min_zeta, weighted).collect()  # a row a width
        best = max(found, key=lambda r: (r.log_likelihood, -r.nth)).nth
        low, high = float(ends[best]), float(ends[best + 2])
    return (low + high) / 2
