"""Frames from chunks, boxes, masks, widths and fits against plain loops and planted answers."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotaframe.operators import fits, images, shoeboxes
from rotaframe.operators.storage import checkpoint
from rotaframe.sources import frames

PANEL = shoeboxes.Panel((-40, 30, -200), (1, 0, 0), (0, -1, 0), (0.1, 0.1), (800, 600), mu=1.5, thickness=0.45)
EXPERIMENT = shoeboxes.Experiment((0, 0, -1.0), (1, 0, 0), (PANEL, PANEL), 1, 300, 10.0, 0.1)
WIDTHS = shoeboxes.Widths(sigma_d=0.03, sigma_m=0.06, box_scale=1.4, min_zeta=0.1, max_images=20)
SCHEMA = "row_id long, id int, panel int, s1_x double, s1_y double, s1_z double, phi double"


def plain_shuffle(data: bytes, element: int) -> bytes:
    n = len(data) // element
    out = bytearray(len(data))
    for i in range(n):
        for byte in range(element):
            for bit in range(8):
                if data[i * element + byte] >> bit & 1:
                    out[(byte * 8 + bit) * (n // 8) + i // 8] |= 1 << (i % 8)
    return bytes(out)


@pytest.mark.parametrize("element", [1, 2, 4])
def test_bits_are_shuffled_as_by_a_plain_loop(element):
    data = np.random.default_rng(element).integers(0, 256, 64 * element).astype(np.uint8)
    want = np.frombuffer(plain_shuffle(data.tobytes(), element), dtype=np.uint8)
    assert (frames.shuffled(data, element) == want).all() and (frames.unshuffled(want, element) == data).all()


def test_chunks_come_back_and_bad_ones_are_errors():
    rng = np.random.default_rng(1)
    for bits in (8, 16, 32):
        for algorithm in ("bslz4", "lz4", ""):
            for shape in ((1, 1), (3, 5), (64, 64), (37, 111)):
                layout = frames.Layout(*shape, bits, algorithm)
                image = rng.poisson(3, shape).astype(f"u{bits // 8}")
                image[0, 0] = 2**bits - 1
                chunk = frames.compress(image, layout)
                assert (frames.decompress(chunk, layout) == image).all()
                bad_ones = [chunk[:-1]] if not algorithm else [chunk[:-1], chunk[:5], frames.HEADER.pack(7, 8192) + chunk[12:]]
                for bad in bad_ones:
                    with pytest.raises((ValueError, OSError)):
                        frames.decompress(bad, layout)
    with pytest.raises(ValueError, match="compression"):
        frames.Layout(1, 1, 16, "gzip")


def frame_table(spark, n=9, height=40, width=48):
    rng = np.random.default_rng(5)
    stack = rng.poisson(2, (n, height, width))
    for f in (3, 4, 5):
        stack[f, 20:23, 30:33] += 60
    stack[7, 5, 5] = 65535
    rows = [(0, f + 1, None if f == 6 else stack[f].ravel().tolist()) for f in range(n)]
    return stack, spark.createDataFrame(rows, "sweep long, frame int, pixels array<long>")


def test_frames_by_ranges_of_files(spark, tmp_path):
    stack, table = frame_table(spark)
    for algorithm in ("bslz4", "lz4", ""):
        layout = frames.Layout(40, 48, 16, algorithm)
        index = checkpoint(frames.write_chunks(table.repartition(3), f"file:{tmp_path}/{algorithm}", layout))
        assert index.filter("offset IS NULL").count() == 1
        index.write.mode("overwrite").parquet(f"{tmp_path}/index")
        spark.dataSource.register(frames.FrameSource)
        source = spark.read.format("frames").options(height=40, width=48, algorithm=algorithm, frames=2).load(f"{tmp_path}/index")
        for read in (frames.decoded(index, layout), source):
            got = {r.frame: np.array(r.pixels).reshape(r.height, r.width) for r in read.collect()}
            assert sorted(got) == [1, 2, 3, 4, 5, 6, 8, 9]  # the seventh was never written
            assert all((got[f] == stack[f - 1]).all() for f in got)
    assert frames.decoded(index.limit(0), layout).count() == 0
    cut = index.withColumn("length", F.col("length") - 1)
    with pytest.raises(Exception, match="plain frame"):
        frames.decoded(cut, layout).collect()


def test_from_chunks_to_spots(spark, tmp_path):
    stack, table = frame_table(spark)
    layout = frames.Layout(40, 48)
    index = checkpoint(frames.write_chunks(table, str(tmp_path), layout))
    masked = spark.createDataFrame([(20, 30)], "y int, x int")
    pixels = {(r.frame, r.y, r.x): r.value for r in frames.signal_pixels(index, layout, masked).collect()}
    want = {}
    for f in range(9):
        if f == 6:
            continue
        mask = np.ones((40, 48), dtype=bool)
        mask[20, 30] = False
        for y, x in zip(*np.nonzero(images.signal(stack[f], mask)), strict=True):
            want[f + 1, y, x] = stack[f, y, x]
    assert pixels == want and (4, 20, 30) not in pixels
    (spot,) = [s for s in frames.spots(index, layout).collect() if s.n_signal > 20]
    assert abs(spot.c_x - 31.5) < 0.2 and abs(spot.c_y - 21.5) < 0.2 and abs(spot.c_z - 4.5) < 0.2


def rays_at(places, phi):
    """Rows of predictions through pixels, in an order of ids."""
    x, y = (np.array(v, dtype=float) for v in zip(*places, strict=True))
    s1 = PANEL.rays(x, y)
    return [(i, 0, 0, *map(float, s), float(p)) for i, (s, p) in enumerate(zip(s1, np.broadcast_to(phi, len(s1)), strict=True))]


def plain_inside(row, voxel):
    """Whether a voxel lies in a row's ellipsoid, by one vector at a time."""
    s1, phi = np.array(row[3:6]), row[6]
    e1 = np.cross(s1, EXPERIMENT.s0)
    e1 /= np.linalg.norm(e1)
    e2 = np.cross(s1, e1)
    e2 /= np.linalg.norm(e2)
    x, y, z = voxel
    ray = PANEL.rays(np.array([x + 0.5]), np.array([y + 0.5]))[0]
    off = (ray * np.linalg.norm(s1) - s1) / np.linalg.norm(s1)
    turn = (e1 @ np.array(EXPERIMENT.axis)) * (math.radians(EXPERIMENT.start + (z + 0.5) * EXPERIMENT.width) - phi)
    return sum(math.degrees(v) ** 2 / s**2 for v, s in ((e1 @ off, 0.03), (e2 @ off, 0.03), (turn, 0.06))) <= 9


def test_pixels_and_rays_are_inverse():
    x, y = np.array([3.0, 400.5, 790.0]), np.array([590.0, 300.5, 2.0])
    u, v, met = PANEL.pixels(PANEL.rays(x, y))
    # the way back takes the ray through the corrected point: equal to a thousandth of a pixel
    assert met.all() and np.abs(u - x).max() < 5e-3 and np.abs(v - y).max() < 5e-3


def test_boxes_and_their_refusals(spark):
    phi = math.radians(20.0)
    good = rays_at([(100, 80), (700, 500), (401, 50), (1, 550)], phi)
    along_axis = (10, 0, 0, *map(float, PANEL.rays(np.array([750.0]), np.array([300.2]))[0]), phi)
    rows = [*good, along_axis, (11, 0, 5, *good[0][3:]), (12, 0, 0, 0.0, 0.0, -1.0, phi), (13, 0, 0, *good[0][3:6], math.radians(200.0)), (14, 0, 0, 0.1, 0.2, 1.0, phi), (15, 0, 0, None, 0.2, 1.0, phi)]
    got = {r.row_id: r for r in shoeboxes.reflection_boxes(spark.createDataFrame(rows, SCHEMA), {0: EXPERIMENT}, WIDTHS).collect()}
    assert [got[i].reason for i in (10, 11, 12, 13, 14, 15)] == [shoeboxes.SMALL_ZETA, shoeboxes.NO_PANEL, shoeboxes.NO_FRAME, shoeboxes.OUTSIDE, shoeboxes.MISSES, shoeboxes.NO_FRAME]
    for row in good:
        r = got[row[0]]
        assert r.reason is None and r.x0 >= 0
        # all of the ellipsoid is in the box: nothing around it is foreground
        for x in range(max(r.x0 - 2, 0), r.x1 + 2):
            for y in range(r.y0 - 2, r.y1 + 2):
                for z in range(r.z0 - 2, r.z1 + 2):
                    if plain_inside(row, (x, y, z)):
                        assert r.x0 <= x < r.x1 and r.y0 <= y < r.y1 and r.z0 <= z < r.z1
    narrow = shoeboxes.Widths(0.03, 0.5, max_images=3)
    assert {r.reason for r in shoeboxes.reflection_boxes(spark.createDataFrame(good, SCHEMA), {0: EXPERIMENT}, narrow).collect()} == {shoeboxes.MANY_IMAGES}


def test_neighbour_masks_are_those_of_all_voxels(spark):
    rng = random.Random(3)
    places = [(rng.uniform(100, 130), rng.uniform(80, 110)) for _ in range(14)]
    rows = rays_at(places, [math.radians(20 + rng.uniform(0, 0.8)) for _ in places])
    boxes = checkpoint(shoeboxes.reflection_boxes(spark.createDataFrame(rows, SCHEMA), {0: EXPERIMENT}, WIDTHS))
    held = {r.row_id: r for r in boxes.collect()}
    fore = {}
    for row in rows:
        b = held[row[0]]
        fore[row[0]] = {(x, y, z) for z in range(b.z0, b.z1) for y in range(b.y0, b.y1) for x in range(b.x0, b.x1) if plain_inside(row, (x, y, z))}
    got = {r.row_id: bytes(r["mask"]) for r in shoeboxes.neighbour_masks(boxes, {0: EXPERIMENT}, WIDTHS, tiles=(8, 8, 4)).collect()}
    marked = 0
    for i, b in held.items():
        others = set().union(*(v for j, v in fore.items() if j != i))
        want = bytes((5 if (x, y, z) in fore[i] else 3) | (32 if (x, y, z) in others else 0) for z in range(b.z0, b.z1) for y in range(b.y0, b.y1) for x in range(b.x0, b.x1))
        assert got[i] == want
        marked += sum(m & 32 > 0 for m in want)
    assert marked > 50
    assert shoeboxes.neighbour_masks(boxes.limit(0), {0: EXPERIMENT}, WIDTHS).count() == 0


def test_widths_are_those_planted(spark):
    rng = np.random.default_rng(11)
    sigma_d, sigma_m, rows = 0.05, 0.25, []
    for i in range(60):
        (base,) = rays_at([(rng.uniform(100, 700), rng.uniform(20, 250))], math.radians(25 + rng.uniform(-3, 3)))
        s1, phi = np.array(base[3:6]), base[6]
        f = shoeboxes.Frames.of(s1[None], EXPERIMENT)
        x, y, met = PANEL.pixels(s1[None] + (f.e1 * rng.normal(0, math.radians(sigma_d), (900, 1)) + f.e2 * rng.normal(0, math.radians(sigma_d), (900, 1))))
        z = np.floor(EXPERIMENT.z(phi + rng.normal(0, math.radians(sigma_m), 900) / abs(f.zeta[0])))
        x, y = np.floor(x), np.floor(y)
        low = [int(v.min()) for v in (x, y, z)]
        size = [int(v.max()) - a + 1 for v, a in zip((x, y, z), low, strict=True)]
        pixels = np.zeros(size[::-1])
        np.add.at(pixels, tuple((v - a).astype(int) for v, a in zip((z, y, x), low[::-1], strict=True)), 1)
        ends = [e for a, n in zip(low, size, strict=True) for e in (a, a + n)]
        rows.append((i, *base[1:], *ends, (pixels + 2).ravel().tolist(), [2.0] * pixels.size, np.where(pixels > 0, 5, 3).astype(np.uint8).tobytes()))
    spots = spark.createDataFrame(rows, f"{SCHEMA}, {', '.join(f'{c} int' for c in shoeboxes.BOX)}, pixels array<double>, background array<double>, mask binary")
    (got,) = shoeboxes.beam_divergence(spots, {0: EXPERIMENT}).collect()
    # two directions, and a pixel's own width of a tenth of a millimetre at 200
    pixel = math.degrees(0.1 / 200) / math.sqrt(12)
    assert got.n_spots == 60 and abs(got.sigma_d - math.sqrt(2 * (sigma_d**2 + pixel**2))) < 0.004
    samples = checkpoint(shoeboxes.range_samples(spots, {0: EXPERIMENT}))
    assert abs(shoeboxes.reflecting_range(samples, EXPERIMENT.width, weighted=True) - sigma_m) < 0.01
    assert shoeboxes.reflecting_range(samples.limit(0), EXPERIMENT.width) is None


def test_pixels_of_predictions(spark):
    rows = spark.createDataFrame([(1, 0, 5.9, 3.1), (2, 0, 6.0, 3.1), (3, 1, 5.9, 3.1), (4, 0, -0.5, 1.0), (5, 0, 9.0, 20.0), (6, 0, None, 1.0)], "row_id int, panel int, px double, py double")
    masked = spark.createDataFrame([(0, 5, 3), (0, 5, 3)], "panel int, x int, y int")
    got = {r.row_id: r.unobservable for r in shoeboxes.unobservable(rows, masked, F.col("px"), F.col("py"), F.lit(10), F.lit(20)).collect()}
    assert got == {1: True, 2: False, 3: False, 4: True, 5: True, 6: True}


def spot_boxes(spark, centres, strengths, noise=None, gap=(), background=4.0):
    """Gaussian spots of sum 1 within 2.5 sigmas in boxes of 9 x 9 about them, all on one image."""
    yy, xx = np.mgrid[:60, :60] + 0.5
    shapes = [np.where((d := (xx - cx) ** 2 + (yy - cy) ** 2) < 6.25, np.exp(-d / 2), 0) for cx, cy in centres]
    shapes = [s / s.sum() for s in shapes]
    image = background + sum(i * s for i, s in zip(strengths, shapes, strict=True))
    if noise is not None:
        image = noise.poisson(image).astype(float)
    rows = []
    for k, ((cx, cy), s) in enumerate(zip(centres, shapes, strict=True)):
        x0, y0 = int(cx) - 4, int(cy) - 4
        cut = lambda a, x0=x0, y0=y0: a[y0 : y0 + 9, x0 : x0 + 9].ravel()
        valid = np.array([(x, y) not in gap for y in range(y0, y0 + 9) for x in range(x0, x0 + 9)])
        mask = np.where(cut(s) > 0, 4, 2) | valid
        rows.append((k, 0, x0, x0 + 9, y0, y0 + 9, 0, 1, cut(image).tolist(), [background] * 81, cut(s).tolist(), mask.astype(np.uint8).tobytes()))
    return spark.createDataFrame(rows, f"row_id long, panel int, {', '.join(f'{c} int' for c in shoeboxes.BOX)}, pixels array<double>, background array<double>, profile array<double>, mask binary")


def test_touching_spots_are_solved_together(spark):
    centres = [(20.3, 20.1), (23.4, 20.6), (25.9, 22.0), (45.0, 45.0), (10.5, 50.5)]
    strengths = [500.0, 3000.0, 200.0, 700.0, 90.0]
    boxes = checkpoint(spot_boxes(spark, centres, strengths))
    got = {r.row_id: r for r in fits.fitted_intensities(boxes).collect()}
    assert [got[k].intensity for k in range(5)] == pytest.approx(strengths, rel=1e-6)
    assert got[0].component == got[1].component == got[2].component and got[3].component is got[4].component is None
    alone = {r.row_id: r for r in fits.fitted_alone(boxes).collect()}
    assert alone[2].intensity > 1.5 * 200 and alone[3].correlation == pytest.approx(1)
    # half of a spot in a gap: as strong as the whole, less of it measured
    cut = {(x, y) for x in range(45, 60) for y in range(60)}
    (part,) = [r for r in fits.fitted_alone(spot_boxes(spark, centres, strengths, gap=cut)).collect() if r.row_id == 3]
    assert part.intensity == pytest.approx(700) and 0.3 < part.measured < 0.7


def test_sigmas_of_fits_are_the_scatter(spark):
    rng = np.random.default_rng(12)
    centres, strengths = [(20.3, 20.1), (23.0, 20.6), (45.0, 45.0)], [800.0, 400.0, 300.0]
    tables, n = None, 40
    for t in range(n):
        own = spot_boxes(spark, centres, strengths, rng).withColumns({"panel": F.lit(t), "row_id": F.col("row_id") + 10 * t})
        tables = own if tables is None else tables.unionByName(own)
    got = fits.fitted_intensities(checkpoint(tables.coalesce(4))).collect()
    for k in range(3):
        z = [(r.intensity - strengths[k]) / math.sqrt(r.variance) for r in got if r.row_id % 10 == k]
        assert len(z) == n and abs(np.mean(z)) < 0.6 and 0.65 < np.std(z) < 1.4


def test_failures_are_named(spark):
    boxes = spot_boxes(spark, [(20.5, 20.5), (40.5, 40.5), (10.5, 40.5)], [100.0, 100.0, 100.0], gap={(x, y) for x in range(30, 60) for y in range(30, 60)})
    boxes = checkpoint(boxes.withColumn("profile", F.when(F.col("row_id") == 2, F.transform("profile", lambda p: p * 0)).otherwise(F.col("profile"))))
    got = {r.row_id: r for r in fits.fitted_alone(boxes).collect()}
    assert got[0].failure is None and got[1].failure == fits.MASKED and got[2].failure == fits.OFF_PROFILE and got[1].intensity is None
    twice = checkpoint(spot_boxes(spark, [(20.5, 20.5), (20.5, 20.5)], [100.0, 100.0]))  # one place, two spots: nothing tells them apart
    assert {r.failure for r in fits.fitted_intensities(twice).collect()} == {fits.SINGULAR}
