"""Operators in Spark: planted answers and brute force on small tables."""

from __future__ import annotations

import collections
import datetime
import math
import os
import random
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotaframe.functions import geometry, stats
from rotaframe.operators import images, integration, joins, lattice, merging, selection, symmetry, windows
from rotaframe.plans import queries, scaling
from rotaframe.sources import tables
from rotaframe.streaming.components import stream_spots


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_geometry(spark):
    v = lambda *x: geometry.vec(*x)
    r = one(
        spark,
        geometry.rotated(v(1, 0, 0), v(0, 0, 1), F.lit(math.pi / 2)).alias("turned"),
        geometry.erf(F.lit(0.7)).alias("e1"), geometry.erf(F.lit(-2.3)).alias("e2"), geometry.erf(F.lit(40.0)).alias("e3"),
        geometry.z_to_phi(F.lit(10.0), F.lit(1), F.lit(5.0), F.lit(0.1)).alias("phi"),
        geometry.phi_to_z(F.lit(6.0), F.lit(1), F.lit(5.0), F.lit(0.1)).alias("z"),
        geometry.d_spacing(*(F.lit(x) for x in (1.0, 1.0, 0.0, 10.0, 10.0, 20.0, 90.0, 90.0, 120.0))).alias("d"),
        geometry.cell_volume(*(F.lit(x) for x in (10.0, 10.0, 20.0, 90.0, 90.0, 120.0))).alias("volume"),
        geometry.quantum_efficiency(F.lit(2.0), F.lit(0.3), F.lit(0.9)).alias("qe"),
        geometry.partiality(F.lit(0.0), F.lit(-9.0), F.lit(9.0), F.lit(0.1), F.lit(0.5)).alias("full"),
        geometry.partiality(F.lit(0.0), F.lit(0.0), F.lit(9.0), F.lit(0.1), F.lit(0.5)).alias("half"),
        stats.with_esd(F.lit(10.4321), F.lit(0.023)).alias("esd"), stats.with_esd(F.lit(10.4321), F.lit(0.0141)).alias("esd1"),
        geometry.zeta(v(0, 0, -1), v(0, 1, 0), v(1, 0, 0)).alias("zeta"),
    )
    assert abs(r.turned.x) < 1e-12 and abs(r.turned.y - 1) < 1e-12
    assert abs(r.e1 - math.erf(0.7)) < 1e-11 and abs(r.e2 - math.erf(-2.3)) < 1e-11 and abs(r.e3 - 1) < 1e-9
    assert r.phi == 6.0 and r.z == 10.0
    assert abs(r.d - 5.0) < 1e-9 and abs(r.volume - 2000 * math.sqrt(3) / 2) < 1e-9
    assert abs(r.qe - (1 - math.exp(-2 * 0.3 / 0.9))) < 1e-12 and abs(r.full - 1) < 1e-9 and abs(r.half - 0.5) < 1e-9
    assert r.esd == "10.43(2)" and r.esd1 == "10.432(14)" and abs(abs(r.zeta) - 1) < 1e-12


def test_reciprocal_points_turn_back(spark):
    beam, axis = geometry.vec(0, 0, -1.25), geometry.vec(1, 0, 0)
    lab = geometry.lab_position(F.lit(30.0), F.lit(-20.0), geometry.vec(-50, 40, -180), geometry.vec(1, 0, 0), geometry.vec(0, -1, 0))
    r = one(spark, geometry.reciprocal_point(lab, beam, axis, F.lit(0.4)).alias("p"), lab.alias("lab"))
    s1 = np.array([r.lab.x, r.lab.y, r.lab.z])
    s1 = s1 / np.linalg.norm(s1) * 1.25
    a = 0.4
    p = np.array([r.p.x, r.p.y, r.p.z])
    back = np.array([[1, 0, 0], [0, math.cos(a), -math.sin(a)], [0, math.sin(a), math.cos(a)]]) @ p
    assert np.abs(back - (s1 - [0, 0, -1.25])).max() < 1e-12


def test_unique_indices(spark):
    rng = random.Random(1)
    rows = [(rng.randrange(-9, 10), rng.randrange(-9, 10), rng.randrange(-9, 10)) for _ in range(300)]
    df = spark.createDataFrame(rows, "h int, k int, l int")
    for name in ("222", "422", "32", "23", "432"):
        group = symmetry.SpaceGroup.of(name)
        got = df.select("h", "k", "l", symmetry.unique_index(group).alias("u"), symmetry.is_centric(group).alias("c")).collect()
        for r in got:
            h = np.array([r.h, r.k, r.l])
            turned = [tuple(h @ np.array(m)) for m in group.rotations]
            best = max(max(t, tuple(-x for x in t)) for t in turned)
            assert (r.u.h, r.u.k, r.u.l) == best and r.u.plus == (best in turned) and r.c == (tuple(-h) in turned)


def test_absences(spark):
    df = spark.createDataFrame([(h, k, l) for h in range(5) for k in range(5) for l in range(5)], "h int, k int, l int")
    body = symmetry.SpaceGroup.of("222", "I")
    assert all(r.a == bool((r.h + r.k + r.l) % 2) for r in df.withColumn("a", symmetry.is_absent(body)).collect())
    screw = symmetry.SpaceGroup.of("2", "P", {symmetry.TWO_Y: (0, "1/2", 0)})
    assert all(r.a == (r.h == r.l == 0 and r.k % 2 == 1) for r in df.withColumn("a", symmetry.is_absent(screw)).collect())
    scores = {r.group: r for r in symmetry.absence_scores(df.withColumns({"i": F.lit(4.0), "v": F.lit(4.0)}), {"I": body, "P": symmetry.SpaceGroup.of("222")}).collect()}
    assert scores["I"].forbidden == 62 and scores["I"].i_over_sigma == 2 and scores["P"].forbidden == 0
    possible = symmetry.possible_reflections(spark, symmetry.SpaceGroup.of("222"), (10.0, 12.0, 15.0, 90.0, 90.0, 90.0), 2.9)
    want = {(h, k, l) for h in range(6) for k in range(7) for l in range(8) if (h or k or l) and 1 / math.sqrt((h / 10) ** 2 + (k / 12) ** 2 + (l / 15) ** 2) > 2.9}
    assert {(r.h, r.k, r.l) for r in possible.collect()} == want


def test_nearest_and_greedy(spark):
    rng = random.Random(2)
    a = [(i, rng.randrange(4), rng.randrange(1000)) for i in range(80)]
    b = [(i, rng.randrange(4), rng.randrange(1000)) for i in range(60)]
    left, right = spark.createDataFrame(a, "id long, k long, t long"), spark.createDataFrame(b, "id long, k long, t long")
    got = {r.id: (r.id_r, r.distance) for r in joins.nearest_by_key(left, right, ["k"], "t", "id", "id").collect()}
    for i, k, t in a:
        best = min(((abs(t - u), j) for j, m, u in b if m == k), default=None)
        assert got.get(i) == (best and (best[1], best[0]))
    pairs = joins.greedy_pairs(left, right, ["k"], "t", "id", 5).collect()
    assert pairs and len({p.left_id for p in pairs}) == len(pairs) == len({p.right_id for p in pairs})
    times = {("a", i): t for i, _, t in a} | {("b", i): t for i, _, t in b}
    assert all(abs(times["a", p.left_id] - times["b", p.right_id]) <= 5 for p in pairs)


def test_lookup_and_unions(spark):
    rows = spark.createDataFrame([(0, 1.0), (1, 2.0)], "id int, x double")
    assert joins.lookup(rows, spark.createDataFrame([(0, "a"), (1, "b")], "id int, m string")).count() == 2
    with pytest.raises(Exception, match="no model for id 1"):
        joins.lookup(rows, spark.createDataFrame([(0, "a")], "id int, m string")).collect()
    with pytest.raises(ValueError, match="differs in x"):
        joins.checked_union(rows, rows.withColumn("x", F.lit("s")))
    out, dropped = joins.combine_runs([rows.withColumn("only", F.lit(1)), rows], "id")
    assert sorted(r.id for r in out.collect()) == [0, 1, 2, 3] and dropped == ["only"]


def test_outliers_one_by_one(spark):
    rng = np.random.default_rng(3)
    rows = []
    for g in range(20):
        x = rng.normal(100, 1, 8)
        if g % 4 == 0:
            x[:2] = [400, 900]  # the larger hides the smaller
        rows += [(g * 10 + i, g, float(v), 1.0) for i, v in enumerate(x)]
    got = windows.reject_outliers(spark.createDataFrame(rows, "row_id long, g long, x double, v double"), ["g"], "row_id", "x", "v")
    assert sorted(r.row_id for r in got.collect()) == sorted(g * 10 + i for g in range(0, 20, 4) for i in (0, 1))


def test_scaling_finds_what_was_planted(spark):
    rng = np.random.default_rng(4)
    n, groups = 6000, 400
    g, z, d = rng.integers(0, groups, n), rng.uniform(0, 100, n), rng.uniform(1.5, 6, n)
    true = (1 + 0.4 * np.sin(z / 30)) * np.exp((-1.2 * z / 100) / (2 * d * d))
    i_true = rng.exponential(500, groups)[g] + 50
    sigma = 0.01 * i_true + 3
    i = true * i_true + rng.normal(0, sigma)
    i[:12] *= 6
    rows = spark.createDataFrame([(k, int(a), float(b), float(c), float(e), float(f)) for k, (a, b, c, e, f) in enumerate(zip(g, i, sigma**2, z, d, strict=True))], "row_id long, h long, i double, v double, z double, d double")
    kept, figures = scaling.scale(rows, ["h"], "row_id", scaling.Model(0, 100, 8, 3), buckets=8)
    got = {r.row_id: r.scale for r in kept.select("row_id", "scale").collect()}
    ratio = np.array([got[k] / true[k] for k in got])
    assert ratio.std() / ratio.mean() < 0.02
    assert figures["outliers_0"] >= 10 and not set(range(12)) & set(got) or len(set(range(12)) & set(got)) <= 1
    assert 0.7 < figures["a"] < 1.4 and figures["b"] < 0.05


def test_spots_of_a_sweep(spark):
    rng = np.random.default_rng(5)
    frames = []
    planted = [(12, 20), (30, 41)]
    for f in range(1, 8):
        image = rng.poisson(4, (50, 60))
        for y, x in planted:
            if 3 <= f <= 5:
                image[y : y + 3, x : x + 3] += 120
        frames.append((0, f, 50, 60, image.ravel().tolist()))
    df = spark.createDataFrame(frames, "sweep long, frame int, height int, width int, pixels array<int>")
    pixels = images.signal_pixels(df)
    spots = images.measure_spots(images.pixel_components(pixels), least=10).collect()
    assert sorted((round(s.c_y, 0), round(s.c_x, 0)) for s in spots) == [(14.0, 22.0), (32.0, 42.0)] or len(spots) == 2
    assert all(s.z0 == 2 and s.z1 == 5 and abs(s.c_z - 3.5) < 0.1 for s in spots)
    hot = selection.frequent_keys(pixels.withColumn("one", F.lit(1)), ["y", "x"], "frame", 0.4)
    assert hot.count() >= 10


def test_spots_of_pages_leave_no_component_out(spark, tmp_path):
    rng = random.Random(8)
    start = datetime.datetime(2024, 1, 1)
    rows = [(start + datetime.timedelta(minutes=rng.randrange(2 * 1440)), rng.randrange(90)) for _ in range(2500)]
    rows += [(start, None), (start, None), (None, 7), (None, None)]
    spark.createDataFrame(rows, "ts timestamp_ntz, user_id long").write.parquet(str(tmp_path / "events.parquet"))
    marks = collections.Counter()
    for ts, user in rows:
        minute = None if ts is None else (ts - start) // datetime.timedelta(minutes=1)
        day = None if ts is None else (ts - datetime.datetime(1970, 1, 1)).days
        marks[(day, *((None, None) if ts is None else (minute % 1440 // 60, minute % 60 // 6)), None if user is None else user % 40)] += 1
    left, expected = dict(marks), collections.Counter()
    while left:
        part, edge = {}, [next(iter(left))]
        while edge:
            at = edge.pop()
            if at not in left:
                continue
            part[at] = left.pop(at)
            if None not in at:
                edge += [(*at[:k], at[k] + step, *at[k + 1 :]) for k in (1, 2, 3) for step in (-1, 1)]
        bounds = [None if None in own else bound(own) + more for k, shift in ((2, 0), (3, 0), (1, -1)) for own in [[p[k] for p in part]] for bound, more in ((min, shift), (max, shift + 1))]
        expected[(next(iter(part))[0], len(part), sum(part.values()), *bounds)] += 1
    got = collections.Counter(tuple(r) for r in queries.spots_of_pages(spark, str(tmp_path)).collect())
    assert got == expected
    assert sum(n for r, n in got.items() if r[1] == 1) > 100 and sum(r[2] * n for r, n in got.items()) == len(rows)


@pytest.mark.parametrize("ending", ["a gap", "a row without a value"])
def test_streamed_spots_are_those_of_the_batch(spark, tmp_path, ending):
    rng = random.Random(6)
    rows = [(0, f, y, x, rng.randrange(1, 9)) for f in range(1, 7) for y in range(6) for x in range(6) if rng.random() < 0.25 and f != 4]
    schema = "sweep long, frame int, y int, x int, value long"
    parts = [[r for r in rows if r[1] == f] for f in range(1, 7)]
    parts.append([(0, 99, 50, 50, 1)] if ending == "a gap" else [(0, None, None, None, None)])
    at = 1_700_000_000
    for i, own in enumerate(p for p in parts if p):
        spark.createDataFrame(own, schema).coalesce(1).write.parquet(str(tmp_path / f"part-{i}"))
        (file,) = (tmp_path / f"part-{i}").glob("*.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        os.utime(shutil.move(file, tmp_path / "in" / f"{i}.parquet"), (at + 10 * i, at + 10 * i))  # files are taken in order of their time
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    name = f"spots_{len(ending)}"
    q = stream_spots(stream).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(120)
    finally:
        q.stop()
    got = sorted((r.n_signal, r.total, r.x0, r.x1, r.y0, r.y1, r.z0, r.z1) for r in spark.table(name).collect())
    batch = images.pixel_components(spark.createDataFrame(rows, schema)).groupBy("component").agg(F.count("*").alias("n"), F.sum("value").alias("t"), *(a.alias(n) for n, a in (("x0", F.min("x")), ("x1", F.max("x") + 1), ("y0", F.min("y")), ("y1", F.max("y") + 1), ("z0", F.min("frame") - 1), ("z1", F.max("frame")))))
    assert got == sorted(tuple(r)[1:] for r in batch.collect())


def test_integration(spark):
    rng = np.random.default_rng(7)
    y, x = np.mgrid[-5:6, -5:6]
    profile = np.exp(-(x * x + y * y) / 3).ravel()
    profile /= profile.sum()
    fg = (x * x + y * y <= 16).ravel().tolist()
    rows = [(b, b % 2, rng.poisson(3 + 600 * profile).astype(float).tolist(), fg, [True] * 121) for b in range(120)]
    boxes = spark.createDataFrame(rows, "box long, region long, pixels array<double>, foreground array<boolean>, valid array<boolean>")
    profiles = {r.region: list(r.profile) for r in integration.reference_profiles(boxes).collect()}
    assert len(profiles) == 2 and np.abs(np.array(profiles[0]) - profile).max() < 0.01
    got = integration.integrated(boxes, profiles).collect()
    assert abs(np.mean([r.i_prf for r in got]) - 600) < 15 and abs(np.mean([r.i_sum for r in got]) - 600) < 15 and np.std([r.i_prf for r in got]) <= 1.1 * np.std([r.i_sum for r in got])


def test_prediction_and_indexing(spark):
    basis = np.diag([40.0, 50.0, 60.0])
    matrix = np.linalg.inv(basis)
    grid = spark.range(-8, 9).select(F.col("id").alias("h")).withColumn("k", F.explode(F.sequence(F.lit(-8), F.lit(8)))).withColumn("l", F.explode(F.sequence(F.lit(-8), F.lit(8))))
    p = lattice.predicted(grid.filter("NOT (h = 0 AND k = 0 AND l = 0)"), matrix, np.array([1.0, 0, 0]), np.array([0, 0, -1.0]), 0.0, math.pi)
    rows = p.collect()
    assert rows and all(abs(math.sqrt(r.s1x**2 + r.s1y**2 + r.s1z**2) - 1) < 1e-9 and 0 <= r.phi < math.pi for r in rows)
    points = spark.createDataFrame([(*map(float, np.array([r.h, r.k, r.l]) @ matrix.T + 1e-4), r.h, r.k, r.l) for r in rows[:200]], "x double, y double, z double, h0 int, k0 int, l0 int")
    got = lattice.indexed(points, basis).collect()
    assert all((r.h, r.k, r.l) == (r.h0, r.k0, r.l0) for r in got)
    counted = lattice.grid_nodes(points, 1 / 256, 128).agg(F.sum("n")).first()[0]
    assert counted == 200
    distances = spark.createDataFrame([(1 / 60.0,)] * 50 + [(1 / 45.0,)] * 30, "distance double")
    assert 60 < lattice.max_cell(distances) < 95


def test_files(spark, tmp_path):
    columns = {"id": ("int", np.arange(5, dtype=np.int32)), "xyz": ("vec3<double>", np.arange(15.0).reshape(5, 3)), "flags": ("std::size_t", np.full(5, 32, dtype=np.uint64)), "entering": ("bool", np.array([1, 0, 1, 0, 1], dtype=np.uint8))}
    for name in ("a", "b"):
        (tmp_path / f"{name}.refl").write_bytes(tables.encode_table(columns))
    got = tables.read_tables(spark, str(tmp_path), {n: k for n, (k, _) in columns.items()})
    assert got.count() == 10 and got.filter("entering AND flags = 32 AND xyz[1] = id * 3 + 1").count() == 6
    document = tables.experiment_document([("e0", {"beam": {"wavelength": 1.0}, "crystal": None})])
    import json

    (tmp_path / "x").mkdir()
    (tmp_path / "x" / "list.expt").write_text(json.dumps(document))
    (r,) = tables.experiment_rows(spark, str(tmp_path / "x")).collect()
    assert r.identifier == "e0" and json.loads(r.beam) == {"wavelength": 1.0} and r.crystal is None


def test_flags_and_samples(spark):
    df = spark.createDataFrame([(1, 32 | 4), (1, 4), (2, 0)], "id int, flags long")
    assert df.filter(selection.has_flag("strong")).count() == 1
    assert [r.flags for r in df.withColumn("flags", selection.set_flag("indexed", F.col("id") == 2)).orderBy("id", "flags").collect()] == [0, 32, 4]
    rows = spark.createDataFrame([(g, i) for g in range(300) for i in range(g % 4)], "g long, row_id long")
    got = selection.sample_groups(rows, ["g"], "row_id", 40, 60)
    sizes = {r.g: r["count"] for r in got.groupBy("g").count().collect()}
    assert len(sizes) == 40 and all(n == g % 4 and n > 1 for g, n in sizes.items())
    pieces = [(g, 100.0 + i, 100.0 + 9 * i, 4.0, 4.0) for g in range(20) for i in range(4)]
    chosen = merging.combination_choice(spark.createDataFrame(pieces, "g long, i_prf double, i_sum double, v_prf double, v_sum double"), ["g"])
    assert [(r.mid, r.chosen) for r in chosen.orderBy("mid").collect()] == [(0.0, True), (10.0, False), (100.0, False), (float("inf"), False)]  # profiles agree best
