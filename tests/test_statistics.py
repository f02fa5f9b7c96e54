"""Statistics of merged data against plain loops on small tables."""

from __future__ import annotations

import math
import random
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from rotaframe.operators import merging, selection, statistics, windows


def observations(spark, n=400, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        h = rng.randrange(60)
        rows.append((i, h, h % 3, rng.random() < 0.5, h % 10 == 0, 50.0 + h + rng.gauss(0, 6), 36.0 * rng.uniform(0.5, 2), rng.uniform(0.8, 1.2)))
    return rows, spark.createDataFrame(rows, "row_id long, h long, shell int, plus boolean, centric boolean, i double, v double, g double")


def test_merging_table(spark):
    rows, df = observations(spark)
    got = {r.shell: r for r in statistics.merging_table(df, ["h"], "shell", "plus", "centric").collect()}
    for shell in (0, 1, 2, None):
        own = [r for r in rows if shell is None or r[2] == shell]
        groups: dict = {}
        for r in own:
            groups.setdefault(r[1], []).append(r)
        best, ratio, top, bottom, apart = 0.0, 0.0, 0.0, 0.0, [0.0, 0.0]
        sides = 0
        for members in groups.values():
            x, w = [r[5] / r[7] for r in members], [r[7] ** 2 / r[6] for r in members]
            mean = sum(a * b for a, b in zip(x, w, strict=True)) / sum(w)
            best, ratio = best + mean, ratio + mean * math.sqrt(sum(w))
            for part in ([True, False], [True], [False]):
                some = [r[5] / r[7] for r in members if (r[4] or r[3]) in part]
                if len(part) == 1:
                    sides += bool(some)
                if len(some) < 2:
                    continue
                off = math.sqrt(len(some) / (len(some) - 1)) * sum(abs(a - sum(some) / len(some)) for a in some)
                if len(part) == 2:
                    top, bottom = top + off, bottom + sum(some)
                else:
                    apart = [apart[0] + off, apart[1] + sum(some)]
        r = got[shell]
        assert (r.observations, r.unique) == (len(own), len(groups))
        assert r.anom_multiplicity == pytest.approx(len(own) / sides)
        assert (r.mean_i, r.i_over_sigma, r.r_meas, r.r_meas_anom) == pytest.approx((best / len(groups), ratio / len(groups), top / bottom, apart[0] / apart[1]))


def test_slopes_of_normal_values(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.gauss(0, 1 + g)) for g in range(2) for i in range(3000)] + [(2, i, 1.0 * i) for i in range(9)]
    got = {r.g: r.slope for r in statistics.normal_slope(spark.createDataFrame(rows, "g int, row_id int, z double"), "g", "z", ["row_id"]).collect()}
    assert abs(got[0] - 1) < 0.06 and abs(got[1] - 2) < 0.12 and got[2] == 0
    p = [0.08 + 0.01 * i for i in range(85)]
    values = spark.createDataFrame([(x,) for x in p], "p double").select("p", statistics.central_quantile(F.col("p")).alias("q")).collect()
    assert all(abs(r.q - NormalDist().inv_cdf(r.p)) < 1e-13 for r in values)


def test_the_control_of_friedel_pairs_deals_as_many(spark):
    _, df = observations(spark)
    real = statistics.friedel_pairs(df, ["h"], "shell", "plus", "centric").count()
    control = statistics.friedel_pairs(df, ["h"], "shell", "plus", "centric", F.xxhash64("row_id"))
    assert control.count() == real > 20
    assert statistics.anomalous_table(control, "shell").filter("shell IS NULL").first().anomalous_pairs == real


def test_calibration_of_honest_sigmas(spark):
    rng = random.Random(3)
    rows = [(i, i // 8, rng.gauss(100, 5), 25.0, 6.25, 1.0) for i in range(4000)]
    df = spark.createDataFrame(rows, "row_id long, h long, i double, v double, v0 double, g double")
    off = statistics.sigma_deviations(df, ["h"], "row_id")
    got = statistics.calibration(off, [F.asc("mean"), F.asc("row_id")], "mean", 5).collect()
    assert sum(r.n for r in got) == 4000 and len(got) == 5
    assert all(0.8 < r.final_ms < 1.2 and 3.2 < r.raw_ms < 4.8 and 0.7 < r.final_robust < 1.4 for r in got)
    assert statistics.calibration(off.limit(40), [F.asc("mean"), F.asc("row_id")], "mean", 5).count() == 0


def test_medians_and_ranks_by_numbering(spark):
    rng = random.Random(4)
    rows = [(rng.randrange(4), float(rng.randrange(30)), float(rng.randrange(9)), i) for i in range(501)]
    df = spark.createDataFrame(rows, "g int, x double, y double, row_id int")
    for upper in (False, True):
        want = {}
        for g in range(4):
            x = sorted(r[1] for r in rows if r[0] == g)
            want[g] = x[len(x) // 2] if upper else (x[(len(x) - 1) // 2] + x[len(x) // 2]) / 2
        assert {r.g: r.median for r in merging.group_medians(df, "g", "x", upper).collect()} == want
    ranked = {r.row_id: r.rank for r in windows.average_ranks(df, ["g"], "x", "rank").collect()}
    for g, x, _, i in rows:
        own = [r[1] for r in rows if r[0] == g]
        assert ranked[i] == sum(v < x for v in own) + (sum(v == x for v in own) + 1) / 2
    assert merging.group_medians(df.limit(0), "g", "x").count() == 0
    sums = merging.running_sums(df, [F.asc("row_id")], "y").collect()
    assert all(r.before == sum(q[2] for q in rows[: r.row_id]) for r in sums[::50])


def test_bins_and_their_tails(spark):
    for n, least, bins, want in ((23, 10, 50, [10, 13]), (25, 10, 50, [10, 10, 5]), (4, 10, 50, [4]), (100, 10, 5, [20] * 5), (0, 10, 50, [])):
        got = merging.equal_count_bins(spark.range(n), [F.asc("id")], least, bins).groupBy("bin").count().orderBy("bin").collect()
        assert [r["count"] for r in got] == want
    got = merging.edge_bins(spark.range(23), [F.asc("id")], 5).orderBy("id").collect()
    assert [r.bin for r in got] == [next(b for b in range(5) if 23 * b // 5 <= i < 23 * (b + 1) // 5) for i in range(23)]


def test_partials(spark):
    rows = [(1, 0, 7, 0.4, 10.0, 4.0, 9.0, 3.0), (2, 0, 7, 0.3, 6.0, 2.0, 5.0, 2.0), (3, 0, 8, 0.5, 1.0, 1.0, 1.0, 1.0), (4, 0, 9, 0.2, 0.0, 2.0, 1.0, 1.0), (5, 0, 9, 0.2, 0.0, 3.0, 1.0, 1.0), (6, 0, 7, 1.0, 50.0, 1.0, 50.0, 1.0), (7, None, 7, 0.4, 2.0, 1.0, 1.0, 1.0), (8, 0, 7, 0.1, 3.0, -1.0, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "row_id long, id long, partial_id long, partiality double, i_prf double, v_prf double, i_sum double, v_sum double")
    got = {r.row_id: r for r in merging.combine_partials(df, ["id", "partial_id"]).collect()}
    assert set(got) == {1, 3, 4, 6, 7, 8}
    a, b = 100 / 4, 36 / 2
    assert (got[1].i_prf, got[1].v_prf, got[1].i_sum, got[1].v_sum, got[1].partiality, got[1].pieces) == pytest.approx(((a * 10 + b * 6) / (a + b), (a * 4 + b * 2) / (a + b), 14, 5, 0.7, 2))
    assert (got[4].i_prf, got[4].v_prf, got[4].pieces) == (0, 5, 2)
    assert got[6].i_prf == 50 and got[3].pieces == 1


def test_means_far_from_zero(spark):
    rows = [(0, 1e9 + x, 1.0) for x in (-3, -1, 0, 1, 3)]
    (r,) = merging.merged_with_sigma(spark.createDataFrame(rows, "h int, x double, w double"), ["h"], "x", "w").collect()
    assert r["mean"] == 1e9 and r.sigma == pytest.approx(1.0)  # 20 / 4 / 5


def test_attenuated_observations_are_found(spark):
    rng = random.Random(5)
    rows, low = [], set()
    for h in range(60):
        for k in range(8):
            i = h * 8 + k
            bad = k == 0 and h % 2 == 0
            low |= {i} if bad else set()
            share = 0.3 if bad else 1.0
            rows.append((i, h, 1000.0 * share + rng.gauss(0, 30), 900.0, 10.0 * share, 10.0))
    rows += [(1000, 99, 5.0, 1.0, 10.0, None), (1001, 98, 500.0, 25.0, 1.0, 10.0)]
    got = {r.row_id: r for r in statistics.judge_attenuation(spark.createDataFrame(rows, "row_id long, h long, i double, v double, background double, expected double"), ["h"], "row_id").collect()}
    assert {i for i, r in got.items() if r.flagged} == low | {1001}
    assert not got[1000].judged and got[1000].probability == 0 and got[1001].ratio == pytest.approx(0.1)


def test_rings_and_counts(spark):
    rng = random.Random(6)
    s = [(rng.uniform(0.1, 0.5) ** (1 / 3) * 0.6,) for _ in range(4000)] + [(1 / 3.669 + rng.uniform(-0.0005, 0.0005),) for _ in range(400)]
    df = spark.createDataFrame(s, "s double")
    assert [r.d for r in statistics.ice_rings(df, "s").collect()] == [3.669]
    counts = statistics.resolution_counts(df, "s", 10).orderBy("bin").collect()
    assert [r.bin for r in counts] == list(range(10)) and sum(r.n for r in counts) == len(s) and counts[0].d_max is None
    assert statistics.resolution_counts(df.limit(0), "s", 10).count() == 0


def test_affine_part(spark):
    rng = random.Random(7)
    rows = []
    for i in range(300):
        x, y = rng.uniform(-900, 900), rng.uniform(-900, 900)
        rows.append((i, x + 0.2 + 1e-4 * x + 3e-4 * y, y - 0.1 - 1e-4 * x + 2e-4 * y, x, y))
    points = statistics.centroid_residuals(spark.createDataFrame(rows, "row_id int, x_obs double, y_obs double, x_cal double, y_cal double"), F.lit(0.0), F.lit(0.0))
    fit = statistics.affine_part(points)
    assert (fit["scale_x"], fit["scale_y"], fit["rotation"], fit["shear"], fit["shift_x"]) == pytest.approx((1e-4, 2e-4, 2e-4, 1e-4, 0.2), rel=1e-6)
    bins = statistics.residual_bins(points, "row_id", ["dx"], 8).collect()
    assert sum(r.n for r in bins) == points.count() and len(bins) == 8


def test_rows_and_experiments(spark):
    df = spark.createDataFrame([(i, i * i) for i in range(9)], "row_id long, x long")
    assert sorted(r.x for r in selection.at_positions(df, spark.createDataFrame([(2,), (5,), (5,)], "p long")).collect()) == [4, 25, 25]
    with pytest.raises(Exception, match="no row at position 77"):
        selection.at_positions(df, spark.createDataFrame([(77,)], "p long")).collect()
    a = spark.createDataFrame([(0, "b1", None), (1, "b2", "c1")], "id long, beam string, crystal string")
    b = spark.createDataFrame([(0, "b1", "c1")], "id long, beam string, crystal string")
    got = sorted((r.id, r.beam, r.beam_id, r.crystal_id) for r in selection.joined_experiments([a, b], ["beam", "crystal"]).collect())
    assert got == [(0, "b1", 0, None), (1, "b2", 1, 0), (2, "b1", 0, 0)]
    held = selection.held_out(df, df.filter("x > 60"), "row_id", 0.5).collect()
    assert len(held) == 8 and 0 < sum(r.held_out for r in held) < 8


def test_jacobian_is_that_of_small_steps(spark):
    from rotaframe.functions import geometry

    v = geometry.vec
    origin, fast, slow = v(-90, 60, -200), v(1, 0, 0), v(0, -1, 0)
    normal = geometry.cross(fast, slow)
    x, y, step = F.col("x"), F.col("y"), 1e-4

    def place(dx, dy):
        ray = geometry.unit(geometry.lab_position(x + dx, y + dy, origin, fast, slow))
        return geometry.mm_to_px(x + dx, y + dy, F.lit(0.075), ray, fast, slow, normal, F.lit(1.9), F.lit(0.45))

    j = geometry.mm_to_px_jacobian(x, y, F.lit(0.075), origin, fast, slow, F.lit(1.9), F.lit(0.45))
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = place(step, 0.0), place(-step, 0.0), place(0.0, step), place(0.0, -step)
    half = 2 * step
    for r in spark.createDataFrame([(3.0, 7.0), (150.0, 20.0), (88.0, 110.0)], "x double, y double").select(F.struct(*(v.alias(k) for k, v in j.items())).alias("j"), F.struct(((ax - bx) / half).alias("xx"), ((cx - dx) / half).alias("xy"), ((ay - by) / half).alias("yx"), ((cy - dy) / half).alias("yy")).alias("n")).collect():
        assert tuple(r.j) == pytest.approx(tuple(r.n), abs=1e-6)


def test_goniometer_and_panels(spark):
    import numpy as np

    from rotaframe.functions import geometry
    from rotaframe.operators import joins

    fixed, axis, setting = geometry.goniometer([[1, 0, 0], [0, 0, 1], [0, 1, 0]], [90, 12, 90], 1)
    assert np.allclose(fixed @ [0, 1, 0], [0, 0, 1]) and axis.tolist() == [0, 0, 1] and np.allclose(setting @ [0, 0, 1], [1, 0, 0])
    (r,) = spark.range(1).select(geometry.matrix_times(fixed, geometry.vec(0, 1, 0)).alias("v")).collect()
    assert tuple(r.v) == pytest.approx((0, 0, 1))
    at = "struct<x: double, y: double, z: double>"
    panels = spark.createDataFrame([(0, 1, (-5.0, -5.0, 10.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), 10.0, 10.0), (0, 0, (-5.0, -5.0, 20.0), (1.0, 0.0, 0.0), (0.0, 1.0, 0.0), 8.0, 10.0)], f"detector int, panel int, origin {at}, fast {at}, slow {at}, width double, height double")
    rays = spark.createDataFrame([(1, 0, (0.0, 0.0, 1.0)), (2, 0, (0.2, 0.0, 1.0)), (3, 0, (0.0, 0.0, -1.0)), (4, 0, (9.0, 0.0, 1.0))], f"ray int, detector int, s1 {at}")
    got = {r.ray: (r.panel, r.x_mm, r.y_mm) for r in joins.first_panel(rays, panels, "detector").collect()}
    assert {k: v[0] for k, v in got.items()} == {1: 0, 2: 1}
    assert got[1][1:] == pytest.approx((5.0, 5.0)) and got[2][1:] == pytest.approx((7.0, 5.0))
