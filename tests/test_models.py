"""Refinement and twinning: planted answers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rotaframe.operators.refinement import cell_of, refine_cell, refine_matrix, spline
from rotaframe.operators.twinning import l_test, law_tests, verdict


def test_spline():
    points = np.array([[0.0], [1], [4], [9], [16]])
    t = np.linspace(0, 1, 50)
    y = spline(points, t)
    assert y[0, 0] == 0 and abs(y[-1, 0] - 16) < 1e-12 and (np.diff(y[:, 0]) > 0).all()
    # a straight line stays one
    line = spline(np.array([[0.0, 1], [1, 3], [2, 5], [3, 7]]), t)
    assert np.abs(line[:, 1] - (2 * line[:, 0] + 1)).max() < 1e-12
    assert spline(np.ones((4, 3, 3)), t).shape == (50, 3, 3)


def test_matrix_with_outliers(spark):
    rng = np.random.default_rng(1)
    true = np.linalg.inv(np.array([[40.0, 1, 0], [0, 55, 2], [3, 0, 70]]))
    h = rng.integers(-9, 10, (500, 3))
    p = h @ true.T + rng.normal(0, 1e-5, (500, 3))
    p[:25] += 0.01
    rows = [(*map(float, a), *map(int, b)) for a, b in zip(p, h, strict=True)]
    matrix, n = refine_matrix(spark.createDataFrame(rows, "x double, y double, z double, h int, k int, l int"))
    assert np.abs(matrix - true).max() < 1e-6 and n <= 475


def test_cells(spark):
    rng = np.random.default_rng(2)
    for system, cell in (("hexagonal", (60.0, 60.0, 90.0, 90.0, 90.0, 120.0)), ("monoclinic", (40.0, 50.0, 60.0, 90.0, 100.0, 90.0)), ("cubic", (78.0,) * 3 + (90.0,) * 3)):
        ca = np.cos(np.radians(cell[3:]))
        a, b, c = cell[:3]
        g = np.linalg.inv(np.array([[a * a, a * b * ca[2], a * c * ca[1]], [a * b * ca[2], b * b, b * c * ca[0]], [a * c * ca[1], b * c * ca[0], c * c]]))
        assert np.abs(cell_of(np.array([g[0, 0], g[1, 1], g[2, 2], 2 * g[1, 2], 2 * g[0, 2], 2 * g[0, 1]])) - cell).max() < 1e-9
        h = rng.integers(-12, 13, (400, 3))
        h = h[(h != 0).any(axis=1)]
        s = np.sqrt(np.einsum("ij,jk,ik->i", h, g, h))
        angle = np.degrees(2 * np.arcsin(s * 0.95 / 2)) + rng.normal(0, 1e-3, len(h))
        got, esd = refine_cell(spark.createDataFrame([(*map(int, x), float(t)) for x, t in zip(h, angle, strict=True)], "h int, k int, l int, two_theta double"), system, 0.95)
        assert np.abs(got - cell).max() < 0.02 and 0 < esd[0] < 0.02


def test_twinning(spark):
    rng = np.random.default_rng(3)
    index = [(h, k, l) for h in range(-9, 10) for k in range(-9, 10) for l in range(1, 9)]
    i = dict(zip(index, rng.exponential(100, len(index)), strict=True))
    for fraction, want in ((0.0, "untwinned"), (0.5, "twinned")):
        rows = [(h, k, l, float((1 - fraction) * i[h, k, l] + fraction * i[k, h, l])) for h, k, l in index]
        df = spark.createDataFrame(rows, "h int, k int, l int, i double")
        r, t = l_test(df).first(), law_tests(df, [F.col("k"), F.col("h"), F.col("l")]).first()
        moment = df.agg(F.avg(F.col("i") * F.col("i")) / F.pow(F.avg("i"), 2)).first()[0]
        assert abs(r.mean_l - (0.375 if fraction else 0.5)) < 0.03 and abs(r.mean_l2 - (0.2 if fraction else 1 / 3)) < 0.03
        assert verdict(r.mean_l, moment) == want
        assert abs(t.fraction - fraction) < 0.03
