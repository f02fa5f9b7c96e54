"""Wilson normalisation, the grid search for known cells and shells of CC half, against planted answers and plain loops."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rotaframe.functions.stats import student_t_cdf
from rotaframe.operators import lattice, merging, wilson

SCHEMA = "row_id long, x double, y double, z double, d double, i double, sigma double"


def intensities(spark, n, log_scale, b, seed=1, spikes=0):
    rng = np.random.default_rng(seed)
    v = rng.uniform(-0.45, 0.45, (n, 3))
    v = v[np.linalg.norm(v, axis=1) > 0.1]
    t = np.stack([v[:, 0] ** 2 / 2, v[:, 1] ** 2 / 2, v[:, 2] ** 2 / 2, v[:, 0] * v[:, 1], v[:, 0] * v[:, 2], v[:, 1] * v[:, 2]], axis=1)
    e2 = rng.exponential(1, len(v))
    e2[:spikes] = 60
    i = np.exp(log_scale - t @ np.array(b)) * e2
    rows = [(k, *map(float, p), float(1 / np.linalg.norm(p)), float(x), 1.0) for k, (p, x) in enumerate(zip(v, i, strict=True))]
    return rows, spark.createDataFrame(rows, SCHEMA)


def test_the_planted_tensor_is_found(spark):
    b = (20.0, 28.0, 35.0, 4.0, -3.0, 2.0)
    rows, df = intensities(spark, 6000, 6.5, b, spikes=3)
    fit = wilson.fit_wilson(df)
    used = sum(0.008 < r[4] ** -2 < 0.690 for r in rows)
    assert fit.fitted and fit.used == used and abs(fit.log_scale - 6.5) < 0.15
    assert np.abs(np.array(fit.b) - b).max() < 2.0
    out = wilson.normalised(df, "row_id", fit).collect()
    assert not {0, 1, 2} & {r.row_id for r in out} and len(out) > len(rows) - 15
    # level in all directions and at all resolutions
    for axis in "xyz":
        ends = [np.mean([r.i for r in out if (abs(r[axis]) > 0.3) == far]) for far in (True, False)]
        assert ends[0] == pytest.approx(ends[1], abs=0.15) and ends[0] == pytest.approx(1, abs=0.15)


def test_too_few_reflections_are_normalised_by_shells(spark):
    rows, df = intensities(spark, 60, 3.0, (5.0, 5.0, 5.0, 0.0, 0.0, 0.0))
    assert not wilson.fit_wilson(df).fitted and not wilson.fit_wilson(df.limit(0)).fitted
    out = wilson.normalised(df, "row_id", shell=20).collect()
    order = sorted(rows, key=lambda r: (-r[4], r[0]))
    size = len(rows)
    last = max(size // 20 - (size % 20 < 10), 0)
    want = {}
    for run in range(last + 1):
        own = [r for k, r in enumerate(order) if min(k // 20, last) == run]
        mean = sum(r[5] for r in own) / len(own)
        want |= {r[0]: r[5] / mean for r in own}
    assert {r.row_id: r.i for r in out} == pytest.approx({k: v for k, v in want.items() if v < 16})
    assert wilson.normalised(df.limit(0), "row_id").count() == 0


def test_the_planted_cell_is_among_the_grid_s_vectors(spark):
    rng = np.random.default_rng(4)
    basis = np.array([[40.0, 3, 0], [0, 55, 2], [4, 0, 70]])
    hkl = rng.integers(-5, 6, (300, 3))
    points = (hkl @ np.linalg.inv(basis).T).tolist()
    df = spark.createDataFrame([*map(tuple, points), (None, 0.0, 0.0)], "x double, y double, z double").repartition(5)
    lengths = np.linalg.norm(basis, axis=1).tolist()
    found = lattice.grid_vectors(df, [*lengths, lengths[0] * 1.001], step=1.0, keep=30)
    assert 0 < len(found) <= 30 and [s for _, s in found] == sorted((s for _, s in found), reverse=True)
    for axis, length in zip(basis, lengths, strict=True):
        u = axis / length
        near = [v for v, _ in found if abs(np.linalg.norm(v) - length) < 1e-6 and abs(v @ u) / length > np.cos(np.radians(1.5))]
        assert near
    # the score is that of a plain sum
    v, score = found[0]
    assert score == pytest.approx(sum(np.cos(2 * np.pi * (np.array(p) @ v)) for p in points))
    assert all(abs(a @ b) / np.linalg.norm(a) / np.linalg.norm(b) <= np.cos(np.radians(5.0)) for k, (a, _) in enumerate(found) for b, _ in found[:k])
    assert len(lattice.hemisphere(2.0)) == pytest.approx(2 * np.pi / np.radians(2.0) ** 2, abs=1)


def test_shells_of_cc_half(spark):
    rng = random.Random(6)
    rows, truth = [], {}
    for h in range(233):
        truth[h] = rng.uniform(50, 150)
        d = 1 + (h * 37 % 233) / 100
        rows += [(h, k, d, truth[h] + rng.gauss(0, 60 / d)) for k in range(rng.choice((1, 4, 5)))]
    df = spark.createDataFrame(rows, "h long, k int, d double, i double")
    got = merging.cc_half_by_resolution(df, ["h"], "i", "d", F.col("k"), bins=5).orderBy("bin").collect()
    groups = {}
    for h, k, d, i in rows:
        groups.setdefault((d, h), []).append(i)
    own = sorted(((d, h, np.mean(x[::2]), np.mean(x[1::2])) for (d, h), x in groups.items() if len(x) > 1), key=lambda g: (-g[0], g[1]))
    size = max(10, len(own) // 5)
    last = max(len(own) // size - (len(own) % size < size // 2), 0)
    assert sum(r.groups for r in got) == len(own) and len(got) == last + 1
    for r in got:
        part = [g for k, g in enumerate(own) if min(k // size, last) == r.bin]
        assert r.d_min == min(g[0] for g in part)
        assert r.cc_half == pytest.approx(np.corrcoef([g[2] for g in part], [g[3] for g in part])[0, 1])
        t = r.critical * ((len(part) - 2) / (1 - r.critical**2)) ** 0.5
        assert student_t_cdf(t, len(part) - 2) == pytest.approx(0.9, abs=1e-6)
