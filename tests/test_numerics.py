"""Numerics on the driver and in batches: planted answers, brute force and analytic values."""

from __future__ import annotations

import math

import numpy as np

from rotaframe.functions.stats import harmonics, normal_quantile, student_t_cdf, student_t_quantile
from rotaframe.operators.clustering import correlation_matrix, cosym_coordinates, elbow, optics, silhouette, ward_linkage
from rotaframe.operators.images import box_sums, signal, untrusted_pixels
from rotaframe.operators.integration import fitted, glm_background, summed
from rotaframe.operators.lattice import choose_basis, crossing_angles, fft_vectors, reduced, same_lattice
from rotaframe.operators.resolution import critical_cc, estimate_resolution
from rotaframe.operators.symmetry import GROUPS, SpaceGroup, closure, lattice_symmetry
from rotaframe.plans.scaling import Model, normal_equations
from rotaframe.sources.tables import decode_table, encode_table, experiment_document, pack, unpack
from rotaframe.streaming.components import Open


def test_quantiles():
    assert abs(normal_quantile(0.975) - 1.959964) < 1e-6
    assert abs(student_t_cdf(2.0, 5) - 0.9490303) < 1e-6
    assert abs(student_t_quantile(0.975, 10) - 2.2281389) < 1e-6
    assert 0 < critical_cc(1000) < critical_cc(20) < 1


def test_harmonics_are_orthonormal():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(200_000, 3))
    v /= np.linalg.norm(v, axis=1)[:, None]
    y = harmonics(3, *v.T)
    gram = 4 * math.pi * (y @ y.T) / len(v)
    assert y.shape[0] == 15 and np.abs(gram - np.eye(15)).max() < 0.03


def test_group_orders():
    want = {"1": 1, "2": 2, "222": 4, "4": 4, "422": 8, "3": 3, "32": 6, "6": 6, "622": 12, "23": 12, "432": 24}
    assert {n: len(closure(g)) for n, g in GROUPS.items()} == want
    assert len(SpaceGroup.of("222", "I").rotations) == 8


def test_lattice_symmetry():
    assert len(lattice_symmetry(np.diag([100.0, 100.0, 100.0]))) == 24
    assert len(lattice_symmetry(np.diag([100.0, 100.0, 225.0]))) == 8
    assert len(lattice_symmetry(np.diag([100.0, 144.0, 225.0]))) == 4
    assert len(lattice_symmetry(np.array([[100.0, 7, 13], [7, 144, 21], [13, 21, 225]]))) == 1


def test_box_sums():
    x = np.random.default_rng(1).integers(0, 9, (12, 15))
    got = box_sums(x, 2)
    for y in range(12):
        for z in range(15):
            assert got[y, z] == x[max(0, y - 2) : y + 3, max(0, z - 2) : z + 3].sum()


def test_spots_stand_out():
    rng = np.random.default_rng(2)
    image = rng.poisson(5, (60, 60))
    image[20:23, 30:33] += 80
    found = signal(image)
    assert found[20:23, 30:33].sum() >= 8 and found.sum() <= 20
    mask = np.ones(image.shape, dtype=bool)
    mask[20:23, 30:33] = False
    assert not signal(image, mask)[20:23, 30:33].any()


def test_untrusted_regions():
    got = untrusted_pixels(10, 10, rectangles=[(0, 2, 0, 1)], circles=[(5.0, 5.0, 1.0)], polygons=[[(7, 7), (9, 7), (9, 9), (7, 9)]], pixels=[(9, 0)])
    assert got.tolist() == sorted([0, 1, 9, 44, 45, 54, 55, 77, 78, 87, 88])


def test_background_and_fits():
    rng = np.random.default_rng(3)
    values = rng.poisson(7.0, 4000).astype(float)
    values[:60] = 500
    assert abs(glm_background(values) - 7) < 0.3 and abs(glm_background(rng.poisson(0.4, 4000).astype(float)) - 0.4) < 0.06
    y, x = np.mgrid[-6:7, -6:7]
    profile = np.exp(-(x * x + y * y) / 4).ravel()
    profile /= profile.sum()
    got = []
    for _ in range(300):
        pixels = rng.poisson(2 + 400 * profile).astype(float)
        got.append(fitted(pixels, profile, 2.0, np.ones(len(pixels), dtype=bool)))
    i = np.array([g[0] for g in got])
    assert abs(i.mean() - 400) < 6 and 0.7 < i.std() / np.sqrt(np.mean([g[1] for g in got])) < 1.3
    total, variance, complete = summed(np.array([5.0, 5, 1, 1]), np.array([True, True, False, False]), np.ones(4, dtype=bool), 1.0)
    assert total == 8 and complete and variance > 8


def test_basis_from_points():
    rng = np.random.default_rng(4)
    basis = np.array([[40.0, 1, 0], [0, 55, 2], [3, 0, 70]])
    hkl = rng.integers(-6, 7, (400, 3))
    points = hkl @ np.linalg.inv(basis).T
    step, n = 1 / 256, 128
    nodes, counts = np.unique(np.round(points / step).astype(int), axis=0, return_counts=True)
    vectors = [v for v, _ in fft_vectors(nodes, counts, step, n, 100.0, 20.0, 12)]
    found = choose_basis(points, vectors, 0.3)
    assert found is not None and same_lattice(found, basis, 0.15)
    long = basis.copy()
    long[2] += 3 * basis[0] - 2 * basis[1]
    assert same_lattice(reduced(long), basis) and np.linalg.norm(reduced(long)[2]) < 75


def test_crossings_meet_the_sphere():
    rng = np.random.default_rng(5)
    matrix, s0, axis = np.linalg.inv(np.diag([50.0, 60, 70])), np.array([0, 0, -1.0]), np.array([1.0, 0, 0])
    h = rng.integers(-20, 21, (200, 3)).astype(float)
    met = 0
    for phi in crossing_angles(h, matrix, axis, s0):
        for hkl, a in zip(h, phi, strict=True):
            if np.isfinite(a) and hkl.any():
                r = matrix @ hkl
                s1 = r * np.cos(a) + np.cross(axis, r) * np.sin(a) + axis * (axis @ r) * (1 - np.cos(a)) + s0
                assert abs(np.linalg.norm(s1) - 1) < 1e-9
                met += 1
    assert met > 100


def test_clusters():
    rng = np.random.default_rng(6)
    a, b = rng.normal((0, 1), 0.05, (12, 2)), rng.normal((1, 0), 0.05, (12, 2))
    points = np.concatenate([a, b])
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(axis=2))
    merges = ward_linkage(d)
    assert merges[-1, 2] > 5 * merges[-2, 2] and merges[-1, 3] == 24
    order, reach, _ = optics(points, 4)
    jumps = np.flatnonzero(reach[order][1:] > 0.5) + 1
    assert len(jumps) == 1 and {*order[: jumps[0]]} in ({*range(12)}, {*range(12, 24)})
    assert silhouette(points, np.repeat([0, 1], 12)) > 0.8 > silhouette(points, np.tile([0, 1], 12))
    cc, w = correlation_matrix([(i, j, float(points[i] @ points[j]), 10.0) for i in range(24) for j in range(i + 1, 24)], 24)
    x, value = cosym_coordinates(cc, w, 2)
    assert value < 1e-6 and np.abs(np.abs(x @ x.T - points @ points.T) * (1 - np.eye(24))).max() < 1e-2
    assert elbow(np.arange(6), np.array([9, 4, 1, 0.9, 0.8, 0.7])) == 2


def test_resolution_estimate():
    d = np.linspace(5, 1.2, 25)
    s = 1 / d**2
    cc = 0.5 * (1 - np.tanh((s - 0.35) / 0.08))
    want = 1 / np.sqrt(0.35 + 0.08 * np.arctanh(1 - 0.6))
    assert abs(estimate_resolution(d.tolist(), cc.tolist(), [100] * 25) - want) < 1e-3
    assert estimate_resolution(d.tolist(), [0.99] * 25, [100] * 25) is None


def test_derivatives_of_the_scale_model():
    rng = np.random.default_rng(7)
    model, p = Model(0, 100, 4, 2), np.array([0.9, 1.1, 1.0, 1.05, 0.5, -0.3])
    n = 60
    z, d, i, v = rng.uniform(0, 100, n), rng.uniform(1.5, 5, n), rng.uniform(50, 90, n), rng.uniform(4, 9, n)
    heads = np.arange(0, n, 6)
    g, u = model.scale(p, z, d)
    for k in range(model.size):
        e = np.eye(model.size)[k] * 1e-6
        assert np.abs((model.scale(p + e, z, d)[0] - model.scale(p - e, z, d)[0]) / 2e-6 - u[:, k]).max() < 1e-7
    _, b, _ = normal_equations(heads, i, v, z, d, model, p)
    for k in range(model.size):
        e = np.eye(model.size)[k] * 1e-5
        slope = (normal_equations(heads, i, v, z, d, model, p + e)[2] - normal_equations(heads, i, v, z, d, model, p - e)[2]) / 2e-5
        assert abs(slope / -2 - b[k]) < 1e-3 * max(1, abs(b[k]))


def test_files():
    for value in (None, True, 0, 127, 300, -5, 1 << 63, 2.5, "é" * 40, b"x" * 300, [1, [2]], {"a": {"b": b""}}):
        assert unpack(pack(value))[0] == value
    columns = {"id": ("int", np.array([1, 2], dtype=np.int32)), "xyz": ("vec3<double>", np.arange(6.0).reshape(2, 3)), "flags": ("std::size_t", np.array([32, 4], dtype=np.uint64))}
    back, names, rows = decode_table(encode_table(columns, {0: "e"}))
    assert rows == 2 and names == {0: "e"} and all((back[n][1] == x).all() and back[n][0] == k for n, (k, x) in columns.items())
    beam = {"wavelength": 0.95}
    document = experiment_document([("a", {"beam": beam, "crystal": None}), ("b", {"beam": dict(beam), "crystal": {"h": 1}})])
    assert len(document["beam"]) == 1 and [e.get("crystal") for e in document["experiment"]] == [None, 0]


def test_streamed_components():
    held = Open()
    assert held.add(1, [(0, 0, 5), (0, 2, 5)]) == []
    assert held.add(2, [(0, 0, 1), (0, 1, 1), (0, 2, 1)]) == []  # joins both
    done = held.add(3, [(9, 9, 2)])
    assert sorted(done[0]) == [(1, 0, 0, 5), (1, 0, 2, 5), (2, 0, 0, 1), (2, 0, 1, 1), (2, 0, 2, 1)]
    assert held.add(5, []) == [[(3, 9, 9, 2)]]  # a missing frame closes all
    try:
        held.add(5, [])
    except ValueError as e:
        assert "frame 5" in str(e)
    else:
        raise AssertionError("a late frame must be an error")
