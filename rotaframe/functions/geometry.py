"""Geometry of a rotation experiment as column expressions, all of it in generated code.

Vectors are Vec, three columns of doubles, or struct columns with x, y and z. Functions of plain columns give plain
expressions. Those that use a value many times take `bind`: a Steps of the DataFrame they are for, which adds the value
as columns, so that it is reckoned once and expressions stay as short as they are written. Without it all is one
expression, which is fine for literals and short arguments.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


Number = Column | float


def _times(a: Number, b: Number) -> Number:
    if isinstance(b, float):
        a, b = b, a
    if isinstance(a, float):
        return a * b if isinstance(b, float) else 0.0 if a == 0 else b if a == 1 else -b if a == -1 else b * a
    return a * b


def _plus(a: Number, b: Number) -> Number:
    if isinstance(a, float) and isinstance(b, float):
        return a + b
    return b if isinstance(a, float) and a == 0 else a if isinstance(b, float) and b == 0 else a + b


def _minus(a: Number, b: Number) -> Number:
    return _plus(a, _times(-1.0, b))


def _column(a: Number) -> Column:
    return F.lit(a) if isinstance(a, float) else a


def _root(a: Number) -> Number:
    return math.sqrt(a) if isinstance(a, float) else F.sqrt(a)


def _inverse(a: Number) -> Number:
    return 1 / a


@dataclass(frozen=True)
class Vec:
    """Three columns or numbers; what numbers settle (a 0, a 1, the length of a constant beam) never reaches the plan."""

    x: Number
    y: Number
    z: Number

    def __getitem__(self, k: str) -> Number:
        return getattr(self, k)

    def struct(self) -> Column:
        return F.struct(*(_column(self[k]).alias(k) for k in "xyz"))

    def alias(self, name: str) -> Column:
        return self.struct().alias(name)

    @classmethod
    def of(cls, name: str) -> Vec:
        """The columns name_x, name_y and name_z."""
        return cls(*(F.col(f"{name}_{k}") for k in "xyz"))


Vector = Vec | Column


class Steps:
    """A DataFrame that grows by the values bound to it; `df` has them as columns of names that begin with an underscore."""

    def __init__(self, df: DataFrame) -> None:
        self.df, self.columns, self.n = df, df.columns, 0

    def __call__(self, value: Vector | float):
        name, self.n = f"_step{self.n}", self.n + 1
        if isinstance(value, float):
            return value
        if isinstance(value, Vec):
            made = {k: f"{name}_{k}" for k in "xyz" if not isinstance(value[k], float)}
            self.df = self.df.withColumns({c: value[k] for k, c in made.items()})
            return Vec(*(F.col(made[k]) if k in made else value[k] for k in "xyz"))
        self.df = self.df.withColumn(name, value)
        return F.col(name)

    def done(self, *columns: Column | str) -> DataFrame:
        """The DataFrame's own columns and these."""
        return self.df.select(*self.columns, *columns)


Bind = Callable[[Vector], Vector]


def inline(value: Vector) -> Vector:
    return value


def vec(x, y, z) -> Vec:
    return Vec(*(v if isinstance(v, Column) else float(v) for v in (x, y, z)))


def _dot(a: Vector, b: Vector) -> Number:
    return _plus(_plus(_times(a["x"], b["x"]), _times(a["y"], b["y"])), _times(a["z"], b["z"]))


def dot(a: Vector, b: Vector) -> Column:
    return _column(_dot(a, b))


def cross(a: Vector, b: Vector) -> Vec:
    one = lambda i, j: _minus(_times(a[i], b[j]), _times(a[j], b[i]))
    return Vec(one("y", "z"), one("z", "x"), one("x", "y"))


def scaled(a: Vector, f: Number) -> Vec:
    return Vec(*(_times(a[k], f) for k in "xyz"))


def plus(a: Vector, b: Vector) -> Vec:
    return Vec(*(_plus(a[k], b[k]) for k in "xyz"))


def minus(a: Vector, b: Vector) -> Vec:
    return Vec(*(_minus(a[k], b[k]) for k in "xyz"))


def _norm(a: Vector) -> Number:
    return _root(_dot(a, a))


def norm(a: Vector) -> Column:
    return _column(_norm(a))


def unit(a: Vector, bind: Bind = inline) -> Vec:
    a = bind(a)
    return scaled(a, bind(_inverse(_norm(a))))


def rotated(v: Vector, axis: Vector, angle: Column, bind: Bind = inline) -> Vec:
    """Rodrigues' formula; axis of unit length, angle in radians."""
    v, c, s = bind(v), bind(F.cos(angle)), bind(F.sin(angle))
    along = bind(_times(_dot(axis, v), 1 - c))
    return plus(plus(scaled(v, c), scaled(cross(axis, v), s)), scaled(axis, along))


def z_to_phi(z: Column, first_image: Column, start: Column, width: Column) -> Column:
    """Image number to rotation angle; image n spans z in [n - 1, n]."""
    return start + (z - (first_image - 1)) * width


def phi_to_z(phi: Column, first_image: Column, start: Column, width: Column) -> Column:
    return (phi - start) / width + (first_image - 1)


def fraction_of_scan(z: Column, first_image: Column, last_image: Column) -> Column:
    return (z - (first_image - 1)) / (last_image - first_image + 1)


def parallax(cos_angle: Column, mu: Column, thickness: Column) -> Column:
    """Mean depth at which a ray is absorbed, along the ray."""
    path = thickness / cos_angle
    return 1 / mu - (path + 1 / mu) * F.exp(-mu * path)


def px_to_mm(x: Column, y: Column, pixel: Column, ray: Vector, fast: Vector, slow: Vector, normal: Vector, mu: Column, thickness: Column, bind: Bind = inline) -> tuple[Column, Column]:
    """Pixels to millimetres: the depth of absorption shifts the spot along the ray's projection."""
    depth = bind(parallax(F.abs(dot(ray, normal)), mu, thickness))
    return x * pixel - dot(ray, fast) * depth, y * pixel - dot(ray, slow) * depth


def mm_to_px(x: Column, y: Column, pixel: Column, ray: Vector, fast: Vector, slow: Vector, normal: Vector, mu: Column, thickness: Column, bind: Bind = inline) -> tuple[Column, Column]:
    """Millimetres to pixels. Not the exact inverse of px_to_mm: each takes the ray through the point it is given."""
    depth = bind(parallax(F.abs(dot(ray, normal)), mu, thickness))
    return (x + dot(ray, fast) * depth) / pixel, (y + dot(ray, slow) * depth) / pixel


def mm_to_px_jacobian(x: Column, y: Column, pixel: Column, origin: Vector, fast: Vector, slow: Vector, mu: Column, thickness: Column, bind: Bind = inline) -> dict[str, Column]:
    """Derivatives of mm_to_px by millimetres on a panel: xx, xy, yx, yy, where xy is that of the pixel's x by y.

    With the ray of unit length r through the point at distance L, r changes by (e - r (r.e)) / L along an axis e, and the depth by mu path exp(-mu path) d(path).
    """
    lab = bind(lab_position(x, y, origin, fast, slow))
    length = bind(_norm(lab))
    ray, normal = bind(scaled(lab, _inverse(length))), cross(fast, slow)
    on = {a: bind(dot(ray, v)) for a, v in (("fast", fast), ("slow", slow), ("normal", normal))}
    path = bind(thickness / F.abs(on["normal"]))
    fade = bind(F.exp(-mu * path))
    depth = bind(1 / mu - (path + 1 / mu) * fade)
    by_path = bind(mu * path * fade * -path / on["normal"])
    axes = {"fast": fast, "slow": slow}

    def one(axis: str, e: str) -> Column:
        turn = lambda a, v: _minus(_dot(axes[e], v), on[e] * on[a]) / length
        return ((1.0 if axis == e else 0.0) + turn(axis, axes[axis]) * depth + on[axis] * by_path * turn("normal", normal)) / pixel

    return {"xx": one("fast", "fast"), "xy": one("fast", "slow"), "yx": one("slow", "fast"), "yy": one("slow", "slow")}


def goniometer(axes: list[list[float]], angles: list[float], scan_axis: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(fixed rotation, scan axis, setting rotation) of a goniometer's axes, from the one next to the crystal outwards; angles in degrees.

    The axes before the scan axis make the fixed rotation, those after it the setting; a vector goes through fixed, scan and setting in turn.
    """

    def turn(axis: list[float], degrees: float) -> np.ndarray:
        u = np.array(axis, dtype=float) / np.linalg.norm(axis)
        k = np.array([[0, -u[2], u[1]], [u[2], 0, -u[0]], [-u[1], u[0], 0]])
        a = math.radians(degrees)
        return np.eye(3) + math.sin(a) * k + (1 - math.cos(a)) * (k @ k)

    fixed, setting = np.eye(3), np.eye(3)
    for i, (axis, angle) in enumerate(zip(axes, angles, strict=True)):
        if i < scan_axis:
            fixed = turn(axis, angle) @ fixed
        elif i > scan_axis:
            setting = turn(axis, angle) @ setting
    return fixed, np.array(axes[scan_axis], dtype=float) / np.linalg.norm(axes[scan_axis]), setting


def matrix_times(m: np.ndarray, v: Vector) -> Vec:
    """A matrix known beforehand times a vector."""
    return Vec(*(_dot(vec(*row), v) for row in m))


def lab_position(x_mm: Column, y_mm: Column, origin: Vector, fast: Vector, slow: Vector) -> Vec:
    return plus(origin, plus(scaled(fast, x_mm), scaled(slow, y_mm)))


def reciprocal_point(lab: Vector, beam: Vector, axis: Vector, phi: Column, bind: Bind = inline) -> Vec:
    """The point of the crystal's reciprocal lattice, at phi = 0, that a spot came from; beam: s0 of length 1 / wavelength."""
    s1 = scaled(unit(lab, bind), _norm(beam))
    return rotated(minus(s1, beam), axis, -phi, bind)


def panel_hit(s1: Vector, origin: Vector, fast: Vector, slow: Vector, bind: Bind = inline) -> tuple[Column, Column, Column]:
    """(x mm, y mm, whether the ray meets the plane in front of it)."""
    normal = bind(cross(fast, slow))
    far = bind(dot(origin, normal) / _dot(s1, normal))
    off = bind(minus(scaled(s1, far), origin))
    return dot(off, fast), dot(off, slow), far > 0


def cell_volume(a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:
    """Angles in degrees."""
    ca, cb, cg = (F.cos(F.radians(v)) for v in (alpha, beta, gamma))
    return a * b * c * F.sqrt(1 - ca * ca - cb * cb - cg * cg + 2 * ca * cb * cg)


def d_spacing(h: Column, k: Column, l: Column, a: Column, b: Column, c: Column, alpha: Column, beta: Column, gamma: Column) -> Column:  # noqa: E741
    """From the cell, by the reciprocal metric."""
    v = cell_volume(a, b, c, alpha, beta, gamma)
    ca, cb, cg = (F.cos(F.radians(x)) for x in (alpha, beta, gamma))
    sa, sb, sg = (F.sin(F.radians(x)) for x in (alpha, beta, gamma))
    s11, s22, s33 = (b * c * sa) * (b * c * sa), (a * c * sb) * (a * c * sb), (a * b * sg) * (a * b * sg)
    s12, s23, s13 = a * b * c * c * (ca * cb - cg), a * a * b * c * (cb * cg - ca), a * b * b * c * (cg * ca - cb)
    return v / F.sqrt(s11 * h * h + s22 * k * k + s33 * l * l + 2 * s12 * h * k + 2 * s23 * k * l + 2 * s13 * h * l)


def quantum_efficiency(mu: Column, thickness: Column, cos_angle: Column) -> Column:
    """1 where the sensor is unknown or the ray runs along it."""
    known = (mu > 0) & (thickness > 0) & (cos_angle > 0)
    return F.when(known, 1 - F.exp(-mu * thickness / cos_angle)).otherwise(F.lit(1.0))


def lorentz_polarization(s0: Vector, s1: Vector, axis: Vector, pol_normal: Vector, fraction: Column, bind: Bind = inline) -> Column:
    """L / P, the factor that corrects an intensity."""
    both, long1 = bind(_times(_norm(s0), _norm(s1))), bind(_norm(s1))
    along_beam, along_normal = bind(dot(s0, s1) / both), bind(dot(pol_normal, s1) / _times(long1, _norm(pol_normal)))
    p = (1 - 2 * fraction) * (1 - along_normal * along_normal) + fraction * (1 + along_beam * along_beam)
    return F.abs(dot(s1, cross(axis, s0))) / both / p


def zeta(s0: Vector, s1: Vector, axis: Vector, bind: Bind = inline) -> Column:
    """How fast a reflection crosses the sphere: axis times the normal of the plane of s1 and s0."""
    normal = bind(cross(s1, s0))
    return dot(axis, normal) / _norm(normal)


# Numerator and denominator of the upper tail of the normal distribution over its density (Hart's rational function, 1968), highest power first.
TAIL_TOP = (3.52624965998911e-2, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
TAIL_BOTTOM = (8.83883476483184e-2, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)


def normal_cdf(x: Column, bind: Bind = inline) -> Column:
    """The normal distribution function, to about 1e-13: Spark SQL has none."""
    far = bind(F.least(F.abs(x), F.lit(38.0)))
    near, top, bottom = F.least(far, F.lit(7.07)), F.lit(0.0), F.lit(0.0)
    for c in TAIL_TOP:
        top = top * near + c
    for c in TAIL_BOTTOM:
        bottom = bottom * near + c
    tail = bind(F.exp(far * far / -2) * top / bottom)
    return F.when(x > 0, 1 - tail).otherwise(tail)


def erf(x: Column, bind: Bind = inline) -> Column:
    """The error function, to about 1e-13."""
    return 2 * normal_cdf(x * math.sqrt(2.0), bind) - 1


def partiality(phi: Column, phi_low: Column, phi_high: Column, sigma_m: Column, zeta_value: Column, bind: Bind = inline) -> Column:
    """Part of a Gaussian in phi, of width sigma_m / |zeta|, between the ends of the box, in any order; 1 without a spread."""
    c = F.abs(zeta_value) / (F.sqrt(F.lit(2.0)) * sigma_m)
    low, high = F.least(phi_low, phi_high), F.greatest(phi_low, phi_high)
    part = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 0.5 * (erf((high - phi) * c, bind) - erf((low - phi) * c, bind))))
    return F.when((sigma_m > 0) & (zeta_value != 0), part).otherwise(F.lit(1.0))


def kabsch_epsilon(s1: Vector, s1_pixel: Vector, s0: Vector, bind: Bind = inline) -> tuple[Column, Column]:
    """Coordinates of a pixel in a reflection's own frame, in radians."""
    e1 = bind(unit(cross(s1, s0), bind))
    e2 = bind(unit(cross(s1, e1), bind))
    off, long = bind(minus(s1_pixel, s1)), bind(_norm(s1))
    return dot(e1, off) / long, dot(e2, off) / long
