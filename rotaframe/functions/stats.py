"""Distributions and presentation: quantiles on the driver, value(esd) notation, distances between figures."""

from __future__ import annotations

import math
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_quantile(p: float) -> float:
    return NormalDist().inv_cdf(p)


def normal_upper_tail(x: float) -> float:
    return 0.5 * math.erfc(x / math.sqrt(2))


def student_t_cdf(t: float, df: float) -> float:
    """By the regularised incomplete beta function, as a continued fraction."""
    x = df / (df + t * t)
    tail = 0.5 * _beta_regularised(df / 2, 0.5, x)
    return 1 - tail if t > 0 else tail


def student_t_quantile(p: float, df: float) -> float:
    """By bisection."""
    low, high = -1e3, 1e3
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if student_t_cdf(middle, df) < p else (low, middle)
    return (low + high) / 2


def _beta_regularised(a: float, b: float, x: float) -> float:
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_regularised(b, a, 1 - x)
    # modified Lentz
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        if i == 0:
            n = 1.0
        elif i % 2 == 0:
            n = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            n = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / max(1 + n * d, tiny) if abs(1 + n * d) > tiny else 1 / tiny
        c = 1 + n / c
        f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * (f - 1) / a


def relative_difference(a: Column, b: Column) -> Column:
    return F.when((a == 0) & (b == 0), F.lit(0.0)).otherwise(2 * (a - b) / (F.abs(a) + F.abs(b)))


def pull(a: Column, b: Column, var_a: Column, var_b: Column) -> Column:
    return (a - b) / F.sqrt(var_a + var_b)


def with_esd(value: Column, esd: Column) -> Column:
    """value(esd) notation, the error with one digit, two if it begins with 1."""
    first = F.floor(F.log10(esd))
    digits = F.greatest(F.lit(0), -(first - F.when(esd / F.pow(F.lit(10.0), first) < 1.95, 1).otherwise(0))).cast("int")
    shown = F.round(esd * F.pow(F.lit(10.0), digits)).cast("long")
    text = F.concat(F.format_string("%.10f", value), F.lit(""))
    whole = F.when(digits == 0, F.round(value).cast("long").cast("string")).otherwise(F.expr("1").cast("string"))
    places = [F.when(digits == k, F.format_string(f"%.{k}f", value)) for k in range(1, 10)]
    return F.when(esd > 0, F.concat(F.coalesce(*places, whole), F.lit("("), shown.cast("string"), F.lit(")"))).otherwise(text)


def real_harmonics(lmax: int):
    """A pandas function of (x, y, z), unit vectors: real spherical harmonics Y_lm, l from 1 to lmax, as an array."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series, y: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series(list(harmonics(lmax, x.to_numpy(), y.to_numpy(), z.to_numpy()).T))

    return run


def harmonics(lmax: int, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Rows by (l, m): l from 1, m from -l to l, normalised on the sphere, without the Condon-Shortley sign."""
    phi, sin = np.arctan2(y, x), np.sqrt(np.maximum(0, 1 - z * z))
    p = {(0, 0): np.ones_like(z)}
    for m in range(1, lmax + 1):
        p[m, m] = p[m - 1, m - 1] * (2 * m - 1) * sin
    for m in range(lmax + 1):
        for degree in range(m + 1, lmax + 1):
            p[degree, m] = ((2 * degree - 1) * z * p[degree - 1, m] - (degree + m - 1) * p.get((degree - 2, m), 0)) / (degree - m)
    out = []
    for degree in range(1, lmax + 1):
        for m in range(-degree, degree + 1):
            k = abs(m)
            n = math.sqrt((2 * degree + 1) / (4 * math.pi) * math.factorial(degree - k) / math.factorial(degree + k))
            wave = np.cos(k * phi) if m >= 0 else np.sin(k * phi)
            out.append(n * p[degree, k] * wave * (math.sqrt(2) if m else 1))
    return np.array(out)
