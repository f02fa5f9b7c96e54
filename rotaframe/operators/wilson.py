"""Wilson statistics: the scale and anisotropic fall-off of intensities by maximum likelihood, normalisation and outliers.

Reflections are rows (i, sigma, d and the reciprocal vector x, y, z in 1 / Angstrom, optionally f2, the mean squared
scattering factor at d). Expected intensities are S = k f2 exp(-b.t) with t the six second-order terms of the vector,
and acentric Wilson statistics give each reflection a negative log likelihood of I / S + ln S. Newton's method needs
one aggregation of 36 sums a round, all of them made by Spark's own expressions; only those reach the driver.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .merging import number_rows

# The range of 1 / d^2 that the fit looks at, the fewest reflections for one, and E^2 of an outlier.
WINDOW = (0.008, 0.690)
LEAST = 100
OUTLIER = 16.0
#: The tensor's components in the order of b.
TERMS = ("xx", "yy", "zz", "xy", "xz", "yz")


@dataclass(frozen=True)
class WilsonFit:
    """ln k and b (xx, yy, zz, xy, xz, yz in square Angstrom: an isotropic B is (B, B, B, 0, 0, 0)); not fitted with too few reflections."""

    fitted: bool
    used: int
    log_scale: float = 0.0
    b: tuple[float, ...] = (0.0,) * 6
    rounds: int = 0

    def fall_off(self) -> Column:
        return sum((F.col(f"_{t}") * v for t, v in zip(TERMS, self.b, strict=True)), F.lit(0.0))


def _with_terms(rows: DataFrame) -> DataFrame:
    """B |s|^2 / 2 with |s| = 1 / d, off-diagonal terms twice."""
    pair = lambda t: F.col(t[0]) * F.col(t[1]) * (0.5 if t[0] == t[1] else 1.0)
    return rows.withColumns({f"_{t}": pair(t) for t in TERMS})


def fit_wilson(rows: DataFrame, most: int = 100) -> WilsonFit:
    """The scale and tensor of greatest likelihood; intensities under 0 count as 0."""
    from .storage import checkpoint

    f2 = F.col("f2") if "f2" in rows.columns else F.lit(1.0)
    d_star = 1 / (F.col("d") * F.col("d"))
    inside = (d_star > WINDOW[0]) & (d_star < WINDOW[1]) & F.col("i").isNotNull() & ~F.isnan("i") & (F.abs("i") < float("inf"))
    own = _with_terms(rows.filter(inside)).select(F.greatest("i", F.lit(0.0)).alias("_i"), f2.alias("_f2"), F.log(f2).alias("_lf2"), *(f"_{t}" for t in TERMS))
    own = checkpoint(own)
    first = own.agg(F.count("*").alias("n"), F.sum("_i").alias("i"), F.sum("_f2").alias("f2")).first()
    if first.n < LEAST or not first.i > 0:
        return WilsonFit(False, first.n)
    names = [f"_{t}" for t in TERMS]

    def sums(theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The negative log likelihood with its gradient and second derivatives."""
        x = F.col("_lf2") + float(theta[0])
        for name, v in zip(names, theta[1:], strict=True):
            x = x - F.col(name) * float(v)
        at = own.withColumn("_x", x).withColumn("_ratio", F.col("_i") * F.exp(-F.col("_x")))
        a = [F.lit(1.0), *(-F.col(c) for c in names)]
        parts = [F.sum(F.col("_ratio") + F.col("_x"))] + [F.sum((1 - F.col("_ratio")) * u) for u in a] + [F.sum(F.col("_ratio") * a[u] * a[v]) for u in range(7) for v in range(u, 7)]
        row = at.agg(*(p.alias(f"s{k}") for k, p in enumerate(parts))).first()  # one row
        second = np.zeros((7, 7))
        second[np.triu_indices(7)] = row[8:]
        return row[0], np.array(row[1:8]), second + np.triu(second, 1).T

    theta = np.array([math.log(first.i / first.f2), *[0.0] * 6])
    value, gradient, second = sums(theta)
    rounds = 0
    for rounds in range(1, most + 1):
        step = np.linalg.lstsq(second + np.diag(1e-12 * (1 + np.abs(np.diag(second)))), -gradient, rcond=None)[0]
        for _ in range(40):
            found = sums(theta + step)
            if found[0] <= value:
                break
            step = step / 2
        else:
            break
        gain, theta = value - found[0], theta + step
        value, gradient, second = found
        if gain <= 1e-10 * abs(value):
            break
    return WilsonFit(bool(np.isfinite(value)), first.n, float(theta[0]), tuple(float(v) for v in theta[1:]), rounds)


def normalised(rows: DataFrame, row_id: str, fit: WilsonFit | None = None, shell: int = 200) -> DataFrame:
    """rows with i and sigma on one scale and without fall-off, Wilson outliers left out.

    Outliers are judged by E^2, an intensity over the mean of its run of `shell` reflections in order of d, the last of
    which takes a remainder of under half: 16 or more is too much. Without a fit the same means normalise.
    """
    fit = fit or fit_wilson(rows)
    numbered = number_rows(rows, [F.desc("d"), F.asc(row_id)])
    last = F.greatest(F.expr(f"n_rows DIV {shell}") - F.when(F.col("n_rows") % shell < shell // 2, 1).otherwise(0), F.lit(0))
    runs = numbered.withColumn("_run", F.least(F.expr(f"row_number DIV {shell}"), last))
    means = runs.groupBy("_run").agg(F.avg("i").alias("_mean"))
    judged = _with_terms(runs.join(means, "_run")).withColumn("_e2", F.when(F.col("_mean") > 0, F.col("i") / F.col("_mean")).otherwise(F.lit(0.0)))
    by_shells = F.when((F.col("_e2") != 0) & (F.col("i") != 0), F.col("_e2") / F.col("i")).otherwise(F.lit(1.0))
    factor = F.exp(fit.fall_off() - fit.log_scale) if fit.fitted else by_shells
    kept = judged.filter(F.col("_e2") < OUTLIER).withColumn("_factor", factor)
    return kept.select(*((F.col(c) * F.col("_factor")).alias(c) if c in ("i", "sigma") else F.col(c) for c in rows.columns))
