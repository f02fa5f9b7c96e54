"""Symmetry of reflections: unique indices, absences, centric reflections and changes of basis, as column expressions."""

from __future__ import annotations

import itertools
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Matrix = tuple[tuple[int, int, int], ...]

# Generators of the rotation groups, acting on indices as columns.
TWO_X, TWO_Y, TWO_Z = ((1, 0, 0), (0, -1, 0), (0, 0, -1)), ((-1, 0, 0), (0, 1, 0), (0, 0, -1)), ((-1, 0, 0), (0, -1, 0), (0, 0, 1))
FOUR_Z, THREE_Z, SIX_Z = ((0, -1, 0), (1, 0, 0), (0, 0, 1)), ((0, -1, 0), (1, -1, 0), (0, 0, 1)), ((1, -1, 0), (1, 0, 0), (0, 0, 1))
TWO_XY, THREE_XYZ = ((0, 1, 0), (1, 0, 0), (0, 0, -1)), ((0, 0, 1), (1, 0, 0), (0, 1, 0))
GROUPS = {
    "1": [], "2": [TWO_Y], "222": [TWO_X, TWO_Y], "4": [FOUR_Z], "422": [FOUR_Z, TWO_X], "3": [THREE_Z], "32": [THREE_Z, TWO_XY],
    "6": [SIX_Z], "622": [SIX_Z, TWO_XY], "23": [TWO_X, TWO_Y, THREE_XYZ], "432": [FOUR_Z, THREE_XYZ, TWO_X],
}
CENTRINGS = {"P": [], "A": [(0, "1/2", "1/2")], "B": [("1/2", 0, "1/2")], "C": [("1/2", "1/2", 0)], "I": [("1/2", "1/2", "1/2")], "F": [(0, "1/2", "1/2"), ("1/2", 0, "1/2")], "R": [("2/3", "1/3", "1/3")]}


def times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(sum(a[i][k] * b[k][j] for k in range(3)) for j in range(3)) for i in range(3))


def closure(generators: list[Matrix]) -> list[Matrix]:
    """All products of generators, the identity first."""
    identity: Matrix = ((1, 0, 0), (0, 1, 0), (0, 0, 1))
    found = [identity]
    for m in found:
        for g in generators:
            if (p := times(m, g)) not in found:
                found.append(p)
    return found


@dataclass(frozen=True)
class SpaceGroup:
    """Rotations with translations; h goes to h R, and its phase by h t."""

    rotations: tuple[Matrix, ...]
    translations: tuple[tuple[Fraction, Fraction, Fraction], ...]

    @classmethod
    def of(cls, point_group: str, centring: str = "P", screws: dict[Matrix, tuple] | None = None) -> SpaceGroup:
        """From a rotation group, a centring, and translations of its generators where they aren't zero."""
        zero = (Fraction(0),) * 3
        part = {g: tuple(Fraction(x) for x in (screws or {}).get(g, (0, 0, 0))) for g in GROUPS[point_group]}
        start = (closure([])[0], zero)
        found = [start]
        centres = [tuple(Fraction(x) for x in c) for c in CENTRINGS[centring]]
        for r, t in found:
            for g, u in [*part.items(), *((start[0], c) for c in centres)]:
                moved = tuple((t[i] + sum(r[i][k] * u[k] for k in range(3))) % 1 for i in range(3))
                if (p := (times(r, g), moved)) not in found:
                    found.append(p)
        return cls(tuple(r for r, _ in found), tuple(t for _, t in found))


def image(h: Column, k: Column, l: Column, m: Matrix) -> tuple[Column, Column, Column]:  # noqa: E741
    """The row vector (h, k, l) times a matrix."""

    def term(j: int) -> Column:
        out = F.lit(0)
        for v, row in zip((h, k, l), m, strict=True):
            if row[j]:
                out = out + v * row[j]
        return out

    return term(0), term(1), term(2)


def unique_index(group: SpaceGroup, h: str = "h", k: str = "k", l: str = "l") -> Column:  # noqa: E741
    """struct(h, k, l, plus): the greatest of a reflection's equivalents, Friedel's mates counted in, and whether it is reached without them."""
    rotations = list(dict.fromkeys(group.rotations))
    c = [F.col(x) for x in (h, k, l)]
    each = []
    for m in rotations:
        x = image(*c, m)
        each.append(F.struct(*(v.cast("int").alias(n) for v, n in zip(x, "hkl", strict=True)), F.lit(1).alias("plus")))
        each.append(F.struct(*((-v).cast("int").alias(n) for v, n in zip(x, "hkl", strict=True)), F.lit(0).alias("plus")))
    best = F.array_max(F.array(*each))
    return F.struct(best["h"].alias("h"), best["k"].alias("k"), best["l"].alias("l"), (best["plus"] == 1).alias("plus"))


def is_centric(group: SpaceGroup, h: str = "h", k: str = "k", l: str = "l") -> Column:  # noqa: E741
    c = [F.col(x) for x in (h, k, l)]
    out = F.lit(False)
    for m in dict.fromkeys(group.rotations):
        x = image(*c, m)
        out = out | ((x[0] == -c[0]) & (x[1] == -c[1]) & (x[2] == -c[2]))
    return out


def is_absent(group: SpaceGroup, h: str = "h", k: str = "k", l: str = "l") -> Column:  # noqa: E741
    """Whether a rotation leaves the reflection where it is and its translation shifts its phase."""
    c = [F.col(x) for x in (h, k, l)]
    out = F.lit(False)
    for m, t in zip(group.rotations, group.translations, strict=True):
        if any(t):
            x = image(*c, m)
            parts = int(np.lcm.reduce([f.denominator for f in t]))
            shift = F.lit(0)
            for v, f in zip(c, t, strict=True):
                shift = shift + v * int(f * parts)
            out = out | ((x[0] == c[0]) & (x[1] == c[1]) & (x[2] == c[2]) & (F.pmod(shift, F.lit(parts)) != 0))
    return out


def reindexed(rows: DataFrame, m: Matrix, h: str = "h", k: str = "k", l: str = "l") -> DataFrame:  # noqa: E741
    """Indices in another basis; the matrix acts on index columns (h' = M h)."""
    transposed: Matrix = tuple(zip(*m, strict=True))
    x = image(F.col(h), F.col(k), F.col(l), transposed)
    return rows.withColumns(dict(zip((h, k, l), x, strict=True)))


def possible_reflections(spark, group: SpaceGroup, cell: tuple[float, ...], d_min: float) -> DataFrame:
    """Unique reflections to d_min, absent ones left out: a grid made by the executors, not the driver."""
    from rotaframe.functions.geometry import d_spacing

    ends = [int(x / d_min) + 1 for x in cell[:3]]
    grid = spark.range(-ends[0], ends[0] + 1).select(F.col("id").cast("int").alias("h"))
    for name, n in zip("kl", ends[1:], strict=True):
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(-n), F.lit(n))))
    grid = grid.filter("NOT (h = 0 AND k = 0 AND l = 0)").withColumn("d", d_spacing(F.col("h"), F.col("k"), F.col("l"), *(F.lit(float(x)) for x in cell)))
    held = grid.filter((F.col("d") >= d_min) & ~is_absent(group)).withColumn("u", unique_index(group))
    return held.filter("h = u.h AND k = u.k AND l = u.l").select("h", "k", "l", "d")


def lattice_symmetry(metric: np.ndarray, tolerance: float = 1.4) -> list[Matrix]:
    """Rotations that a cell's metric allows, to a tolerance in degrees: twofold axes by Le Page's test of a direct and a reciprocal axis."""
    inverse = np.linalg.inv(metric)
    small = [v for v in itertools.product((-2, -1, 0, 1, 2), repeat=3) if any(v)]
    found = []
    for u in small:
        direct = np.array(u) @ metric @ np.array(u)
        for h in small:
            product = abs(int(np.dot(u, h)))
            if product not in (1, 2):
                continue
            cos = product / np.sqrt(direct * (np.array(h) @ inverse @ np.array(h)))
            if np.degrees(np.arccos(min(1.0, cos))) <= tolerance:
                m = 2 * np.outer(u, h) / np.dot(u, h) - np.eye(3)
                if np.allclose(m, np.round(m)):
                    found.append(tuple(tuple(int(x) for x in row) for row in np.round(m)))
    return closure(list(dict.fromkeys(found)))


def absence_scores(rows: DataFrame, candidates: dict[str, SpaceGroup], value: str = "i", variance: str = "v") -> DataFrame:
    """For each candidate group: reflections it forbids and their mean I / sigma, in one pass."""
    sigma = F.col(value) / F.sqrt(variance)
    parts = []
    for name, group in candidates.items():
        gone = is_absent(group)
        parts.append(F.struct(F.lit(name).alias("group"), F.sum(gone.cast("long")).alias("forbidden"), F.avg(F.when(gone, sigma)).alias("i_over_sigma")))
    return rows.agg(F.array(*parts).alias("g")).select(F.explode("g").alias("g")).select("g.*")


def element_scores(merged: DataFrame, operators: dict[str, Matrix], value: str = "i", least: int = 3) -> DataFrame:
    """Correlation of reflections with their images under each operator, and the pairs behind it: images are exploded from the short list, one join."""
    c = [F.col(x) for x in "hkl"]
    images = F.explode(F.array(*(F.struct(F.lit(name).alias("operator"), *(v.cast("int").alias(f"{n}_") for v, n in zip(image(*c, m), "hkl", strict=True))) for name, m in operators.items())))
    moved = merged.select("h", "k", "l", F.col(value).alias("a"), images.alias("o")).select("h", "k", "l", "a", "o.*").filter("NOT (h = h_ AND k = k_ AND l = l_)")
    mates = merged.select(*(F.col(n).cast("int").alias(f"{n}_") for n in "hkl"), F.col(value).alias("b"))
    return moved.join(mates, ["h_", "k_", "l_"]).groupBy("operator").agg(F.count("*").alias("pairs"), F.corr("a", "b").alias("cc")).filter(F.col("pairs") >= least)
