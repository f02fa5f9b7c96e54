"""Scaling: a smooth scale and decay fitted to repeated observations, with merged intensities eliminated.

Observations are dealt to buckets by their group once and packed, a row for each bucket. Every evaluation is
then one pass without a shuffle: each bucket gives its part of the normal equations, and the driver, which only
ever sees sums of the size of the parameters, solves them (Levenberg-Marquardt).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotaframe.operators.storage import checkpoint
from rotaframe.operators.windows import leave_one_out, reject_outliers

COLUMNS = ["g", "i", "v", "z", "d"]


@dataclass(frozen=True)
class Model:
    """g = C(z) exp(B(z) / 2 d^2), C and B linear between nodes evenly placed over [z_low, z_high]."""

    z_low: float
    z_high: float
    scales: int = 8
    decays: int = 3

    @property
    def size(self) -> int:
        return self.scales + self.decays

    def start(self) -> np.ndarray:
        return np.concatenate([np.ones(self.scales), np.zeros(self.decays)])

    def _weights(self, z: np.ndarray, nodes: int) -> np.ndarray:
        at = np.clip((z - self.z_low) / (self.z_high - self.z_low), 0, 1) * max(nodes - 1, 0)
        low = np.minimum(at.astype(np.int64), max(nodes - 2, 0))
        out = np.zeros((len(z), nodes))
        rows = np.arange(len(z))
        out[rows, low] = 1 - (at - low)
        if nodes > 1:
            out[rows, low + 1] = at - low
        return out

    def scale(self, p: np.ndarray, z: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scales and their derivatives by the parameters."""
        a, b = self._weights(z, self.scales), self._weights(z, self.decays)
        c, half = a @ p[: self.scales], 1 / (2 * d * d)
        decay = np.exp(b @ p[self.scales :] * half)
        g = c * decay
        return g, np.concatenate([a * decay[:, None], b * (g * half)[:, None]], axis=1)


#: Observations of a bucket, about: 4 MB of a packed row.
BUCKET = 100_000


def packed(rows: DataFrame, keys: list[str], buckets: int | None = None) -> DataFrame:
    """One row for each bucket of groups: columns group, i, v, z, d as binary, in group order. rows need i, v, z and d.

    There are as many buckets as the rows call for, unless their number is given. A bucket holds whole groups, so it grows with
    the multiplicity of its largest one alone.
    """
    buckets = buckets or 1 + rows.count() // BUCKET
    own = rows.select(F.xxhash64(*keys).alias("g"), *(F.col(c).cast("double") for c in COLUMNS[1:])).withColumn("bucket", F.pmod(F.col("g"), F.lit(buckets)))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in COLUMNS])
        return pa.table({c: pa.array([table.column(c).to_numpy().tobytes()], type=pa.binary()) for c in COLUMNS})

    return checkpoint(own.groupBy("bucket").applyInArrow(run, ", ".join(f"{c} binary" for c in COLUMNS)))


def _unpacked(row: dict) -> tuple[np.ndarray, ...]:
    g = np.frombuffer(row["g"], dtype=np.int64)
    return np.flatnonzero(np.append(True, g[1:] != g[:-1])), *(np.frombuffer(row[c], dtype=np.float64) for c in COLUMNS[1:])


def normal_equations(heads: np.ndarray, i: np.ndarray, v: np.ndarray, z: np.ndarray, d: np.ndarray, model: Model, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(J^T W J, J^T W r, r^T W r) of residuals I - g I_h, I_h the best merged intensity and so a function of the parameters."""
    g, u = model.scale(p, z, d)
    w = 1 / v
    size = np.diff(np.append(heads, len(i)))
    sums = lambda x: np.add.reduceat(x, heads, axis=0)
    spread = lambda x: np.repeat(x, size, axis=0)
    b = sums(w * g * g)
    merged = sums(w * g * i) / b
    d_merged = (sums((w * i)[:, None] * u) - 2 * merged[:, None] * sums((w * g)[:, None] * u)) / b[:, None]
    many = spread(size > 1)
    r = np.where(many, i - g * spread(merged), 0)
    j = np.where(many[:, None], u * spread(merged)[:, None] + g[:, None] * spread(d_merged), 0)
    return (j * w[:, None]).T @ j, (j * w[:, None]).T @ r, float((w * r * r).sum())


def evaluate(data: DataFrame, model: Model, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """The normal equations over all buckets; summed in two steps, so the driver gets one row a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for row in batch.to_pylist():
                part = normal_equations(*_unpacked(row), model, p)
                total = part if total is None else tuple(x + y for x, y in zip(total, part, strict=True))
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([total[0].ravel(), total[1], [total[2]]]).tobytes()], type=pa.binary())], names=["sums"])

    def add(table: pa.Table) -> pa.Table:
        return pa.table({"sums": pa.array([sum(np.frombuffer(x, dtype=np.float64) for x in table.column("sums").to_pylist()).tobytes()], type=pa.binary())})

    parts = data.mapInArrow(run, "sums binary").withColumn("to", F.pmod(F.spark_partition_id(), F.lit(32)))
    sums = sum(np.frombuffer(r.sums, dtype=np.float64) for r in parts.groupBy("to").applyInArrow(add, "sums binary").collect())
    n = model.size
    return sums[: n * n].reshape(n, n), sums[n * n : n * n + n], float(sums[-1])


def fit(data: DataFrame, model: Model, rounds: int = 30, tolerance: float = 1e-7) -> tuple[np.ndarray, np.ndarray, float]:
    """(parameters, covariance, chi squared). The mean scale is held at 1, as only ratios are known."""
    p, damping = model.start(), 1e-3
    hold = np.concatenate([np.ones(model.scales) / model.scales, np.zeros(model.decays)])
    a, b, chi = evaluate(data, model, p)
    for _ in range(rounds):
        strong = np.trace(a) / model.size
        held = a + strong * np.outer(hold, hold) + 1e-9 * strong * np.eye(model.size)
        step = np.linalg.solve(held + damping * np.diag(np.diag(held)), b)
        new = p + step
        new[: model.scales] = np.maximum(new[: model.scales], 1e-3)
        new[: model.scales] /= new[: model.scales].mean()
        next_a, next_b, next_chi = evaluate(data, model, new)
        if next_chi < chi:
            done = chi - next_chi < tolerance * chi
            p, a, b, chi, damping = new, next_a, next_b, next_chi, damping / 5
            if done:
                break
        else:
            damping *= 5
            if damping > 1e8:
                break
    strong = np.trace(a) / model.size
    return p, np.linalg.pinv(a + strong * np.outer(hold, hold)), chi


def with_scale(rows: DataFrame, model: Model, p: np.ndarray, covariance: np.ndarray | None = None) -> DataFrame:
    """rows with their scale g and, given a covariance, its variance."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + ", scale double, scale_variance double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            g, u = model.scale(p, batch.column("z").to_numpy(zero_copy_only=False), batch.column("d").to_numpy(zero_copy_only=False))
            var = np.zeros(len(g)) if covariance is None else np.einsum("ij,jk,ik->i", u, covariance, u)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(g), pa.array(var)], names=[*batch.schema.names, "scale", "scale_variance"])

    return rows.mapInArrow(run, schema)


def error_model(rows: DataFrame, keys: list[str], value: str, variance: str, candidates: list[float] | None = None, bins: int = 10) -> tuple[float, float]:
    """(a, b) of var' = a^2 (var + (b I)^2): b makes squared deviations over var' most even between bins of intensity, a makes their mean 1.

    All candidates are reckoned in one pass; the driver gets bins times candidates of sums.
    """
    tried = candidates or [0.0, *np.geomspace(0.003, 0.3, 24).tolist()]
    own = leave_one_out(rows.select(*keys, F.col(value).alias("x"), F.col(variance).alias("v"), (1 / F.col(variance)).alias("w")), keys, "x", "w").filter("others IS NOT NULL")
    edges = own.select(F.percentile_approx("others", [k / bins for k in range(1, bins)], 1000).alias("e")).first()["e"] or []
    bin_of = sum(((F.col("others") > float(e)).cast("int") for e in edges), F.lit(0))
    factor = F.col("group_size") / (F.col("group_size") - 1)
    square = (F.col("x") - F.col("others")) * (F.col("x") - F.col("others"))
    each = [F.avg(square / (factor * (F.col("v") + float(b) ** 2 * F.col("others") * F.col("others")))).alias(f"b{k}") for k, b in enumerate(tried)]
    table = own.groupBy(bin_of.alias("bin")).agg(F.count("*").alias("n"), *each).collect()
    weights = np.array([r.n for r in table], dtype=float)
    best = None
    for k, b in enumerate(tried):
        m = np.array([r[f"b{k}"] for r in table])
        mean = (weights * m).sum() / weights.sum()
        uneven = (weights * (m / mean - 1) ** 2).sum()
        if best is None or uneven < best[0]:
            best = (uneven, float(np.sqrt(mean)), float(b))
    return best[1], best[2]


def scale(rows: DataFrame, keys: list[str], row_id: str, model: Model, buckets: int | None = None) -> tuple[DataFrame, dict]:
    """Fit, reject outliers, fit again, error model. rows need i, v, z and d; (rows that stay with scaled values, figures)."""
    live, figures = rows, {}
    for turn in range(2):
        p, covariance, chi = fit(packed(live, keys, buckets), model)
        scaled = with_scale(rows, model, p, covariance).withColumns({"i_scaled": F.col("i") / F.col("scale"), "v_scaled": F.col("v") / (F.col("scale") * F.col("scale")) + F.col("i") * F.col("i") * F.col("scale_variance") / F.pow(F.col("scale"), F.lit(4.0))})
        scaled = checkpoint(scaled)
        out = checkpoint(reject_outliers(scaled, keys, row_id, "i_scaled", "v_scaled"))
        live = rows.join(out, row_id, "left_anti")
        figures[f"outliers_{turn}"], figures[f"chi_{turn}"] = out.count(), chi
    kept = scaled.join(out, row_id, "left_anti")
    a, b = error_model(kept, keys, "i_scaled", "v_scaled")
    figures |= {"parameters": p, "covariance": covariance, "a": a, "b": b}
    return kept.withColumn("v_scaled", a * a * (F.col("v_scaled") + b * b * F.col("i_scaled") * F.col("i_scaled"))), figures
