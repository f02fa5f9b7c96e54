"""Ranking, leave-one-out and trend computations."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .merging import medians, number_rows, running_sums


def leave_one_out(rows: DataFrame, keys: list[str], value: str, weight: str | None = None) -> DataFrame:
    """Each row with the (weighted) mean of the others in its group; null where it is alone."""
    w = F.col(weight) if weight else F.lit(1)
    sums = rows.groupBy(*keys).agg(F.sum(w).alias("_sw"), F.sum(w * F.col(value)).alias("_swx"), F.count("*").alias("group_size"))
    rest = F.when(F.col("group_size") > 1, (F.col("_swx") - w * F.col(value)) / (F.col("_sw") - w))
    return rows.join(sums, keys).withColumn("others", rest).drop("_sw", "_swx")


def ranks(rows: DataFrame, by: list[str], value: str, ties: list[str], name: str) -> DataFrame:
    """rows with the rank from 0 of their value in its group; equal values are ranked by `ties`. No task holds a group."""
    numbered = number_rows(rows, [F.asc(c) for c in (*by, value, *ties)])
    first = numbered.groupBy(*by).agg(F.min("row_number").alias("_first"))
    return numbered.join(first, by).withColumn(name, F.col("row_number") - F.col("_first")).drop("row_number", "n_rows", "_first")


def average_ranks(rows: DataFrame, by: list[str], value: str, name: str) -> DataFrame:
    """rows with the rank from 1 of their value in its group, equal values sharing their mean rank."""
    shared = _mean_ranks(rows, by, [value]).select(*by, F.col("_v").alias(value), F.col("_rank").alias(name))
    return rows.join(shared, [*by, value])


def _mean_ranks(rows: DataFrame, by: list[str], values: list[str]) -> DataFrame:
    """(by, _which, _v, _rank) of the distinct values of several columns of one type, all placed in one go."""
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("_which"), F.col(v).alias("_v")) for v in values))).alias("_e")
    counts = rows.select(*by, each).groupBy(*by, "_e._which", "_e._v").agg(F.count("*").alias("_equal"))
    placed = running_sums(counts, [F.asc(c) for c in (*by, "_which", "_v")], "_equal")
    first = placed.groupBy(*by, "_which").agg(F.min("before").alias("_first"))
    return placed.join(first, [*by, "_which"]).select(*by, "_which", "_v", (F.col("before") - F.col("_first") + (F.col("_equal") + 1) / 2).alias("_rank"))


def spearman(rows: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Rank correlation by group, ties averaged."""
    own = rows.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"))
    # rows that are equal in both are one with their number
    pairs = own.groupBy(*keys, "_x", "_y").agg(F.count("*").alias("_n"))
    ranks = _mean_ranks(own, keys, ["_x", "_y"])
    for name, v in (("_rx", "_x"), ("_ry", "_y")):
        pairs = pairs.join(ranks.filter(F.col("_which") == v).select(*keys, F.col("_v").alias(v), F.col("_rank").alias(name)), [*keys, v])
    n, a, b = F.col("_n"), F.col("_rx"), F.col("_ry")
    # ranks are about the group's middle, so that squares lose nothing
    middle = pairs.groupBy(*keys).agg(((F.sum(n) + 1) / 2).alias("_middle"))
    pairs = pairs.join(middle, keys).withColumns({"_rx": a - F.col("_middle"), "_ry": b - F.col("_middle")})
    sums = pairs.groupBy(*keys).agg(F.sum(n).alias("n"), F.sum(n * a * a).alias("_aa"), F.sum(n * b * b).alias("_bb"), F.sum(n * a * b).alias("_ab"))
    return sums.select(*keys, "n", F.when((F.col("_aa") > 0) & (F.col("_bb") > 0), F.col("_ab") / F.sqrt(F.col("_aa") * F.col("_bb"))).alias("rho"))


def reject_outliers(rows: DataFrame, keys: list[str], row_id: str, value: str, variance: str, limit: float = 6.0, least: int = 3) -> DataFrame:
    """(row_id) of outliers: in each group the worst deviation from the others is dropped and all is reckoned again,
    until none is beyond the limit or fewer than `least` are left. One outlier can hide another, so one pass won't do."""

    def run(table: pa.Table) -> pa.Table:
        x = table.column(value).to_numpy()
        w = 1 / table.column(variance).to_numpy()
        live = np.ones(len(x), dtype=bool)
        while live.sum() >= least:
            sw, swx = w[live].sum(), (w * x)[live].sum()
            rest = sw - w
            with np.errstate(divide="ignore", invalid="ignore"):
                z = np.abs(x - (swx - w * x) / rest) / np.sqrt(1 / w + 1 / rest)
            z[~live | ~np.isfinite(z)] = -1
            worst = int(z.argmax())
            if z[worst] <= limit:
                break
            live[worst] = False
        return pa.table({row_id: table.column(row_id).filter(pa.array(~live))})

    kind = rows.select(row_id).schema[0].dataType.simpleString()
    return rows.select(*keys, row_id, value, variance).groupBy(*keys).applyInArrow(run, f"{row_id} {kind}")


def trend_table(binned: DataFrame, x: str, y: str) -> DataFrame:
    """By bin: count, median of x and of y / x, Pearson's and Spearman's correlation, robust spread, and outliers beyond max(5 spread, 5 per cent).

    A bin may be as large as it likes; rows are read several times, so a costly input should be stored first.
    """
    from .storage import checkpoint

    rows = binned.filter(F.col(x) != 0).select("bin", F.col(x).alias("_x"), F.col(y).alias("_y"), (F.col(y) / F.col(x)).alias("_ratio"))
    counts = rows.groupBy("bin").agg(F.count("*").alias("n"), F.corr("_x", "_y").alias("pearson"))
    # a row a bin, used more than once
    middle = checkpoint(medians(rows, "bin", ["_x", "_ratio"])).withColumnsRenamed({"_x": "median_x", "_ratio": "median_ratio"})
    off = rows.join(middle, "bin").select("bin", F.abs(F.col("_ratio") - F.col("median_ratio")).alias("_off"))
    spread = checkpoint(medians(off, "bin", ["_off"])).select("bin", (F.col("_off") * 1.4826).alias("spread"))
    limit = F.greatest(5 * F.col("spread"), F.lit(0.05))
    outliers = off.join(spread, "bin").groupBy("bin").agg(F.sum((F.col("_off") > limit).cast("long")).alias("outliers"))
    ranked = spearman(rows, ["bin"], "_x", "_y").select("bin", F.col("rho").alias("spearman"))
    return counts.join(middle, "bin").join(spread, "bin").join(outliers, "bin").join(ranked, "bin")


def gaps(rows: DataFrame, keys: list[str], at: str, row_id: str) -> DataFrame:
    """Steps between repeats of a key."""
    w = Window.partitionBy(*keys).orderBy(at, row_id)
    return rows.withColumn("gap", F.col(at) - F.lag(at).over(w)).filter("gap IS NOT NULL")


def chains(rows: DataFrame, keys: list[str], at: str, row_id: str, gap: float) -> DataFrame:
    """Rows with the number of their run within the key: a step of more than `gap` begins a new one."""
    w = Window.partitionBy(*keys).orderBy(at, row_id)
    new = F.when(F.col(at) - F.lag(at).over(w) > gap, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn("chain", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")
