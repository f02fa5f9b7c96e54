"""Twinning tests on merged intensities: joins on transformed indices and single aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .joins import symmetry_mates

#: Steps between reflections that twinning doesn't relate but whose mean intensities are alike.
STEPS = [(2, 0, 0), (0, 2, 0), (0, 0, 2), (2, 2, 0), (2, 0, 2), (0, 2, 2)]


def l_test(merged: DataFrame, value: str = "i") -> DataFrame:
    """Mean |L| and L^2 of L = (I1 - I2) / (I1 + I2) over near pairs. Acentric: 0.5 and 1/3 without, 0.375 and 0.2 with perfect twinning."""
    steps = F.explode(F.array(*(F.struct(*(F.lit(x).alias(n) for x, n in zip(s, ("dh", "dk", "dl"), strict=True))) for s in STEPS)))
    moved = merged.select("h", "k", "l", F.col(value).alias("a"), steps.alias("s"))
    moved = moved.select((F.col("h") + F.col("s.dh")).alias("h"), (F.col("k") + F.col("s.dk")).alias("k"), (F.col("l") + F.col("s.dl")).alias("l"), "a")
    both = moved.join(merged.select("h", "k", "l", F.col(value).alias("b")), ["h", "k", "l"]).filter("a + b > 0")
    ratio = (F.col("a") - F.col("b")) / (F.col("a") + F.col("b"))
    return both.agg(F.count("*").alias("pairs"), F.avg(F.abs(ratio)).alias("mean_l"), F.avg(ratio * ratio).alias("mean_l2"))


def law_tests(merged: DataFrame, law: list[Column], value: str = "i") -> DataFrame:
    """R twin and the twin fraction by the H test for one law: mean H = 1/2 - fraction for acentric data."""
    both = symmetry_mates(merged, ["h", "k", "l"], law, value).withColumn("mate", F.col(f"{value}_mate")).filter((F.col(value) + F.col("mate")) > 0)
    off, total = F.abs(F.col(value) - F.col("mate")), F.col(value) + F.col("mate")
    return both.agg(F.count("*").alias("pairs"), (F.sum(off) / F.sum(F.abs(total))).alias("r_twin"), F.avg(off / total).alias("mean_h")).withColumn("fraction", F.greatest(F.lit(0.0), 0.5 - F.col("mean_h")))


def verdict(mean_l: float, second_moment: float) -> str:
    """From the L test and the second moment <I^2> / <I>^2 (2 without, 1.5 with perfect twinning)."""
    if mean_l < 0.44 and second_moment < 1.8:
        return "twinned"
    return "untwinned" if mean_l > 0.47 else "doubtful"
