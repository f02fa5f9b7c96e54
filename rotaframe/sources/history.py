"""A history of runs: figures by data set and commit, and whether a new run's are within tolerance of the last one's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Relative and absolute tolerance of each kind of figure.
TOLERANCES = {"accuracy": (0.01, 0.0), "seconds": (0.10, 0.5), "memory_mb": (0.10, 10.0)}


def record(runs: DataFrame, path: str) -> None:
    """Append rows (dataset, commit, at, kind, name, value)."""
    runs.select("dataset", "commit", "at", "kind", "name", "value").write.mode("append").partitionBy("dataset").parquet(path)


def compared(history: DataFrame) -> DataFrame:
    """Each figure with the one before it of its data set and name, and whether it is within tolerance."""
    w = Window.partitionBy("dataset", "kind", "name").orderBy("at", "commit")
    relative, absolute = F.lit(None).cast("double"), F.lit(None).cast("double")
    for kind, (r, a) in TOLERANCES.items():
        relative = F.when(F.col("kind") == kind, F.lit(r)).otherwise(relative)
        absolute = F.when(F.col("kind") == kind, F.lit(a)).otherwise(absolute)
    out = history.withColumn("before", F.lag("value").over(w))
    within = F.abs(F.col("value") - F.col("before")) <= F.greatest(relative * F.abs("before"), absolute)
    return out.withColumn("within", F.coalesce(within, F.col("before").isNull()))
