"""A Spark session with the settings this library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str = "local[*]", shuffle_partitions: int = 200, **conf: str) -> SparkSession:
    """Adaptive execution with skew-join splitting, Arrow transfer, UTC. On a cluster, pass master and sizes by spark-submit."""
    builder = (
        SparkSession.builder.master(master)
        .appName("rotaframe")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
