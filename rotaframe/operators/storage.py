"""Cutting lineage in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; only where that is unset and all runs on one machine, as in tests, a temporary folder."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (context.master == "local" or context.master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir isn't set: the executors need a folder that all of them share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="rotaframe-"))
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """A copy of df in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, path: str | None = None) -> DataFrame:
    """df as a table written in the shared folder, at a path of its own unless given; what is there is replaced.

    A checkpoint hands on the size that its plan was reckoned to have, and a join's is the product of its sides': after
    some rounds of joins such a number takes all of the driver's memory. A table has the size of its files.
    """
    path = path or f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
