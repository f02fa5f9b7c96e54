"""Helpers shared by the operators on training text."""

from __future__ import annotations

import ctypes
import functools
import inspect
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a maximal run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's spark.checkpoint.dir.

    Only where that is unset and all runs on one machine, as in tests, a temporary folder is made.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local[") and context.master != "local":
            raise RuntimeError("spark.checkpoint.dir isn't set: the executors need a folder that all of them share")
        folder = tempfile.mkdtemp(prefix="rotaframe-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def with_own_names(operator: Callable) -> Callable:
    """An operator on docs that returns its columns, run with columns named by their place, so that none can clash with its own."""
    signature = inspect.signature(operator)

    @functools.wraps(operator)
    def own(docs: DataFrame, *args, **options) -> DataFrame:
        bound = signature.bind(docs, *args, **options)
        bound.apply_defaults()
        places = {c: f"column{i}" for i, c in enumerate(docs.columns)}
        bound.arguments["docs"] = docs.toDF(*places.values())
        for name in ("id_col", "text_col", "source_col"):
            if name in bound.arguments:
                bound.arguments[name] = places[bound.arguments[name]]
        return operator(*bound.args, **bound.kwargs).toDF(*docs.columns)

    return own


def trimmed(run: Callable) -> Callable:
    """A function for mapInArrow that gives its worker's freed memory back to the system when a task ends; workers live on."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return own


def give_back() -> None:
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a copy in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage of df with a table written in the shared folder; smaller than a checkpoint of the same rows."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(column: str):
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def partitions_for(rows_or_bytes: int, each: int, least: int = 1) -> int:
    """Partitions so that each gets about `each` units; grows with the input."""
    return max(least, -(-int(rows_or_bytes) // each))


def joined_groups(rows: DataFrame, keys: list[str], groups: Callable[[DataFrame], DataFrame], counters: int = 512) -> DataFrame:
    """rows joined with groups(rows), an aggregate by the (long) keys; a key with a large share of all rows is no burden to one task.

    A Misra-Gries summary names every key that more than one row in `counters` has. Rows of those that prove that
    frequent, `counters` keys at most, meet their broadcast aggregate on the map side; all others are shuffled.
    rows are read several times, so they should be stored.
    """
    n = rows.count()
    mark = F.xxhash64(*keys)  # two keys with one mark go the same way, and are told apart there
    named = rows.select(mark.alias("mark")).stat.freqItems(["mark"], 1 / counters).first()[0]
    counts = rows.select(mark.alias("mark")).filter(F.col("mark").isin(named)).groupBy("mark").agg(F.count("*").alias("met"))
    heavy = [r.mark for r in counts.filter((F.col("met") > 1) & (F.col("met") * counters >= n)).collect()]  # counters at most
    frequent, rare = rows.filter(mark.isin(heavy)), rows.filter(~mark.isin(heavy))
    return frequent.join(F.broadcast(groups(frequent)), keys).unionByName(rare.join(groups(rare), keys))
