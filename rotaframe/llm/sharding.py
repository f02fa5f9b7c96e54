"""Sharding by a Feistel permutation of global row numbers.

Rows are numbered 0 to n - 1 in id order without one global sort in a task: a
range partitioning sorts slices, and each slice starts at the sum of the counts
before it. A balanced Feistel network of eight rounds permutes the smallest
even-bit domain that holds n; a value that lands beyond n is put through the
network again (cycle walking) until it lands inside, which keeps the map a
permutation of exactly 0 to n - 1. The permuted number m of a row gives its
shard m mod k and its slot m div k, both computable from the row number alone
and invertible, and row counts of shards differ by one at most.

Defined cases: a null text has no bytes (size 1, crc32 0); null ids come first;
repeated rows are told apart by their text's crc32, and identical ones by the
order in which they are met; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, text_or_empty

ROUNDS = 8


def _mix(x: np.ndarray, key: int) -> np.ndarray:
    x = (x + np.uint64(key)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Permutation:
    """A keyed permutation of range(n), with its inverse."""

    def __init__(self, n: int, seed: int) -> None:
        self.n = n
        self.half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
        self.keys = [(seed * 0x2545F4914F6CDD1D + r * 0x9E3779B97F4A7C15) & (2**64 - 1) for r in range(ROUNDS)]

    def _network(self, x: np.ndarray, keys: list[int], back: bool) -> np.ndarray:
        mask = np.uint64((1 << self.half) - 1)
        left, right = x >> np.uint64(self.half), x & mask
        for key in keys:
            if back:
                left, right = right ^ (_mix(left, key) & mask), left
            else:
                left, right = right, left ^ (_mix(right, key) & mask)
        return (left << np.uint64(self.half)) | right

    def _walk(self, x, keys: list[int], back: bool) -> np.ndarray:
        out = self._network(np.asarray(x, dtype=np.uint64), keys, back)
        while (outside := np.flatnonzero(out >= self.n)).size:
            out[outside] = self._network(out[outside], keys, back)
        return out.astype(np.int64)

    def of(self, x) -> np.ndarray:
        return self._walk(x, self.keys, False)

    def inverse(self, y) -> np.ndarray:
        return self._walk(y, self.keys[::-1], True)


def numbered(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows with row_number from 0 in the given order, and the total as n_rows."""
    # a checkpoint, so that a task that is run again finds the same rows in the same slice
    held = checkpoint(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("slice_row", F.monotonically_increasing_id()))
    held = held.withColumns({"slice": F.shiftright("slice_row", 33), "in_slice": F.col("slice_row").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = held.groupBy("slice").agg(F.count("*").alias("rows"))  # one row a partition
    every = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumns({"start": F.coalesce(F.sum("rows").over(every), F.lit(0)), "n_rows": F.sum("rows").over(Window.partitionBy(F.lit(0)))})
    return held.join(F.broadcast(starts.drop("rows")), "slice").withColumn("row_number", F.col("start") + F.col("in_slice")).drop("slice", "slice_row", "in_slice", "start")


def shard(docs: DataFrame, shards: int = 8, seed: int = 9, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, row_number, n_rows, shard, slot for each row of docs."""
    text = text_or_empty(text_col).cast("binary")
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text).alias("text_crc32")), ["doc_id", "text_crc32"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        permutation = None
        for batch in batches:
            if batch.num_rows:
                permutation = permutation or Permutation(batch.column("n_rows")[0].as_py(), seed)
                m = permutation.of(batch.column("row_number").to_numpy())
                batch = pa.RecordBatch.from_arrays([*batch.columns, pa.array((m % shards).astype(np.int32)), pa.array(m // shards)], names=[*batch.schema.names, "shard", "slot"])
                yield batch

    kind = rows.select("doc_id").schema[0].dataType.simpleString()
    return rows.select("doc_id", "size", "text_crc32", "row_number", "n_rows").mapInArrow(place, f"doc_id {kind}, size long, text_crc32 long, row_number long, n_rows long, shard int, slot long")


def read_order(docs: DataFrame, numbers: DataFrame, shards: int, at: int) -> DataFrame:
    """The rows of one shard in the order in which it is read."""
    own = numbers.filter(F.col("shard") == at).select("doc_id", "slot")
    return docs.join(own, "doc_id").orderBy("slot")
