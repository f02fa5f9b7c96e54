"""Token ids as checksummed binary blocks, written and read back by Spark.

Documents are dealt to files by ranges of their id and stand in ascending id
order in each. A file is a run of blocks (see coder.py) of whole documents, of
about `block_ids` ids each; a longer document makes a longer block. Blocks are
rows of a table in the folder that all executors share, so Spark's commit
protocol holds when a task or an executor is lost, and any store will do.

Defined cases: a null or empty text is its end id alone; null ids come first;
repeated rows are written as rows of their own; an empty table gives no block;
other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from typing import ClassVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .coder import decode_block, encode_block
from .common import shared_folder, text_or_empty, trimmed
from .tokens import Encoder

BLOCK_IDS = 1 << 20


class BlockEncoder(Encoder):
    """An encoder with a memo of about 150 MB and larger chunks: fewer pieces are encoded or looked up again."""

    _of: ClassVar[dict[str, Encoder]] = {}
    most: ClassVar[int | None] = 800_000
    chunk: ClassVar[int | None] = 1 << 22


def write_blocks(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, block_ids: int = BLOCK_IDS, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write docs' ids under path: file, number (of the block in its file), n_ids, block."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").select("doc_id", "text", F.spark_partition_id().alias("file"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = BlockEncoder.shared(vocabulary)
        size = encoder.tokenizer.get_vocab_size()
        names, held, n, number, file = [], [], 0, 0, 0

        def block() -> pa.RecordBatch:
            ids = np.concatenate(held)
            data = encode_block(names, [len(x) for x in held], ids, size)
            return pa.RecordBatch.from_arrays([pa.array([file], type=pa.int32()), pa.array([number], type=pa.int32()), pa.array([len(ids)], type=pa.int64()), pa.array([data], type=pa.binary())], names=["file", "number", "n_ids", "block"])

        for batch in batches:
            if batch.num_rows:
                file = batch.column("file")[0].as_py()
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.encode_column(batch.column("text")), strict=True):
                if held and n + len(ids) >= block_ids:
                    yield block()
                    names, held, n, number = [], [], 0, number + 1
                names.append(doc_id)
                held.append(np.append(ids, np.uint16(end_id)))
                n += len(ids) + 1
        if held:
            yield block()

    rows.mapInArrow(trimmed(run), "file int, number int, n_ids long, block binary").write.parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    blocks = spark.read.parquet(path)
    # two levels of running sums: over files, one row each, and over the blocks of a file
    files = blocks.groupBy("file").agg(F.sum("n_ids").alias("in_file"))
    files = files.withColumn("file_start", F.coalesce(F.sum("in_file").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("in_file")
    starts = blocks.select("file", "number", "n_ids").withColumn("before", F.coalesce(F.sum("n_ids").over(Window.partitionBy("file").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    starts = starts.join(files, "file").select("file", "number", (F.col("file_start") + F.col("before")).alias("block_start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file, number = batch.column("file")[i], batch.column("number")[i]
                names, lengths, ids = decode_block(batch.column("block")[i].as_py())
                ends = np.cumsum(lengths)
                data = ids.astype("<u4").tobytes()
                crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip((ends - lengths).tolist(), ends.tolist(), strict=True)]
                n = len(names)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file.as_py()] * n, type=pa.int32()), pa.array([number.as_py()] * n, type=pa.int32()), pa.array(names, type=pa.int64()), pa.array(ends - lengths), pa.array(lengths), pa.array(crc, type=pa.int64())],
                    names=["file", "number", "doc_id", "in_block", "n_tokens", "ids_crc32"],
                )

    # blocks are large rows: few at a time cross to Python
    docs = blocks.select("file", "number", "block").mapInArrow(trimmed(run), "file int, number int, doc_id long, in_block long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["file", "number"]).select("doc_id", (F.col("block_start") + F.col("in_block")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, vocabulary: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write docs to a new folder of the shared place and read them back."""
    path = f"{shared_folder(docs.sparkSession)}/token-ids-{uuid.uuid4().hex}"
    write_blocks(docs, path, vocabulary, end_id, id_col=id_col, text_col=text_col)
    return read_blocks(docs.sparkSession, path)
