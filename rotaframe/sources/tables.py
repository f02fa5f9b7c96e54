"""Tables and models in files: reflection tables in MessagePack, experiment lists in JSON, frames in Parquet.

The native form of everything is Parquet. The MessagePack form is read and written a file at a time by
executors (binaryFile in, one row a file out), so any store that Spark reads will do.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Type names of columns in files, with the stored numbers' kind and how many make a value.
COLUMN_TYPES = {
    "int": ("<i4", 1), "std::size_t": ("<u8", 1), "double": ("<f8", 1), "bool": ("u1", 1), "vec2<double>": ("<f8", 2), "vec3<double>": ("<f8", 3),
    "mat3<double>": ("<f8", 9), "int6": ("<i4", 6), "cctbx::miller::index<>": ("<i4", 3), "tiny<int,2>": ("<i4", 2),
}


def unpack(data: bytes, at: int = 0):
    """One MessagePack value and where it ends."""
    b = data[at]
    if b < 0x80:
        return b, at + 1
    if b >= 0xE0:
        return b - 256, at + 1
    if b < 0x90:
        return _map(data, at + 1, b & 15)
    if b < 0xA0:
        return _list(data, at + 1, b & 15)
    if b < 0xC0:
        n = b & 31
        return data[at + 1 : at + 1 + n].decode(), at + 1 + n
    if b in (0xC0, 0xC2, 0xC3):
        return {0xC0: None, 0xC2: False, 0xC3: True}[b], at + 1
    numbers = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
    if b in numbers:
        size = struct.calcsize(numbers[b])
        return struct.unpack_from(numbers[b], data, at + 1)[0], at + 1 + size
    lengths = {0xC4: ">B", 0xC5: ">H", 0xC6: ">I", 0xD9: ">B", 0xDA: ">H", 0xDB: ">I", 0xDC: ">H", 0xDD: ">I", 0xDE: ">H", 0xDF: ">I"}
    if b not in lengths:
        raise ValueError(f"MessagePack type {b:#x} isn't read")
    n = struct.unpack_from(lengths[b], data, at + 1)[0]
    start = at + 1 + struct.calcsize(lengths[b])
    if b <= 0xC6:
        return data[start : start + n], start + n
    if b <= 0xDB:
        return data[start : start + n].decode(), start + n
    return _list(data, start, n) if b <= 0xDD else _map(data, start, n)


def _list(data: bytes, at: int, n: int):
    out = []
    for _ in range(n):
        value, at = unpack(data, at)
        out.append(value)
    return out, at


def _map(data: bytes, at: int, n: int):
    out = {}
    for _ in range(n):
        key, at = unpack(data, at)
        out[key], at = unpack(data, at)
    return out, at


def pack(value) -> bytes:
    """MessagePack of None, bools, ints, floats, strings, bytes, lists and maps."""
    if value is None or isinstance(value, bool):
        return {None: b"\xc0", False: b"\xc2", True: b"\xc3"}[value]
    if isinstance(value, int):
        if 0 <= value < 128:
            return bytes([value])
        return struct.pack(">Bq", 0xD3, value) if value < 1 << 63 else struct.pack(">BQ", 0xCF, value)
    if isinstance(value, float):
        return struct.pack(">Bd", 0xCB, value)
    if isinstance(value, str):
        raw = value.encode()
        return struct.pack(">BI", 0xDB, len(raw)) + raw
    if isinstance(value, bytes):
        if len(value) >= 1 << 32:
            raise ValueError("a column of 4 GB or more has no MessagePack form; write Parquet")
        return struct.pack(">BI", 0xC6, len(value)) + value
    if isinstance(value, list | tuple):
        return struct.pack(">BI", 0xDD, len(value)) + b"".join(map(pack, value))
    return struct.pack(">BI", 0xDF, len(value)) + b"".join(pack(k) + pack(v) for k, v in value.items())


def decode_table(data: bytes) -> tuple[dict[str, tuple[str, np.ndarray]], dict[int, str], int]:
    """(columns: type and values, identifiers, rows) of a file's bytes: [kind, version, {identifiers, nrows, data}]."""
    _, _, body = unpack(data)[0]
    rows, columns = int(body["nrows"]), {}
    for name, (kind, (n, raw)) in body["data"].items():
        if kind in COLUMN_TYPES:
            dtype, width = COLUMN_TYPES[kind]
            x = np.frombuffer(raw, dtype=dtype)
            columns[name] = (kind, x if width == 1 else x.reshape(n, width))
    return columns, {int(k): v for k, v in (body.get("identifiers") or {}).items()}, rows


def encode_table(columns: dict[str, tuple[str, np.ndarray]], identifiers: dict[int, str] | None = None) -> bytes:
    data = {}
    for name, (kind, x) in columns.items():
        dtype, width = COLUMN_TYPES[kind]
        data[name] = [kind, [len(x), np.ascontiguousarray(x, dtype=dtype).tobytes()]]
    rows = max((len(x) for _, x in columns.values()), default=0)
    return pack(["dials::af::reflection_table", 1, {"identifiers": dict(identifiers or {}), "nrows": rows, "data": data}])


def _spark_type(kind: str) -> str:
    dtype, width = COLUMN_TYPES[kind]
    base = {"<i4": "int", "<u8": "long", "<f8": "double", "u1": "boolean"}[dtype]
    return base if width == 1 else f"array<{base}>"


def read_tables(spark: SparkSession, path: str, columns: dict[str, str]) -> DataFrame:
    """Rows of all table files under a path, with row_id and file. columns: name to type name; files must have them."""
    schema = "file string, row_id long, " + ", ".join(f"`{n}` {_spark_type(k)}" for n, k in columns.items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found, _, rows = decode_table(content)
                arrays = [pa.array([file] * rows), pa.array(np.arange(rows))]
                for name, kind in columns.items():
                    if name not in found or found[name][0] != kind:
                        raise ValueError(f"{file} has no column {name} of type {kind}")
                    x = found[name][1]
                    x = x.astype(bool) if kind == "bool" else x.astype(np.int64) if kind == "std::size_t" else x
                    arrays.append(pa.array(x) if x.ndim == 1 else pa.array(list(x)))
                yield pa.RecordBatch.from_arrays(arrays, names=["file", "row_id", *columns])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, schema)


def experiment_rows(spark: SparkSession, path: str) -> DataFrame:
    """One row for each experiment of a JSON list: its index, identifier and models as JSON text."""
    kinds = ("beam", "detector", "goniometer", "scan", "crystal")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("value").to_pylist():
                document = json.loads(content)
                rows = []
                for i, e in enumerate(document.get("experiment", [])):
                    model = lambda k: json.dumps(document[k][e[k]]) if isinstance(e.get(k), int) and e[k] >= 0 else None  # noqa: B023, E731
                    rows.append((i, e.get("identifier", ""), *(model(k) for k in kinds)))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int32() if k == 0 else pa.string()) for k, c in enumerate(zip(*rows, strict=True))], names=["id", "identifier", *kinds])

    return spark.read.text(path, wholetext=True).mapInArrow(run, "id int, identifier string, " + ", ".join(f"{k} string" for k in kinds))


def experiment_document(rows: list[tuple[str, dict[str, dict | None]]]) -> dict:
    """A JSON list from (identifier, models); equal models are written once and shared by index."""
    document: dict = {"__id__": "ExperimentList", "experiment": []}
    for identifier, models in rows:
        entry: dict = {"__id__": "Experiment", "identifier": identifier, "imageset": -1}
        for kind, model in models.items():
            own = document.setdefault(kind, [])
            if model is not None:
                if model not in own:
                    own.append(model)
                entry[kind] = own.index(model)
        document["experiment"].append(entry)
    return document


def unmerged_export(rows: DataFrame, least_i_over_sigma: float = -5.0, least_partiality: float = 0.99) -> DataFrame:
    """Rows and columns of an unmerged export, one batch an image: the filter and corrections, to be written as Parquet or CSV."""
    keep = (F.col("v") > 0) & (F.col("i") / F.sqrt("v") >= least_i_over_sigma) & (F.col("partiality") >= least_partiality)
    return rows.filter(keep).select("h", "k", "l", (F.floor("z") + 1).cast("int").alias("batch"), F.col("i").cast("float"), F.sqrt("v").cast("float").alias("sigma"), F.col("partiality").cast("float"), F.col("d").cast("float"))
