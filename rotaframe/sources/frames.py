"""Detector frames from compressed chunks: where a chunk lies, reading ranges of a data file, and decompression.

A data file holds frames' chunks one after another, as a detector's writer leaves them; an index says where each frame's
is: rows (sweep, frame, path, offset, length), with a null offset for a frame that was never written. The index is a
table, so frames are dealt to tasks by Spark, and a task reads only its own ranges of the files. A chunk is bit-shuffled
LZ4 ("bslz4"), LZ4 in blocks ("lz4") or plain bytes (""), of little-endian unsigned pixels.

Frames come either as rows, by decoded() or by spark.read.format("frames"), or are searched for spots in the task that
decoded them, by signal_pixels(), so that no image crosses to the JVM.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from rotaframe.operators import images

# Fixed values of the format: bytes of the header (size of the frame, size of a block, both big-endian), bytes of a block's
# length, and the elements that a group of bits is shuffled by.
HEADER = struct.Struct(">QI")
LENGTH = struct.Struct(">I")
GROUP = 8
#: Bytes of a block that this module writes.
BLOCK = 8192
INDEX = "sweep long, frame int, path string, offset long, length long"
FRAMES = "sweep long, frame int, height int, width int, pixels array<long>"


@dataclass(frozen=True)
class Layout:
    """What all frames of an index have in common."""

    height: int
    width: int
    bits: int = 16
    algorithm: str = "bslz4"

    @property
    def element(self) -> int:
        return self.bits // 8

    @property
    def size(self) -> int:
        return self.height * self.width * self.element

    def __post_init__(self) -> None:
        if self.bits not in (8, 16, 32):
            raise ValueError(f"pixels of {self.bits} bits")
        if self.algorithm not in ("bslz4", "lz4", ""):
            raise ValueError(f"unknown compression {self.algorithm}")


def _transposed(words: np.ndarray) -> np.ndarray:
    """Each 64-bit word as an 8 x 8 matrix of bits, transposed: three rounds that swap ever larger quarters."""
    for shift, mask in ((7, 0x00AA00AA00AA00AA), (14, 0x0000CCCC0000CCCC), (28, 0x00000000F0F0F0F0)):
        swap = (words ^ (words >> np.uint64(shift))) & np.uint64(mask)
        words = words ^ swap ^ (swap << np.uint64(shift))
    return words


def unshuffled(block: np.ndarray, element: int) -> np.ndarray:
    """Bytes of elements from their shuffled bits: the first bits of all elements came first, then the second ones."""
    n = len(block) // element
    # (byte of the element, bit of the byte, eight elements a byte) to words of eight bits' bytes
    rows = block.reshape(element, 8, n // 8).transpose(0, 2, 1)
    words = _transposed(np.ascontiguousarray(rows).view(np.uint64)[..., 0])
    return np.ascontiguousarray(words.view(np.uint8).reshape(element, n).T).reshape(-1)


def shuffled(block: np.ndarray, element: int) -> np.ndarray:
    """The other way round."""
    n = len(block) // element
    words = np.ascontiguousarray(block.reshape(n, element).T).reshape(element, n // 8, 8).view(np.uint64)[..., 0]
    rows = _transposed(words).view(np.uint8).reshape(element, n // 8, 8)
    return np.ascontiguousarray(rows.transpose(0, 2, 1)).reshape(-1)


def decompress(chunk: bytes, layout: Layout) -> np.ndarray:
    """The frame of a chunk; a chunk that doesn't fit the layout is an error."""
    kind = np.dtype(f"<u{layout.element}")
    if not layout.algorithm:
        if len(chunk) != layout.size:
            raise ValueError(f"a plain frame of {len(chunk)} bytes, not {layout.size}")
        return np.frombuffer(chunk, dtype=kind).reshape(layout.height, layout.width)
    if len(chunk) < HEADER.size:
        raise ValueError("a chunk shorter than its header")
    size, block = HEADER.unpack_from(chunk)
    if size != layout.size:
        raise ValueError(f"a chunk of a frame of {size} bytes, not {layout.size}")
    shuffle = layout.algorithm == "bslz4"
    codec, view = pa.Codec("lz4_raw"), memoryview(chunk)
    block = block or (BLOCK if shuffle else size)
    if shuffle and block % (GROUP * layout.element):
        raise ValueError(f"blocks of {block} bytes")
    out, at, done = np.empty(size, dtype=np.uint8), HEADER.size, 0
    whole = size - size % (GROUP * layout.element) if shuffle else size  # what is left is stored as it is
    while done < whole:
        if at + LENGTH.size > len(chunk):
            raise ValueError("a chunk that ends early")
        (length,) = LENGTH.unpack_from(chunk, at)
        at += LENGTH.size
        wanted = min(block, whole - done)
        if not length or at + length > len(chunk):
            raise ValueError("a block that ends outside its chunk")
        # blocks that don't get smaller are stored as they are, but not among shuffled ones
        plain = not shuffle and length == wanted
        bytes_ = view[at : at + length] if plain else codec.decompress(view[at : at + length], decompressed_size=wanted)
        part = np.frombuffer(bytes_, dtype=np.uint8)
        out[done : done + wanted] = unshuffled(part, layout.element) if shuffle else part
        at, done = at + length, done + wanted
    if at + size - done > len(chunk):
        raise ValueError("a chunk that ends early")
    if done < size:
        out[done:] = np.frombuffer(view[at : at + size - done], dtype=np.uint8)
    return out.view(kind).reshape(layout.height, layout.width)


def compress(frame: np.ndarray, layout: Layout) -> bytes:
    """A frame as a chunk that decompress reads."""
    data = np.ascontiguousarray(frame, dtype=f"<u{layout.element}").reshape(-1).view(np.uint8)
    if not layout.algorithm:
        return data.tobytes()
    shuffle, codec, out = layout.algorithm == "bslz4", pa.Codec("lz4_raw"), [HEADER.pack(len(data), BLOCK)]
    whole = len(data) - len(data) % (GROUP * layout.element) if shuffle else len(data)
    for at in range(0, whole, BLOCK):
        part = data[at : min(at + BLOCK, whole)]
        packed = codec.compress((shuffled(part, layout.element) if shuffle else part).tobytes()).to_pybytes()
        if not shuffle and len(packed) >= len(part):
            packed = part.tobytes()
        out += [LENGTH.pack(len(packed)), packed]
    return b"".join([*out, data[whole:].tobytes()])


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pyarrow.fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
    return pyarrow.fs.LocalFileSystem(), path


def _chunks(index: pa.RecordBatch) -> Iterator[tuple[int, int, bytes]]:
    """sweep, frame and chunk of the rows that have one; a file is opened once for the rows that follow one another."""
    path, file = None, None
    try:
        for row in index.to_pylist():
            if row["offset"] is None or row["length"] is None:  # never written
                continue
            if row["path"] != path:
                if file is not None:
                    file.close()
                system, name = _opened(row["path"])
                path, file = row["path"], system.open_input_file(name)
            chunk = file.read_at(row["length"], row["offset"])
            if len(chunk) != row["length"]:
                raise ValueError(f"{path} ends inside the chunk of frame {row['frame']}")
            yield row["sweep"], row["frame"], chunk
    finally:
        if file is not None:
            file.close()


def _frame_batch(sweep: int, frame: int, image: np.ndarray) -> pa.RecordBatch:
    pixels = pa.ListArray.from_arrays(pa.array([0, image.size], type=pa.int32()), pa.array(image.reshape(-1).astype(np.int64)))
    return pa.RecordBatch.from_arrays([pa.array([sweep], type=pa.int64()), pa.array([frame], type=pa.int32()), *(pa.array([n], type=pa.int32()) for n in image.shape), pixels], names=["sweep", "frame", "height", "width", "pixels"])


def _in_order(index: DataFrame) -> DataFrame:
    return index.select("sweep", "frame", "path", "offset", "length")


def decoded(index: DataFrame, layout: Layout) -> DataFrame:
    """(sweep, frame, height, width, pixels) of the frames of an index; frames without a chunk aren't there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for sweep, frame, chunk in _chunks(batch):
                yield _frame_batch(sweep, frame, decompress(chunk, layout))

    return _in_order(index).mapInArrow(run, FRAMES)


def signal_pixels(index: DataFrame, layout: Layout, masked: DataFrame | None = None, threshold: images.Threshold = images.Threshold()) -> DataFrame:  # noqa: B008
    """(sweep, frame, y, x, value) of signal pixels, found where the chunks are decoded. masked: (y, x) of pixels never to be used, a detector's worth."""
    flat = [r.y * layout.width + r.x for r in masked.select("y", "x").distinct().collect()] if masked is not None else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.ones(layout.height * layout.width, dtype=bool)
        mask[flat] = False
        mask = mask.reshape(layout.height, layout.width)
        for batch in batches:
            for sweep, frame, chunk in _chunks(batch):
                image = decompress(chunk, layout).astype(np.int64)
                y, x = np.nonzero(images.signal(image, mask, threshold))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(y), sweep)), pa.array(np.full(len(y), frame, dtype=np.int32)), pa.array(y.astype(np.int32)), pa.array(x.astype(np.int32)), pa.array(image[y, x])], names=["sweep", "frame", "y", "x", "value"])

    return _in_order(index).mapInArrow(run, "sweep long, frame int, y int, x int, value long")


def spots(index: DataFrame, layout: Layout, masked: DataFrame | None = None, threshold: images.Threshold = images.Threshold(), least: int = 3) -> DataFrame:  # noqa: B008
    """From chunks to measured spots: signal pixels, components over frames, and their sums."""
    return images.measure_spots(images.pixel_components(signal_pixels(index, layout, masked, threshold)), least)


def write_chunks(frames: DataFrame, folder: str, layout: Layout) -> DataFrame:
    """Write frames (sweep, frame, pixels) as data files under folder, one for each task; the rows of their index.

    A null in place of pixels is a frame that isn't written. A task's file has a name of its own, so a task that is run
    again leaves at worst a file that no index names. The rows have to be stored by the caller: each reading writes anew.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, at, file = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.chunks", 0, None
        system, name = _opened(path)
        try:
            for batch in batches:
                out = []
                for sweep, frame, pixels in zip(*(batch.column(c) for c in ("sweep", "frame", "pixels")), strict=True):
                    if not pixels.is_valid:
                        out.append((sweep.as_py(), frame.as_py(), path, None, None))
                        continue
                    if file is None:
                        system.create_dir(name.rsplit("/", 1)[0], recursive=True)
                        file = system.open_output_stream(name)
                    chunk = compress(pixels.values.to_numpy(zero_copy_only=False).reshape(layout.height, layout.width), layout)
                    file.write(chunk)
                    out.append((sweep.as_py(), frame.as_py(), path, at, len(chunk)))
                    at += len(chunk)
                if out:
                    types = [pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["sweep", "frame", "path", "offset", "length"])
        finally:
            if file is not None:
                file.close()

    return frames.select(F.col("sweep").cast("long"), F.col("frame").cast("int"), "pixels").mapInArrow(run, INDEX)


@dataclass
class _Part(InputPartition):
    """Rows [first, first + n) of one row group of an index file."""

    path: str
    group: int
    first: int
    n: int


class _Reader(DataSourceReader):
    def __init__(self, path: str, layout: Layout, each: int) -> None:
        self.path, self.layout, self.each = path, layout, each

    def partitions(self) -> list[InputPartition]:
        """Ranges of frames; only the files' footers are read here, never their rows."""
        system, name = _opened(self.path)
        info = system.get_file_info(name)
        files = [name] if info.is_file else sorted(f.path for f in system.get_file_info(pyarrow.fs.FileSelector(name)) if f.is_file and f.path.endswith(".parquet"))
        parts = []
        for file in files:
            meta = pa.parquet.read_metadata(file, filesystem=system)
            for group in range(meta.num_row_groups):
                rows = meta.row_group(group).num_rows
                parts += [_Part(file, group, first, min(self.each, rows - first)) for first in range(0, rows, self.each)]
        return parts

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        index = pa.parquet.ParquetFile(part.path, filesystem=system).read_row_group(part.group, columns=["sweep", "frame", "path", "offset", "length"])
        for batch in index.slice(part.first, part.n).to_batches():
            for sweep, frame, chunk in _chunks(batch):
                yield _frame_batch(sweep, frame, decompress(chunk, self.layout))


class FrameSource(DataSource):
    """spark.read.format("frames").options(height=, width=, bits=, algorithm=, frames=).load(a Parquet index): frames as rows, `frames` of them a partition."""

    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return FRAMES

    def reader(self, schema) -> DataSourceReader:
        o = self.options
        return _Reader(o["path"], Layout(int(o["height"]), int(o["width"]), int(o.get("bits", "16")), o.get("algorithm", "bslz4")), int(o.get("frames", "100")))
