"""Suffix-array dedup of long repeated substrings, by longest-previous-factor arrays.

A byte goes if it is in a substring of `length` bytes that also starts
elsewhere: anywhere else (keep_first=False), or anywhere before, in the order of
document ids and positions (keep_first=True, which keeps the first copy).

No machine can hold the suffix array of all documents, so suffixes are first
dealt to groups in which all equal ones meet:

1. Each window of `length` bytes names its anchor, the leftmost least hash of
   its GRAM-byte substrings. Equal windows have equal anchors at equal places.
   Neighbouring windows mostly share an anchor; runs of them, cut into cells by
   their distance x to the anchor, are the records. All windows of a cell
   contain one core, and a record's key is the hash of it; its content hash is
   that of all its bytes.
2. A key met once is done: its windows are found nowhere else. Records with one
   key and one content are copies as a whole.
3. Keys with several contents need a closer look. One record of each content
   sends its bytes to a task with all others of its key. There the suffixes of
   the group are ordered by prefix doubling up to `length` bytes; for each, the
   nearest smaller text positions before and after it in suffix order give its
   longest previous factor, and whether that reaches `length`.
4. A key with more than HOT contents is never brought together: its records are
   cut into narrower cells, and at last into single windows, where equal keys
   mean equal windows and counting is all that is left.
5. Spans are united per document and cut out.

Defined cases: a null or empty text has no bytes; matches never cross
documents; repeated rows are documents of their own, so all of a long one goes
if keep_first is not set, and both stay if it is (rows are told apart by a
64-bit hash of id and text); an empty table gives an empty
result; texts under `length` bytes stay whole; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import joined_groups, partitions_for, text_or_empty, trimmed, written
from .quality import nearest_smaller, union_spans

GRAM = 64
#: Widths of cells: of the first records, and of a hot key's.
CELL, NARROW = 113, 12
#: Contents of a key that are brought together in one task, about 1 MB.
HOT = 2048
#: Bytes of text worked on at a time, and of contents in a task of step 3.
BATCH, TASK = 1 << 20, 1 << 20
POSITION = 21  # bits of a position in a batch
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
BASE = 0x9E3779B97F4A7C15 | 1
UNBASE = pow(BASE, -1, 1 << 64)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


_LETTER = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 to base**(n - 1), modulo 2**64."""
    if len(_powers.get(base, ())) < n:
        own = np.full(max(n, BATCH + 1), base, dtype=np.uint64)
        own[0] = 1
        _powers[base] = np.cumprod(own, dtype=np.uint64)
    return _powers[base][:n]


class Hashes:
    """Hashes of any substrings of some bytes, each in constant time."""

    def __init__(self, data: np.ndarray) -> None:
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(_LETTER[data] * _power(BASE, len(data)), dtype=np.uint64)])
        self.back = _power(UNBASE, len(data) + 1)

    def of(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[begin]) * self.back[begin] + (end - begin).astype(np.uint64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of all windows of `width` values, from those of blocks' beginnings and ends."""
    n = len(x)
    blocks = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, dtype=x.dtype)
    blocks[:n] = x
    blocks = blocks.reshape(-1, width)
    from_left = np.minimum.accumulate(blocks, axis=1).ravel()
    from_right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(from_right[: n - width + 1], from_left[width - 1 : n])


def anchors(data: np.ndarray, ends: np.ndarray, length: int, hashes: Hashes) -> tuple[np.ndarray, ...]:
    """Runs of windows with one anchor: (owner, anchor, first window, last window); ends: of the documents in data."""
    n = len(data)
    begins = np.concatenate([[0], ends[:-1]])
    owners = np.repeat(np.arange(len(ends)), np.maximum(0, ends - begins - length + 1))
    if not len(owners):
        return owners, owners, owners, owners
    counts = np.maximum(0, ends - begins - length + 1)
    windows = np.arange(len(owners)) - np.repeat(np.cumsum(counts) - counts, counts) + begins[owners]
    p = np.arange(n - GRAM + 1)
    grams = hashes.of(p, p + GRAM)
    # the leftmost of equal hashes: positions in the lower bits
    marked = (grams >> np.uint64(POSITION) << np.uint64(POSITION)) | p.astype(np.uint64)
    at = (sliding_min(marked, length - GRAM + 1)[windows] & np.uint64((1 << POSITION) - 1)).astype(np.int64)
    new = np.append(True, (at[1:] != at[:-1]) | (owners[1:] != owners[:-1]))
    heads = np.flatnonzero(new)
    return owners[heads], at[heads], windows[heads], windows[np.append(heads[1:] - 1, len(windows) - 1)]


def cells(anchor: np.ndarray, first: np.ndarray, last: np.ndarray, width: int, most: int) -> tuple[np.ndarray, ...]:
    """Runs cut by x = anchor - window into cells of `width`: (run, first window, last window, core's begin, core's least x end)."""
    low, high = (anchor - last) // width, (anchor - first) // width
    count = high - low + 1
    run = np.repeat(np.arange(len(anchor)), count)
    cell = np.arange(len(run)) - np.repeat(np.cumsum(count) - count, count) + low[run]
    x_low, x_high = cell * width, np.minimum((cell + 1) * width - 1, most)
    return run, np.maximum(first[run], anchor[run] - x_high), np.minimum(last[run], anchor[run] - x_low), anchor[run] - x_low, anchor[run] - x_high


def records(data: np.ndarray, hashes: Hashes, anchor: np.ndarray, first: np.ndarray, last: np.ndarray, length: int, width: int) -> tuple[np.ndarray, ...]:
    """(run, first window, last window, key, content) of all cells."""
    run, a, b, latest, earliest = cells(anchor, first, last, width, length - GRAM)
    # the core is in every window of a cell: from the start of its latest to the end of its earliest
    key = _mix(hashes.of(latest, earliest + length) + (anchor[run] - latest).astype(np.uint64))
    content = _mix(hashes.of(a, b + length) ^ ((anchor[run] - a).astype(np.uint64) << np.uint64(32)))
    return run, a, b, key.view(np.int64), content.view(np.int64)


RECORD = "key long, content long, doc long, start long, windows int"


def _batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list[bytes]]]:
    docs, texts, total = [], [], 0
    for batch in batches:
        for d, t in zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True):
            text = t.as_py()
            if texts and total + len(text) > size:
                yield docs, texts
                docs, texts, total = [], [], 0
            docs.append(d)
            texts.append(text)
            total += len(text)
    if texts:
        yield docs, texts


def _parts(text: bytes, length: int) -> Iterator[tuple[int, bytes]]:
    """A very long text in parts that share all but one byte of a window, so that every window is in one part."""
    step = (1 << POSITION) - 2 * length
    for at in range(0, max(1, len(text) - length + 1), step):
        yield at, text[at : at + step + length - 1]


def _find_records(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for docs, texts in _batches(batches, BATCH):
            parts = [(d, at, part) for d, t in zip(docs, texts, strict=True) if len(t) >= length for at, part in _parts(t, length)]
            while parts:  # a batch's positions must fit
                some, total = [], 0
                while parts and (not some or total + len(parts[0][2]) < 1 << POSITION):
                    some.append(parts.pop(0))
                    total += len(some[-1][2])
                data = np.frombuffer(b"".join(p for _, _, p in some), dtype=np.uint8)
                ends = np.cumsum([len(p) for _, _, p in some])
                hashes = Hashes(data)
                owner, anchor, first, last = anchors(data, ends, length, hashes)
                r, a, b, key, content = records(data, hashes, anchor, first, last, length, CELL)
                own = owner[r]
                doc, offset = np.array([d for d, _, _ in some], dtype=np.int64), np.array([o for _, o, _ in some]) - np.concatenate([[0], ends[:-1]])
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(content), pa.array(doc[own]), pa.array(a + offset[own]), pa.array((b - a + 1).astype(np.int32))], names=["key", "content", "doc", "start", "windows"])

    return run


# ---- step 3 --------------------------------------------------------------


def _dense(x: np.ndarray) -> np.ndarray:
    """Ranks of values from 0, equal ones alike."""
    by = np.argsort(x, kind="stable")
    new = np.append(0, x[by][1:] != x[by][:-1])
    out = np.empty(len(x), dtype=np.int64)
    out[by] = np.cumsum(new)
    return out


def prefix_ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Ranks of all suffixes of data by their first `length` bytes; those near the end are ranked as if zeros followed."""
    padded = np.concatenate([data, np.zeros(8, dtype=np.uint8)]).astype(np.uint64)
    eight = np.zeros(len(data), dtype=np.uint64)
    for k in range(8):
        eight = (eight << np.uint64(8)) | padded[k : k + len(data)]
    rank, h = _dense(eight), 8
    n = len(data)

    def then(rank: np.ndarray, step: int) -> np.ndarray:
        after = np.zeros(n, dtype=np.int64)
        after[: n - step] = rank[step:] + 1 if step < n else 0
        return _dense(rank * (n + 1) + after)

    while 2 * h <= length:
        rank = then(rank, h)
        h *= 2
    return then(rank, length - h) if h < length else rank


def longest_previous(rank: np.ndarray, position: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For suffixes with ranks by their first `length` bytes (equal: that long a common prefix) and text positions:
    whether the longest previous factor is that long, and whether that of the text read backwards is (an equal one comes later)."""
    order = np.lexsort((position, rank))
    n = len(order)

    def reaches(values: np.ndarray) -> np.ndarray:
        bounded = np.concatenate([[-1], values[order], [-1]])
        at = np.arange(1, n + 1)
        ranks = np.concatenate([[-1], rank[order], [-1]])
        out = np.zeros(n, dtype=bool)
        for step in (-1, 1):  # previous and next smaller position in suffix order
            found = nearest_smaller(bounded, at, step)
            out |= ranks[found] == ranks[at]
        back = np.zeros(n, dtype=bool)
        back[order] = out
        return back

    place = np.empty(n, dtype=np.int64)
    place[np.lexsort((np.arange(n), position))] = np.arange(n)
    return reaches(place), reaches(n - 1 - place)


SPAN = "doc long, begin long, end long"


def _spans_of(doc: np.ndarray, start: np.ndarray, hit: np.ndarray, record: np.ndarray, length: int) -> pa.RecordBatch:
    """Runs of hit windows of a record as spans; windows in order."""
    at = np.flatnonzero(hit)
    new = np.append(True, (np.diff(at) != 1) | (record[at][1:] != record[at][:-1])) if len(at) else np.zeros(0, dtype=bool)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:] - 1, len(at) - 1) if len(at) else heads
    return pa.RecordBatch.from_arrays([pa.array(doc[at[heads]]), pa.array(start[at[heads]]), pa.array(start[at[tails]] + length)], names=["doc", "begin", "end"])


def _compare(length: int, keep_first: bool):
    """Records (key, copies, doc, order, start, bytes) of some keys, all of each, in; spans of their repeated windows out."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("key", "ascending"), ("doc_order", "ascending"), ("doc", "ascending"), ("start", "ascending")])
        keys = table.column("key").to_numpy()
        texts = table.column("bytes").to_pylist()
        sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        begins = np.cumsum(sizes) - sizes
        count = sizes - length + 1
        record = np.repeat(np.arange(len(texts)), count)
        nth = np.arange(len(record)) - np.repeat(np.cumsum(count) - count, count)
        group = np.cumsum(np.append(0, keys[1:] != keys[:-1]))
        rank = prefix_ranks(data, length)[begins[record] + nth]
        rank = rank * (group[-1] + 1) + group[record]  # windows of one key alone
        # rows are in text order, so positions in them are text positions
        before, after = longest_previous(rank, np.arange(len(record)))
        start = table.column("start").to_numpy()[record] + nth
        hit = before if keep_first else before | after
        return pa.Table.from_batches([_spans_of(table.column("doc").to_numpy()[record], start, hit, record, length)])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts with their records' places in; the records' bytes out."""
    for batch in batches:
        for row in range(batch.num_rows):
            text = batch.column("text")[row].as_py()
            places = batch.column("places")[row].as_py()
            doc, order = batch.column("doc")[row].as_py(), batch.column("doc_order")[row].as_py()
            yield pa.RecordBatch.from_arrays(
                [pa.array([p["key"] for p in places]), pa.array([p["hot"] for p in places]), pa.array([doc] * len(places)), pa.array([order] * len(places), type=pa.int64()), pa.array([p["start"] for p in places], type=pa.int64()), pa.array([text[p["start"] : p["start"] + p["size"]] for p in places], type=pa.binary())],
                names=["key", "hot", "doc", "doc_order", "start", "bytes"],
            )


# ---- step 4 --------------------------------------------------------------


def _narrow(length: int, width: int):
    """Records of hot keys in; records of narrower cells out. Single windows have their own hash as key and content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # 2048 records' bytes are few enough for the positions of a batch
        for batch in (b.slice(i, 2048) for b in batches for i in range(0, b.num_rows, 2048)):
            texts = batch.column("bytes").to_pylist()
            sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
            data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            hashes, begins, ends = Hashes(data), np.cumsum(sizes) - sizes, np.cumsum(sizes)
            if width == 1:
                count = sizes - length + 1
                r = np.repeat(np.arange(len(texts)), count)
                a = b = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count) + begins[r]
                key = hashes.of(a, a + length).view(np.int64)
                content = _mix(key.view(np.uint64)).view(np.int64)
            else:
                owner, anchor, first, last = anchors(data, ends, length, hashes)
                r, a, b, key, content = records(data, hashes, anchor, first, last, length, width)
                r = owner[r]
            cut = [data[x : y + length].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            shift = batch.column("start").to_numpy() - begins
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(content), batch.column("doc").take(pa.array(r)), batch.column("doc_order").take(pa.array(r)), pa.array(a + shift[r]), pa.array((b - a + 1).astype(np.int32)), pa.array(cut, type=pa.binary())], names=["key", "content", "doc", "doc_order", "start", "windows", "bytes"])

    return run


# ---- the operator ----------------------------------------------------------


def _several(rows: DataFrame) -> DataFrame:
    """Rows of keys met twice or more, with `mixed`: whether contents differ."""

    def keys(own: DataFrame) -> DataFrame:
        found = own.groupBy("key").agg(F.count("*").alias("met"), F.min("content").alias("lo"), F.max("content").alias("hi"))
        return found.filter("met > 1").select("key", (F.col("lo") != F.col("hi")).alias("mixed"))

    return joined_groups(rows, ["key"], keys)


def _whole(rows: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """Spans of records that are copies as a whole."""
    place = F.struct("doc_order", "doc", "start")
    first = [F.min(place).alias("first")] if keep_first else []
    out = joined_groups(rows, ["key", "content"], lambda own: own.groupBy("key", "content").agg(F.count("*").alias("copies"), *first).filter("copies > 1"))
    if keep_first:
        out = out.filter(F.col("first") != place)
    return out.select("doc", F.col("start").alias("begin"), (F.col("start") + F.col("windows") - 1 + length).alias("end"))


def repeated_spans(texts: DataFrame, length: int, keep_first: bool) -> DataFrame:
    """(doc, begin, end) of bytes to remove, not yet united. texts: doc (a key of the row), doc_order, text (binary)."""
    found = written(texts.select("doc", "text").mapInArrow(trimmed(_find_records(length)), RECORD))
    # ids in the order of documents are needed for the first copy alone
    several = written(_several(found))
    orders = texts.select("doc", "doc_order").filter(F.octet_length("text") >= length) if keep_first else None
    with_order = lambda df: df.join(orders.dropDuplicates(["doc"]), "doc") if keep_first else df.withColumn("doc_order", F.lit(0).cast("long"))
    several = with_order(several)
    spans = _whole(several, length, keep_first)
    place = F.struct("doc_order", "doc", "start", "windows")
    contents = written(several.filter("mixed").groupBy("key", "content").agg(F.min(place).alias("p")).select("key", "p.*"))
    many = joined_groups(contents, ["key"], lambda own: own.groupBy("key").agg(F.count("*").alias("contents")))
    closer = many.withColumn("hot", F.col("contents") > HOT).drop("contents")
    places = closer.groupBy("doc").agg(F.collect_list(F.struct("key", "hot", "start", (F.col("windows") - 1 + length).alias("size"))).alias("places"))
    cut = texts.join(places, "doc").select("doc", "doc_order", "text", "places").mapInArrow(trimmed(_cut), "key long, hot boolean, doc long, doc_order long, start long, bytes binary")
    cut = written(cut.dropDuplicates(["key", "doc", "start"]) if keep_first else cut)
    total = cut.filter("not hot").agg(F.sum(F.octet_length("bytes"))).first()[0] or 0
    tasks = partitions_for(total, TASK)
    grouped = cut.filter("not hot").withColumn("task", F.pmod(F.xxhash64("key"), F.lit(tasks)))
    spans = spans.unionByName(grouped.drop("hot").groupBy("task").applyInArrow(_compare(length, keep_first), SPAN))
    hot = cut.filter("hot").select("doc", "doc_order", "start", "bytes")
    if hot.take(1):
        kind = "key long, content long, doc long, doc_order long, start long, windows int, bytes binary"
        narrow = written(_several(written(hot.mapInArrow(trimmed(_narrow(length, NARROW)), kind))))
        spans = spans.unionByName(_whole(narrow, length, keep_first))
        # one of each content goes on, as before
        mixed = narrow.filter("mixed").groupBy("key", "content").agg(F.min(F.struct("doc_order", "doc", "start", "windows", "bytes")).alias("p")).select("p.*")
        single = written(mixed.select("doc", "doc_order", "start", "bytes").mapInArrow(trimmed(_narrow(length, 1)), kind).drop("bytes"))
        spans = spans.unionByName(_whole(single, length, keep_first))
    return spans


RESULT = "n_bytes long, n_removed long, n_spans long, spans array<struct<begin: long, end: long>>, kept binary, kept_sha256 string"


def _remove(kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, removed, count, spans, kept, sha = [], [], [], [], [], []
            for text, own in zip(batch.column("text"), batch.column("spans"), strict=True):
                text, own = text.as_py(), own.as_py() or []
                begin = np.array([s["begin"] for s in own], dtype=np.int64)
                end = np.array([s["end"] for s in own], dtype=np.int64)
                by = np.argsort(begin, kind="stable")
                begin, end = union_spans(begin[by], end[by], np.zeros(len(begin)))
                at, left = 0, []
                for a, b in zip(begin.tolist(), end.tolist(), strict=True):
                    left.append(text[at:a])
                    at = b
                rest = b"".join([*left, text[at:]]) if len(begin) else text
                size.append(len(text))
                removed.append(len(text) - len(rest))
                count.append(len(begin))
                spans.append([{"begin": a, "end": b} for a, b in zip(begin.tolist(), end.tolist(), strict=True)])
                kept.append(rest)
                sha.append(hashlib.sha256(rest).hexdigest())
            arrays = [batch.column("doc_id"), pa.array(size, type=pa.int64()), pa.array(removed, type=pa.int64()), pa.array(count, type=pa.int64()), pa.array(spans, type=pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))), pa.array(kept, type=pa.binary()), pa.array(sha, type=pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept", "kept_sha256"])

    return run


def substring_dedup(docs: DataFrame, length: int = 400, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, spans (in bytes), kept (the bytes left), kept_sha256 for each row of docs."""
    if length < 2 * GRAM:
        raise ValueError(f"length must be {2 * GRAM} at least")
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    text = text_or_empty(text_col)
    # a key of the row: rows with one id and different texts are different documents
    rows = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), text).alias("doc"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63) + 1)).alias("doc_order"), text.cast("binary").alias("text"))
    spans = repeated_spans(rows.select("doc", "doc_order", "text"), length, keep_first)
    united = written(spans.groupBy("doc").agg(F.collect_list(F.struct("begin", "end")).alias("spans")))
    return rows.join(united, "doc", "left").select("doc_id", "text", "spans").mapInArrow(trimmed(_remove(kind)), f"doc_id {kind}, {RESULT}")
