"""Order-preserving packing: dynamic programming chooses the window cuts.

Documents keep their id order. A range partitioning deals runs of documents to
tasks; each task reads its run as one stream of token ids and cuts it into
windows of at most `window` ids. A cut may stand after a document (free), after
a sentence (costs `sentence_cost`), or, where no such place comes for long,
inside a sentence (costs `hard_cost`). The cost of a window is its padding plus
the penalty of the cut that ends it. best(j) = min over i with
pos(j) - pos(i) <= window of best(i) + window - (pos(j) - pos(i)) + penalty(j);
best(i) + pos(i) goes through a monotone queue, so every cut enters and leaves
it once.

A stream is worked off in stretches of at most `stretch` ids or one document,
which bounds a task's memory; the last windows of a stretch are carried over to
the next one, so a stretch costs no padding of its own.

Defined cases: a null or empty text is its end id alone; repeated rows are
packed as rows of their own; null ids come first; an empty table gives an empty
result; documents longer than a window are cut; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, trimmed
from .tokens import Encoder

#: Kinds of cut.
DOCUMENT, SENTENCE, HARD = 0, 1, 2


def choose_cuts(places: np.ndarray, kinds: np.ndarray, window: int, sentence_cost: int, hard_cost: int) -> np.ndarray:
    """Indices into places (ascending; the last is the end) of the cuts of least cost; the stream starts at 0.

    No gap between neighbours, nor the first place, is over window.
    """
    price = (0, sentence_cost, hard_cost)
    pos = [0, *places.tolist()]
    kind = [DOCUMENT, *kinds.tolist()]
    best = [0] * len(pos)
    came = [0] * len(pos)
    queue: deque[tuple[int, int]] = deque([(0, 0)])  # (best + pos, index), values rising
    for j in range(1, len(pos)):
        low = pos[j] - window
        while pos[queue[0][1]] < low:
            queue.popleft()
        value, i = queue[0]
        best[j] = value + window - pos[j] + price[kind[j]]
        came[j] = i
        own = best[j] + pos[j]
        while queue and queue[-1][0] > own:
            queue.pop()
        queue.append((own, j))
    cuts = []
    j = len(pos) - 1
    while j:
        cuts.append(j - 1)
        j = came[j]
    return np.array(cuts[::-1], dtype=np.int64)


def cut_places(lengths: np.ndarray, sentence_ends: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """All places where a stream of documents may be cut, ascending, and their kinds."""
    ends = np.cumsum(lengths)
    places = np.concatenate([ends, sentence_ends])
    kinds = np.concatenate([np.full(len(ends), DOCUMENT), np.full(len(sentence_ends), SENTENCE)])
    order = np.lexsort((kinds, places))
    places, kinds = places[order], kinds[order]
    first = np.ones(len(places), dtype=bool)
    first[1:] = places[1:] != places[:-1]
    places, kinds = places[first], kinds[first]
    step = window // 8
    gaps = np.diff(places, prepend=0)
    long = np.flatnonzero(gaps > step)
    if len(long):
        extra = np.concatenate([np.arange(places[i] - gaps[i] + step, places[i], step) for i in long])
        places, kinds = np.concatenate([places, extra]), np.concatenate([kinds, np.full(len(extra), HARD)])
        order = np.argsort(places, kind="stable")
        places, kinds = places[order], kinds[order]
    return places, kinds


class Stream:
    """Documents of one task, cut as they come."""

    def __init__(self, window: int, stretch: int, sentence_cost: int, hard_cost: int) -> None:
        self.window, self.stretch, self.costs = window, stretch, (sentence_cost, hard_cost)
        self.docs: list[tuple] = []  # (doc_id, first id's place in the document, ids, sentence ends, document's length)
        self.held = 0
        self.sequence = 0

    def add(self, doc_id, ids: np.ndarray, ends: np.ndarray) -> Iterator[tuple]:
        self.docs.append((doc_id, 0, ids, ends, len(ids)))
        self.held += len(ids)
        if self.held >= self.stretch:
            yield from self.pack(last=False)

    def pack(self, last: bool) -> Iterator[tuple]:
        """Pieces of the windows chosen; unless last, those of the final 16 windows stay for the next stretch."""
        if not self.docs:
            return
        lengths = np.array([len(d[2]) for d in self.docs])
        begins = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.concatenate([d[3] + b for d, b in zip(self.docs, begins, strict=False)])
        places, kinds = cut_places(lengths, ends, self.window)
        cuts = places[choose_cuts(places, kinds, self.window, *self.costs)]
        if not last:
            cuts = cuts[: max(0, len(cuts) - 16)]
        edges = np.concatenate([[0], cuts])
        d = 0
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            at = a
            while at < b:
                while begins[d + 1] <= at:
                    d += 1
                doc_id, first, ids, _, total = self.docs[d]
                to = min(b, int(begins[d + 1]))
                piece = ids[at - int(begins[d]) : to - int(begins[d])]
                yield doc_id, first + at - int(begins[d]), to - at, zlib.crc32(piece.astype("<u4").tobytes()), total, self.sequence, at - a
                at = to
            self.sequence += 1
        done = int(edges[-1])
        rest = []
        for (doc_id, first, ids, ends_, total), b in zip(self.docs, begins.tolist(), strict=False):
            if b + len(ids) > done:
                skip = max(0, done - b)
                rest.append((doc_id, first + skip, ids[skip:], ends_[ends_ > skip] - skip, total))
        self.docs, self.held = rest, int(begins[-1]) - done


def pack(
    docs: DataFrame,
    vocabulary: str,
    end_id: int = 2,
    window: int = 4096,
    sentence_cost: int = 24,
    hard_cost: int = 512,
    stretch: int = 1 << 20,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    sequence_id is the task's number in its upper bits and a count from 0 in
    its lower 33, so it rises with the document order.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows = rows.select("doc_id", "text", F.spark_partition_id().alias("slice"))
    return rows.mapInArrow(trimmed(_packer(vocabulary, end_id, window, stretch, sentence_cost, hard_cost)), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _packer(vocabulary: str, end_id: int, window: int, stretch: int, sentence_cost: int, hard_cost: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.shared(vocabulary)
        stops = encoder.sentence_ends()
        stream = Stream(window, stretch, sentence_cost, hard_cost)
        base, kind = 0, pa.int64()

        def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*pieces, strict=True))
            columns[5] = [base + x for x in columns[5]]
            return pa.RecordBatch.from_arrays([pa.array(columns[0], type=kind), *(pa.array(c, type=pa.int64()) for c in columns[1:])], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        pieces: list[tuple] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            base, kind = batch.column("slice")[0].as_py() << 33, batch.schema.field("doc_id").type
            ids_of = batch.column("doc_id").to_pylist()
            for doc_id, ids in zip(ids_of, encoder.encode_column(batch.column("text")), strict=True):
                ids = np.append(ids, np.uint16(end_id))
                ends = np.flatnonzero(stops[ids]) + 1
                pieces += stream.add(doc_id, ids, ends[ends < len(ids)])
            if pieces:
                yield batch_of(pieces)
                pieces = []
        if pieces := list(stream.pack(last=True)):
            yield batch_of(pieces)

    return run
