"""Alignment of the tokens of two vocabularies over the bytes of the same texts.

Both token sequences of a text spell a space and the text, byte for byte. A
packed bitset has a bit for every byte at which a token of A ends, another one
those of B; their AND has the shared cuts. Its set bits, selected in order, are
the ends of groups, and popcounts of the words of either bitset up to a cut (a
rank) say how many tokens end there, so each group is a range of A tokens and a
range of B tokens. All texts of a chunk stand in one bitset, one after another;
the last byte of a text is a cut, so no group reaches over it.

A link is a pair of an A and a B token whose byte ranges end together. As a
token has one byte at least, one token of either side ends at a cut: a group's
links are those of its last tokens, one a group. Of two byte strings that end
together one ends with the other, so the pairs of ids that can be linked are at
most the bytes of all tokens of both vocabularies, some 600,000 for 50,000 and
32,000 tokens: counts of pairs have a size that no corpus exceeds, and are
summed by Spark, broadcast, and looked up where a document's links are kept.

Defined cases: null and empty texts, and those that A or B doesn't spell byte
for byte (U+2581 in a text, which B takes for a space), have no tokens: zeros,
and an empty groups_sha256; strings of special tokens in a text are plain text;
repeated rows and null ids of documents give rows of their own, and their links
count as often; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import text_or_empty, trimmed, written
from .pieces import PieceEncoder, piece_bytes
from .tokens import Encoder

#: Bytes of text aligned at a time, or one text.
CHUNK = 1 << 20


class PlainEncoder(Encoder):
    """Ids of byte-level tokens, strings of special tokens taken as plain text."""

    _of: ClassVar[dict[str, Encoder]] = {}

    def __init__(self, path: str) -> None:
        super().__init__(path)
        if not self.plain:
            raise ValueError("not a byte-level vocabulary")
        self.tokenizer.encode_special_tokens = True
        self.special = []


def byte_level_signs() -> dict[str, int]:
    """The sign of each byte in a byte-level vocabulary: printable Latin-1 stands for itself, other bytes for signs from U+0100 on, in order."""
    own = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    other = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(other)}


@dataclass
class Spelling:
    """The bytes of every token, one after another."""

    flat: np.ndarray
    begin: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, tokens: list[bytes]) -> Spelling:
        size = np.array([*map(len, tokens)], dtype=np.int64)
        return cls(np.frombuffer(b"".join(tokens), dtype=np.uint8), np.cumsum(size) - size, size)

    def bytes_of(self, ids: np.ndarray) -> np.ndarray:
        size = self.size[ids]
        shift = self.begin[ids] - (np.cumsum(size) - size)
        return self.flat[np.repeat(shift, size) + np.arange(int(size.sum()))]


class EndSet:
    """A packed set of the bytes at which tokens end."""

    def __init__(self, n: int, ends: np.ndarray) -> None:
        mark = np.zeros(-(-n // 64) * 64, dtype=bool)
        mark[ends - 1] = True
        self.words = np.packbits(mark, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many ends there are up to and with each of these bytes."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        upto = np.uint64(0xFFFFFFFFFFFFFFFF) >> (np.uint64(63) - bit)
        return self.before[word] + np.bitwise_count(self.words[word] & upto)

    def shared(self, other: EndSet) -> np.ndarray:
        """The bytes at which tokens of both end: the set bits of the AND, in order."""
        return np.flatnonzero(np.unpackbits((self.words & other.words).view(np.uint8), bitorder="little"))


@dataclass
class Aligned:
    """Token ids of texts, one after another, and their groups: the ends of each group's ranges of A and B tokens."""

    a: np.ndarray
    b: np.ndarray
    a_end: np.ndarray
    b_end: np.ndarray
    #: tokens and groups of each text
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray

    def linked(self) -> tuple[np.ndarray, np.ndarray]:
        """The places of the A and B token of each link."""
        return self.a_end - 1, self.b_end - 1


class Aligner:
    _of: ClassVar[dict[tuple[str, str], Aligner]] = {}

    def __init__(self, a_path: str, b_path: str) -> None:
        self.a, self.b = PlainEncoder.shared(a_path), PieceEncoder.shared(b_path)
        if max(self.a.tokenizer.get_vocab_size(), self.b.model.get_piece_size()) > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        signs = byte_level_signs()
        tokens = (self.a.tokenizer.id_to_token(i) for i in range(self.a.tokenizer.get_vocab_size()))
        self.spell_a = Spelling.of([bytes(signs[c] for c in t) for t in tokens])
        self.spell_b = Spelling.of([piece_bytes(self.b.model, i) for i in range(self.b.model.get_piece_size())])
        self.decimals = _decimals()

    @classmethod
    def shared(cls, a_path: str, b_path: str) -> Aligner:
        if (a_path, b_path) not in cls._of:
            cls._of.clear()
            cls._of[a_path, b_path] = cls(a_path, b_path)
        return cls._of[a_path, b_path]

    def align(self, texts: pa.Array) -> Aligned:
        """The alignment of texts without nulls; a text that isn't spelled by both has no tokens."""
        none, space = pa.scalar("", texts.type), pa.scalar(" ", texts.type)
        spaced = pc.binary_join_element_wise(none, texts, space)
        # a letter before the space is a token of its own, and the memo's cuts before single spaces hold at once
        led = [ids[1:] for ids in self.a.encode_column(pc.binary_join_element_wise(none, pa.scalar("x", texts.type), spaced, none))]
        other = [*self.b.encode_column(texts)]
        data, bounds = _bytes(spaced)
        n_a, n_b = np.array([*map(len, led)]), np.array([*map(len, other)])
        a, b = np.concatenate(led).astype(np.int64), np.concatenate(other).astype(np.int64)
        size = np.diff(bounds)
        fine = (size > 1) & (n_a > 0) & (n_b > 0)
        for ids, n, spell in ((a, n_a, self.spell_a), (b, n_b, self.spell_b)):
            fine &= _same(spell, ids, n, data, bounds)
        a, b = a[np.repeat(fine, n_a)], b[np.repeat(fine, n_b)]
        n_a, n_b, size = n_a * fine, n_b * fine, size * fine
        n = int(size.sum())
        ends_a, ends_b = EndSet(n, np.cumsum(self.spell_a.size[a])), EndSet(n, np.cumsum(self.spell_b.size[b]))
        cuts = ends_a.shared(ends_b)
        upto = np.searchsorted(cuts, np.cumsum(size) - 1, side="right")
        return Aligned(a, b, ends_a.rank(cuts), ends_b.rank(cuts), n_a, n_b, np.diff(upto, prepend=0) * fine)

    def written_groups(self, found: Aligned) -> Iterator[memoryview]:
        """Each text's groups as `a1,a2|b1;a3|b2,b3`: decimal ids of A and B."""
        groups = np.arange(len(found.a_end))
        a_sizes, b_sizes = np.diff(found.a_end, prepend=0), np.diff(found.b_end, prepend=0)
        # an A token follows all B tokens of the groups before, a B token all A tokens of its group and those before
        place_a = np.arange(len(found.a)) + np.repeat(found.b_end - b_sizes, a_sizes)
        place_b = np.arange(len(found.b)) + found.a_end[np.repeat(groups, b_sizes)]
        n = len(found.a) + len(found.b)
        ids, sign = np.empty(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
        ids[place_a], ids[place_b] = found.a, found.b
        sign[place_a[found.a_end - 1]], sign[place_b[found.b_end - 1]] = 1, 2
        chars, size = self.decimals
        size = size[ids]
        out = chars[sign, ids][np.arange(chars.shape[2]) < size[:, None]].data
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(found.n_a + found.n_b)])]
        for low, high in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield out[low : max(low, high - 1)]


def _decimals() -> tuple[np.ndarray, np.ndarray]:
    """The decimal of each 16-bit id with the sign after it (within a side, after A's side, after B's), and its size."""
    chars = np.zeros((3, 1 << 16, 6), dtype=np.uint8)
    size = np.empty(1 << 16, dtype=np.int64)
    for i in range(1 << 16):
        digits = str(i).encode()
        size[i] = len(digits) + 1
        chars[:, i, : len(digits)] = np.frombuffer(digits, dtype=np.uint8)
        chars[:, i, len(digits)] = (0x2C, 0x7C, 0x3B)
    return chars, size


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    _, places, values = texts.buffers()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    bounds = np.frombuffer(places, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(values, dtype=np.uint8) if values else np.zeros(0, dtype=np.uint8)
    return data[bounds[0] : bounds[-1]], bounds - bounds[0]


def _same(spell: Spelling, ids: np.ndarray, n: np.ndarray, data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which texts are spelled by their ids, byte for byte."""
    own = np.concatenate([[0], np.cumsum(spell.size[ids])])[np.concatenate([[0], np.cumsum(n)])]
    spelled = spell.bytes_of(ids)
    if np.array_equal(own, bounds) and np.array_equal(spelled, data):
        return np.ones(len(n), dtype=bool)
    return np.array([np.array_equal(spelled[own[i] : own[i + 1]], data[bounds[i] : bounds[i + 1]]) for i in range(len(n))], dtype=bool)


def _chunks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch of about CHUNK bytes of text, or one."""
    ends = np.cumsum(pc.binary_length(batch.column("text")).to_numpy())
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + CHUNK, side="right")))
        yield batch.slice(at, to - at)
        at = to


def _rows(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows, rows.schema[0].dataType.simpleString()


def links(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, link (from 0 in its row of docs), a_place, b_place, a_id, b_id for each link."""
    rows, kind = _rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.shared(a_path, b_path)
        for batch in batches:
            for part in _chunks(batch):
                found = aligner.align(part.column("text"))
                a, b = found.linked()
                first = [np.repeat(np.cumsum(n) - n, found.n_groups) for n in (found.n_groups, found.n_a, found.n_b)]
                own = part.column("doc_id").take(pa.array(np.repeat(np.arange(part.num_rows), found.n_groups)))
                columns = [np.arange(len(a)) - first[0], a - first[1], b - first[2]]
                yield pa.RecordBatch.from_arrays([own, *map(pa.array, columns), pa.array(found.a[a].astype(np.int32)), pa.array(found.b[b].astype(np.int32))], names=["doc_id", "link", "a_place", "b_place", "a_id", "b_id"])

    return rows.mapInArrow(trimmed(run), f"doc_id {kind}, link long, a_place long, b_place long, a_id int, b_id int")


def aligned(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, groups_sha256, pairs: the pairs of a row's links, sorted, 32 bits each with the B id above the A id."""
    rows, kind = _rows(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner.shared(a_path, b_path)
        for batch in batches:
            for part in _chunks(batch):
                found = aligner.align(part.column("text"))
                a, b = found.linked()
                pairs = np.split(((found.b[b] << 16) | found.a[a]).astype("<u4"), np.cumsum(found.n_groups)[:-1])
                digests = [hashlib.sha256(text).hexdigest() if len(text) else "" for text in aligner.written_groups(found)]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(n.astype(np.int64)) for n in (found.n_a, found.n_b, found.n_groups)), pa.array(digests, type=pa.string()), pa.array([np.sort(p).tobytes() for p in pairs], type=pa.binary())],
                    names=["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs"],
                )

    return rows.mapInArrow(trimmed(run), f"doc_id {kind}, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary")


def pair_counts(kept: DataFrame) -> DataFrame:
    """a_id, b_id, n, best for each pair of ids that is linked: its links in the corpus, and whether no pair of its B id has more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        for batch in batches:  # a task's counts are bounded as all are
            data, _ = _bytes(batch.column("pairs"))
            some, n = np.unique(np.frombuffer(data, dtype="<u4"), return_counts=True)
            every, at = np.unique(np.concatenate([keys, some]), return_inverse=True)
            total = np.zeros(len(every), dtype=np.int64)
            total[at[: len(keys)]] += counts
            total[at[len(keys) :]] += n
            keys, counts = every, total
        yield pa.RecordBatch.from_arrays([pa.array((keys & 0xFFFF).astype(np.int32)), pa.array((keys >> 16).astype(np.int32)), pa.array(counts)], names=["a_id", "b_id", "n"])

    sums = kept.select("pairs").mapInArrow(trimmed(run), "a_id int, b_id int, n long").groupBy("a_id", "b_id").agg(F.sum("n").alias("n"))
    return sums.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("b_id")))


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 for each row of docs."""
    kept = written(aligned(docs, a_path, b_path, id_col, text_col))
    counts = pair_counts(kept).toArrow()
    bound = vocabulary_bytes(a_path, b_path)
    if counts.num_rows > bound:
        raise ValueError(f"{counts.num_rows} pairs of ids, more than the {bound} bytes of the vocabularies")
    a_id, b_id, n, best = (counts.column(c).to_numpy() for c in ("a_id", "b_id", "n", "best"))
    key = (b_id.astype(np.uint32) << np.uint32(16)) | a_id.astype(np.uint32)
    order = np.argsort(key)
    known = docs.sparkSession.sparkContext.broadcast((key[order], n[order], best[order].astype(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, best = known.value
        for batch in batches:
            data, bounds = _bytes(batch.column("pairs"))
            at = np.searchsorted(key, np.frombuffer(data, dtype="<u4"))
            before = [np.concatenate([[0], np.cumsum(x[at])])[bounds // 4] for x in (best, n)] if len(at) else [bounds, bounds]
            n_best, total = (np.diff(x) for x in before)
            columns = {c: batch.column(c) for c in ("doc_id", "n_a", "n_b", "n_groups")}
            columns |= {"n_links": batch.column("n_groups"), "n_best": pa.array(n_best), "count_sum": pa.array(total), "groups_sha256": batch.column("groups_sha256")}
            yield pa.RecordBatch.from_arrays([*columns.values()], names=[*columns])

    kind = kept.select("doc_id").schema[0].dataType.simpleString()
    return kept.mapInArrow(trimmed(run), f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def vocabulary_bytes(a_path: str, b_path: str) -> int:
    """The bytes of all tokens of both vocabularies: no more pairs of ids can end together."""
    aligner = Aligner.shared(a_path, b_path)
    return len(aligner.spell_a.flat) + len(aligner.spell_b.flat)
