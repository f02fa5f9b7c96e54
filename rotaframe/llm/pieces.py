"""SentencePiece ids and back, by a table of distinct chunks.

The library writes a text with a marker for each space and one put before it.
If no piece of the model has a marker after another character, no merge reaches
across the place before a run of markers: the ids of a text are those of its
marked words (a run of markers with what follows up to the next), one after
another. So a batch of texts is cut into marked words, Arrow's dictionary
encoding finds the distinct ones, the library segments those that the worker's
table doesn't know yet, once each, and the ids are gathered back by position.
Nothing is shuffled, and the table is bounded (tokens.MEMO). A model that has
such a piece, another normalisation or pieces set by a user is met by encoding
whole texts; read from the model file, not assumed.

Defined cases: a null or empty text has no ids of its own, only the begin and
end ids asked for, and decodes to an empty text; U+2581 in a text is a marker
like a space, so it decodes to a space; repeated rows and null ids of documents
give rows of their own; a text of any length without a space is one marked word;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterable, Iterator
from itertools import repeat
from operator import itemgetter
from typing import ClassVar

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from sentencepiece import sentencepiece_model_pb2

from .common import text_or_empty, trimmed
from .tokens import LONG, MEMO, TOGETHER, Encoder

MARKER = "▁"
#: Ids decoded in one call, or those of one text: the library takes them as Python lists.
DECODED = 200_000


def cut_at_markers(path: str) -> bool:
    """Whether the ids of a text are those of its marked words by this model."""
    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as file:
        model.ParseFromString(file.read())
    rule, trainer = model.normalizer_spec, model.trainer_spec
    plain = rule.add_dummy_prefix and not rule.remove_extra_whitespaces and not rule.precompiled_charsmap and not trainer.treat_whitespace_as_suffix and trainer.model_type == trainer.BPE and trainer.byte_fallback
    if not plain or any(p.type == p.USER_DEFINED for p in model.pieces):
        return False
    return not any(MARKER in p.piece.lstrip(MARKER) for p in model.pieces)


def piece_bytes(model: sentencepiece.SentencePieceProcessor, i: int) -> bytes:
    """What a piece stands for in a text: a marker for a space, a byte piece for its byte."""
    piece = model.id_to_piece(i)
    return bytes([int(piece[3:-1], 16)]) if model.is_byte(i) else piece.replace(MARKER, " ").encode()


class PieceEncoder(Encoder):
    """Ids of texts without begin and end, by the worker's table of marked words."""

    _of: ClassVar[dict[str, Encoder]] = {}

    def __init__(self, path: str) -> None:
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        if self.model.get_piece_size() > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.cut = cut_at_markers(path)
        #: bytes of each piece in a text, where a marker is one space
        self.sizes = np.array([len(piece_bytes(self.model, i)) for i in range(self.model.get_piece_size())])
        self.marker_id = self.model.piece_to_id(MARKER)
        self.clear()

    def encode_column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        if not self.cut:
            for text in texts:
                yield np.array(self.model.encode(text.as_py()), dtype=np.uint16)
            return
        if pc.any(pc.match_substring(texts, MARKER)).as_py():
            texts = pc.replace_substring(texts, MARKER, " ")
        # the marker that the library puts first stands there, so that every word begins with one
        yield from super().encode_column(pc.binary_join_element_wise(pa.scalar("", texts.type), texts, pa.scalar(" ", texts.type)))

    def _chunk(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of marked texts that stand one after another, and how many each has."""
        if self.count > MEMO:
            self._purge()
        cut = data == 0x20
        cut[1:] &= ~cut[:-1]
        cut[ends[:-1]] = True
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(data)).astype(np.int32 if len(data) < 1 << 31 else np.int64)
        kind = pa.binary() if bounds.dtype == np.int32 else pa.large_binary()
        words = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        distinct, index = words.dictionary.to_numpy(zero_copy_only=False).tolist(), words.indices.to_numpy()
        slots = np.array([*map(self.memo.get, distinct, repeat(-1))], dtype=np.int64)
        self.used[slots[slots > 0]] = True
        new = np.flatnonzero(slots < 0)
        long = np.array([len(distinct[i]) > LONG for i in new.tolist()], dtype=bool)
        for kept, own in ((True, new[~long]), (False, new[long])):
            mark = self.count, self.fill  # long words come last and aren't kept
            if len(own):
                slots[own] = added = self._put(*self._segment([distinct[i] for i in own.tolist()]))
                if kept:
                    self.memo.update(zip([distinct[i] for i in own.tolist()], added.tolist(), strict=True))
        which = slots[index]
        which[np.searchsorted(starts, ends[:-1][np.diff(ends) == 1])] = 0  # empty texts get no marker
        ids = self._gather(which)
        before = np.concatenate([[0], np.cumsum(self.length[which], dtype=np.int64)])
        self.count, self.fill = mark
        return ids, np.diff(before[np.searchsorted(starts, ends)])

    def _segment(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of marked words, and how many each has; the library puts the first marker back.

        Words follow one another in a call, and the bytes of pieces tell their ids apart. Markers alone, which would run into the next word's, have a call of their own.
        """
        alone = [w.endswith(b" ") for w in words]
        groups = []
        for bare, these in itertools.groupby(zip(alone, words, strict=True), key=itemgetter(0)):
            own = [w for _, w in these]
            step = 1 if bare else TOGETHER
            for i in range(0, len(own), step):
                groups.append(b"".join(own[i : i + step]))
        found = self.model.encode([str(g[1:], "utf-8", "replace") for g in groups], num_threads=1)
        found = [ids if len(g) > 1 else [self.marker_id] for g, ids in zip(groups, found, strict=True)]
        ids = np.concatenate([np.array(x, dtype=np.uint16) for x in found])
        ends, need = np.cumsum(self.sizes[ids]), np.cumsum([*map(len, words)])
        if ends[-1] != need[-1]:
            raise ValueError("words that aren't UTF-8")
        return ids, np.diff(np.searchsorted(ends, need) + 1, prepend=0)

    def framed(self, texts: pa.Array, begin: bool, end: bool) -> Iterator[np.ndarray]:
        first = [self.model.bos_id()] if begin else []
        last = [self.model.eos_id()] if end else []
        for ids in self.encode_column(texts):
            yield np.concatenate([first, ids, last]).astype("<u4")

    def decode(self, many: Iterable[np.ndarray]) -> Iterator[str]:
        """The library's texts of ids, few enough of them at a time."""
        held, n = [], 0
        for ids in many:
            if held and n + len(ids) > DECODED:
                yield from self.model.decode(held, num_threads=1)
                held, n = [], 0
            held.append(ids.tolist())
            n += len(ids)
        if held:
            yield from self.model.decode(held, num_threads=1)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, str]:
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text"))
    return rows, rows.schema[0].dataType.simpleString()


def encode(docs: DataFrame, model: str, begin: bool = True, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) for each row of docs."""
    rows, kind = _texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.shared(model)
        for batch in batches:
            ids = [x.astype(np.int32) for x in encoder.framed(batch.column("text"), begin, end)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, type=pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return rows.mapInArrow(trimmed(run), f"doc_id {kind}, ids array<int>")


def decode(encoded: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, text for each row of ids; null ids are none."""
    rows = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.shared(model)
        for batch in batches:
            texts = [*encoder.decode([np.array(x.values) for x in batch.column("ids")])]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, type=pa.string())], names=["doc_id", "text"])

    return rows.mapInArrow(trimmed(run), f"doc_id {rows.schema[0].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, model: str, begin: bool = True, end: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: texts encoded and decoded again in one pass, without the ids crossing back to the JVM."""
    rows, kind = _texts(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = PieceEncoder.shared(model)
        for batch in batches:
            sizes, digests = [], []

            def met(texts: pa.Array = batch.column("text"), sizes: list = sizes, digests: list = digests) -> Iterator[np.ndarray]:
                for ids in encoder.framed(texts, begin, end):
                    sizes.append(len(ids))
                    digests.append(hashlib.sha256(ids.tobytes()).hexdigest())
                    yield ids

            decoded = [hashlib.sha256(text.encode("utf-8")).hexdigest() for text in encoder.decode(met())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, type=pa.int64()), pa.array(digests, type=pa.string()), pa.array(decoded, type=pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return rows.mapInArrow(trimmed(run), f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
