"""Token ids from a public vocabulary file by the tokenizers library, with a memo of pieces.

The library's own ids for a text are those of its pieces, one after another, if
the text is split before a single space or line feed that stands between two
characters that aren't white space, and before a full stop or comma after an
ASCII letter: no pre-token of these vocabularies goes on across such a place.
So each distinct piece is encoded by the library once and looked up after that.
A text with white space at either end or next to other white space, or with the
string of a special token (which the library takes for that token), is encoded
whole. A piece of one space and ASCII letters is one pre-token of a byte-level
vocabulary, so the library's model gets it without the regular expression that
looks for pre-tokens. tests/llm/test_tokens.py holds all ways equal.

A chunk of texts is worked on as one run of bytes: numpy finds the cuts, Arrow's
dictionary encoding the distinct pieces, and only those meet Python's memo.
"""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator
from itertools import repeat
from typing import ClassVar

import numpy as np
import pyarrow as pa
from tokenizers import Encoding, Tokenizer
from tokenizers.pre_tokenizers import CharDelimiterSplit

# a task has one core
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces of the memo, at most; when it is full, those not met again since the last time go. About 75 MB.
MEMO = 400_000
#: Bytes of text encoded at a time, or one text.
CHUNK = 1 << 21
#: Pieces of more bytes rarely come again and aren't kept.
LONG = 64
#: Pieces that follow one another in a call of the library.
TOGETHER = 200

_BREAK = np.zeros(256, dtype=bool)
_BREAK[[0x20, 0x0A]] = True
_PLAIN = np.zeros(256, dtype=bool)  # ASCII other than white space and control characters
_PLAIN[0x21:0x7F] = True
_LETTER = np.zeros(256, dtype=bool)
_LETTER[0x41:0x5B] = _LETTER[0x61:0x7B] = True


def _ids(encoding: Encoding) -> np.ndarray:
    return np.frombuffer(array("H", encoding.ids), dtype=np.uint16)


class Encoder:
    _of: ClassVar[dict[str, Encoder]] = {}
    #: instead of MEMO and CHUNK, for workers with memory to spare
    most: ClassVar[int | None] = None
    chunk: ClassVar[int | None] = None

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        n = self.tokenizer.get_vocab_size()
        if n > 1 << 16:
            raise ValueError("ids of more than 16 bits")
        self.special = [t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()]
        # bytes of each token: each of its characters stands for one; a sign for the end of a word for none
        self.sizes = np.array([len(self.tokenizer.id_to_token(i).removesuffix("</w>")) for i in range(n)])
        byte_level = "ByteLevel" in str(self.tokenizer.pre_tokenizer)
        #: texts are taken as they are, white space too
        self.plain = byte_level and self.tokenizer.normalizer is None
        #: the same model without a search for pre-tokens
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = CharDelimiterSplit(" ")
        #: else white space goes, and ASCII keeps its length; no other kind of file is here
        if not self.plain and not any(t.endswith("</w>") for t in self.tokenizer.get_vocab()):
            raise ValueError("neither a byte-level vocabulary nor one with word ends")
        self.clear()

    @classmethod
    def shared(cls, path: str) -> Encoder:
        """One for each worker process, so that its memo lasts over tasks; one of another path gives way."""
        if path not in cls._of:
            cls._of.clear()
            cls._of[path] = cls(path)
        return cls._of[path]

    def clear(self) -> None:
        """Slot 0 is the piece without ids."""
        self.memo: dict[bytes, int] = {}
        self.count, self.fill = 1, 0
        self.begin, self.length = np.zeros(1 << 12, dtype=np.int32), np.zeros(1 << 12, dtype=np.int32)
        self.used = np.zeros(1 << 12, dtype=bool)
        self.flat = np.zeros(1 << 14, dtype=np.uint16)

    def _purge(self) -> None:
        """Keep the pieces met again since the last time, unless there are none or those are most of the memo."""
        kept = [p for p, s in self.memo.items() if self.used[s]]
        if not 0 < len(kept) <= (self.most or MEMO) // 2:
            self.clear()
            return
        slots = np.array([self.memo[p] for p in kept], dtype=np.int64)
        ids, lengths = self._gather(slots), self.length[slots]
        self.clear()
        self.memo = dict(zip(kept, self._put(ids, lengths).tolist(), strict=True))

    def _put(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Add pieces of these lengths; their slots."""
        slots = np.arange(self.count, self.count + len(lengths))
        if slots[-1:] >= len(self.begin):
            more = 2 * (self.count + len(lengths))
            self.begin, self.length, self.used = np.resize(self.begin, more), np.resize(self.length, more), np.resize(self.used, more)
        if self.fill + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * (self.fill + len(ids)))
        self.begin[slots] = self.fill + np.cumsum(lengths) - lengths
        self.length[slots] = lengths
        self.used[slots] = False
        self.flat[self.fill : self.fill + len(ids)] = ids
        self.count += len(lengths)
        self.fill += len(ids)
        return slots

    def _gather(self, slots: np.ndarray) -> np.ndarray:
        lengths = self.length[slots]
        shift = self.begin[slots] - (np.cumsum(lengths, dtype=np.int32) - lengths)
        return self.flat[np.repeat(shift, lengths) + np.arange(int(lengths.sum()), dtype=np.int32)]

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, as uint16."""
        return self.encode_column(pa.array(texts, type=pa.large_string()))

    def encode_column(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text of a column of strings without nulls, as uint16."""
        if not len(texts):
            return
        kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
        _, places, values = texts.buffers()
        ends = np.frombuffer(places, dtype=kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        data = np.frombuffer(values, dtype=np.uint8) if values else np.zeros(0, dtype=np.uint8)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + (self.chunk or CHUNK), side="right")) - 1)
            ids, lengths = self._chunk(data[ends[at] : ends[to]], ends[at : to + 1] - ends[at])
            yield from np.split(ids, np.cumsum(lengths)[:-1])
            at = to

    def _chunk(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that stand one after another, and how many each has."""
        if self.count > (self.most or MEMO):
            self._purge()
        cut = (data == 0x20) | (data == 0x0A)
        stops = np.flatnonzero((data[1:] == 0x2E) | (data[1:] == 0x2C))
        cut[stops[_LETTER[data[stops]]] + 1] = True
        first = ends[:-1][ends[:-1] < ends[1:]]
        cut[first] = True
        starts = np.flatnonzero(cut)
        bounds = np.append(starts, len(data)).astype(np.int32 if len(data) < 1 << 31 else np.int64)
        kind = pa.binary() if bounds.dtype == np.int32 else pa.large_binary()
        pieces = pa.Array.from_buffers(kind, len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)]).dictionary_encode()
        distinct, index = pieces.dictionary.to_numpy(zero_copy_only=False).tolist(), pieces.indices.to_numpy()
        slots = np.array([*map(self.memo.get, distinct, repeat(-1))], dtype=np.int32)
        self.used[slots[slots > 0]] = True
        whole = first[_BREAK[data[first]]]  # texts to be encoded whole, by where they begin
        new = np.flatnonzero(slots < 0)
        once = new[:0]
        if len(new):
            own = [distinct[i] for i in new.tolist()]
            sizes = np.array([*map(len, own)])
            joined = b"".join(own)
            raw, end = np.frombuffer(joined, dtype=np.uint8), np.cumsum(sizes)
            spaced = _BREAK[raw[end - sizes]]
            # a body that begins and ends with other ASCII than white space is safe, others are looked at
            safe = _PLAIN[raw[np.minimum(end - sizes + spaced, end - 1)]] & _PLAIN[raw[end - 1]]
            doubtful = {*np.flatnonzero(~safe).tolist()}
            if b"<" in joined:
                doubtful |= {i for i, piece in enumerate(own) if b"<" in piece}
            bad = np.array(sorted(i for i in doubtful if self._unsafe(str(own[i], "utf-8", "replace"))), dtype=np.int64)
            fine = np.ones(len(new), dtype=bool)
            fine[bad] = False
            if len(bad):
                slots[new[bad]] = 0
                places = starts[np.isin(index, new[bad])]
                whole = np.union1d(whole, ends[np.searchsorted(ends, places, side="right") - 1])
            keep, once = np.flatnonzero(fine & (sizes <= LONG)), new[fine & (sizes > LONG)]
            if len(keep):
                own = [own[i] for i in keep.tolist()]
                slots[new[keep]] = added = self._put(*self._learn(own, spaced[keep]))
                self.memo.update(zip(own, added.tolist(), strict=True))
        mark = self.count, self.fill
        if len(once):
            own = [distinct[i] for i in once.tolist()]
            slots[once] = self._put(*self._learn(own, np.array([p[0] in b" \n" for p in own])))
        which = slots[index]
        if len(whole):
            edges = ends[np.searchsorted(ends, whole, side="right")]
            ids = [_ids(e) for e in self.tokenizer.encode_batch([str(data[a:b], "utf-8", "replace") for a, b in zip(whole.tolist(), edges.tolist(), strict=True)], add_special_tokens=False)]
            own = self._put(np.concatenate(ids), np.array([len(x) for x in ids]))
            low, high = np.searchsorted(starts, whole), np.searchsorted(starts, edges)
            for a, b in zip(low.tolist(), high.tolist(), strict=True):
                which[a:b] = 0
            which[low] = own
        ids = self._gather(which)
        before = np.concatenate([[0], np.cumsum(self.length[which], dtype=np.int64)])
        self.count, self.fill = mark
        return ids, np.diff(before[np.searchsorted(starts, ends)])

    def _unsafe(self, piece: str) -> bool:
        """Whether more white space meets that before a piece, or that after it, or it may hold a special token."""
        body = piece[1:] if piece[0] in " \n" else piece
        return not body or body[0].isspace() or body[-1].isspace() or ("<" in body and any(s in body.lower() for s in self.special))

    def _learn(self, pieces: list[bytes], spaced: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of pieces, and how many each has.

        Those that begin with white space may follow one another in a call: the sizes of tokens, or else their offsets, tell their ids apart.
        """
        sized = spaced
        if not self.plain:  # only ASCII keeps its size, and white space inside has none
            sized = spaced & np.array([p.isascii() and len(p.split()) == 1 for p in pieces])
        word = sized & self._words(pieces) if self.plain else np.zeros(len(pieces), dtype=bool)
        ways = [np.flatnonzero(own).tolist() for own in (word, sized & ~word, spaced & ~sized, ~spaced)]
        ids, lengths = [], np.zeros(len(pieces), dtype=np.int64)
        for own, way in zip(ways, (self._worded, self._sized, self._offset, self._alone), strict=True):
            if own:
                some, lengths[own] = way([pieces[i] for i in own])
                ids.append(some)
        order = np.concatenate([np.array(own, dtype=np.int64) for own in ways])
        if not (np.diff(order) > 0).all():  # back into the order of pieces
            flat, own = np.concatenate(ids), lengths[order]
            begin = np.empty(len(pieces), dtype=np.int64)
            begin[order] = np.cumsum(own) - own
            return flat[np.repeat(begin - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(flat))], lengths
        return np.concatenate(ids), lengths

    def _alone(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        ids = [_ids(e) for e in self.tokenizer.encode_batch_fast([str(p, "utf-8", "replace") for p in pieces], add_special_tokens=False)]
        return np.concatenate(ids), np.array([len(x) for x in ids])

    def _words(self, pieces: list[bytes]) -> np.ndarray:
        """Whether each is a space and ASCII letters."""
        sizes = np.array([*map(len, pieces)])
        raw, end = np.frombuffer(b"".join(pieces), dtype=np.uint8), np.cumsum(sizes)
        right = _LETTER[raw]
        right[end - sizes] = raw[end - sizes] == 0x20
        return np.logical_and.reduceat(right, end - sizes)

    def _worded(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self._together(pieces, self.words, b" \xc4\xa0")  # U+0120 is the byte-level sign for a space

    def _sized(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return self._together(pieces, self.tokenizer, b" ")

    def _together(self, pieces: list[bytes], tokenizer: Tokenizer, space: bytes) -> tuple[np.ndarray, np.ndarray]:
        groups = [str(b"".join(pieces[i : i + TOGETHER]).replace(b" ", space), "utf-8", "replace") for i in range(0, len(pieces), TOGETHER)]
        ids = np.concatenate([_ids(e) for e in tokenizer.encode_batch_fast(groups, add_special_tokens=False)])
        ends, need = np.cumsum(self.sizes[ids]), np.cumsum([len(p) - (not self.plain) for p in pieces])
        if ends[-1] != need[-1]:  # bytes that aren't UTF-8
            return self._alone(pieces)
        return ids, np.diff(np.searchsorted(ends, need) + 1, prepend=0)

    def _offset(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        texts = [str(p, "utf-8", "replace") for p in pieces]
        ids, starts, base = [], [], 0
        groups = ["".join(texts[i : i + TOGETHER]) for i in range(0, len(texts), TOGETHER)]
        for group, e in zip(groups, self.tokenizer.encode_batch(groups, add_special_tokens=False), strict=True):
            ids.append(_ids(e))
            starts += [base + a for a, _ in e.offsets]
            base += len(group)
        return np.concatenate(ids), np.diff(np.searchsorted(np.array(starts, dtype=np.int64), np.cumsum([*map(len, texts)])), prepend=0)

    def sentence_ends(self) -> np.ndarray:
        """True at ids that end a sentence: tokens of closing punctuation with a full stop, ! or ?."""
        ends = np.zeros(1 << 16, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            bare = token.removesuffix("</w>")
            if bare and bare.strip(".!?\"')") == "" and set(bare) & set(".!?"):
                ends[i] = True
        return ends
