"""Binary blocks of token ids: an adaptive context-mixing range coder.

A block is coded on its own, from reset models, and carries a checksum. Its ids
are cut into `lanes` contiguous runs that are coded side by side, so that numpy
handles one id of every lane at a step; all lanes of a block share the models,
which learn from a step's ids before the next one, in coder and decoder alike.

Three predictions are mixed:
order 2: the id that last followed the two ids before;
order 1: the id that last followed the one id before;
order 0: the frequencies of all ids of the block so far.
Each context of orders 1 and 2 has a confidence (how often its id was right of
late), and for every pair of confidences the shares of the three are counted:
whether order 2 was right, else order 1, else neither. The mixed distribution
is (share 2) at the one id, (share 1) at the other, and (share 0) spread over
all ids by their frequencies; a range coder of 64 bits of state narrows its
interval by it. When the interval is under 2**32, the upper half of its low end
goes out as one word; an interval that straddles two such words is cut short at
the border first, so there is no carry, and one word a step is always enough.

Block: magic, counts, checksum of all that follows, doc table (id, length),
words of each lane, the lanes' words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"RTK2"
HEAD = struct.Struct("<4sIIIII")  # magic, ids, docs, lanes, vocabulary, crc32 of the rest
WORD = np.uint64(32)
LOW = np.uint64((1 << 32) - 1)
ONE = np.int32(1)
SHARE_BITS = np.uint64(12)
SHARE = 1 << 12  # scale of the three shares
MOST = 1 << 20  # the frequencies of order 0 add up to less
SLOTS = 1 << 18  # of order 2
SUREST = np.int32(3)  # a confidence grows by one with a hit, up to this, and is 0 after a miss


class Model:
    """What coder and decoder know before a step; both make it from the same ids.

    Predictions are kept as 4 * id + confidence. Ids, slots and keys are places in
    tables and have 64 bits, as numpy wants of those. A key is 16 * confidence of order 2
    + 4 * confidence of order 1 + which prediction was right: 0 order 2, 1 order 1, 2 neither.
    """

    def __init__(self, vocabulary: int, decodes: bool) -> None:
        self.decodes = decodes
        self.vocabulary = vocabulary
        self.next1 = np.zeros(vocabulary, dtype=np.int32)
        self.next2 = np.zeros(SLOTS, dtype=np.int32)
        self.counts = np.ones(vocabulary, dtype=np.int64)
        self.ids = np.arange(vocabulary, dtype=np.uint16 if vocabulary <= 1 << 16 else np.int32)  # the smaller, the more of inverse is in a cache
        self.shares = np.tile(np.array([2, 2, 12, 0], dtype=np.int64), 16)
        self.step = 0
        self.seen: list[np.ndarray] = []
        self.keys: list[np.ndarray] = []
        self._weigh()
        self._count()

    def _count(self) -> None:
        """Cumulative frequencies of order 0, every id above zero."""
        counts = self.counts
        if counts.sum() >= MOST:
            counts = self.counts = (counts + 1) >> 1
        ends = np.cumsum(counts)
        self.cumulative, self.each = (ends - counts).astype(np.uint64), counts.astype(np.uint64)
        self.total = np.uint64(ends[-1])
        # for the decoder: the id at each point
        self.inverse = np.repeat(self.ids, counts) if self.decodes else None

    def _weigh(self) -> None:
        """By key: where its share begins, and how wide it is; at least 1 for orders 2 and 1, and 62 for order 0."""
        own = self.shares.reshape(16, 4)
        total = own.sum(axis=1)
        e2 = np.maximum(1, own[:, 0] * (SHARE - 64) // total)
        e1 = e2 + np.maximum(1, own[:, 1] * (SHARE - 64) // total)
        zero = np.zeros(16, dtype=np.int64)
        bottom, top = np.stack([zero, e2, e1, zero], axis=1), np.stack([e2, e1, zero + SHARE, zero], axis=1)
        self.bottom, self.width = bottom.ravel().astype(np.uint64), (top - bottom).ravel().astype(np.uint64)
        self.end2, self.end1 = e2.astype(np.uint64), e1.astype(np.uint64)

    def learn(self, now: np.ndarray, a: np.ndarray, slot: np.ndarray, miss2: np.ndarray, miss1: np.ndarray, key: np.ndarray) -> None:
        """now: 4 * the step's ids; miss2, miss1: prediction ^ now, under 4 where it was right, and the confidence then."""
        # lanes with one context: the last lane's entry stands, as numpy assigns in order
        self.next2[slot] = now + np.minimum(miss2 + 1, SUREST) * (miss2 < 4)
        self.next1[a] = now + np.minimum(miss1 + 1, SUREST) * (miss1 < 4)
        self.seen.append(now)
        self.keys.append(key)
        self.step += 1
        step = self.step
        if step < 8 or step % 4 == 0:
            self.shares += np.bincount(np.concatenate(self.keys), minlength=64) * 8
            self.keys = []
            if step % 8 == 0:
                self.shares = (self.shares >> 1) + np.tile(np.array([1, 1, 1, 0]), 16)
            self._weigh()
        if step % 32 == 0 or step < 32 and step & (step - 1) == 0:
            self.counts += np.bincount(np.concatenate(self.seen) >> 2, minlength=self.vocabulary) * 2
            self.seen = []
            self._count()


def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of order 2, for the id before and the one before that."""
    return (a * 0x9E3B + b * 0x85EB) & (SLOTS - 1)


def lanes_of(n: int) -> int:
    return max(1, min(4096, n // 128))


def _runs(n: int, columns: np.ndarray) -> list[tuple[slice, np.ndarray]]:
    """Places in the ids of whole lanes' runs, and the part of columns (steps, lanes) that has them side by side; the first lanes' are one longer where n doesn't divide."""
    lanes = columns.shape[1]
    base, more = divmod(n, lanes)
    cut = more * (base + 1)
    return [(slice(0, cut), columns[: base + 1, :more]), (slice(cut, n), columns[:base, more:])]


def _encode_ids(ids: np.ndarray, vocabulary: int) -> tuple[np.ndarray, np.ndarray]:
    """(words of each lane, all lanes' words)."""
    n = len(ids)
    lanes = lanes_of(n)
    steps, short = -(-n // lanes), n // lanes
    model = Model(vocabulary, False)
    low, size = np.zeros(lanes, dtype=np.uint64), np.full(lanes, ~np.uint64(0))
    # a step's ids side by side, after two steps of id 0
    columns = np.zeros((steps + 2, lanes), dtype=np.int64)
    for places, own in _runs(n, columns[2:]):
        own[:] = ids[places].reshape(own.shape[::-1]).T
    marked = (columns << 2).astype(np.int32)
    whose, words = [], []
    for t in range(steps):
        m = lanes if t < short else n - short * lanes
        a, now = columns[t + 1, :m], marked[t + 2, :m]
        slot = _slot(a, columns[t, :m])
        p2, p1 = model.next2.take(slot), model.next1.take(a)
        miss2, miss1 = p2 ^ now, p1 ^ now
        which = (miss2 > 3) * ((miss1 > 3) + ONE)
        key = (((p2 & 3) << 4) + ((p1 & 3) << 2) + which).astype(np.int64)
        r = size[:m] >> SHARE_BITS
        first, width = r * model.bottom.take(key), r * model.width.take(key)
        rest = np.flatnonzero(which == 2)
        x = columns[t + 2].take(rest)
        unit = width.take(rest) // model.total
        first[rest] += unit * model.cumulative.take(x)
        width[rest] = unit * model.each.take(x)
        lo = low[:m]
        lo += first
        out = np.flatnonzero(width <= LOW)
        if len(out):
            own = lo[out]
            whose.append(out.astype(np.uint16))
            words.append((own >> WORD).astype(np.uint32))
            width[out] = np.minimum(width[out], (LOW - (own & LOW)) + np.uint64(1)) << WORD
            lo[out] = own << WORD
        size[:m] = width
        model.learn(now, a, slot, miss2, miss1, key)
    every = np.arange(lanes, dtype=np.uint16)
    whose += [every, every]  # what is left of the state
    words += [(low >> WORD).astype(np.uint32), (low & LOW).astype(np.uint32)]
    lane = np.concatenate(whose)
    return np.bincount(lane, minlength=lanes), np.concatenate(words)[np.argsort(lane, kind="stable")]


def _decode_ids(n: int, lanes: int, used: np.ndarray, flat: np.ndarray, vocabulary: int) -> np.ndarray:
    steps, short = -(-n // lanes), n // lanes
    model = Model(vocabulary, True)
    low, size = np.zeros(lanes, dtype=np.uint64), np.full(lanes, ~np.uint64(0))
    at = np.cumsum(used) - used
    flat = flat.astype(np.uint64)
    code = (flat[at] << WORD) | flat[at + 1]
    at = at + 2
    columns = np.zeros((steps + 2, lanes), dtype=np.int64)
    for t in range(steps):
        m = lanes if t < short else n - short * lanes
        a = columns[t + 1, :m]
        slot = _slot(a, columns[t, :m])
        p2, p1 = model.next2.take(slot), model.next1.take(a)
        cell = (((p2 & 3) << 2) + (p1 & 3)).astype(np.int64)
        lo, r, co = low[:m], size[:m] >> SHARE_BITS, code[:m]
        off = co - lo
        which = (off >= r * model.end2.take(cell)).astype(np.int64) + (off >= r * model.end1.take(cell))
        key = (cell << 2) + which
        first, width = r * model.bottom.take(key), r * model.width.take(key)
        now = np.where(which == 0, p2, p1) & ~3
        rest = np.flatnonzero(which == 2)
        unit, base = width.take(rest) // model.total, first.take(rest)
        x = model.inverse.take(np.minimum((off.take(rest) - base) // unit, model.total - np.uint64(1)).astype(np.int64)).astype(np.int64)
        now[rest] = x << 2
        first[rest] = base + unit * model.cumulative.take(x)
        width[rest] = unit * model.each.take(x)
        lo += first
        out = np.flatnonzero(width <= LOW)
        if len(out):
            own, place = lo[out], at[out]
            co[out] = (co[out] << WORD) | flat[place]
            at[out] = place + 1
            width[out] = np.minimum(width[out], (LOW - (own & LOW)) + np.uint64(1)) << WORD
            lo[out] = own << WORD
        size[:m] = width
        columns[t + 2, :m] = now >> 2
        model.learn(now, a, slot, p2 ^ now, p1 ^ now, key)
    return np.concatenate([own.T.ravel() for _, own in _runs(n, columns[2:])])


def encode_block(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, vocabulary: int) -> bytes:
    """One block of whole documents; ids are theirs, one after another."""
    used, flat = _encode_ids(ids, vocabulary) if len(ids) else (np.zeros(1, dtype=np.int64), np.zeros(0, dtype=np.uint32))
    known = np.array([d is not None for d in doc_ids], dtype=np.uint8)
    table = np.array([d or 0 for d in doc_ids], dtype="<i8").tobytes() + known.tobytes() + np.array(lengths, dtype="<u4").tobytes()
    body = table + used.astype("<u4").tobytes() + flat.astype("<u4").tobytes()
    return HEAD.pack(MAGIC, len(ids), len(doc_ids), len(used), vocabulary, zlib.crc32(body)) + body


def decode_block(block: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc ids, lengths and ids of a block; ValueError if it isn't whole."""
    if len(block) < HEAD.size:
        raise ValueError("not a block of token ids")
    magic, n, docs, lanes, vocabulary, crc = HEAD.unpack_from(block)
    body = block[HEAD.size :]
    if magic != MAGIC or zlib.crc32(body) != crc:
        raise ValueError("a block of token ids is damaged")
    own = np.frombuffer(body, dtype="<i8", count=docs)
    known = np.frombuffer(body, dtype=np.uint8, count=docs, offset=8 * docs)
    lengths = np.frombuffer(body, dtype="<u4", count=docs, offset=9 * docs).astype(np.int64)
    used = np.frombuffer(body, dtype="<u4", count=lanes, offset=13 * docs).astype(np.int64)
    flat = np.frombuffer(body, dtype="<u4", offset=13 * docs + 4 * lanes)
    ids = _decode_ids(n, lanes, used, flat, vocabulary) if n else np.zeros(0, dtype=np.int64)
    return [int(d) if k else None for d, k in zip(own, known, strict=True)], lengths, ids
