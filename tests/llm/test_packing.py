from __future__ import annotations

import random
import zlib
from functools import cache

import numpy as np

from rotaframe.llm.packing import Stream, choose_cuts, cut_places, pack
from rotaframe.llm.queries import vocabulary
from rotaframe.llm.tokens import Encoder

from .helpers import clashing, documents, frame


def test_cuts_cost_least():
    for seed in range(60):
        rng = random.Random(seed)
        places = np.array(sorted(rng.sample(range(1, 60), rng.randrange(3, 12))))
        window = max(12, int(np.diff(places, prepend=0).max()))
        kinds = np.array([rng.randrange(3) for _ in places])
        price = (0, 3, 9)

        @cache
        def best(i: int, places=tuple(places.tolist()), kinds=tuple(kinds.tolist()), window=window) -> int:
            at = places[i - 1] if i else 0
            if i == len(places):
                return 0
            return min(window - (places[j] - at) + price[kinds[j]] + best(j + 1) for j in range(i, len(places)) if places[j] - at <= window)

        cuts = choose_cuts(places, kinds, window, 3, 9)
        ends = [0, *places[cuts].tolist()]
        cost = sum(window - (b - a) for a, b in zip(ends, ends[1:], strict=False)) + sum(price[kinds[c]] for c in cuts)
        assert ends[-1] == places[-1] and all(b - a <= window for a, b in zip(ends, ends[1:], strict=False)) and cost == best(0)


def test_long_gaps_get_places():
    places, kinds = cut_places(np.array([5, 5000, 3]), np.array([2, 700]), 64)
    assert np.diff(places, prepend=0).max() <= 64 and {5, 5005, 5008, 2, 700} <= set(places.tolist())
    assert kinds[places.tolist().index(5)] == 0 and kinds[places.tolist().index(2)] == 1


def test_a_stream_worked_off_in_stretches():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 99, rng.integers(1, 300)).astype(np.uint16) for _ in range(60)]
    s = Stream(64, 500, 4, 40)
    pieces = [p for i, d in enumerate(docs) for p in s.add(i, d, np.flatnonzero(d[:-1] < 9) + 1)] + list(s.pack(last=True))
    whole(pieces, dict(enumerate(docs)), 64)
    assert [(p[0], p[1]) for p in pieces] == sorted((p[0], p[1]) for p in pieces)


def whole(pieces, docs, window):
    """Each id in one piece; offsets without gaps; sequences no longer than the window."""
    got: dict = {}
    for doc, start, length, crc, total, sequence, offset in pieces:
        ids = docs[doc]
        assert total == len(ids) and crc == zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
        got.setdefault(doc, []).append((start, length))
    assert set(got) == set(docs)
    for doc, parts in got.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at and length > 0
            at += length
        assert at == len(docs[doc])
    sequences: dict = {}
    for _, _, length, _, _, sequence, offset in pieces:
        sequences.setdefault(sequence, []).append((offset, length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= window


def test_rows(spark):
    path = vocabulary("word_bpe_49k.json")
    encoder = Encoder(path)
    rows = [r for r in documents() if r[0] is not None][:-2]
    docs = {r[0]: np.array([*encoder.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 2]) for r in rows}
    for df in (frame(spark, rows), clashing(spark).filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"])):
        whole([tuple(r) for r in pack(df, path).collect()], docs, 4096)
    assert len(pack(frame(spark), path).select("doc_id").distinct().collect()) == len(docs) + 1
    assert pack(frame(spark, []), path).collect() == []


def test_little_padding(spark):
    path = vocabulary("word_bpe_49k.json")
    rows = [(i, " ".join(["word is here."] * random.Random(i).randrange(10, 300)), "en", "a", 1) for i in range(400)]
    got = pack(frame(spark, rows).repartition(1), path).collect()
    tokens, sequences = sum(r.length for r in got), len({r.sequence_id for r in got})
    slices = len({r.sequence_id >> 33 for r in got})
    assert (sequences - slices) * 4096 < 1.02 * tokens
