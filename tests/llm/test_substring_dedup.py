from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

import rotaframe.llm.substring_dedup as module
from rotaframe.llm.substring_dedup import longest_previous, prefix_ranks, sliding_min, substring_dedup

from .helpers import clashing, documents, frame


def brute(rows, length, keep_first):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at = defaultdict(list)
    for i, (_, t) in enumerate(rows):
        for s in range(len(t) - length + 1):
            at[t[s : s + length]].append((i, s))
    cover = [bytearray(len(t)) for _, t in rows]
    for places in at.values():
        if len(places) > 1:
            for i, s in places[1:] if keep_first else places:
                cover[i][s : s + length] = b"\1" * length
    out = []
    for (d, t), c in zip(rows, cover, strict=True):
        rest = bytes(x for x, y in zip(t, c, strict=True) if not y)
        out.append((d, len(t), sum(c), sum(1 for i in range(len(c)) if c[i] and not (i and c[i - 1])), hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    passages = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzé ", k=rng.randrange(100, 700))) for _ in range(10)]
    out = []
    for i in range(40):
        out.append((i, "".join(rng.choice(passages)[rng.randrange(50) :] if rng.random() < 0.6 else "".join(rng.choices("abcdefgh", k=200)) for _ in range(rng.randrange(6)))))
    return [*out, (100, "a" * 1500), (101, "ab" * 900), (102, "a" * 399), (103, "")]


@pytest.mark.parametrize(("hot", "keep_first"), [(2048, False), (2048, True), (3, False), (3, True)])
def test_against_all_windows(spark, rows, monkeypatch, hot, keep_first):
    monkeypatch.setattr(module, "HOT", hot)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = substring_dedup(df, 400, keep_first).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
    assert sorted(map(tuple, got), key=str) == brute([(d, t.encode()) for d, t in rows], 400, keep_first)


def test_odd_rows(spark):
    rows = documents()
    for df in (frame(spark), clashing(spark)):
        got = substring_dedup(df, 200, False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()
        assert sorted(map(tuple, got), key=str) == brute([(r[0], (r[1] or "").encode()) for r in rows], 200, False)
    assert substring_dedup(frame(spark, [])).collect() == []


def test_longest_previous_factors():
    rng = np.random.default_rng(5)
    data = rng.integers(0, 2, 400).astype(np.uint8)
    rank = prefix_ranks(data, 9)[: len(data) - 8]
    before, after = longest_previous(rank, np.arange(len(rank)))
    texts = [data[i : i + 9].tobytes() for i in range(len(rank))]
    assert before.tolist() == [t in texts[:i] for i, t in enumerate(texts)]
    assert after.tolist() == [t in texts[i + 1 :] for i, t in enumerate(texts)]
    # the order of ranks is that of suffixes
    assert [texts[i] for i in np.argsort(rank, kind="stable")] == sorted(texts)


def test_sliding_min():
    x = np.random.default_rng(1).integers(0, 99, 50).astype(np.uint64)
    for w in (1, 2, 7, 50):
        assert sliding_min(x, w).tolist() == [x[i : i + w].min() for i in range(len(x) - w + 1)]
