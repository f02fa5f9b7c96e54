from __future__ import annotations

import zlib

import numpy as np

from rotaframe.llm.sharding import Permutation, read_order, shard

from .helpers import clashing, documents, frame


def test_permutations_and_their_inverses():
    for n in (1, 2, 3, 5, 16, 17, 1000, 4097):
        p = Permutation(n, 9)
        m = p.of(np.arange(n))
        assert sorted(m.tolist()) == list(range(n))
        assert (p.inverse(m) == np.arange(n)).all()
    assert (Permutation(1000, 1).of(np.arange(1000)) != Permutation(1000, 2).of(np.arange(1000))).any()


def test_it_shuffles():
    m = Permutation(10_000, 3).of(np.arange(10_000))
    assert abs(np.corrcoef(np.arange(10_000), m)[0, 1]) < 0.05
    # neighbours are spread over shards as by chance
    assert abs((m[1:] % 8 == m[:-1] % 8).mean() - 1 / 8) < 0.02


def test_rows(spark):
    rows = documents()
    runs = []
    for df in (frame(spark), clashing(spark), frame(spark).repartition(5)):
        got = shard(df, 8).collect()
        assert len(got) == len(rows)
        assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
        slots = {}
        for r in got:
            slots.setdefault(r.shard, []).append(r.slot)
        assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
        assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
        runs.append(sorted(map(str, ((r.doc_id, r.text_crc32, r.shard, r.slot) for r in got))))
    assert runs[0] == runs[1] == runs[2]
    assert shard(frame(spark, [])).collect() == []
    one = spark.createDataFrame([(7, "x")], "doc_id long, text string")
    assert [(r.shard, r.slot) for r in shard(one, 8).collect()] == [(0, 0)]
    first = read_order(frame(spark, rows[:50]), shard(frame(spark, rows[:50]), 8), 8, 3).collect()
    assert len(first) in (6, 7)


def scalar_permutation(n: int, seed: int, x: int) -> int:
    """The network in Python's own integers, a number at a time."""
    word = (1 << 64) - 1
    half = 1
    while 4**half < n:
        half += 1
    mask = (1 << half) - 1
    while True:
        left, right = divmod(x, 1 << half)
        for r in range(8):
            z = (right + seed * 0x2545F4914F6CDD1D + r * 0x9E3779B97F4A7C15) & word
            z = z * 0x9E3779B97F4A7C15 & word
            z ^= z >> 29
            z = z * 0xBF58476D1CE4E5B9 & word
            left, right = right, left ^ ((z ^ (z >> 32)) & mask)
        x = (left << half) | right
        if x < n:
            return x


def test_the_permutation_is_that_of_a_plain_loop():
    for n, seed in ((1, 5), (2, 1), (7, 3), (16, 2), (17, 2), (300, 11)):
        assert Permutation(n, seed).of(np.arange(n)).tolist() == [scalar_permutation(n, seed, x) for x in range(n)]


def test_shards_are_those_of_a_plain_loop(spark):
    import inspect

    seed = inspect.signature(shard).parameters["seed"].default
    rows = [r for r in documents(60) if r[0] is not None]
    rows = list({r[0]: r for r in rows}.values())  # of one id once: then the order is that of ids
    order = sorted(r[0] for r in rows)
    want = {d: divmod(scalar_permutation(len(rows), seed, i), 8)[::-1] for i, d in enumerate(order)}
    assert {r.doc_id: (r.shard, r.slot) for r in shard(frame(spark, rows), 8).collect()} == want
