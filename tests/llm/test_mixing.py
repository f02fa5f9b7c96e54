from __future__ import annotations

import itertools
import random
import re

from rotaframe.llm.mixing import capped_targets, min_cost_flow, mix, repeat_documents

from .helpers import clashing, documents, frame


def test_targets():
    assert capped_targets([10, 10, 10], [3, 1, 2], 45, 2) == [20.0, 25 / 3, 50 / 3]
    assert capped_targets([0, 0], [3, 1], 0, 2) == [0.0, 0.0]
    for seed in range(50):
        rng = random.Random(seed)
        sizes = [rng.randrange(1000) for _ in range(rng.randrange(1, 9))]
        targets = capped_targets(sizes, [(3, 1, 2)[i % 3] for i in range(len(sizes))], 1.5 * sum(sizes), 2)
        assert all(t <= 2 * s + 1e-6 for t, s in zip(targets, sizes, strict=True))
        assert abs(sum(targets) - 1.5 * sum(sizes)) < 1e-6


def test_flow_is_largest_and_cheapest():
    for seed in range(40):
        rng = random.Random(seed)
        p, s = rng.randrange(1, 4), rng.randrange(1, 3)
        capacities = [rng.randrange(0, 4) for _ in range(p)]
        members = [tuple(sorted(rng.sample(range(s), rng.randrange(1, s + 1)))) for _ in range(p)]
        quotas = [rng.randrange(0, 6) for _ in range(s)]
        flow = min_cost_flow(capacities, members, quotas, 2)

        def cost(use):
            return sum(max(0, u - c) for u, c in zip(use, capacities, strict=True))

        best = None
        cells = [(i, j) for i in range(p) for j in members[i]]
        for amounts in itertools.product(range(6), repeat=len(cells)):
            use, got = [0] * p, [0] * s
            for (i, j), a in zip(cells, amounts, strict=True):
                use[i] += a
                got[j] += a
            if all(u <= 2 * c for u, c in zip(use, capacities, strict=True)) and all(g <= q for g, q in zip(got, quotas, strict=True)):
                key = (-sum(got), cost(use))
                best = key if best is None else min(best, key)
        assert (-sum(map(sum, flow)), cost([sum(f) for f in flow])) == best


def test_documents(spark):
    rows = documents()
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    names = sorted(n for n in sizes if n is not None) + [None]
    targets = dict(zip(names, capped_targets([sizes[n] for n in names], [(3, 1, 2)[i % 3] for i in range(len(names))], 1.5 * sum(sizes.values()), 2), strict=True))
    runs = []
    for df in (frame(spark), frame(spark).repartition(7)):
        got = mix(df).collect()
        assert len(got) == len(rows)
        taken: dict = {}
        for r in got:
            (source,) = r.sources
            assert r.source_size == sizes[source] and abs(r.target - targets[source]) < 1e-6
            assert r.taken == r.copies * r.size and 0 <= r.copies <= 2
            taken[source] = taken.get(source, 0) + r.taken
        biggest = max(size(r[1]) for r in rows)
        assert all(abs(taken[n] - targets[n]) <= biggest for n in names)
        runs.append(sorted(((r.doc_id, r.taken) for r in got), key=str))
    assert [r for r in runs[0] if r[0] != 0] == [r for r in runs[1] if r[0] != 0]
    assert len(mix(clashing(spark).drop("sources")).collect()) == len(rows)
    assert mix(frame(spark, [])).collect() == []


def test_what_a_long_document_leaves_is_filled(spark):
    for seed in range(4):
        rows = [(100 * seed + i, "w " * (i % 5 + 1), "a") for i in range(40)] + [(1000 + seed, "w " * 115, "a"), (2000 + seed, None, "a")]
        got = mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        short = got[0].target - sum(r.taken for r in got)
        whole = min(r.copies for r in got if r.size)
        assert 0 <= short < min((r.size for r in got if r.size and r.copies == whole), default=1)
        assert max(r.copies for r in got) <= 2 and len(got) == len(rows)


def test_overlapping_sources(spark):
    rows = [(i, "w " * 10, ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else ["b"]) for i in range(90)]
    got = mix(spark.createDataFrame(rows, "doc_id long, text string, source array<string>")).collect()
    assert len({tuple(r.sources) for r in got}) == 3 and abs(sum(r.taken for r in got) - 1.5 * 900) <= 30


def test_repeating(spark):
    df = frame(spark)
    want = {}
    for r in mix(df).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.copies
    got: dict = {}
    for r in repeat_documents(df).collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + 1
    assert got == {k: v for k, v in want.items() if v}
