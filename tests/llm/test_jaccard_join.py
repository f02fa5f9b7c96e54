from __future__ import annotations

import random

import rotaframe.llm.jaccard_join as module
from rotaframe.llm.jaccard_join import components, jaccard_join, keep_one_of_each, pack_sorted, shingle_sets, unpack_sorted

from .helpers import clashing, documents, frame


def brute(rows, n=5, num=75, den=100):
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else []))
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and den * len(a & sets[j]) >= num * len(a | sets[j]):
                parent[find(i)] = find(j)
    least: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), least.get(find(i)) if s else d) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def near_copies(n, seed, edits):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    passage = " ".join(f"p{i}" for i in range(40))
    rows = []
    for i in range(n):
        own = list(base)
        for _ in range(rng.randrange(edits)):
            own[rng.randrange(len(own))] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(own) if i % 3 else passage + " " + " ".join(f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 90)))))
    return rows


def result(df):
    return sorted(map(tuple, jaccard_join(df).select("doc_id", "n_shingles", "component_id").collect()), key=str)


def test_near_copies_and_a_common_passage(spark, monkeypatch):
    monkeypatch.setattr(module, "BLOCK_BYTES", 20_000)  # many blocks
    for hot, edits in ((8, 8), (2, 14)):
        monkeypatch.setattr(module, "LOCALLY_HOT", hot)
        rows = near_copies(150, edits, edits)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        assert result(df) == brute(rows)


def test_pairs_left_after_the_rounds_are_compared(spark, monkeypatch):
    monkeypatch.setattr(module, "ROUNDS", 0)
    rows = near_copies(90, 5, 14)
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_labels_are_dealt_by_all_their_rows(spark, monkeypatch):
    given = []
    monkeypatch.setattr(module, "fitting", lambda df, rows: given.append((df.columns, df.count(), rows)) or df)
    rows = near_copies(60, 3, 8)
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
    labels = [(n, r) for c, n, r in given if c == ["node", "component"]]
    assert len(labels) == module.ROUNDS + 1 and labels[-1][0] > 0 and all(n <= r for n, r in labels)


def test_chains_are_one_component(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(words[3 * i : 3 * i + 60])) for i in range(80)]
    want = brute(rows)
    assert {c for _, _, c in want} == {0}
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == want


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in documents()]
    for df in (frame(spark), clashing(spark)):
        assert result(df) == brute(rows)
    assert jaccard_join(frame(spark, [])).collect() == []


def test_keep_one(spark):
    rows = [(r[0], r[1]) for r in documents(60) if r[0] is not None]
    keep = {d for d, _, c in brute(rows) if d == c}
    got = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id for r in got} == keep


def test_keep_one_of_rows_with_repeated_ids(spark):
    a, b, c, d, e = (" ".join(f"{x}{i}" for i in range(40)) for x in "abcde")
    rows = [(1, a), (2, a + " more"), (2, b), (3, c), (3, c), (4, d), (4, e), (4, d + " more"), (5, ""), (5, ""), (None, a), (6, b), (7, "own text")]
    got = keep_one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = sorted(((r.doc_id, r.text.replace(" more", "")) for r in got), key=str)
    assert got == sorted([(1, a), (2, b), (3, c), (4, d), (4, e), (5, ""), (5, ""), (None, a), (7, "own text")], key=str)


def test_packed_hashes_and_short_texts():
    import numpy as np

    x = np.sort(np.random.default_rng(1).integers(0, 2**64, 100, dtype=np.uint64))
    assert (unpack_sorted(pack_sorted(x)) == x).all() and len(unpack_sorted(pack_sorted(x[:0]))) == 0
    a, b, c, d = shingle_sets([b"a b", b"A B", b"a b c", b""], 5, {})
    assert a.tolist() == b.tolist() != c.tolist() and len(d) == 0


def test_short_texts_alone_in_a_partition(spark):
    for words in range(1, 5):
        (own,) = shingle_sets([b"a b c d"[: 2 * words - 1]], 5, {})
        assert len(own) == 1
    rows = [(i, "a b c d"[: 2 * (i % 4) + 1]) for i in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(8, "doc_id")
    assert result(df) == brute(rows)


def test_components_of_random_graphs(spark):
    rng = random.Random(7)
    edges = [(rng.randrange(-60, 60), rng.randrange(-60, 60)) for _ in range(70)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    adjacent: dict = {}
    for u, v in edges:
        adjacent.setdefault(u, set()).add(v)
        adjacent.setdefault(v, set()).add(u)
    for node in adjacent:
        seen, stack = {node}, [node]
        while stack:
            for y in adjacent[stack.pop()] - seen:
                seen.add(y)
                stack.append(y)
        assert got.get(node, node) == min(seen)


def test_no_edges_take_no_steps(spark, monkeypatch):
    stored, own = [], module.checkpoint
    monkeypatch.setattr(module, "checkpoint", lambda df: stored.append(df) or own(df))
    edges = spark.createDataFrame([(5, 4), (4, 3), (9, 3), (8, 7), (6, 6)], "u long, v long")
    assert {r.node: r.component for r in components(edges).collect()} == {4: 3, 5: 3, 9: 3, 8: 7}
    assert len(stored) > 1
    stored.clear()
    assert components(edges.filter("u = 6")).collect() == [] and len(stored) == 1
