from __future__ import annotations

import hashlib
import random
import zlib

from rotaframe.llm import prefix_trie as trie
from rotaframe.llm.prefix_trie import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def expected(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        base = c - (abs(c) % 5) * (1 if c >= 0 else -1)
        built[c] = own.get(base, [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[n] for n in below) if below else 1
        saved[node] = sum(saved[n] for n in below) + (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0)
    out = []
    for node, convs in members.items():
        ends = sorted(c for c in convs if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        out.append((min(convs), len(node), parent, len(convs), len(children.get(node, [])), leaves[node], saved[node], hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(map(str, out))


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


def conversations(n=60, seed=2):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        # few texts, so that prefixes are shared
        rows += [(c, t, rng.choice(["user", "assistant"]), rng.choice(["a", "bé", "c"])) for t in range(rng.randrange(1, 8))]
    rows += [(c, t, "user", "same") for c in range(100, 180) for t in range(3)]
    rows += [(300, None, None, None), (300, None, "user", None), (300, 1, None, "x"), (301, 5, "user", ""), (None, 1, "user", "lost"), (-7, 1, "user", "minus"), (-3, 1, "user", "less")]
    return [*rows, rows[0], rows[0]]


def test_nodes_are_those_of_a_plain_trie(spark):
    rows = conversations()
    assert rows_of(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == expected(rows)
    clash = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for name in ("depth", "place", "part", "lane0", "key0", "pointer0", "h", "m", "base", "length", "n_bytes", "turn_hash"):
        clash = clash.selectExpr("*", f"'clash' AS {name}")
    assert rows_of(prefix_trie(clash)) == expected(rows)


def test_empty_tables_and_single_conversations(spark):
    assert prefix_trie(spark.createDataFrame([], SCHEMA)).collect() == []
    assert prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).collect() == []
    for c in (4, 5, 9):  # with and without the one it is built on
        rows = [(c, t, "user", f"t{t}") for t in range(3)]
        assert rows_of(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == expected(rows)


def test_long_conversations_over_ranges_and_rounds(spark):
    rng = random.Random(8)
    rows = [(c, t, "user", rng.choice("ab") if t > 150 else "same") for c in (10, 11, 12) for t in range(400)]
    rows += [(20 + c, t, "user", "x") for c in range(30) for t in range(2)]
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # one conversation in several ranges
    try:
        assert rows_of(prefix_trie(spark.createDataFrame(rows, SCHEMA))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_runs_of_many_ends(spark, monkeypatch):
    monkeypatch.setattr(trie, "RUN", 50)
    ends = spark.createDataFrame([(0, 0, c) for c in range(100)] + [(1, 2, 5)], "key0 long, key1 long, conv_id long").repartition(4)
    want = {(0, 0): hashlib.sha256(",".join(map(str, range(100))).encode()).hexdigest(), (1, 2): hashlib.sha256(b"5").hexdigest()}
    assert {(r.key0, r.key1): r.ends_sha256 for r in trie.ends_digests(ends).collect()} == want


def test_scratch_tables_go(spark, tmp_path):
    import os

    rows = conversations(20)
    out = prefix_trie(spark.createDataFrame(rows, SCHEMA))
    folder = trie.shared_folder(spark)
    newest = max((f"{folder}/{d}" for d in os.listdir(folder) if d.startswith("trie-")), key=os.path.getmtime)
    assert rows_of(out) == expected(rows)
    assert len(os.listdir(newest)) <= 7  # not the tables of all rounds
