from __future__ import annotations

import hashlib

from rotaframe.llm.exact_dedup import exact_dedup, keep_one

from .helpers import clashing, documents, frame


def expected(rows):
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault(r[1] or "", []).append(r[0])
    out = []
    for text, ids in groups.items():
        keep = max(ids, key=lambda i: (i is not None, i or 0))
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_against_groups_by_text(spark):
    for df in (frame(spark), clashing(spark)):
        for counters in (2, 512):  # few counters: nearly all by the shuffle
            got = exact_dedup(df, counters=counters).collect()
            assert sorted([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got], key=str) == expected(documents())
            # of each group one row stays, of repeated rows too
            kept = [r.text_sha256 for r in got if r.kept]
            assert len(kept) == len(set(kept)) == len({r.text_sha256 for r in got})
            assert all(r.doc_id == r.keep_id for r in got if r.kept)


def test_a_hot_group_is_settled_on_the_map_side(spark):
    rows = [(i, "hot" if i % 3 else f"t{i}", "en", "a", 1) for i in range(600)]
    got = exact_dedup(frame(spark, rows), counters=8).collect()
    assert {(r.keep_id, r.group_size) for r in got if r.group_size > 1} == {(599, 400)}
    plan = exact_dedup(frame(spark, rows), counters=8)._jdf.queryExecution().toString()
    assert "Python" not in plan and "BroadcastHashJoin" in plan


def test_keep_one_and_empty(spark):
    rows = documents()
    got = keep_one(frame(spark)).collect()
    assert sorted({r.text or "" for r in got}) == sorted({r[1] or "" for r in rows}) and len(got) == len({r[1] or "" for r in rows})
    assert exact_dedup(frame(spark, [])).collect() == [] and keep_one(frame(spark, [])).collect() == []
