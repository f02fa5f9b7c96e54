from __future__ import annotations

import random
import re
from collections import Counter

from rotaframe.llm.quality import judge, quality

from .helpers import clashing, documents, frame


def brute(text: bytes, least: int):
    words = re.findall(rb"[^\x20\x09-\x0D]+", text)
    n = len(words)
    windows = Counter(tuple(words[i : i + 3]) for i in range(n - 2))
    twice = {i + k for i in range(n - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    covered, longest = set(), 0
    for i in range(n):
        best = 0
        for j in range(n):
            if i != j:
                k = 0
                while i + k < n and j + k < n and words[i + k] == words[j + k]:
                    k += 1
                best = max(best, k)
        if best >= least:
            covered |= set(range(i, i + best))
            longest = max(longest, best)
    lines = text.split(b"\n")
    dup = sum(bool(line.split()) and line in lines[:i] for i, line in enumerate(lines))
    return n, sum(len(w.decode()) for w in words), sum(text.count(c.encode()) for c in "#*$%&|<>"), dup, len(twice), longest, sum(len(words[i].decode()) for i in covered)


def test_against_all_pairs_of_suffixes():
    rng = random.Random(2)
    texts = ["".join(rng.choice(["a ", "b ", "é ", "cc\n", "\n", "| ", "d\t"]) for _ in range(rng.randrange(120))).encode() for _ in range(50)]
    texts += [b"", b" ", b"\n\n", b"a b c d e f g h i a b c d e f g h i", b"x " * 300]
    for least in (3, 8):
        got = judge(texts, least, 0.3, 200)
        for i, text in enumerate(texts):
            want = brute(text, least)
            assert tuple(got[c][i] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "longest_repeat")) == want[:6]
            assert abs(got["covered_fraction"][i] - (want[6] / want[1] if want[1] else 0)) < 1e-9
            assert sum(s["end"] - s["begin"] for s in got["spans"][i]) >= want[5]


def test_maximal_repeats():
    # abc twice, its suffixes bc and c no more often: one maximal repeat
    out = judge([b"a b c x a b c y"], 1, 0.3, 200)
    assert out["n_maximal"] == [1] and out["spans"] == [[{"begin": 0, "end": 3}, {"begin": 4, "end": 7}]]
    # b alone too: two
    assert judge([b"a b x a b y b z"], 1, 0.3, 200)["n_maximal"] == [2]


def test_rows(spark):
    rows = documents()
    for df in (frame(spark), clashing(spark)):
        got = quality(df).collect()
        assert len(got) == len(rows)
        for r in got:
            assert not (r.base_failed and r.kept) and r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
    assert quality(frame(spark, [])).collect() == []
