from __future__ import annotations

import hashlib
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from rotaframe.llm.alignment import EndSet, align, aligned, byte_level_signs, links, pair_counts
from rotaframe.llm.pieces import piece_bytes

from .helpers import clashing, documents, frame
from .test_pieces import LIBRARY, odd_texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TOKENIZER = Tokenizer.from_file(A)
TOKENIZER.encode_special_tokens = True


def plain(text):
    """Ids of A and B, the groups of a text, and its links by all pairs of tokens."""
    if not text:
        return [], [], [], []
    signs = byte_level_signs()
    a, b = TOKENIZER.encode(" " + text, add_special_tokens=False).ids, LIBRARY.encode(text)
    spelled = [[bytes(signs[c] for c in TOKENIZER.id_to_token(i)) for i in a], [piece_bytes(LIBRARY, i) for i in b]]
    if any(b"".join(s) != (" " + text).encode() for s in spelled):
        return [], [], [], []
    ends_a, ends_b = ([*accumulate(map(len, s))] for s in spelled)
    pairs = [(i, j) for i, x in enumerate(ends_a) for j, y in enumerate(ends_b) if x == y]
    groups, low = [], 0
    for cut in sorted({*ends_a} & {*ends_b}):
        groups.append("|".join(",".join(str(i) for i, e in zip(ids, ends, strict=True) if low < e <= cut) for ids, ends in ((a, ends_a), (b, ends_b))))
        low = cut
    return a, b, groups, pairs


def expected(rows):
    found = [plain(r[1]) for r in rows]
    counts = Counter((a[i], b[j]) for a, b, _, pairs in found for i, j in pairs)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(n, best.get(b, 0))
    out = []
    for row, (a, b, groups, pairs) in zip(rows, found, strict=True):
        own = [counts[a[i], b[j]] for i, j in pairs]
        n_best = sum(n == best[b[j]] for n, (_, j) in zip(own, pairs, strict=True))
        out.append(str((row[0], len(a), len(b), len(groups), len(pairs), n_best, sum(own), hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else "")))
    return sorted(out)


def rows_of(df):
    return sorted(str(tuple(r)) for r in df.collect())


def test_alignment_is_that_of_all_pairs(spark):
    rows = [(i, r[1] and r[1][:300], *r[2:]) for i, r in enumerate(documents(40))]
    rows += [(2000 + i, t[:200], "en", "a", 0) for i, t in enumerate([*odd_texts(150), "a▁b", "<|endoftext|> and <s>", "  two", "I'm   here"])]
    rows += [(None, "no id", "en", "a", 0), rows[0], rows[0]]
    assert rows_of(align(frame(spark, rows), A, B)) == expected(rows)
    assert rows_of(align(frame(spark, rows).repartition(6), A, B)) == expected(rows)


def test_defined_cases(spark):
    assert align(frame(spark, []), A, B).collect() == []
    empty = [(1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, "▁", "en", "a", 0)]
    assert rows_of(align(frame(spark, empty), A, B)) == [str((i, 0, 0, 0, 0, 0, 0, "")) for i in (1, 2, 3)]
    want = rows_of(align(frame(spark), A, B))
    assert rows_of(align(clashing(spark), A, B)) == want


def test_a_long_text_over_chunks(spark, monkeypatch):
    rows = [(1, "word after word, " * 100_000, "en", "a", 0), (2, "word after word", "en", "a", 0)]
    got = {r.doc_id: r for r in align(frame(spark, rows), A, B).collect()}
    a, b = TOKENIZER.encode(" " + rows[0][1], add_special_tokens=False).ids, LIBRARY.encode(rows[0][1])
    assert (got[1].n_a, got[1].n_b) == (len(a), len(b))
    assert got[2].count_sum >= 3 * 100_000


def test_links_and_counts_as_tables(spark):
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(odd_texts(40))]
    want, counts = [], Counter()
    for doc, text, *_ in rows:
        a, b, _, pairs = plain(text)
        want += [(doc, n, i, j, a[i], b[j]) for n, (i, j) in enumerate(pairs)]
        counts.update((a[i], b[j]) for i, j in pairs)
    assert sorted(map(tuple, links(frame(spark, rows), A, B).collect())) == want
    found = pair_counts(aligned(frame(spark, rows), A, B)).collect()
    assert {(r.a_id, r.b_id): r.n for r in found} == counts
    # of two tokens that end together one ends with the other, which bounds the pairs
    signs = byte_level_signs()
    for a, b in counts:
        x, y = bytes(signs[c] for c in TOKENIZER.id_to_token(a)), piece_bytes(LIBRARY, b)
        assert x.endswith(y) or y.endswith(x)


def test_bitsets():
    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 1000):
        a, b = (np.union1d(np.flatnonzero(rng.random(n) < 0.4), [n - 1]) + 1 for _ in range(2))
        x, y = EndSet(n, a), EndSet(n, b)
        assert x.shared(y).tolist() == (np.intersect1d(a, b) - 1).tolist()
        at = np.arange(n)
        assert x.rank(at).tolist() == [(a <= i + 1).sum() for i in at]
