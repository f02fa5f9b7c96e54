from __future__ import annotations

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from rotaframe.llm import pieces

from .helpers import clashing, documents, frame

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)


def expected(rows):
    out = []
    for row in rows:
        ids = LIBRARY.encode(row[1] or "", add_bos=True, add_eos=True)
        out.append((row[0], len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()))
    return sorted(map(str, out))


def odd_texts(n, seed=5):
    rng = random.Random(seed)
    parts = [*"ab  \n\t.▁<>sé日😀0\0　\r", "the ", "and", "<unk>", "<s>", "    ", "<0x41>", "wordswordswords" * 6]
    return ["".join(rng.choices(parts, k=rng.randrange(0, 30))) for _ in range(n)]


def test_ids_are_the_library_s():
    encoder = pieces.PieceEncoder(MODEL)
    assert encoder.cut
    texts = odd_texts(3000) + ["", " ", "▁", "x" * 5000, " ".join(["tail"] * 3) + "  "]
    for _ in range(2):  # the second time by the table
        assert [ids.tolist() for ids in encoder.encode(texts)] == LIBRARY.encode(texts)
    assert encoder.count == len(encoder.memo) + 1 and b"x" * 5000 not in encoder.memo


def test_each_word_is_segmented_once(monkeypatch):
    encoder = pieces.PieceEncoder(MODEL)
    met = []
    own = encoder._segment
    monkeypatch.setattr(encoder, "_segment", lambda words: met.extend(words) or own(words))
    list(encoder.encode(["one two one", "two one", "one"]))
    list(encoder.encode(["two three one"]))
    assert sorted(met) == [b" one", b" three", b" two"]


def test_whole_texts_where_pieces_cross_markers(monkeypatch):
    monkeypatch.setattr(pieces, "cut_at_markers", lambda path: False)
    texts = odd_texts(50)
    assert [ids.tolist() for ids in pieces.PieceEncoder(MODEL).encode(texts)] == LIBRARY.encode(texts)


def test_a_full_table(monkeypatch):
    monkeypatch.setattr(pieces, "MEMO", 5)
    encoder = pieces.PieceEncoder(MODEL)
    for i in range(6):
        texts = odd_texts(20, i)
        assert [ids.tolist() for ids in encoder.encode(texts)] == LIBRARY.encode(texts)


def test_round_trip(spark):
    rows = [*documents(), *((2000 + i, t, "en", "a", 0) for i, t in enumerate(odd_texts(200)))]
    for df in (frame(spark, rows), frame(spark, rows).repartition(7)):
        assert sorted(str(tuple(r)) for r in pieces.round_trip(df, MODEL).collect()) == expected(rows)
    assert sorted(str(tuple(r)) for r in pieces.round_trip(clashing(spark), MODEL).collect()) == expected(documents())
    assert pieces.round_trip(frame(spark, []), MODEL).collect() == []


@pytest.mark.parametrize(("begin", "end"), [(True, False), (False, False)])
def test_ids_and_texts_as_tables(spark, begin, end):
    rows = documents(30)
    encoded = pieces.encode(frame(spark, rows), MODEL, begin, end)
    want = sorted(str((r[0], LIBRARY.encode(r[1] or "", add_bos=begin, add_eos=end))) for r in rows)
    assert sorted(str((r.doc_id, r.ids)) for r in encoded.collect()) == want
    back = pieces.decode(encoded, MODEL)
    assert sorted(str(tuple(r)) for r in back.collect()) == sorted(str((r[0], r[1] or "")) for r in rows)
    none = spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")
    assert sorted(map(tuple, pieces.decode(none, MODEL).collect())) == [(1, ""), (2, "")]
