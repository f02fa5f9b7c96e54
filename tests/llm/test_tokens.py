from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import rotaframe.llm.tokens as tokens
from rotaframe.llm.coder import _runs, decode_block, encode_block, lanes_of
from rotaframe.llm.queries import vocabulary
from rotaframe.llm.token_output import BlockEncoder, round_trip
from rotaframe.llm.tokens import Encoder

from .helpers import clashing, documents, frame

VOCABULARIES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


@pytest.mark.parametrize("name", VOCABULARIES)
def test_memo_gives_the_ids_of_whole_texts(name, monkeypatch):
    monkeypatch.setattr(tokens, "MEMO", 500)
    monkeypatch.setattr(tokens, "CHUNK", 2000)
    monkeypatch.setattr(tokens, "LONG", 12)
    rng = random.Random(1)
    parts = ["a", "B", "é", " ", "  ", "\n", "\t", ".", "!", "'s", "1", "23", "ß", "<|endoftext|>", " ", " ", "́", "日本", "\0", "\r", "😀", "İ", "’", ",", "ab", "x.y", "<|endoftext|>", "\x1c", "longpiece" * 3]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(3000)]
    texts += ["a <|endoftext|> b", "a<|ENDOFTEXT|> b", "<|startoftext|>", "", "", " ".join(texts[:50])]
    encoder, plain = Encoder(vocabulary(name)), Tokenizer.from_file(vocabulary(name))
    for part in (texts, texts[::-1], [f"{a}. {b} {c}," for a, b, c in zip(texts, texts[1:], texts[2:], strict=False)]):
        got = list(encoder.encode(part))
        assert len(got) == len(part)
        for text, ids in zip(part, got, strict=True):
            assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text
    column = pa.array(["skipped", *texts[:40]])[1:]  # a slice, with places of 32 bits
    assert [x.tolist() for x in encoder.encode_column(column)] == [plain.encode(t, add_special_tokens=False).ids for t in texts[:40]]
    assert list(encoder.encode([])) == []


def test_special_strings_are_what_the_library_takes_them_for():
    assert next(Encoder(vocabulary("byte_bpe_50k.json")).encode(["a <|endoftext|> b"])).tolist().count(50256) == 1
    assert next(Encoder(vocabulary("word_bpe_49k.json")).encode(["a <|endoftext|> b"])).tolist().count(49407) == 1


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 127, 129, 3000):
        for size, ids in ((50257, rng.integers(0, 50257, n)), (50257, np.full(n, 7)), (3, rng.integers(0, 3, n)), (1, np.zeros(n, int)), (50257, rng.zipf(1.3, n) % 50257)):
            block = encode_block([1, None], [n, 0], ids.astype(np.uint16), size)
            names, lengths, back = decode_block(block)
            assert names == [1, None] and lengths.tolist() == [n, 0] and (back == ids).all()
            damaged = bytearray(block)
            damaged[-1] ^= 1
            with pytest.raises(ValueError, match="damaged"):
                decode_block(bytes(damaged))


def test_repetition_costs_little():
    ids = np.tile(np.random.default_rng(2).integers(0, 50257, 300), 200).astype(np.uint16)
    assert len(encode_block([1], [len(ids)], ids, 50257)) < 0.5 * 2 * len(ids)


def test_round_trip_of_documents(spark):
    path = vocabulary("byte_bpe_50k.json")
    encoder = Encoder(path)
    rows = sorted(documents(), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, start = [], 0
    for r in rows:
        ids = [*encoder.tokenizer.encode(r[1] or "", add_special_tokens=False).ids, 0]
        want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
        start += len(ids)
    for df in (frame(spark), clashing(spark)):
        assert sorted(map(tuple, round_trip(df, path).collect()), key=lambda r: r[1]) == want
    assert round_trip(frame(spark, []), path).collect() == []


def test_bytes_of_a_block_stay():
    ids = (np.arange(300_000) ** 2 // 7 % 1009 % 501).astype(np.uint16)
    block = encode_block([1], [len(ids)], ids, 50257)
    assert (len(block), zlib.crc32(block)) == (66469, 1991960976)  # as files written so far
    assert (decode_block(block)[2] == ids).all()


def test_words_of_letters_need_no_search_for_pre_tokens(monkeypatch):
    path = vocabulary("byte_bpe_50k.json")
    plain, rng, seen = Tokenizer.from_file(path), random.Random(4), []
    encoder = BlockEncoder(path)
    monkeypatch.setattr(encoder, "_worded", lambda pieces, way=encoder._worded: seen.extend(pieces) or way(pieces))
    words = ["".join(rng.choices("aBcdeZ", k=rng.randrange(1, 12))) for _ in range(3000)] + ["don't", "x1", "é", "Ġ", "\u0120a", "a_b", "I'm", "n.", "s,"]
    texts = [" ".join(rng.choices(words, k=rng.randrange(1, 60))) for _ in range(400)]
    texts += [" lead", "trail ", "a\nb\n c", "a  b", "Ġa Ġb", "one"]
    for text, ids in zip(texts, encoder.encode(texts), strict=True):
        assert ids.tolist() == plain.encode(text, add_special_tokens=False).ids, text
    assert len(seen) > 2000 and all(p[:1] == b" " and p[1:].isalpha() and p.isascii() for p in seen)


def test_memo_and_chunk_of_blocks(monkeypatch):
    path = vocabulary("byte_bpe_50k.json")
    monkeypatch.setattr(tokens, "MEMO", 3)
    monkeypatch.setattr(BlockEncoder, "most", 50)
    monkeypatch.setattr(BlockEncoder, "chunk", 400)
    plain, encoder, rng, sizes = Tokenizer.from_file(path), BlockEncoder(path), random.Random(5), []
    for _ in range(200):
        text = " ".join("".join(rng.choices("abcd", k=3)) for _ in range(20))
        sizes.append(len(encoder.memo))
        assert next(encoder.encode([text])).tolist() == plain.encode(text, add_special_tokens=False).ids
    assert 30 < max(sizes) <= 50 + 20
    assert BlockEncoder.shared(path) is not Encoder.shared(path)


@pytest.mark.parametrize("n", [4096 * 128, 4096 * 130 + 1, 4096 * 131 - 1, 128 * 7 + 5, 129])
def test_lanes_of_unlike_length(n):
    ids = (np.arange(n) ** 2 // 11 % 997).astype(np.uint16)
    columns = np.zeros((-(-n // lanes_of(n)), lanes_of(n)), dtype=np.int64)
    for places, own in _runs(n, columns):
        own[:] = ids[places].reshape(own.shape[::-1]).T
    base, more = divmod(n, lanes_of(n))
    assert (columns[:, 0] == ids[: len(columns)]).all() and (columns[:base, -1] == ids[n - base :]).all()
    assert more in (0, lanes_of(n)) or (columns[base, more:] == 0).all()
    assert (decode_block(encode_block([1], [n], ids, 50257))[2] == ids).all()
