"""The pipeline's stages on a small table, against plain Python."""

from __future__ import annotations

import random

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from rotaframe.llm.toxicity import fold, learn, matched, score

from .test_jaccard_join import brute
from .test_toxicity import labelled


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    rng = random.Random(3)
    path = tmp_path_factory.mktemp("tables")
    texts, labels = labelled(160, 8)
    texts += texts[:20]
    labels += labels[:20]
    for t in texts[20:40]:
        own = t.split()
        own[rng.randrange(len(own))] = "changed"
        texts.append(" ".join(own))
        labels.append(0)
    texts[100:103] = [None, "", " "]
    n = len(texts)
    pq.write_table(pa.table({"doc_id": list(range(n)), "text": texts, "lang": ["en"] * n, "source": [rng.choice(["a", "b", "c", None]) for _ in range(n)], "n_chars": [len(t or "") for t in texts]}), path / "documents.parquet")
    pq.write_table(pa.table({"doc_id": list(range(160)), "quality": [1] * 160, "toxic": labels[:160]}), path / "labels.parquet")
    return str(path), texts


def test_stages(spark, folder):
    path, texts = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    lexicon = corpus_pipeline.learned_lexicon(spark, path)
    a = lexicon.automaton()
    clean = {i for i, t in enumerate(texts) if score(lexicon, matched(a, fold(t or "")), len(fold(t or "").split())) < 0.7}
    out = corpus_pipeline.STAGES[0][1](spark, docs, path)
    assert {r.doc_id for r in out.collect()} == clean and out.columns == docs.columns and 0 < len(clean) < len(texts)
    out = corpus_pipeline.STAGES[1][1](spark, out, path)
    last = {}
    for i in sorted(clean):
        last[texts[i] or ""] = i
    assert {r.doc_id for r in out.collect()} == set(last.values()) and out.columns == docs.columns
    out = corpus_pipeline.STAGES[2][1](spark, out, path)
    kept = {d for d, _, c in brute([(i, texts[i]) for i in sorted(last.values())]) if d == c}
    assert {r.doc_id for r in out.collect()} == kept and out.columns == docs.columns and len(kept) < len(last)
    out = corpus_pipeline.STAGES[3][1](spark, out, path)
    mixed = [r.doc_id for r in out.collect()]
    assert set(mixed) <= kept and max(mixed.count(i) for i in mixed) <= 2 and out.columns == docs.columns
    out = corpus_pipeline.STAGES[4][1](spark, out, path)
    assert {r.doc_id for r in out.collect()} == set(mixed)


def test_run(spark, folder):
    path, _ = folder
    rows = corpus_pipeline.run(spark, path).collect()
    assert rows and {"doc_id", "start", "length", "sequence_id", "offset"} <= set(rows[0].asDict())
    assert len(corpus_pipeline.STAGES) == 5 and learn([], []).weights == {}


def test_clashing_columns_and_empty_tables(spark, folder):
    from pyspark.sql import functions as F

    path, _ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    own = ["_text", "_drop_id", "_drops", "_keep_id", "_keep_sha", "_id", "_rows", "_least", "_key", "_set", "_component", "_mix_id", "_copies", "_times", "_nth", "_copy", "key", "size", "row"]
    clashing = docs.withColumns({c: F.lit("own") for c in own})
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs, clashing = stage(spark, docs, path), stage(spark, clashing, path)
        assert clashing.columns[5:] == own
        assert sorted(map(str, clashing.select(docs.columns).collect())) == sorted(map(str, docs.collect()))
        assert clashing.filter("_key <> 'own' OR size <> 'own'").count() == 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, path)
        assert empty.collect() == []
