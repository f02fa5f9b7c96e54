"""Rows that operators must bear: nulls, empty and long texts, ties, repeated rows, clashing columns."""

from __future__ import annotations

import random

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents(n: int = 120, seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    words = ["alpha", "beta", "Gamma", "délta", "e.", "zeta,", "eta", "the", "of", "idiot", "|", "x1"]
    base = [" ".join(rng.choices(words, k=rng.randrange(1, 120))) for _ in range(40)]
    rows = []
    for i in range(n):
        text = rng.choice(base)
        if rng.random() < 0.4:
            own = text.split(" ")
            own[rng.randrange(len(own))] = rng.choice(words)
            text = " ".join(own)
        rows.append((i, text, "en", rng.choice(["a", "b", "c", "é", None]), len(text)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "a", 0), (1002, " \n\t", "en", "a", 3), (None, "null id", None, "b", 7), (1003, "long " * 5000, "en", "c", 25000), (1004, "日本語 テキスト", "ja", "a", 9)]
    return [*rows, rows[0], rows[0]]


def frame(spark, rows=None):
    return spark.createDataFrame(documents() if rows is None else rows, COLUMNS)


def clashing(spark):
    """The same rows with columns that are called as the operators' own."""
    from pyspark.sql import functions as F

    df = frame(spark)
    for name in ("kept", "keep_id", "group_size", "row", "digest", "size", "sources", "score", "key", "doc", "spans", "shard", "slot", "start", "bucket", "component_id", "order", "bin", "number", "file"):
        df = df.withColumn(name, F.lit("clash"))
    return df
