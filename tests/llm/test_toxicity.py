from __future__ import annotations

import random

from rotaframe.llm.toxicity import Lexicon, drop_toxic, fold, learn, matched, score, toxicity

from .helpers import clashing, documents, frame


def test_folding():
    assert fold("An 1d10t, a m0r0n!") == " an idiot a moron "
    assert fold("іdiоt") == " idiot "  # Cyrillic letters
    assert fold("ID​IOT ｉｄｉｏｔ") == " idiot idiot "
    assert fold("in 2024, 3 of 10") == " in 2024 3 of 10 "
    assert fold("réeux “naïve”—so") == " réeux naïve so "
    assert fold("") == "  "


def test_matches_and_exceptions():
    lexicon = Lexicon({" trash ": 3.0, " trash": 1.0, " idiot ": 2.0}, frozenset({" trash can "}))
    a = lexicon.automaton()
    assert matched(a, fold("trash")) == 3.0  # the longest of overlapping matches
    assert matched(a, fold("idiot trash")) == 5.0  # though they share a space
    assert matched(a, fold("a trash can")) == 0.0
    assert matched(a, fold("trashy")) == 1.0
    assert matched(None, "x") == 0.0


def brute(lexicon: Lexicon, text: str) -> float:
    found = []
    folded = fold(text)
    for p, w in [*lexicon.weights.items(), *((e, 0.0) for e in lexicon.exceptions)]:
        at = folded.find(p)
        while at >= 0:
            found.append((at, at + len(p) - 1, w))
            at = folded.find(p, at + 1)
    total, taken = 0.0, []
    for begin, end, w in sorted(found, key=lambda f: (f[0] - f[1], f[0])):
        if all(end - 1 <= b or begin >= e - 1 for b, e in taken):
            taken.append((begin, end))
            total += w
    return total


def labelled(n, seed):
    rng = random.Random(seed)
    words = [a + b for a in ("an", "the", "on", "er", "st", "ing") for b in ("re", "ti", "or", "ha", "es")]
    texts, labels = [], []
    for _ in range(n):
        own = rng.choices(words, k=rng.randrange(20, 200))
        toxic = rng.random() < 0.3
        if toxic:
            for _ in range(max(2, len(own) // 20)):
                own[rng.randrange(len(own))] = rng.choice(["idiot", "m0ron", "scum", "grultesk", "grultova"])
        texts.append(" ".join(own))
        labels.append(int(toxic))
    return texts, labels


def test_held_out_accuracy():
    lexicon = learn(*labelled(600, 1))
    a = lexicon.automaton()
    texts, labels = labelled(400, 2)
    right = 0
    for text, label in zip(texts, labels, strict=True):
        total = matched(a, fold(text))
        assert abs(total - brute(lexicon, text)) < 1e-9
        right += (score(lexicon, total, len(text.split())) >= 0.7) == bool(label)
    assert right >= 0.98 * len(labels)
    assert learn(["a"], [0]) == Lexicon()


def test_rows(spark):
    lexicon = Lexicon({" idiot ": 3.0}, frozenset(), (-3.0, 2.0, 4.0))
    rows = documents()
    want = sorted((score(lexicon, brute(lexicon, r[1] or ""), len(fold(r[1] or "").split())) for r in rows))
    for df in (frame(spark), clashing(spark)):
        got = toxicity(df, lexicon).collect()
        assert all(abs(g - w) < 1e-9 for g, w in zip(sorted(r.score for r in got), want, strict=True))
        kept = drop_toxic(df, lexicon, 0.7)
        assert kept.columns == df.columns and kept.count() == sum(s < 0.7 for s in want)
    assert toxicity(frame(spark, []), lexicon).collect() == []
    assert max(r.score for r in toxicity(frame(spark), Lexicon()).collect()) < 1e-9


def test_sample_of_repeated_ids_takes_one_text_of_each(spark):
    from rotaframe.llm.toxicity import training_rows

    docs = spark.createDataFrame([(i, f"text {i} {k}") for i in range(40) for k in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] * 2, "doc_id long, toxic int")
    texts, marks = training_rows(docs, labels, 12)
    assert len(texts) == 24 and sum(marks) == 12
    assert len({t.split()[1] for t in texts}) == 24
    assert training_rows(docs.repartition(3), labels.repartition(2), 12) == (texts, marks)


def test_a_column_called_as_the_own_one_stays(spark):
    docs = spark.createDataFrame([(1, "fine words", "mine"), (2, "idiot", "too")], "doc_id long, text string, _text string")
    lexicon = Lexicon({" idiot ": 9.0}, frozenset(), (-3.0, 2.0, 9.0))
    assert [r._text for r in drop_toxic(docs, lexicon, 0.7).collect()] in (["mine"], ["mine", "too"])
    assert drop_toxic(docs, lexicon, 2.0).columns == ["doc_id", "text", "_text"]
