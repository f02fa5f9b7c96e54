"""Toxicity by a weighted lexicon matched with Aho-Corasick.

Texts are folded first: compatibility forms, case, homoglyphs of other scripts
and digits or signs that stand for letters. The lexicon holds whole words and
word beginnings, each with a log-odds weight, and exception phrases: longer
matches that hold a lexicon word but are harmless, which outweigh it. One
Aho-Corasick automaton finds them all in one pass. The sum of weights, taken as
such and by text length, goes through a logistic function to a score.

The lexicon and the three numbers of the logistic function are learned from a
bounded sample of labelled rows: `sample` rows of either label at most, those
with the smallest hashes of their id. Labels are used for learning alone.

Defined cases: a null or empty text scores as one without a match; repeated
rows get equal scores; without labelled rows of both kinds every score is 0; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, trimmed

# Letters of other scripts, digits and signs, each with the Latin letter it is read as.
HOMOGLYPHS = {"а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ɡ": "g", "һ": "h", "і": "i", "ј": "j", "к": "k", "ӏ": "l", "м": "m", "о": "o", "р": "p", "ѕ": "s", "т": "t", "ѵ": "v", "х": "x", "у": "y", "α": "a", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i"}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i"}

_HIDDEN = "\u00ad\u200b\u200c\u200d\ufeff"
_LETTERS = str.maketrans(HOMOGLYPHS | dict.fromkeys(_HIDDEN, ""))
_SIGNS = str.maketrans(DIGITS)
#: Signs that lead to a closer look at a text's words; ! alone ends words too often.
_SUSPECT = re.compile("[0134578@$9]|[^\\W\\d_]![^\\W\\d_]")
_OTHER_SCRIPT = re.compile(f"[\u0131\u0250-\u02af\u0370-\u058f{_HIDDEN}]")
#: Bytes of a text that part words: all ASCII but letters and digits.
_PARTING = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_WIDE_PUNCTUATION = re.compile("[\u2010-\u2060\u00a0-\u00bf\u3000-\u303f]")


def fold(text: str) -> str:
    """Lower case, compatibility forms composed, homoglyphs and digit substitutions undone; words with one space around each."""
    text = text.lower()
    if not text.isascii():
        if not unicodedata.is_normalized("NFKC", text):
            text = unicodedata.normalize("NFKC", text)
        if _OTHER_SCRIPT.search(text):
            text = text.translate(_LETTERS)
        text = _WIDE_PUNCTUATION.sub(" ", text)
    if _SUSPECT.search(text):
        text = " ".join([w if w.isalpha() else _unsign(w) for w in text.split()])
    plain = text.encode("utf-8", "surrogatepass").translate(_PARTING).decode("utf-8", "surrogatepass")
    return f" {' '.join(plain.split())} "


def _unsign(word: str) -> str:
    """A word of letters with digits or signs among them, as it is read."""
    bare = word.strip(".,;:?!\"'()[]{}-")
    if bare.isalpha() or not any(c in DIGITS for c in bare) or not any(c.isalpha() for c in bare):
        return word
    return bare.translate(_SIGNS)


@dataclass
class Lexicon:
    """Patterns as they stand in a folded text: ' word ' for a word, ' begi' for a beginning."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    logistic: tuple[float, float, float] = (-30.0, 0.0, 0.0)

    def automaton(self) -> ahocorasick.Automaton | None:
        if not self.weights:
            return None
        a = ahocorasick.Automaton()
        for pattern, weight in self.weights.items():
            a.add_word(pattern, (len(pattern), weight))
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), 0.0))
        a.make_automaton()
        return a


def matched(a: ahocorasick.Automaton | None, folded: str) -> float:
    """The sum of weights; of overlapping matches the longest counts alone, the earliest of equals."""
    if a is None:
        return 0.0
    found = [(end - n + 1, end, weight) for end, (n, weight) in a.iter(folded)]
    if not found:
        return 0.0
    # the space around a word may be shared by two matches
    found.sort(key=lambda f: (f[0] - f[1], f[0]))
    taken: list[tuple[int, int]] = []
    total = 0.0
    for begin, end, weight in found:
        i = bisect.bisect(taken, (begin, end))
        if (i == 0 or taken[i - 1][1] - 1 <= begin) and (i == len(taken) or end - 1 <= taken[i][0]):
            taken.insert(i, (begin, end))
            total += weight
    return total


def features(total: float, words: int) -> tuple[float, float]:
    return math.log1p(total), 10 * total / (words + 50)


def score(lexicon: Lexicon, total: float, words: int) -> float:
    a, b, c = lexicon.logistic
    x, y = features(total, words)
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def learn(texts: list[str], labels: list[int], support: float = 0.012, least: float = 2.0, size: int = 2000) -> Lexicon:
    """A lexicon of words and word beginnings that toxic texts have far more often, and its logistic function."""
    if len(set(labels)) < 2:
        return Lexicon()
    folded = [fold(t) for t in texts]
    hits: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
    for text, label in zip(folded, labels, strict=True):
        words = set(text.split())
        hits[label].update({f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in range(3, min(len(w), 9))})
    n0, n1 = labels.count(0), labels.count(1)
    rate = lambda p: (hits[1][p] + 0.1) / n1 / ((hits[0][p] + 0.5) / n0)
    good = {p: math.log(rate(p)) for p, n in hits[1].items() if n >= max(3, support * n1) and math.log(rate(p)) > least}
    # of a beginning and its longer forms that nearly all its texts have, the longest says most exactly what is meant
    longest = dict.fromkeys(good)
    for p in sorted(good, key=lambda p: (len(p), p)):
        for k in range(4, len(p)):
            if p[:k] in longest and hits[1][p] >= 0.85 * hits[1][p[:k]]:
                longest[p[:k]] = p
    # the best first: what is common among toxic texts and rare elsewhere; other forms of a chosen pattern add nothing
    chosen: dict[str, float] = {}
    for p in sorted(good, key=lambda p: (-good[p] * hits[1][p], len(p), p)):
        if len(chosen) >= size:
            break
        p = longest[p] or p
        if not any(p[:k] in chosen for k in range(4, len(p) + 1)) and not any(c.startswith(p) for c in chosen):
            chosen[p] = good[p]
    lexicon = Lexicon(chosen)
    # exceptions: neighbouring pairs around a match that only harmless texts have, three of them at least
    pairs: dict[int, Counter[str]] = {0: Counter(), 1: Counter()}
    a = lexicon.automaton()
    for text, label in zip(folded, labels, strict=True):
        if a and any(True for _ in a.iter(text)):
            words = text.split()
            pairs[label].update({f" {x} {y} " for x, y in zip(words, words[1:], strict=False) if any(True for _ in a.iter(f" {x} ")) or any(True for _ in a.iter(f" {y} "))})
    lexicon.exceptions = frozenset(p for p, n in pairs[0].items() if n >= 3 and not pairs[1][p])
    a = lexicon.automaton()
    x = np.array([(1.0, *features(matched(a, t), t.count(" ") - 1)) for t in folded])
    y = np.array(labels, dtype=float)
    w = np.zeros(3)
    balance = np.where(y == 1, 0.5 / n1, 0.5 / n0) * len(y)
    for _ in range(50):  # Newton steps with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (balance * (p - y)) + 1e-3 * w
        step = np.linalg.solve((x * (balance * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(3), grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    lexicon.logistic = tuple(float(v) for v in w)
    return lexicon


def training_rows(docs: DataFrame, labels: DataFrame, sample: int, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> tuple[list[str], list[int]]:
    """Texts and labels of at most `sample` ids of either label, those with the smallest hashes; of an id on several rows, one text."""
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id IS NOT NULL AND label IN (0, 1)")
    marked = marked.groupBy("doc_id").agg(F.max("label").alias("label"))
    by_hash = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = marked.filter("label = 0").orderBy(*by_hash).limit(sample).unionByName(marked.filter("label = 1").orderBy(*by_hash).limit(sample))
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("text")).join(F.broadcast(chosen), "doc_id")
    rows = rows.groupBy("doc_id", "label").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text")).orderBy("doc_id").collect()
    return [r.text for r in rows], [r.label for r in rows]


def _scored(lexicon: Lexicon, kept_below: float | None, text_col: str = "_text"):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = lexicon.automaton()
        for batch in batches:
            scores, totals, lengths = [], [], []
            for text in batch.column(text_col).to_pylist():
                folded = fold(text)
                n = max(0, folded.count(" ") - 1) if folded.strip() else 0
                total = matched(a, folded)
                totals.append(total)
                lengths.append(n)
                scores.append(score(lexicon, total, n))
            if kept_below is None:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, type=pa.float64()), pa.array(totals, type=pa.float64()), pa.array(lengths, type=pa.int64())], names=["doc_id", "score", "weight", "n_words"])
            else:
                yield batch.filter(pa.array([s < kept_below for s in scores], type=pa.bool_())).drop_columns([text_col])

    return run


def toxicity(docs: DataFrame, lexicon: Lexicon, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, weight (the sum of matched weights), n_words for each row of docs."""
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).alias("_text"))
    return rows.mapInArrow(trimmed(_scored(lexicon, None)), f"doc_id {kind}, score double, weight double, n_words long")


def drop_toxic(docs: DataFrame, lexicon: Lexicon, threshold: float = 0.7, text_col: str = "text") -> DataFrame:
    """The rows of docs that score under the threshold, with all their columns; one pass, no join."""
    own = "_text"
    while own in docs.columns:
        own += "_"
    return docs.withColumn(own, text_or_empty(text_col)).mapInArrow(trimmed(_scored(lexicon, threshold, own)), docs.schema)
