"""Quality rules with a suffix-array repetition test.

For each batch of documents one suffix array over their words is built by
prefix doubling (only suffixes that are still tied go on to the next round, and
a document's suffixes are tied with its own alone). Neighbours in suffix order
with a longest common prefix (LCP) of `min_repeat` words or more delimit LCP
intervals. The interval right above a suffix has the longest prefix of it that
occurs elsewhere in the document; intervals whose suffixes have different words
before them are the maximal repeated substrings. Their occurrences are united
into spans. A document is rejected if the spans cover more than `max_covered`
of its word characters, or if one repeat is longer than `max_repeat` words.

Defined cases: a null or empty text has no words, fails the base rule and is
rejected; repeated rows are judged row by row; very long texts are read whole;
an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty, trimmed

SYMBOLS = b"#*$%&|<>"
#: Words of a batch; a longer document is a batch of its own.
BATCH = 400_000


@dataclass
class SuffixArray:
    """Suffixes of several sequences, those of one sequence told from those of all others."""

    order: np.ndarray  # suffix order: positions
    rank: np.ndarray  # the inverse, ties (only of equal positions) none
    levels: list[np.ndarray]  # levels[k]: equal at two positions if and only if 2**k items agree within a sequence

    def lcp(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Longest common prefixes of the suffixes at i and j."""
        n = len(self.order)
        i, j, out = i.copy(), j.copy(), np.zeros(len(i), dtype=np.int64)
        for k in range(len(self.levels) - 1, -1, -1):
            level, inside = self.levels[k], (i < n) & (j < n)
            same = np.zeros(len(i), dtype=bool)
            same[inside] = level[i[inside]] == level[j[inside]]
            step = same.astype(np.int64) << k
            i, j, out = i + step, j + step, out + step
        return out


def suffix_array(items: np.ndarray, owner: np.ndarray, until: int | None = None) -> SuffixArray:
    """By prefix doubling. items: integers from 0; owner: ascending sequence numbers.

    With until, doubling stops once prefixes of that many items are ordered.
    """
    n = len(items)
    end = np.searchsorted(owner, owner, side="right")
    key = owner.astype(np.int64) * (int(items.max(initial=0)) + 1) + items
    order = np.argsort(key, kind="stable")
    first = np.ones(n, dtype=bool)
    first[1:] = key[order][1:] != key[order][:-1]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[order] = start
    levels = [rank.astype(np.int32)]
    tied = ~(first & np.append(first[1:], True))
    slots, h = np.flatnonzero(tied), 1
    while len(slots) and (until is None or h < until):
        p = order[slots]
        after = np.where(p + h < end[p], rank[np.minimum(p + h, n - 1)], -1)
        group = start[slots]
        by = np.argsort(group * (n + 1) + after + 1, kind="stable")
        p, after, group = p[by], after[by], group[by]
        order[slots] = p
        new = np.ones(len(slots), dtype=bool)
        new[1:] = (group[1:] != group[:-1]) | (after[1:] != after[:-1])
        own = np.maximum.accumulate(np.where(new, slots, 0))
        start[slots] = own
        rank[p] = own
        h *= 2
        levels.append(rank.astype(np.int32))
        slots = slots[~(new & np.append(new[1:], True))]
    return SuffixArray(order, rank, levels)


def union_spans(begin: np.ndarray, end: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of one owner covered by spans [begin, end) given in ascending order of begin; owner: of each span."""
    if not len(begin):
        return begin, end
    reach = np.maximum.accumulate(end)
    new = np.ones(len(begin), dtype=bool)
    new[1:] = (begin[1:] > reach[:-1]) | (owner[1:] != owner[:-1])
    heads = np.flatnonzero(new)
    return begin[heads], reach[np.append(heads[1:] - 1, len(begin) - 1)]


def nearest_smaller(values: np.ndarray, at: np.ndarray, step: int) -> np.ndarray:
    """For each index in `at`, the nearest one in direction step (-1 or 1) with a smaller value; the ends must be smaller.

    Links jump over links, so that a long run takes a number of rounds of the order of its logarithm.
    """
    link = np.arange(len(values)) + step
    found = link[at]
    while (more := np.flatnonzero(values[found] >= values[at])).size:
        found[more] = link[found[more]]
        link[at] = found
    return found


def repeats(sa: SuffixArray, items: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, longest repeated prefix) of the suffixes with one of `least` items or more, ascending, and the owner of each maximal repeated substring."""
    order, n = sa.order, len(sa.order)
    k = min(least.bit_length() - 1, len(sa.levels) - 1)
    near = np.flatnonzero(sa.levels[k][order[1:]] == sa.levels[k][order[:-1]])
    lcp = np.zeros(n + 1, dtype=np.int64)  # lcp[t]: of order[t - 1] and order[t]
    lcp[near + 1] = sa.lcp(order[near], order[near + 1])
    lcp[lcp < least] = 0
    inner = np.flatnonzero(lcp)
    if not len(inner):
        return inner, inner, inner
    # LCP intervals: suffixes first to last - 1 in order share lcp[inner] items, and no wider range does
    first, last = nearest_smaller(lcp, inner, -1), nearest_smaller(lcp, inner, 1)
    interval = np.unique(first * (n + 1) + last)
    first, last = interval // (n + 1), interval % (n + 1)
    before = np.where((order > 0) & (owner[order - 1] == owner[order]), items[order - 1], -1)
    changes = np.concatenate([[0], np.cumsum(before[1:] != before[:-1])])
    maximal = changes[last - 1] > changes[first]  # can't be made longer to the left
    longest = np.maximum(lcp[:-1], lcp[1:])
    at = np.flatnonzero(longest)
    by = np.argsort(order[at], kind="stable")
    return order[at][by], longest[at][by], owner[order[first[maximal]]]


def judge(texts: list[bytes], min_repeat: int, max_covered: float, max_repeat: int) -> dict[str, list]:
    """The base counts and the repetition figures of each text."""
    words: list[bytes] = []
    counts, dup, symbols, word_chars = [], [], [], []
    for text in texts:
        own = text.split()  # of bytes: at ASCII white space alone
        words += own
        counts.append(len(own))
        seen: set[bytes] = set()
        again = 0
        for line in text.split(b"\n"):
            if line in seen:
                again += 1
            elif line and not line.isspace():
                seen.add(line)
        dup.append(again)
        symbols.append(sum(map(text.count, (SYMBOLS[i : i + 1] for i in range(len(SYMBOLS))))))
    n, counts = len(words), np.array(counts, dtype=np.int64)
    joined = np.frombuffer(b" ".join(words) + b" ", dtype=np.uint8)
    # code points: bytes that don't go on with one, less the spaces put in
    heads = np.concatenate([[0], np.cumsum((joined & 0xC0) != 0x80)])
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    begin = np.concatenate([[0], np.cumsum(lengths + 1)])[:n]
    chars = heads[begin + lengths] - heads[begin] if n else np.zeros(0, dtype=np.int64)
    edges = np.concatenate([[0], np.cumsum(counts)])
    total = np.concatenate([[0], np.cumsum(chars)])
    word_chars = (total[edges[1:]] - total[edges[:-1]]).tolist()
    covered, longest, n_repeat, maximal, spans = ([0] * len(texts) for _ in range(5))
    spans = [[] for _ in texts]
    if n:
        items = pd.factorize(np.array(words, dtype=object))[0].astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), counts)
        sa = suffix_array(items, owner)
        n_repeat = _in_windows(sa, owner, edges)
        pos, length, of_maximal = repeats(sa, items, owner, min_repeat)
        a, b = union_spans(pos, pos + length, owner[pos])
        who = owner[a]
        covered = np.bincount(who, total[b] - total[a], len(texts)).astype(np.int64).tolist()
        most = np.zeros(len(texts), dtype=np.int64)
        np.maximum.at(most, owner[pos], length)
        longest = most.tolist()
        maximal = np.bincount(of_maximal, minlength=len(texts)).tolist()
        for d, x, y in zip(who.tolist(), (a - edges[who]).tolist(), (b - edges[who]).tolist(), strict=True):
            spans[d].append({"begin": x, "end": y})
    fraction = [c / w if w else 0.0 for c, w in zip(covered, word_chars, strict=True)]
    counts = counts.tolist()
    failed = [w < 50 or 100 * r > 50 * w for w, r in zip(counts, n_repeat, strict=True)]
    kept = [not f and c <= max_covered and m <= max_repeat for f, c, m in zip(failed, fraction, longest, strict=True)]
    return {
        "n_words": counts, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": list(n_repeat), "base_failed": failed, "kept": kept,
        "covered_fraction": fraction, "longest_repeat": longest, "n_maximal": maximal, "spans": spans,
    }


def _in_windows(sa: SuffixArray, owner: np.ndarray, edges: np.ndarray) -> list[int]:
    """Words in windows of three that the document has twice or more."""
    n = len(owner)
    if n < 3 or len(sa.levels) < 2:
        return [0] * (len(edges) - 1)
    two = sa.levels[1].astype(np.int64)
    at = np.flatnonzero(owner[:-2] == owner[2:])
    key = two[at] * n + two[at + 1]
    by = np.argsort(key, kind="stable")
    same = key[by][1:] == key[by][:-1]
    twice = at[by[np.append(same, False) | np.append(False, same)]]
    hit = np.zeros(n, dtype=bool)
    for k in range(3):
        hit[twice + k] = True
    total = np.concatenate([[0], np.cumsum(hit)])
    return (total[edges[1:]] - total[edges[:-1]]).tolist()


SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "covered_fraction double, longest_repeat long, n_maximal long, spans array<struct<begin: long, end: long>>"
)


def quality(docs: DataFrame, min_repeat: int = 8, max_covered: float = 0.3, max_repeat: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, kept, and the repetition figures for each row of docs.

    spans are the united occurrences of repeated substrings, in words.
    """
    kind = docs.select(id_col).schema[0].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").to_pylist()
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= 6 * BATCH):
                    size += len(texts[to])
                    to += 1
                out = judge(texts[at:to], min_repeat, max_covered, max_repeat)
                columns = [batch.column("doc_id").slice(at, to - at)]
                for name, values in out.items():
                    columns.append(pa.array(values, type=TYPES[name]))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *out])
                at = to

    return rows.mapInArrow(trimmed(run), f"doc_id {kind}, {SCHEMA}")


TYPES = {
    "n_words": pa.int64(), "word_chars": pa.int64(), "n_symbols": pa.int64(), "n_dup_lines": pa.int64(), "n_repeat_words": pa.int64(), "base_failed": pa.bool_(), "kept": pa.bool_(),
    "covered_fraction": pa.float64(), "longest_repeat": pa.int64(), "n_maximal": pa.int64(), "spans": pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())])),
}
