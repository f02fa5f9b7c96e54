"""Exact n-gram Jaccard join by prefix filters under several global orders.

1. Every document becomes the set of its word shingles (64-bit hashes) and a
   digest of that set; equal sets are one set from here on.
2. Shingle frequencies: packets of hashes go to buckets by hash, where the
   number of sets with each is counted. A shingle of one set alone can be in no
   intersection; it is left out, but counts in the set's size. What comes back
   for a set are its shared shingles, each with its frequency. A set with under
   3/4 of its shingles shared can have no partner and is done.
3. Order 1 (rare shingles first) gives candidates: a pair must share a shingle
   that is in the prefix of both (the first n - needed + 1 shingles, the ones
   left out coming first).
4. Sets with a common prefix shingle form a group. All pairs are never made:
   a group's pairs are taken in rounds, its members against one pivot, and
   pairs already joined through others are left out; what is then left across
   components is compared pair by pair.
5. The filters are intersected before any set is fetched: a pair of order 1
   meets the prefixes of its two sets under orders 2 and 3 (two seeded hash
   orders) and goes on only if both share a shingle there too. What is left
   meets the sets themselves, and the intersection is counted exactly.
6. Links give components by min-label propagation with pointer jumping.

Frequencies only order shingles, and only "one set or more" decides what is
left out; both are counted over all sets.

Defined cases: a null text or one without words has an empty set, linked with
nothing; fewer words than n make one shingle; repeated rows have equal sets and
so one component; rows with a null id are left out of components; an empty
table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpoint, partitions_for, text_or_empty, trimmed, with_own_names, written

#: Bytes of text whose shingles make up a packet's block, and of text for each bucket.
BLOCK_BYTES, BUCKET_BYTES = 2 << 20, 10 << 20
#: A shingle with more sets than this in one block is known to them as shared at once; its bucket hears of two of them.
LOCALLY_HOT = 8
#: Rounds of pivots before the pairs left are compared one by one: this many, and up to MOST_ROUNDS while more pairs
#: would be left than PAIRS times the rows of all groups and each round halves them.
ROUNDS, MOST_ROUNDS, PAIRS = 2, 8, 4
#: Seeds of orders 2 and 3.
SEEDS = (2, 3)
M1, M2, M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * M2
    x = (x ^ (x >> np.uint64(27))) * M3
    return x ^ (x >> np.uint64(31))


def _word_hashes(words: list[bytes], memo: dict[bytes, int]) -> np.ndarray:
    if len(memo) > 200_000:
        memo.clear()
    for w in set(words).difference(memo):
        memo[w] = int.from_bytes(hashlib.blake2b(w, digest_size=8).digest(), "little")
    return np.fromiter(map(memo.__getitem__, words), dtype=np.uint64, count=len(words))


def shingle_sets(texts: list[bytes], n: int, memo: dict[bytes, int]) -> list[np.ndarray]:
    """The distinct n-word shingles of each text as sorted hashes. bytes.lower() changes A-Z alone, split() parts at ASCII white space."""
    words = [t.lower().split() for t in texts]
    counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    h = mix64(_word_hashes([w for own in words for w in own], memo))
    ends = np.cumsum(counts)
    rolled = h.copy()
    for k in range(1, n):  # rolled[i]: of words i to i + k
        m = max(0, len(h) - k)
        rolled[:m] = mix64(rolled[:m] * M1 + h[k : k + m] + np.uint64(k))
    out = []
    for own, count, end in zip(words, counts.tolist(), ends.tolist(), strict=True):
        begin = end - count
        if count >= n:
            out.append(np.unique(rolled[begin : end - n + 1]))
        elif count:
            short = hashlib.blake2b(b" ".join(own), digest_size=8, person=b"short").digest()
            out.append(np.frombuffer(short, dtype=np.uint64))
        else:
            out.append(np.zeros(0, dtype=np.uint64))
    return out


def set_key(own: np.ndarray) -> int:
    """A signed 64-bit key of a set; 0 only for the empty one."""
    if not len(own):
        return 0
    return int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True) or 1


# Packets are rows (kind, bucket, ids, keys, ns, hashes, counts) of packed columns.
# DOCUMENTS: ids, keys and set sizes of a block's rows. SHINGLES: hashes to the bucket of their hash.
# SHARED: hashes known to be in two sets or more, to the bucket of their set's key.
# FREQUENT: hashes and their frequencies. In the middle two, keys and ns name the sets once.
DOCUMENTS, SHINGLES, SHARED, FREQUENT = range(4)
PACKETS = "kind int, bucket int, ids binary, keys binary, ns binary, hashes binary, counts binary"
NAMES = ["kind", "bucket", "ids", "keys", "ns", "hashes", "counts"]
TYPES = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
#: Stands for a null id.
NO_ID = -(1 << 63)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [[] for _ in NAMES]
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=t) for c, t in zip(columns, TYPES, strict=True)], names=NAMES)


def pack_sorted(x: np.ndarray) -> bytes:
    """Ascending hashes as differences, their bytes by plane, so that the shuffle's compression finds the empty planes."""
    return np.diff(x, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack_sorted(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, dtype=np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _key_bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    return _bucket_of(mix64(keys.astype(np.int64).view(np.uint64)), buckets)


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal values begin, and their lengths."""
    heads = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, dtype=np.int64)
    return heads, np.diff(np.append(heads, len(x)))


def _shared_rows(keys: np.ndarray, sizes: np.ndarray, hashes: np.ndarray, buckets: int) -> Iterator[tuple]:
    """SHARED packets of (set, size, hash) triples."""
    kb = _key_bucket(keys, buckets)
    by = np.lexsort((hashes, keys, kb))
    kb, keys, sizes, hashes = kb[by], keys[by], sizes[by], hashes[by]
    for a, n in zip(*(x.tolist() for x in _runs(kb)), strict=True):
        heads, count = _runs(keys[a : a + n])
        yield SHARED, int(kb[a]), None, keys[a + heads].tobytes(), sizes[a + heads].astype(np.int32).tobytes(), hashes[a : a + n].tobytes(), count.astype(np.int32).tobytes()


def _packets(n: int, buckets: int):
    def block(number: int, ids: list, texts: list[bytes], memo: dict) -> pa.RecordBatch:
        sets = shingle_sets(texts, n, memo)
        keys = np.array([set_key(s) for s in sets], dtype=np.int64)
        ns = np.array([len(s) for s in sets], dtype=np.int32)
        rows = [(DOCUMENTS, int(mix64(np.array([number, len(ids)], dtype=np.uint64))[0] % np.uint64(buckets)), np.array([NO_ID if d is None else d for d in ids], dtype=np.int64).tobytes(), keys.tobytes(), ns.tobytes(), None, None)]
        one_keys, at = np.unique(keys, return_index=True)  # equal sets once
        at, one_keys = at[one_keys != 0], one_keys[one_keys != 0]
        if len(at):
            one_ns = ns[at]
            own = np.repeat(np.arange(len(at)), one_ns)
            hashes = np.concatenate([sets[i] for i in at])
            by = np.argsort(hashes, kind="stable")
            hashes, own = hashes[by], own[by]
            heads, count = _runs(hashes)
            hot = np.repeat(count > LOCALLY_HOT, count)
            if hot.any():
                rows += _shared_rows(one_keys[own[hot]], one_ns[own[hot]], hashes[hot], buckets)
            # to the buckets: all sets of a shingle, or its first two where its sets know already
            send = np.flatnonzero(~hot | (np.arange(len(hashes)) - np.repeat(heads, count) < 2))
            weight = np.where(hot, np.repeat(count, count) // 2, 1)[send]
            hashes, own = hashes[send], own[send]
            for a, m in zip(*(x.tolist() for x in _runs(_bucket_of(hashes, buckets))), strict=True):
                used, local = np.unique(own[a : a + m], return_inverse=True)
                local = local.astype(np.uint16 if len(used) < 1 << 16 else np.uint32)
                w = weight[a : a + m]
                rows.append((SHINGLES, int(_bucket_of(hashes[a : a + 1], buckets)[0]), local.tobytes(), one_keys[used].tobytes(), one_ns[used].tobytes(), pack_sorted(hashes[a : a + m]), None if (w == 1).all() else w.astype(np.int32).tobytes()))
        return _rows(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[bytes, int] = {}
        ids, texts, size, number = [], [], 0, 0
        for batch in batches:
            for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                ids.append(d)
                texts.append(t.as_py())
                size += len(texts[-1])
                if size >= BLOCK_BYTES:
                    yield block(number, ids, texts, memo)
                    ids, texts, size, number = [], [], 0, number + 1
        if ids:
            yield block(number, ids, texts, memo)

    return run


def _count(buckets: int):
    """All packets of one bucket in. Shingles of two sets or more go on as SHARED and FREQUENT, other kinds as they are."""

    def run(table: pa.Table) -> pa.Table:
        kind = table.column("kind").to_numpy()
        passed = table.filter(pa.array(kind != SHINGLES))
        columns: list[list[np.ndarray]] = [[], [], [], []]
        for row in table.filter(pa.array(kind == SHINGLES)).to_pylist():
            hashes, keys = unpack_sorted(row["hashes"]), np.frombuffer(row["keys"], dtype=np.int64)
            local = np.frombuffer(row["ids"], dtype=np.uint16 if len(row["ids"]) == 2 * len(hashes) else np.uint32)
            weight = np.ones(len(hashes), dtype=np.int32) if row["counts"] is None else np.frombuffer(row["counts"], dtype=np.int32)
            for c, x in zip(columns, (hashes, keys[local], np.frombuffer(row["ns"], dtype=np.int32)[local], weight), strict=True):
                c.append(x)
        if not columns[0]:
            return passed.cast(SCHEMA)
        hashes, keys, sizes, weights = map(np.concatenate, columns)
        by = np.argsort(hashes, kind="stable")
        hashes = hashes[by]
        heads, count = _runs(hashes)
        many = np.repeat(count > 1, count)  # most shingles are met once: leave them here
        by, hashes = by[many], hashes[many]
        keys, sizes, weights = keys[by], sizes[by], weights[by]
        by = np.lexsort((keys, hashes))
        hashes, keys, sizes, weights = hashes[by], keys[by], sizes[by], weights[by]
        # one set met in several blocks counts once
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1])) if len(hashes) else np.zeros(0, dtype=bool)
        hashes, keys, sizes, weights = hashes[new], keys[new], sizes[new], weights[new]
        heads, count = _runs(hashes)
        many = np.repeat(count > 1, count)
        rows = list(_shared_rows(keys[many], sizes[many], hashes[many], buckets))
        total = np.add.reduceat(weights, heads) if len(heads) else weights
        often = np.flatnonzero(total >= OFTEN)
        if len(often):
            rows.append((FREQUENT, 0, None, None, None, hashes[heads[often]].tobytes(), total[often].astype(np.int32).tobytes()))
        return pa.concat_tables([passed.cast(SCHEMA), pa.Table.from_batches([_rows(rows)]).cast(SCHEMA)])

    return run


SCHEMA = pa.schema(list(zip(NAMES, TYPES, strict=True)))
#: Frequency from which a shingle may get a place of its own at the end of order 1, and the number of such places: a bound on what is broadcast.
OFTEN, PLACES = 16, 1 << 17


def _order_1(hashes: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Indices that put hashes in order 1: rare ones by hash, then the frequent by their class of frequency."""
    known, klass = frequent
    place = np.zeros(len(hashes), dtype=np.int64)
    if len(known):
        i = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        place = np.where(known[i] == hashes, klass[i], 0)
    return np.lexsort((hashes, place))


def prefix(n: int, m: int, needed: int) -> int:
    """Shared shingles in the prefix of a set of n, m of them shared, for an overlap of `needed`: those left out come first."""
    return max(0, min(m, m - needed + 1))


def _least_overlap(a: int, b: int, num: int, den: int) -> int:
    """The least intersection of sets of a and b shingles with den * intersection >= num * union."""
    return -(-num * (a + b) // (num + den))


def seeded(own: np.ndarray, p: int, seed: int) -> np.ndarray:
    """The p first of a set's shared shingles under a seeded hash order; shingles left out come first in every order."""
    return own if p >= len(own) else own[np.argpartition(mix64(own ^ np.uint64(seed)), p - 1)[:p]]


SETS = "key long, n int, hashes binary, p2 array<long>, p3 array<long>"


def _assemble(num: int, den: int, frequent):
    """SHARED packets of one key bucket in; sets that may have a partner out, their shared shingles in order 1 and their prefixes in orders 2 and 3."""

    def run(table: pa.Table) -> pa.Table:
        out: dict[str, list] = {"key": [], "n": [], "hashes": [], "p2": [], "p3": []}
        parts: list[list[np.ndarray]] = [[], [], []]
        for row in table.to_pylist():
            count = np.frombuffer(row["counts"], dtype=np.int32)
            for c, x in zip(parts, (np.repeat(np.frombuffer(row["keys"], dtype=np.int64), count), np.repeat(np.frombuffer(row["ns"], dtype=np.int32), count), np.frombuffer(row["hashes"], dtype=np.uint64)), strict=True):
                c.append(x)
        keys, sizes, hashes = map(np.concatenate, parts)
        by = np.lexsort((hashes, keys))
        keys, sizes, hashes = keys[by], sizes[by], hashes[by]
        new = np.append(True, (hashes[1:] != hashes[:-1]) | (keys[1:] != keys[:-1]))  # told by its bucket and by a block
        keys, sizes, hashes = keys[new], sizes[new], hashes[new]
        for a, m in zip(*(x.tolist() for x in _runs(keys)), strict=True):
            n = int(sizes[a])
            if den * m >= num * n:
                own = hashes[a : a + m]
                out["key"].append(int(keys[a]))
                out["n"].append(n)
                out["hashes"].append(own[_order_1(own, frequent.value)].tobytes())
                p = prefix(n, m, -(-num * n // den))
                for name, seed in zip(("p2", "p3"), SEEDS, strict=True):
                    out[name].append(seeded(own, p, seed).view(np.int64))
        kinds = {"key": pa.int64(), "n": pa.int32(), "hashes": pa.binary(), "p2": pa.list_(pa.int64()), "p3": pa.list_(pa.int64())}
        return pa.table({name: pa.array(out[name], type=kind) for name, kind in kinds.items()})

    return run


def _prefix_rows(num: int, den: int):
    """Sets in; (token, key, n, m, pos) for the shingles of their prefixes out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, key, size, shared, pos = [], [], [], [], []
            for k, n, data in zip(*(batch.column(c).to_pylist() for c in ("key", "n", "hashes")), strict=True):
                own = np.frombuffer(data, dtype=np.int64)
                p = prefix(n, len(own), -(-num * n // den))
                token.append(own[:p])
                key.append(np.full(p, k))
                size.append(np.full(p, n, dtype=np.int32))
                shared.append(np.full(p, len(own), dtype=np.int32))
                pos.append(np.arange(p, dtype=np.int32))
            if token:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in (token, key, size, shared, pos)], names=["token", "key", "n", "m", "pos"])

    return run


def _verify(num: int, den: int):
    """Rows (a, b, na, nb, sa, sb) in; (a, b) of those linked out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros(batch.num_rows, dtype=bool)
            last, known = None, np.zeros(0, dtype=np.uint64)
            columns = [batch.column(c).to_pylist() for c in ("b", "na", "nb", "sa", "sb")]
            for i, (b, na, nb, sa, sb) in enumerate(zip(*columns, strict=True)):
                needed = _least_overlap(na, nb, num, den)
                x, y = np.frombuffer(sa, dtype=np.uint64), np.frombuffer(sb, dtype=np.uint64)
                if min(len(x), len(y)) < needed:
                    continue
                if last != b:
                    last, known = b, np.sort(y)
                j = np.minimum(np.searchsorted(known, x), len(known) - 1)
                both = int((known[j] == x).sum())
                found[i] = den * both >= num * (na + nb - both)
            at = pa.array(np.flatnonzero(found))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(at), batch.column("b").take(at)], names=["a", "b"])

    return run


# ---- components ------------------------------------------------------------


def fitting(df: DataFrame, rows: int, each: int = 200_000) -> DataFrame:
    """df in no more partitions than its rows call for; in one, what follows needs no shuffle."""
    return df.coalesce(partitions_for(rows, each, 1))


def _pairs(df: DataFrame, *columns: tuple[str, str]) -> DataFrame:
    """A row (u, v) for each row of df and each pair of columns."""
    return df.select(F.explode(F.array(*(F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in columns))).alias("pair")).select("pair.u", "pair.v")


def _counted(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """edges in as many partitions as they call for; their number, and a sum that tells whether a step changed them."""
    now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % (1 << 40))).first())
    return fitting(edges, now[0]), now


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node reachable, by alternating large-star and small-star steps.

    edges: u, v longs. No node's edges are ever gathered in one row; a hub's are reduced to their minimum.
    """
    edges = checkpoint(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    edges, before = _counted(edges)
    while before[0]:
        # rows are turned by explode(), not by a union, which would read them twice and take one partition apart again
        both = _pairs(edges, ("u", "v"), ("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        # large star: every larger neighbour goes to the least of the neighbourhood
        large = both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        # small star: a node and its smaller neighbours go to the least of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u")
        edges, now = _counted(checkpoint(_pairs(small, ("v", "m"), ("u", "m")).filter("u <> v").distinct()))
        if now == before:
            break
        before = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component"))


# ---- the operator ----------------------------------------------------------


def jaccard_sets(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(documents: doc_id, key, n_shingles), (sets that may have a partner, as in SETS)."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).cast("binary").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = partitions_for(total, BUCKET_BYTES, 16)
    packets = rows.mapInArrow(trimmed(_packets(n, buckets)), PACKETS)
    counted = written(packets.groupBy("bucket").applyInArrow(_count(buckets), PACKETS))
    documents = counted.filter(F.col("kind") == DOCUMENTS).mapInArrow(trimmed(_documents), "doc_id long, key long, n_shingles long")
    often = counted.filter(F.col("kind") == FREQUENT).mapInArrow(_frequent, "hash long, count int")
    top = often.orderBy(F.desc("count"), "hash").limit(PLACES).collect()  # a bound, whatever the input
    known = np.array([r["hash"] for r in top], dtype=np.int64).view(np.uint64)
    klass = np.array([int(r["count"]).bit_length() for r in top], dtype=np.int64)
    by = np.argsort(known)
    frequent = spark.sparkContext.broadcast((known[by], klass[by]))
    sets = counted.filter(F.col("kind") == SHARED).groupBy("bucket").applyInArrow(_assemble(num, den, frequent), SETS)
    return documents, written(sets)


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.select(["ids", "keys", "ns"]).to_pylist():
            ids, keys, ns = np.frombuffer(row["ids"], dtype=np.int64), np.frombuffer(row["keys"], dtype=np.int64), np.frombuffer(row["ns"], dtype=np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=ids == NO_ID), pa.array(keys), pa.array(ns.astype(np.int64))], names=["doc_id", "key", "n_shingles"])


def _frequent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.select(["hashes", "counts"]).to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row["hashes"], dtype=np.int64)), pa.array(np.frombuffer(row["counts"], dtype=np.int32))], names=["hash", "count"])


def _may_link(num: int, den: int):
    """What sizes and places in order 1 leave possible for members x and y of a token's group."""
    needed = F.ceil(F.lit(num) * (F.col("x.n") + F.col("y.n")) / F.lit(num + den))
    lower = F.least("x.n", "y.n") * den >= F.greatest("x.n", "y.n") * num
    # if the token is the first that both share, no more than it and what is behind it can be shared
    return lower & (F.least(F.col("x.m") - F.col("x.pos"), F.col("y.m") - F.col("y.pos")) >= needed)


def _size_class(num: int, den: int):
    """Sets that can be linked are of one class or of neighbouring ones; a little wider than need be, for rounding."""
    return F.floor(F.log(F.col("n").cast("double")) / max(1e-3, 1.0001 * math.log(den / num))).cast("int")


def _in_all_orders(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of order 1 that share a prefix shingle under orders 2 and 3 too."""
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("key").alias(side), F.col("p2").alias(f"{side}2"), F.col("p3").alias(f"{side}3")), side)
    return pairs.filter(F.arrays_overlap("a2", "b2") & F.arrays_overlap("a3", "b3")).select("a", "b")


def links(sets: DataFrame, num: int, den: int) -> DataFrame:
    """(node, component) of all sets that are linked with another."""
    spark = sets.sparkSession
    members = sets.mapInArrow(trimmed(_prefix_rows(num, den)), "token long, key long, n int, m int, pos int")
    groups = members.groupBy("token").agg(F.count("*").alias("size")).filter("size > 1")
    members = checkpoint(members.join(groups, "token").select("token", "key", "n", "m", "pos"))
    rows = members.count()
    labels, known = spark.createDataFrame([], "node long, component long"), 0
    step, last, before = 0, False, float("inf")
    while not last:
        own = members.withColumn("component", F.col("key"))
        if step:
            own = members.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
            # groups that are one component are done
            split = own.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo <> hi").select("token")
            own = checkpoint(own.join(split, "token"))
            members = own.drop("component")
        if step or step >= ROUNDS:
            # members outside their group's main component, and the pairs they could make with all of it
            main = own.groupBy("token", "component").agg(F.count("*").alias("size")).groupBy("token").agg(F.max_by("component", F.struct("size", "component")).alias("main"), F.sum("size").alias("size"))
            outside = F.sum((F.col("component") != F.col("main")).cast("long"))
            left = own.join(main, "token").groupBy("token").agg((outside * F.first("size")).alias("pairs")).agg(F.sum("pairs")).first()[0] or 0
            last = step >= ROUNDS and (step >= MOST_ROUNDS or left <= PAIRS * rows or left > before / 2)
            before = left
        if not last:
            # the pivot: first the member with the fewest shingles of its own, then any other
            score = F.col("m") / F.col("n") if step == 0 else F.xxhash64(F.lit(step), "key")
            pivots = own.groupBy("token").agg(F.max(F.struct(score.alias("score"), "key", "n", "m", "pos", "component")).alias("p")).select("token", "p.*")
        else:
            # what is left: members outside a group's main component against all whose size is near enough, by classes of sizes
            pivots = own.join(main, "token").filter("component <> main").drop("main", "size")
            own = own.withColumn("class", _size_class(num, den))
            pivots = pivots.withColumn("class", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: _size_class(num, den) + d)))
        near = (F.col("x.class") == F.col("y.class")) if last else F.lit(True)
        pairs = own.alias("x").join(pivots.alias("y"), (F.col("x.token") == F.col("y.token")) & near & (F.col("x.component") != F.col("y.component")) & _may_link(num, den))
        pairs = pairs.groupBy(F.least("x.key", "y.key").alias("lo"), F.greatest("x.key", "y.key").alias("hi")).agg(F.min("y.key").alias("pivot"))
        # the pivot's set is b, so that one sorted copy serves its pairs
        pairs = pairs.select(F.when(F.col("pivot") == F.col("lo"), F.col("hi")).otherwise(F.col("lo")).alias("a"), F.col("pivot").alias("b"))
        pairs = _in_all_orders(pairs, sets)
        both = pairs.join(sets.select(F.col("key").alias("a"), F.col("n").alias("na"), F.col("hashes").alias("sa")), "a").join(sets.select(F.col("key").alias("b"), F.col("n").alias("nb"), F.col("hashes").alias("sb")), "b")
        found = both.mapInArrow(trimmed(_verify(num, den)), "a long, b long")
        to = labels.withColumnRenamed("node", "a")
        joined = found.join(to, "a", "left").select(F.coalesce("component", "a").alias("u"), "b").join(labels.withColumnRenamed("node", "b"), "b", "left").select("u", F.coalesce("component", "b").alias("v"))
        over = components(joined)  # of components so far
        moved = labels.join(over.withColumnRenamed("node", "c").withColumnRenamed("component", "to"), F.col("component") == F.col("c"), "left").select("node", F.coalesce("to", "component").alias("component"))
        known += over.count()  # at least the rows of labels
        step += 1
        labels = checkpoint(fitting(moved.unionByName(over.join(labels, "node", "left_anti")), known))
    return labels


def jaccard_join(docs: DataFrame, n: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, set_key, component_id for each row of docs.

    Documents link where den * intersection >= num * union; component_id is the
    smallest id reachable by links. Rows with equal set_key have equal sets.
    """
    return _joined(docs, n, num, den, id_col, text_col).drop("component")


def _joined(docs: DataFrame, n: int, num: int, den: int, id_col: str, text_col: str) -> DataFrame:
    """jaccard_join() with component, a key of its own for each component; null for empty sets."""
    documents, sets = jaccard_sets(docs, n, num, den, id_col, text_col)
    labels = links(sets, num, den)
    # a key's least id, then a component's; both by partial sums, so one large group is no burden
    least = documents.filter("key <> 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    own = least.join(labels.withColumnRenamed("node", "key"), "key", "left").withColumn("component", F.coalesce("component", "key"))
    heads = own.groupBy("component").agg(F.min("least").alias("component_id"))
    named = own.join(heads, "component").select("key", "component", "component_id")
    return documents.join(named, "key", "left").select("doc_id", "n_shingles", F.col("key").alias("set_key"), F.when(F.col("key") != 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "component")


@with_own_names
def keep_one_of_each(docs: DataFrame, n: int = 5, num: int = 75, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs less those linked, over any number of links, with one of a smaller id or with another row of the same id.

    Rows with one id are told apart by their sets. Rows with a null id or an empty set are all kept.
    """
    found = _joined(docs, n, num, den, id_col, text_col)
    by_id = found.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.count("*").alias("_rows"), F.max("component_id").alias("_least"))
    by_id = checkpoint(by_id.filter("_rows > 1 OR _id <> _least").select("_id", "_rows"))
    at = F.col(id_col).cast("long") == F.col("_id")
    once = docs.join(by_id.select("_id"), at, "left_anti")
    repeated = by_id.filter("_rows > 1").select("_id")
    if not repeated.take(1):
        return once

    def key_of(text):
        return set_key(shingle_sets([bytes(text)], n, {})[0])

    # the sets of these few rows are made again, as rows of docs and of found have no key in common
    more = docs.join(repeated, at, "left_semi").withColumn("_key", F.udf(key_of, "long")(text_or_empty(text_col).cast("binary")))
    heads = found.join(repeated, F.col("doc_id") == F.col("_id"), "left_semi").filter("doc_id = component_id AND set_key <> 0")
    heads = heads.select(F.col("doc_id").alias("_id"), F.col("set_key").alias("_set"), F.col("component").alias("_component")).distinct()
    first = Window.partitionBy("_component").orderBy("_key", F.xxhash64(F.col(text_col)))
    one = more.join(heads, at & (F.col("_key") == F.col("_set"))).withColumn("_nth", F.row_number().over(first)).filter("_nth = 1")
    return once.unionByName(one.select(*docs.columns)).unionByName(more.filter("_key = 0").select(*docs.columns))
