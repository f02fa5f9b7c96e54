"""The trie of shared conversation prefixes, rolled up by pointer jumping.

Conversations are numbered turn by turn and given running digests without a
sort of one conversation in one task: rows stand in ranges of (conversation,
order), a task sums within its range, and a range adds what the ranges before
it have of its first conversation. A prefix's digest is the sum of a hash of
(depth, turn) over its turns, in two lanes of 60 bits, so that sums of parts
add up; a turn's own hash is SHA-256 over role and text. Rows of one digest are
one node, and the digest without the last turn is its parent: the edges.

Leaves and savings then climb by doubling: each node holds a pointer, first to
its parent, and the sums over its descendants nearer than that. In a round each
node gets the sums of those that point to it and takes its pointer's pointer, so
a trie of depth d takes log2(d) + 1 rounds. Sums by pointer are aggregated on
the map side first; a node that over 1/512 of all rows point to (there are 512 at
most) is looked up by a broadcast, all others by a shuffle.

The conversations that end at a node are hashed in numeric order: ranges of
(node, conversation) are sorted and written out by tasks as runs of decimals,
and only those runs of a node's ends pass through one task, one at a time.

Defined cases: null roles and texts are empty; turns are ordered by turn (null
first), then role, then the hash of role and text, so repeated rows are turns of
their own, next to one another; rows without a conversation id belong to none
and are left out; an empty table has no node, not even a root; the remainder of
a negative id has its sign, as in SQL; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_folder, text_or_empty, trimmed

#: Of a table's rows one in this many makes a key hot; so there are no more hot keys than this.
SHARE = 512
#: Turns of the original conversation that a rebuilt one may begin with, less one.
HEADS = 9
#: Digests are kept to 60 bits a lane, so that a sum of two fits a long.
MASK = (1 << 60) - 1
#: Bytes of decimals written as one run.
RUN = 1 << 20
LANES = ["lane0", "lane1"]
KEY = ["key0", "key1"]
POINTER = ["pointer0", "pointer1"]


class Scratch:
    """Tables in the shared folder, each dropped once those made from it are written."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, f"{shared_folder(spark)}/trie-{uuid.uuid4().hex}"
        self.n = 0

    def write(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table.scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def running(scratch: Scratch, rows: DataFrame, order: list[str], lanes: list[str]) -> DataFrame:
    """rows with `place` from 1 within conv_id, in the given order, and lanes replaced by their running sums (60 bits) in it."""
    sums = ["place", *lanes]
    ranged = rows.repartitionByRange("conv_id", *order).sortWithinPartitions("conv_id", *order).withColumns({"place": F.lit(1).cast("long"), "part": F.spark_partition_id()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, carry = None, {}
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            first = np.flatnonzero(np.diff(conv, prepend=conv[0] - 1))
            size = np.diff(np.append(first, len(conv)))
            goes_on = conv[0] == own
            for c in sums:
                total = np.cumsum(batch.column(c).to_numpy().astype(np.uint64))
                before = np.where(first > 0, total[first - 1], np.uint64(0))
                if goes_on:
                    before[:1] -= carry[c]
                total = (total - np.repeat(before, size)) & np.uint64(MASK)
                carry[c] = total[-1]
                batch = batch.set_column(batch.schema.get_field_index(c), c, pa.array(total.astype(np.int64)))
            own = conv[-1]
            yield batch

    held = scratch.write(ranged.mapInArrow(trimmed(run), ranged.schema))
    ends = held.groupBy("part").agg(F.min("conv_id").alias("first"), F.max(F.struct("conv_id", *sums)).alias("last"))
    # `place` grows within a range, so the greatest of a conversation is its last row there
    carried, own, totals = [], None, None
    for end in sorted(ends.collect(), key=lambda e: e.part):  # a row a range
        if own is not None and end.first == own:
            carried.append((end.part, own, *totals))
        here = [end.last[c] for c in sums]
        goes_on = end.last.conv_id == own
        totals = [(a + b) & MASK for a, b in zip(totals, here, strict=True)] if goes_on else here
        own = end.last.conv_id
    if not carried:
        return held.drop("part")
    before = rows.sparkSession.createDataFrame(carried, f"part int, conv_id long, {', '.join(f'{c}_before long' for c in sums)}")
    out = held.join(F.broadcast(before), ["part", "conv_id"], "left")
    return out.withColumns({c: (F.col(c) + F.coalesce(f"{c}_before", F.lit(0))).bitwiseAND(MASK) for c in sums}).drop("part", *(f"{c}_before" for c in sums))


def looked_up(rows: DataFrame, keys: list[str], facts: DataFrame, met: str, n_rows: int) -> DataFrame:
    """rows joined with facts, one row a key at most; `met` has how many of the n_rows rows have a key.

    Keys of more than one in SHARE rows, SHARE at most, meet their facts on the map side, so that no task gets all rows of one.
    """
    hot = facts.filter(F.col(met) * SHARE > n_rows).drop(met)
    cold = rows.join(F.broadcast(hot.select(keys)), keys, "left_anti").join(facts.drop(met), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(cold)


def lane(number: int, *parts: Column | str) -> Column:
    """60 bits of the SHA-256 of parts."""
    start = 1 + 15 * number
    return F.conv(F.substring(F.sha2(F.concat_ws(":", *parts), 256), start, 15), 16, 10).cast("long")


def heads_of(conv_id: Column) -> Column:
    """How many turns a rebuilt conversation takes from the one it is rebuilt on."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(HEADS))


def rebuilt(scratch: Scratch, conversations: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The turns of all rebuilt conversations (conv_id, depth, turn_hash, n_bytes, length), and the conversations (conv_id, length).

    Conversation c takes the first h turns of conversation c - c % 5, then its own from the one after its h-th on.
    """
    role, text = text_or_empty(role_col), text_or_empty(text_col)
    turns = conversations.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"),
        F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256).alias("turn_hash"), F.octet_length(text).cast("long").alias("n_bytes"),
    ).filter(F.col("conv_id").isNotNull())
    placed = running(scratch, turns, ["turn", "role", "turn_hash"], []).drop("turn", "role")
    sizes = scratch.write(placed.groupBy("conv_id").agg(F.count("*").alias("n_turns")))
    bases = sizes.select(F.col("conv_id").alias("base"), "n_turns")
    convs = sizes.withColumns({"base": F.col("conv_id") - F.col("conv_id") % 5, "h": heads_of(F.col("conv_id"))}).join(bases.withColumnRenamed("n_turns", "in_base"), "base", "left")
    convs = convs.withColumn("m", F.least(F.coalesce("in_base", F.lit(0)), "h").cast("long")).drop("in_base")
    convs = scratch.write(convs.withColumn("length", F.col("m") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))))
    n_rows = placed.count()
    own = looked_up(placed.filter(F.col("place") > heads_of(F.col("conv_id"))), ["conv_id"], convs.select("conv_id", "h", "m", "length", "n_turns"), "n_turns", n_rows)
    own = own.withColumn("depth", F.col("place") - F.col("h") + F.col("m"))
    # a conversation has 8 such turns at most, and 9 others are built on it at most
    heads = placed.filter((F.col("conv_id") % 5 == 0) & (F.col("place") < HEADS)).withColumnsRenamed({"conv_id": "base", "place": "depth"})
    heads = heads.join(convs.select("base", "conv_id", "h", "length"), "base").filter(F.col("depth") <= F.col("h"))
    columns = ["conv_id", "depth", "turn_hash", "n_bytes", "length"]
    return own.select(columns).unionByName(heads.select(columns)), convs.select("conv_id", "length")


def ends_digests(ends: DataFrame) -> DataFrame:
    """key0, key1, ends_sha256: the SHA-256 of the decimal ids of conversations that end at a node, ascending, joined by commas."""
    order = [*KEY, "conv_id"]
    ranged = ends.repartitionByRange(*order).sortWithinPartitions(*order)

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Columns(["key0", "key1", "first", "run"], [pa.int64(), pa.int64(), pa.int64(), pa.string()], 1 << 12)
        key, ids, size = None, [], 0
        for batch in batches:
            for a, b, conv in zip(*(batch.column(c).to_pylist() for c in order), strict=True):
                if ids and ((a, b) != key or size > RUN):
                    yield from held.add((*key, ids[0], ",".join(map(str, ids))))
                    ids, size = [], 0
                key = a, b
                ids.append(conv)
                size += 20
        if ids:
            yield from held.add((*key, ids[0], ",".join(map(str, ids))))
        yield from held.rest()

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Columns(["key0", "key1", "ends_sha256"], [pa.int64(), pa.int64(), pa.string()], 1 << 12)
        key, state = None, None
        for batch in batches:
            for a, b, run in zip(*(batch.column(c).to_pylist() for c in ("key0", "key1", "run")), strict=True):
                if (a, b) != key:
                    if key is not None:
                        yield from held.add((*key, state.hexdigest()))
                    key, state = (a, b), hashlib.sha256()
                else:
                    state.update(b",")
                state.update(run.encode())
        if key is not None:
            yield from held.add((*key, state.hexdigest()))
        yield from held.rest()

    some = ranged.mapInArrow(trimmed(runs), "key0 long, key1 long, first long, run string")
    return some.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(trimmed(hashes), "key0 long, key1 long, ends_sha256 string")


class _Columns:
    """Rows gathered to batches of about `most`."""

    def __init__(self, names: list[str], kinds: list[pa.DataType], most: int) -> None:
        self.names, self.kinds, self.most, self.rows = names, kinds, most, []

    def add(self, row: tuple) -> Iterator[pa.RecordBatch]:
        self.rows.append(row)
        if len(self.rows) >= self.most:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*self.rows, strict=True), self.kinds, strict=True)], names=self.names)
            self.rows = []


def rolled_up(scratch: Scratch, state: DataFrame, values: list[str]) -> DataFrame:
    """key0, key1 and, for each node, its values summed over its subtree: state has key0, key1, pointer0, pointer1 (the parent, null at the root) and values."""
    while True:
        pointing = state.filter(F.col(POINTER[0]).isNotNull())
        sums = pointing.groupBy(*POINTER).agg(*(F.sum(v).alias(f"{v}_below") for v in values), F.count("*").alias("met"))
        sums = sums.withColumnsRenamed(dict(zip(POINTER, KEY, strict=True)))
        reached = state.join(sums, KEY, "left").withColumns({v: F.col(v) + F.coalesce(f"{v}_below", F.lit(0)) for v in values})
        met = scratch.write(reached.select(*KEY, *POINTER, *values, "met"))
        scratch.drop(state)
        n_pointing = met.filter(F.col(POINTER[0]).isNotNull()).count()
        if not n_pointing:
            return met.select(*KEY, *values)
        nodes = met.select(*KEY, *POINTER, *values)
        # the pointers of the nodes that are pointed to
        facts = met.filter(F.col("met").isNotNull()).select(*(F.col(k).alias(p) for k, p in zip(KEY, POINTER, strict=True)), *(F.col(p).alias(f"next_{p}") for p in POINTER), "met")
        jumped = looked_up(nodes.filter(F.col(POINTER[0]).isNotNull()), POINTER, facts, "met", n_pointing)
        jumped = jumped.select(*KEY, *(F.col(f"next_{p}").alias(p) for p in POINTER), *values)
        state = scratch.write(jumped.unionByName(nodes.filter(F.col(POINTER[0]).isNull())))
        scratch.drop(met)


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 for each node."""
    scratch = Scratch(conversations.sparkSession)
    turns, convs = rebuilt(scratch, conversations, conv_col, turn_col, role_col, text_col)
    own = [lane(i, F.col("depth").cast("string"), "turn_hash") for i in range(2)]
    turns = turns.select("conv_id", "depth", "n_bytes", (F.col("depth") == F.col("length")).alias("ends"), *(o.alias(n) for o, n in zip(own, LANES, strict=True)), *(o.alias(f"{n}_own") for o, n in zip(own, LANES, strict=True)))
    prefixes = running(scratch, turns, ["depth"], LANES).drop("place")
    # the digest without the last turn is the parent's
    prefixes = prefixes.withColumns({p: (F.col(n) - F.col(f"{n}_own")).bitwiseAND(MASK) for p, n in zip(POINTER, LANES, strict=True)}).withColumnsRenamed(dict(zip(LANES, KEY, strict=True)))
    root = [F.lit(0).cast("long").alias(k) for k in KEY]
    edges = prefixes.groupBy(*KEY).agg(
        F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.count("*").alias("n_convs"), F.max("n_bytes").alias("n_bytes"), *(F.max(p).alias(p) for p in POINTER)
    )
    top = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter(F.col("n_convs") > 0)
    top = top.select(*root, "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("n_bytes"), *(F.lit(None).cast("long").alias(p) for p in POINTER))
    edges = scratch.write(edges.unionByName(top))
    children = edges.filter(F.col(POINTER[0]).isNotNull()).groupBy(*POINTER).agg(F.count("*").alias("n_children")).withColumnsRenamed(dict(zip(POINTER, KEY, strict=True)))
    nodes = scratch.write(edges.join(children, KEY, "left").withColumns({"n_children": F.coalesce("n_children", F.lit(0)), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_bytes")}))
    scratch.drop(edges)
    state = scratch.write(nodes.select(*KEY, *POINTER, (F.col("n_children") == 0).cast("long").alias("n_leaves"), "saved_tokens"))
    totals = rolled_up(scratch, state, ["n_leaves", "saved_tokens"])
    below = nodes.filter(F.col(POINTER[0]).isNotNull())
    parents = nodes.filter(F.col("n_children") > 0).select(*(F.col(k).alias(p) for k, p in zip(KEY, POINTER, strict=True)), F.col("conv_id").alias("parent_conv_id"), "n_children")
    named = looked_up(below.drop("saved_tokens").withColumnRenamed("n_children", "own_children"), POINTER, parents, "n_children", below.count()).withColumnRenamed("own_children", "n_children")
    named = named.unionByName(nodes.filter(F.col(POINTER[0]).isNull()).drop("saved_tokens").withColumn("parent_conv_id", F.lit(None).cast("long")))
    ends = prefixes.filter("ends").select(*KEY, "conv_id").unionByName(convs.filter(F.col("length") == 0).select(*root, "conv_id"))
    out = named.join(totals, KEY).join(ends_digests(ends), KEY, "left")
    nothing = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nothing)).alias("ends_sha256"))
