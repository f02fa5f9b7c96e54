"""Mixing sources to target weights by min-cost flow over membership patterns.

A document may belong to several sources. Documents with the same set of
sources form a pattern; only patterns, never documents, reach the driver. There
a transport network routes words from patterns to source quotas: a pattern's
words may be used once at cost 0, a second time at cost 1, a third at cost 2
and so on (convex, so copies are spread before they are piled up), and
successive shortest augmenting paths give a flow of least cost. The flow says
how many words each pattern gives in all: whole rounds of all its documents,
and a last part round, for which documents are taken in a seeded order until
one doesn't fit. What is left then, less than that one's size, is filled with
other documents, larger ones first, until none of those not taken fits.

The seeded order is never a global sort. Hash bins of two levels are summed;
running sums over bins find the bin where the part round ends, and only the
documents of that one small bin are ranked.

Defined cases: a null text has size 0 and is never needed (taken 0); a null
source is a source of its own, last in order; an empty table gives an empty
result; repeated rows count as rows of their own, ordered by their row number;
columns beyond those named are not read.

Bound: the number of patterns on the driver is at most `max_patterns`; more
than that raises, it never drops any.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, checkpoint, text_or_empty, with_own_names

#: Bins of the seeded order: this many, and as many again within one of them.
BINS = 4096


def capped_targets(sizes: list[int], weights: list[float], total: float, most: float) -> list[float]:
    """Split total by weight; no share is above most * size, the excess goes to the others by weight."""
    targets = [0.0] * len(sizes)
    free, left = set(range(len(sizes))), float(total)
    while free:
        weight = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] > most * sizes[i] * weight]
        if not over:
            for i in free:
                targets[i] = left * weights[i] / weight
            break
        for i in over:
            targets[i] = most * float(sizes[i])
            free.discard(i)
        left -= sum(targets[i] for i in over)
    return targets


def min_cost_flow(capacities: list[int], members: list[tuple[int, ...]], quotas: list[int], rounds: int) -> list[list[int]]:
    """Words that each pattern sends to each source, at least cost among the largest flows.

    Nodes: a start, the patterns, the sources, an end. A pattern takes its
    capacity once for each round, round r at cost r a word.
    """
    p, s = len(capacities), len(quotas)
    start, end = p + s, p + s + 1
    heads: list[list[int]] = [[] for _ in range(p + s + 2)]
    to: list[int] = []
    room: list[int] = []
    cost: list[int] = []

    def edge(a: int, b: int, capacity: int, price: int) -> int:
        for x, y, c, w in ((a, b, capacity, price), (b, a, 0, -price)):
            heads[x].append(len(to))
            to.append(y)
            room.append(c)
            cost.append(w)
        return len(to) - 2

    sent: dict[tuple[int, int], int] = {}
    for i, capacity in enumerate(capacities):
        for r in range(rounds):
            edge(start, i, capacity, r)
        for j in members[i]:
            sent[i, j] = edge(i, p + j, capacity * rounds, 0)
    for j, quota in enumerate(quotas):
        edge(p + j, end, quota, 0)

    potential = [0] * len(heads)
    while True:
        far = [float("inf")] * len(heads)
        came = [-1] * len(heads)
        far[start] = 0
        heap: list[tuple[float, int]] = [(0, start)]
        while heap:
            d, x = heapq.heappop(heap)
            if d > far[x]:
                continue
            for e in heads[x]:
                if room[e] > 0 and (n := d + cost[e] + potential[x] - potential[to[e]]) < far[to[e]]:
                    far[to[e]], came[to[e]] = n, e
                    heapq.heappush(heap, (n, to[e]))
        if came[end] < 0:
            break
        for x, d in enumerate(far):
            if d < float("inf"):
                potential[x] += int(d)
        path, x = [], end
        while x != start:
            path.append(came[x])
            x = to[came[x] ^ 1]
        most = min(room[e] for e in path)
        for e in path:
            room[e] -= most
            room[e ^ 1] += most
    return [[room[sent[i, j] ^ 1] if (i, j) in sent else 0 for j in range(s)] for i in range(p)]


def code_point_order(names) -> list:
    """Names by code point, null last."""
    return sorted((n for n in names if n is not None), key=lambda n: [ord(c) for c in n]) + [None] * (None in names)


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[float, ...] = (3.0, 1.0, 2.0),
    share: float = 1.5,
    most: int = 2,
    seed: int = 20,
    max_patterns: int = 100_000,
) -> DataFrame:
    """doc_id, sources, size, source_size, target, copies, taken for each row of docs.

    source_col is a string, or an array of strings for overlapping sources.
    `weights` repeat over the sources by code point; together they take `share`
    of all words, and no source more than `most` times its own.
    """
    many = dict(docs.dtypes)[source_col].startswith("array")
    # arrays can't hold a null apart from an absent one once sorted, so null is marked
    sources = F.array_sort(F.array_distinct(F.coalesce(F.col(source_col), F.array(F.lit(None).cast("string"))))) if many else F.array(F.col(source_col))
    rows = checkpoint(
        docs.select(
            F.col(id_col).alias("doc_id"),
            sources.alias("sources"),
            F.regexp_count(text_or_empty(text_col), F.lit(WORD)).cast("long").alias("size"),
            F.monotonically_increasing_id().alias("row"),
        ).withColumn("order", F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).bitwiseAND(F.lit((1 << 62) - 1)))
    )
    plan = _plan(rows, weights, share, most, max_patterns)
    spark = docs.sparkSession
    schema = "sources array<string>, pattern_size long, whole int, part long, source_size long, target double"
    patterns = F.broadcast(spark.createDataFrame(plan, schema))  # max_patterns rows at most
    return _select(rows.join(patterns, "sources", "left") if plan else rows.join(patterns, "sources"))


def _plan(rows: DataFrame, weights, share, most, max_patterns) -> list[tuple]:
    found = rows.groupBy("sources").agg(F.sum("size").alias("size")).limit(max_patterns + 1).collect()
    if len(found) > max_patterns:
        raise ValueError(f"more than {max_patterns} membership patterns")
    found.sort(key=lambda r: [(x is None, x or "") for x in r.sources])
    names = code_point_order({x for r in found for x in r.sources})
    at = {n: i for i, n in enumerate(names)}
    sizes = [sum(r.size for r in found if n in r.sources) for n in names]
    targets = capped_targets(sizes, [weights[i % len(weights)] for i in range(len(names))], share * sum(r.size for r in found), most)
    flow = min_cost_flow([r.size for r in found], [tuple(at[x] for x in r.sources) for r in found], [round(t) for t in targets], most)
    plan = []
    for r, sent in zip(found, flow, strict=True):
        whole, part = divmod(sum(sent), r.size) if r.size else (0, 0)
        first = at[r.sources[0]]
        plan.append((list(r.sources), r.size, whole, part, sizes[first], targets[first]))
    return plan


def _within(rows: DataFrame, keys: list[str], small) -> DataFrame:
    """rows with `inside`: those of each group of keys, in seeded order, whose running sum of `weight` is within `part`. small: how tables of a row a group are joined."""
    rows = rows.withColumns({"bin": F.shiftright("order", 50).cast("int"), "sub": F.shiftright("order", 38).bitwiseAND(F.lit(BINS - 1)).cast("int")})

    def running(df: DataFrame, key: str, keys: list[str], base) -> DataFrame:
        """The weight before each bin."""
        w = Window.partitionBy(*keys).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
        sums = df.groupBy(*keys, key).agg(F.sum("weight").alias("in_bin"), F.first("part").alias("part"), base.alias("base"))
        return sums.withColumn("before", F.col("base") + F.coalesce(F.sum("in_bin").over(w), F.lit(0)))

    bins = running(rows, "bin", keys, F.lit(0).cast("long"))
    # one bin of each group straddles the end of its part
    edge = bins.filter((F.col("before") < F.col("part")) & (F.col("before") + F.col("in_bin") > F.col("part"))).select(*keys, "bin", F.col("before").alias("base"))
    at_edge = rows.join(small(edge), [*keys, "bin"])
    subs = running(at_edge, "sub", [*keys, "bin"], F.first("base"))
    # exact ranks only in the last sub-bin: about a row in BINS * BINS of the group
    last = subs.filter((F.col("before") < F.col("part")) & (F.col("before") + F.col("in_bin") > F.col("part"))).select(*keys, "bin", "sub", F.col("before").alias("sub_base"))
    w = Window.partitionBy(*keys).orderBy("order", "row").rowsBetween(Window.unboundedPreceding, 0)
    ranked = at_edge.join(small(last), [*keys, "bin", "sub"]).withColumn("upto", F.col("sub_base") + F.sum("weight").over(w))
    cut = ranked.filter(F.col("upto") <= F.col("part")).groupBy(*keys).agg(F.max(F.struct("order", "row")).alias("cut"))
    ends = (
        bins.filter(F.col("before") + F.col("in_bin") <= F.col("part")).groupBy(*keys).agg(F.max("bin").alias("last_bin"))
        .join(subs.filter(F.col("before") + F.col("in_bin") <= F.col("part")).groupBy(*keys).agg(F.max(F.struct("bin", "sub")).alias("last_sub")), keys, "full")
        .join(cut, keys, "full")
    )
    inside = (
        F.coalesce(F.col("bin") <= F.col("last_bin"), F.lit(False))
        | F.coalesce(F.struct("bin", "sub") <= F.col("last_sub"), F.lit(False))
        | F.coalesce(F.struct("order", "row") <= F.col("cut"), F.lit(False))
    )
    return rows.join(small(ends), keys, "left").withColumn("inside", inside & (F.col("part") > 0)).drop("bin", "sub", "last_bin", "last_sub", "cut")


def _fill(table: pa.Table) -> pa.Table:
    """How many documents of each size fill what is left of one pattern's part round, the largest sizes first."""
    table = table.sort_by([("size", "descending")])
    left, need = table.column("left")[0].as_py(), []
    for size, count in zip(table.column("size").to_pylist(), table.column("count").to_pylist(), strict=True):
        need.append(min(count, left // size))
        left -= need[-1] * size
    return table.select(["sources", "size"]).append_column("need", pa.array(need, type=pa.int64())).filter(pa.array([n > 0 for n in need]))


def _select(rows: DataFrame) -> DataFrame:
    """Take the part round: documents in seeded order while their running sum is within `part`, then others that fit into what is left."""
    chosen = checkpoint(_within(rows.withColumn("weight", F.col("size")), ["sources"], F.broadcast))
    # a row a pattern; less is left than the size of the document at the cut
    left = chosen.filter("part > 0").groupBy("sources").agg((F.first("part") - F.sum(F.when(F.col("inside"), F.col("size")).otherwise(0))).alias("left"))
    rest = chosen.filter("part > 0 AND NOT inside AND size > 0")
    sizes = rest.groupBy("sources", "size").agg(F.count("*").alias("count")).join(F.broadcast(left), "sources").filter("size <= left")
    needs = sizes.groupBy("sources").applyInArrow(_fill, "sources array<string>, size long, need long")
    # stored, as _within() reads its rows several times: its plan would hold all of the above as often
    fitting = checkpoint(rest.drop("part", "inside", "weight").join(needs.withColumnRenamed("need", "part"), ["sources", "size"]).withColumn("weight", F.lit(1)))
    fill = _within(fitting, ["sources", "size"], lambda df: df)
    filled = fill.filter("inside").select("row", F.lit(1).alias("filled"))
    copies = F.col("whole") + F.col("inside").cast("int") + F.coalesce("filled", F.lit(0))
    return chosen.join(filled, "row", "left").select("doc_id", "row", "sources", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).alias("taken"))


@with_own_names
def repeat_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mixture itself: each row of docs as often as it is taken, with all its columns.

    Rows with one id share what is taken of them evenly, as the order of such rows isn't known when they are read again.
    """
    chosen = mix(docs, id_col, text_col, source_col, **options)
    by_id = chosen.groupBy(F.col("doc_id").alias("_mix_id")).agg(F.sum("copies").alias("_copies"), F.count("*").alias("_rows"))
    held = docs.join(checkpoint(by_id.filter("_copies > 0")), F.col(id_col).eqNullSafe(F.col("_mix_id")))
    own = Window.partitionBy("_mix_id").orderBy(F.xxhash64(F.col(text_col)))
    # ids are unique as a rule; only others are ranked
    once = held.filter("_rows = 1").withColumn("_times", F.col("_copies").cast("int"))
    more = held.filter("_rows > 1").withColumn("_nth", F.row_number().over(own))
    more = more.withColumn("_times", (F.floor(F.col("_copies") / F.col("_rows")) + (F.col("_nth") <= F.col("_copies") % F.col("_rows")).cast("int")).cast("int"))
    both = once.select(*docs.columns, "_times").unionByName(more.select(*docs.columns, "_times"))
    return both.filter("_times > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_times")))).select(*docs.columns)
