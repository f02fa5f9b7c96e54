"""Joins by key and rank, nearest in order, in space and by overlap; set operations with checks.

Spatial and nearest joins are equi joins on grid cells or keys, never products
of whole tables. Small sides are left to Spark's own size check, not forced.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rotaframe.functions import geometry

from . import windows


def lookup(rows: DataFrame, models: DataFrame, key: str = "id") -> DataFrame:
    """Rows with their model's columns. An id that names no model is an error, not a dropped row."""
    out = rows.join(models.withColumn("_known", F.lit(True)), key, "left")
    checked = F.when(F.col("_known"), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit(f"no model for {key} "), F.col(key).cast("string"))).cast("boolean"))
    return out.filter(checked).drop("_known")


def keyed_rank_join(left: DataFrame, right: DataFrame, keys: list[str], tie: list[str]) -> DataFrame:
    """Pairs of rows with equal keys and equal rank in the tie order, within a key; columns of right end in _r."""
    rank = Window.partitionBy(*keys).orderBy(*tie)
    a = left.withColumn("rank", F.row_number().over(rank))
    b = right.withColumn("rank", F.row_number().over(rank))
    b = b.select(*keys, "rank", *(F.col(c).alias(f"{c}_r") for c in right.columns if c not in keys))
    return a.join(b, [*keys, "rank"])


def nearest_by_key(left: DataFrame, right: DataFrame, keys: list[str], at: str, row_id: str, tie: str) -> DataFrame:
    """For each left row the right row of its key with the nearest value of `at`; ties to the least `tie`. Columns of right end in _r.

    Sorted neighbours do it: the last right value at or before each left one and the first after it, by windows over the union, so a key's pairs are never made.
    """
    cols = [c for c in right.columns if c not in keys]
    packed = F.struct(F.col(at).alias("_at"), F.col(tie).alias("_tie"), *(F.col(c).alias(f"{c}_r") for c in cols))
    # of right rows with one place, the least tie stands for all
    single = right.groupBy(*keys, at).agg(F.min(packed).alias("_p"))
    both = left.select(*keys, F.col(at).alias("_w"), F.struct(*left.columns).alias("_l"), F.lit(None).cast(single.schema["_p"].dataType).alias("_p"), F.lit(1).alias("_side"))
    both = both.unionByName(single.select(*keys, F.col(at).alias("_w"), F.lit(None).cast(both.schema["_l"].dataType).alias("_l"), "_p", F.lit(0).alias("_side")))
    w = Window.partitionBy(*keys).orderBy("_w", "_side")
    before = F.last("_p", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_p", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    out = both.withColumns({"_b": before, "_a": after}).filter("_side = 1 AND (_b IS NOT NULL OR _a IS NOT NULL)")
    gap_b, gap_a = F.col("_w") - F.col("_b._at"), F.col("_a._at") - F.col("_w")
    take_b = F.col("_a").isNull() | (F.col("_b").isNotNull() & ((gap_b < gap_a) | ((gap_b == gap_a) & (F.col("_b._tie") <= F.col("_a._tie")))))
    best = F.when(take_b, F.col("_b")).otherwise(F.col("_a"))
    return out.withColumn("_best", best).select("_l.*", *(F.col(f"_best.{c}_r") for c in cols), F.abs(F.col("_w") - F.col("_best._at")).alias("distance"))


def greedy_pairs(left: DataFrame, right: DataFrame, keys: list[str], at: str, row_id: str, radius: float) -> DataFrame:
    """Within a key, both sides walk in order of `at`: a pair within the radius is taken, else the lower one is passed over.

    Order dependent by definition. No pair crosses a gap of more than the radius, so a key is cut there first, and each run is
    walked by one function; runs are spread over tasks.
    """
    sides = [df.select(*keys, at, row_id, F.lit(n).alias("_side")) for n, df in enumerate((left, right))]
    cut = windows.chains(sides[0].unionByName(sides[1]), keys, at, row_id, radius)
    runs = cut.groupBy(*keys, "chain").agg(F.min("_side").alias("_lo"), F.max("_side").alias("_hi")).filter("_lo <> _hi")
    cut = cut.join(runs.select(*keys, "chain"), [*keys, "chain"], "left_semi")

    def walk(a: pa.Table, b: pa.Table) -> pa.Table:
        a, b = a.sort_by([(at, "ascending"), (row_id, "ascending")]), b.sort_by([(at, "ascending"), (row_id, "ascending")])
        x, y = a.column(at).to_pylist(), b.column(at).to_pylist()
        i = j = 0
        left_ids, right_ids = [], []
        while i < len(x) and j < len(y):
            if abs(x[i] - y[j]) <= radius:
                left_ids.append(i)
                right_ids.append(j)
                i, j = i + 1, j + 1
            elif x[i] < y[j]:
                i += 1
            else:
                j += 1
        return pa.table({"left_id": a.column(row_id).take(pa.array(left_ids, type=pa.int64())), "right_id": b.column(row_id).take(pa.array(right_ids, type=pa.int64()))})

    columns = [*keys, "chain", at, row_id]
    a, b = (cut.filter(F.col("_side") == n).select(*(F.col(c).alias(c) for c in columns)).groupBy(*keys, "chain") for n in (0, 1))
    return a.cogroup(b).applyInArrow(walk, "left_id long, right_id long")


def _cells(df: DataFrame, axes: list[str], size: float, spread: int) -> DataFrame:
    """A row for its own grid cell, or for it and its neighbours."""
    out = df
    for i, axis in enumerate(axes):
        cell = F.floor(F.col(axis) / size)
        out = out.withColumn(f"_c{i}", F.explode(F.array(*(cell + k for k in range(-spread, spread + 1)))) if spread else cell)
    return out


def within(left: DataFrame, right: DataFrame, axes: list[str], radius: float, keys: list[str] | None = None) -> DataFrame:
    """All pairs within a distance, by an equi join on grid cells of that width; the other side's columns end in _r."""
    keys = keys or []
    b = right.select(*keys, *(F.col(c).alias(f"{c}_r") for c in right.columns if c not in keys))
    b = _cells(b, [f"{a}_r" for a in axes], radius, 1)
    pairs = _cells(left, axes, radius, 0).join(b, [*keys, *(f"_c{i}" for i in range(len(axes)))]).drop(*(f"_c{i}" for i in range(len(axes))))
    d2 = sum(((F.col(a) - F.col(f"{a}_r")) * (F.col(a) - F.col(f"{a}_r")) for a in axes), F.lit(0.0))
    return pairs.withColumn("d2", d2).filter(F.col("d2") <= radius * radius)


def mutual_nearest(left: DataFrame, right: DataFrame, axes: list[str], radius: float, row_id: str) -> DataFrame:
    """Pairs each of which is the other's nearest within the radius; ties to the least id."""
    pairs = within(left, right, axes, radius).select(F.col(row_id).alias("left_id"), F.col(f"{row_id}_r").alias("right_id"), "d2")
    a = pairs.groupBy("left_id").agg(F.min(F.struct("d2", "right_id")).alias("m")).select("left_id", F.col("m.right_id").alias("right_id"), F.col("m.d2").alias("d2"))
    b = pairs.groupBy("right_id").agg(F.min(F.struct("d2", "left_id")).alias("m")).select(F.col("m.left_id").alias("left_id"), "right_id")
    return a.join(b, ["left_id", "right_id"])


def nearest_neighbour(rows: DataFrame, axes: list[str], radius: float, keys: list[str], row_id: str, coincident: float = 1e-4) -> DataFrame:
    """Distance to the nearest other row of the group, coincident ones left out; within the radius."""
    near = within(rows, rows, axes, radius, keys).filter((F.col(row_id) != F.col(f"{row_id}_r")) & (F.col("d2") > coincident * coincident))
    return near.groupBy(row_id).agg(F.sqrt(F.min("d2")).alias("distance"))


def overlaps(boxes: DataFrame, row_id: str, axes: list[tuple[str, str]], tiles: list[int], keys: list[str] | None = None) -> DataFrame:
    """Pairs of boxes [low, high) that overlap on all axes: an equi join on tiles, each pair kept at its first common tile alone."""
    keys = keys or []
    tiled = boxes
    for i, ((low, high), size) in enumerate(zip(axes, tiles, strict=True)):
        tiled = tiled.withColumn(f"_t{i}", F.explode(F.sequence(F.floor(F.col(low) / size), F.floor((F.col(high) - 1) / size))))
    at = [f"_t{i}" for i in range(len(axes))]
    ends = [c for pair in axes for c in pair]
    b = tiled.select(*keys, *at, F.col(row_id).alias("b"), *(F.col(c).alias(f"{c}_b") for c in ends))
    a = tiled.select(*keys, *at, F.col(row_id).alias("a"), *ends)
    hit = F.col("a") < F.col("b")
    for i, ((low, high), size) in enumerate(zip(axes, tiles, strict=True)):
        hit = hit & (F.col(low) < F.col(f"{high}_b")) & (F.col(f"{low}_b") < F.col(high))
        hit = hit & (F.col(f"_t{i}") == F.greatest(F.floor(F.col(low) / size), F.floor(F.col(f"{low}_b") / size)))
    return a.join(b, [*keys, *at]).filter(hit).select(*keys, "a", "b")


def outside_ranges(rows: DataFrame, ranges: DataFrame, at: str, low: str, high: str, width: int, keys: list[str] | None = None) -> DataFrame:
    """Rows whose place is in none of the ranges [low, high]: a range anti join by blocks of `width`."""
    keys = keys or []
    blocks = ranges.withColumn("_block", F.explode(F.sequence(F.floor(F.col(low) / width), F.floor(F.col(high) / width))))
    held = rows.withColumn("_block", F.floor(F.col(at) / width))
    same = [held[k] == blocks[k] for k in keys]
    hit = (held["_block"] == blocks["_block"]) & held[at].between(blocks[low], blocks[high])
    for s in same:
        hit = hit & s
    return held.join(blocks, hit, "left_anti").drop("_block")


def symmetry_mates(rows: DataFrame, keys: list[str], operator: list[Column], value: str) -> DataFrame:
    """Each row with its image under an operator on the keys; fixed points and missing images are left out."""
    fixed = F.lit(True)
    for k, image in zip(keys, operator, strict=True):
        fixed = fixed & (F.col(k) == image)
    moved = rows.filter(~fixed).select(*keys, F.col(value), *(c.alias(f"_{k}") for k, c in zip(keys, operator, strict=True)))
    mates = rows.select(*(F.col(k).alias(f"_{k}") for k in keys), F.col(value).alias(f"{value}_mate"))
    return moved.join(mates, [f"_{k}" for k in keys]).drop(*(f"_{k}" for k in keys))


def best_operator(a: DataFrame, b: DataFrame, keys: list[str], operators: dict[str, list[Column]], value: str, identity: str, least: int = 10) -> DataFrame:
    """Rank correlation of a with b reindexed by each operator that leaves `least` common keys, and which is best; ties go to the identity.

    One pass over b: images are exploded from the short list of operators. Equal values are ranked in the order of keys.
    """
    images = F.explode(F.array(*(F.struct(F.lit(name).alias("operator"), *(c.alias(k) for k, c in zip(keys, image, strict=True))) for name, image in operators.items())))
    moved = b.select(images.alias("_i"), F.col(value).alias("_b")).select("_i.*", "_b")
    both = a.select(*keys, F.col(value).alias("_a")).join(moved, keys)
    both = windows.ranks(windows.ranks(both, ["operator"], "_a", keys, "_ra"), ["operator"], "_b", keys, "_rb")
    found = both.groupBy("operator").agg(F.count("*").alias("common"), F.corr("_ra", "_rb").alias("cc")).filter(F.col("common") >= least)
    best = found.agg(F.max_by("operator", F.struct(F.coalesce("cc", F.lit(-2.0)), F.col("operator") == identity, "operator")).alias("best"))  # one row
    return found.join(F.broadcast(best)).select("operator", "common", "cc", (F.col("operator") == F.col("best")).alias("chosen"))


def explain_unpartnered(rows: DataFrame, partners: DataFrame, keys: list[str], row_id: str, reasons: list[tuple[str, Column]], otherwise: str) -> DataFrame:
    """Rows without a partner of their key, and the first reason that holds."""
    why = F.lit(otherwise)
    for name, holds in reversed(reasons):
        why = F.when(holds, F.lit(name)).otherwise(why)
    return rows.join(partners.select(*keys).distinct(), keys, "left_anti").select(row_id, why.alias("reason"))


def checked_union(*frames: DataFrame) -> DataFrame:
    """Union of tables that must have the same columns and types."""
    want = {(f.name, f.dataType) for f in frames[0].schema.fields}
    for i, f in enumerate(frames[1:], 1):
        have = {(x.name, x.dataType) for x in f.schema.fields}
        if have != want:
            names = sorted({n for n, _ in want ^ have})
            raise ValueError(f"table {i} differs in {', '.join(names)}")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def combine_runs(frames: list[DataFrame], id_col: str) -> tuple[DataFrame, list[str]]:
    """Runs made one table: ids follow on, columns common to all with one type are kept; the names of others are returned."""
    types = [dict(f.dtypes) for f in frames]
    common = [c for c in frames[0].columns if all(t.get(c) == types[0][c] for t in types)]
    dropped = sorted({c for t in types for c in t} - set(common))
    out = None
    for n, f in enumerate(frames):
        own = f.select(*(F.col(c) for c in common if c != id_col), F.col(id_col).cast("long").alias(id_col), F.lit(n).alias("_run"))
        out = own if out is None else out.unionByName(own)
    sizes = out.groupBy("_run").agg((F.max(id_col) + 1).alias("_size"))  # a row a run
    before = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_run", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    out = out.join(F.broadcast(starts), "_run").withColumn(id_col, F.col(id_col) + F.col("_start"))
    return out.drop("_run", "_start"), dropped


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component: the least node reachable), by rounds of large and small stars.

    A round ties every larger neighbour of a node to the least of its neighbourhood, then a node and its smaller neighbours
    to the least of those, so a component's depth is cut by a factor and the rounds don't grow with its width. Edges go to
    two tables in turn, so that of all rounds two are held; minima are never broadcast, being as many as nodes.
    """
    from .storage import shared_folder, written

    ends = written(edges.select(F.col(a).alias("u"), F.col(b).alias("v")).distinct())
    now = ends.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    folder = f"{shared_folder(edges.sparkSession)}/stars-{uuid.uuid4().hex}"
    before = None
    for n in itertools.count():
        now = written(now, f"{folder}/{n % 2}")
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            break
        before = mark
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least.hint("merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low.hint("merge"), "u").select("v", "m").unionByName(low.select(F.col("u").alias("v"), "m"))
        now = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    nodes = ends.select(F.explode(F.array("u", "v")).alias("node")).filter("node IS NOT NULL").distinct()
    found = now.toDF("node", "component").hint("merge")
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def map_batches(function, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Apply a function of numpy columns to Arrow batches."""
    for batch in batches:
        columns = {n: batch.column(n).to_numpy(zero_copy_only=False) for n in batch.schema.names}
        out = function(**columns)
        yield pa.RecordBatch.from_arrays([pa.array(np.asarray(v)) for v in out.values()], names=list(out))


#: Panels of all detectors that are written into a projection, at most; a detector has some tens, and experiments share detectors.
PANELS = 1024


def first_panel(rays: DataFrame, panels: DataFrame, detector: str, ray: str = "s1") -> DataFrame:
    """Rays with the first panel, in their order, that they meet in front of them, and the place there in millimetres; others are left out.

    panels: detector, panel, origin, fast, slow, width, height (mm), a row a panel of each detector. They are constants
    of a projection, so no ray is shuffled or made more than one row; more than PANELS are an error.
    """
    known = panels.orderBy(detector, "panel").limit(PANELS + 1).collect()
    if len(known) > PANELS:
        raise ValueError(f"more than {PANELS} panels")
    s1, own = F.col(ray), rays
    found = []
    for n, p in enumerate(known):
        # the ray in the panel's own frame: s1 = x fast + y slow + w origin, up to a factor
        to_panel = np.linalg.inv(np.array([[p.fast[k], p.slow[k], p.origin[k]] for k in "xyz"], dtype=float))
        along = geometry.matrix_times(to_panel, s1)
        own = own.withColumns({f"_{k}{n}": along[k] for k in "xyz"})
        x, y, far = F.col(f"_x{n}"), F.col(f"_y{n}"), F.col(f"_z{n}")
        met = (F.col(detector) == F.lit(p[detector])) & (far > 0) & (x >= 0) & (x <= far * p.width) & (y >= 0) & (y <= far * p.height)
        found.append(F.when(met, F.struct(F.lit(p.panel).alias("panel"), (x / far).alias("x_mm"), (y / far).alias("y_mm"))))
    if not found:
        kind = panels.select("panel").schema[0].dataType
        return rays.select("*", F.lit(None).cast(kind).alias("panel"), *(F.lit(None).cast("double").alias(c) for c in ("x_mm", "y_mm"))).limit(0)
    # a filter on the row's number can't be moved below the steps, where each of them would be written out again and again
    hit = own.withColumns({"_hit": F.coalesce(*found), "_row": F.monotonically_increasing_id()}).filter(F.col("_hit").isNotNull() & (F.col("_row") >= 0))
    return hit.select(*rays.columns, "_hit.*")
