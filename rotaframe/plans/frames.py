"""Frames, boxes and fits on the driver's tables, each with the SQL that says the same where SQL can.

Vectors are rows of pixels, order lines are predictions on one large panel, orders are spots that touch their neighbours.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaframe.functions import geometry
from rotaframe.operators import fits, shoeboxes
from rotaframe.operators.storage import checkpoint, shared_folder, written
from rotaframe.sources import frames

from .figures import horner, near
from .queries import table
from .registry import query

ROWS, WIDTH = 32, 64


def images_of_vectors(spark: SparkSession, sf_dir: str, dark: int = 0) -> DataFrame:
    """(sweep, frame, pixels): a vector is a row of a frame of 32, missing rows are dark, and every seventh frame was never written."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.transform("embedding", lambda e: F.greatest(F.floor(F.abs(e.cast("double")) * 1000) - dark, F.lit(0).cast("long"))).alias("row"))
    rows = rows.select(F.lit(0).alias("sweep"), F.expr(f"CAST(id DIV {ROWS} AS INT)").alias("frame"), (F.col("id") % ROWS).cast("int").alias("y"), "row")
    none = F.array_repeat(F.lit(0).cast("long"), WIDTH)
    held = rows.groupBy("sweep", "frame").agg(F.map_from_entries(F.collect_list(F.struct("y", "row"))).alias("rows"))  # 32 of them
    pixels = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(ROWS - 1)), lambda y: F.coalesce(F.try_element_at("rows", y), none)))
    return held.select("sweep", "frame", F.when(F.col("frame") % 7 != 3, pixels).alias("pixels"))


def written_frames(spark: SparkSession, sf_dir: str, layout: frames.Layout, dark: int = 0) -> DataFrame:
    """The stored index of those frames' chunks."""
    held = checkpoint(images_of_vectors(spark, sf_dir, dark))
    return checkpoint(frames.write_chunks(held, f"{shared_folder(spark)}/chunks-{uuid.uuid4().hex}", layout))


PIXELS = f"SELECT CAST(vec_id // {ROWS} AS INTEGER) AS frame, vec_id % {ROWS} AS y, unnest(range({WIDTH})) AS x, CAST(floor(abs(unnest(embedding)::DOUBLE) * 1000) AS BIGINT) AS v FROM embeddings WHERE (vec_id // {ROWS}) % 7 <> 3"


@query(f"SELECT frame, CAST({ROWS * WIDTH} AS BIGINT) AS n, CAST(sum(v) AS BIGINT) AS total, max(v) AS most, CAST(sum(v * (y * {WIDTH} + x + 1)) AS BIGINT) AS place FROM ({PIXELS}) GROUP BY 1")
def frames_from_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames written as bit-shuffled LZ4 chunks, read back by ranges of their files."""
    layout = frames.Layout(ROWS, WIDTH)
    read = frames.decoded(written_frames(spark, sf_dir, layout), layout)
    pixels = read.select("frame", F.posexplode("pixels").alias("at", "v"))
    return pixels.groupBy("frame").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.max("v").alias("most"), F.sum(F.col("v") * (F.col("at") + 1)).alias("place"))


@query()
def spots_from_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From chunks to measured spots, over all frames; tests/test_frames.py holds it against plain loops."""
    layout = frames.Layout(ROWS, WIDTH, algorithm="lz4")
    found = frames.spots(written_frames(spark, sf_dir, layout, dark=260), layout, least=1)
    return found.select("sweep", "n_signal", "total", *(F.round(f"c_{k}", 6).alias(f"c_{k}") for k in "xyz"))


# A beam of 0.9 Angstrom along -z, an axis along x, a panel of 1000 x 750 pixels of 0.2 mm at 250 mm, images of 0.1 degrees.
EXPERIMENT = shoeboxes.Experiment((0, 0, -1 / 0.9), (1, 0, 0), (shoeboxes.Panel((-100, 75, -250), (1, 0, 0), (0, -1, 0), (0.2, 0.2), (1000, 750)),), 1, 120_000, 0.0, 0.1)
WIDTHS = shoeboxes.Widths(sigma_d=0.02, sigma_m=0.05, box_scale=1.5, min_zeta=0.1, max_images=24)
PLACED = """p AS (SELECT ord * 8 + line AS row_id, any_value(x) AS x, any_value(y) AS y, min((ord % 50000) * 0.2 + line * 0.03) AS deg FROM (SELECT l_orderkey AS ord, l_linenumber AS line, l_partkey % 200 + 0.25::DOUBLE AS x, l_suppkey % 150 + 0.5::DOUBLE AS y,
  row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey) AS nth FROM lineitem) WHERE nth = 1 GROUP BY 1),
u AS (SELECT *, (x - 100) / len AS ux, (75 - y) / len AS uy, -250 / len AS uz FROM (SELECT *, sqrt((x - 100) ** 2 + (75 - y) ** 2 + 62500) AS len FROM p)),
f AS (SELECT *, -uy / r AS e1x, ux / r AS e1y, -uy / r AS zeta FROM (SELECT *, sqrt(ux * ux + uy * uy) AS r FROM u)),
k AS (SELECT *, -uz * e1y AS e2x, uz * e1x AS e2y, ux * e1y - uy * e1x AS e2z, 0.15 / abs(zeta) AS half FROM f),
c AS (SELECT row_id, min(px) AS xa, max(px) AS xb, min(py) AS ya, max(py) AS yb FROM (SELECT row_id, ((ux + a * e1x + b * e2x) * fz + 100) / 0.2 AS px, (75 - (uy + a * e1y + b * e2y) * fz) / 0.2 AS py
  FROM (SELECT *, -250 / (uz + b * e2z) AS fz FROM k, (SELECT a * t AS a, b * t AS b FROM (SELECT radians(0.06) * 1.5 AS t), (SELECT unnest([-1, 1]) AS a), (SELECT unnest([-1, 1]) AS b)))) GROUP BY 1),
b AS (SELECT k.*, floor(xa) AS xl, ceil(xb) AS xh, floor(ya) AS yl, ceil(yb) AS yh, floor((deg - half) / 0.1) AS zl, ceil((deg + half) / 0.1) AS zh FROM k JOIN c ON k.row_id = c.row_id),
w AS (SELECT *, CASE WHEN abs(zeta) < 0.1 THEN 'small zeta' WHEN zh - zl > 24 THEN 'too many images' WHEN greatest(xl, 0) >= least(xh, 1000) OR greatest(yl, 0) >= least(yh, 750) OR greatest(zl, 0) >= least(zh, 120000) THEN 'outside the panel or the scan' END AS reason FROM b),
boxes AS (SELECT *, CASE WHEN reason IS NULL THEN CAST(greatest(xl, 0) AS INTEGER) END AS x0, CASE WHEN reason IS NULL THEN CAST(least(xh, 1000) AS INTEGER) END AS x1, CASE WHEN reason IS NULL THEN CAST(greatest(yl, 0) AS INTEGER) END AS y0, CASE WHEN reason IS NULL THEN CAST(least(yh, 750) AS INTEGER) END AS y1,
  CASE WHEN reason IS NULL THEN CAST(greatest(zl, 0) AS INTEGER) END AS z0, CASE WHEN reason IS NULL THEN CAST(least(zh, 120000) AS INTEGER) END AS z1 FROM w)"""
VOXELS = """v AS (SELECT row_id, x, y, z, ((e1x * ox + e1y * oy) ** 2 + (e2x * ox + e2y * oy + e2z * oz) ** 2) / radians(0.02) ** 2 + (zeta * ((z + 0.5) * 0.1 - deg) / 0.05) ** 2 <= 9 AS front
  FROM (SELECT *, ((x + 0.5) * 0.2 - 100) / n - ux AS ox, (75 - (y + 0.5) * 0.2) / n - uy AS oy, -250 / n - uz AS oz FROM (SELECT *, sqrt(((x + 0.5) * 0.2 - 100) ** 2 + (75 - (y + 0.5) * 0.2) ** 2 + 62500) AS n
    FROM (SELECT row_id, e1x, e1y, e2x, e2y, e2z, ux, uy, uz, zeta, deg, x, y, unnest(range(z0, z1)) AS z FROM (SELECT * EXCLUDE (x, y), x, unnest(range(y0, y1)) AS y FROM (SELECT * EXCLUDE (x, y), y, unnest(range(x0, x1)) AS x FROM boxes WHERE reason IS NULL))))))"""


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as predicted reflections, one for each order and number."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"), F.struct(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp")).alias("p"))
    own = rows.groupBy("ord", "line").agg(F.min("p").alias("p")).withColumn("deg", (F.col("ord") % 50000) * 0.2 + F.col("line") * 0.03)
    x, y = F.col("p.part") % 200 + 0.25, F.col("p.supp") % 150 + 0.5
    length = F.sqrt((x - 100) * (x - 100) + (75 - y) * (75 - y) + 62500) * 0.9
    return own.select((F.col("ord") * 8 + F.col("line")).alias("row_id"), F.lit(0).alias("id"), F.lit(0).alias("panel"), ((x - 100) / length).alias("s1_x"), ((75 - y) / length).alias("s1_y"), (-250 / length).alias("s1_z"), F.radians("deg").alias("phi"), (x / 0.2).alias("px"), (y / 0.2).alias("py"))


@query(f"WITH {PLACED} SELECT row_id, round(zeta, 8) AS zeta, x0, x1, y0, y1, z0, z1, reason FROM boxes")
def reflection_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shoeboxes.reflection_boxes(predictions(spark, sf_dir), {0: EXPERIMENT}, WIDTHS)
    return out.select("row_id", near(F.col("zeta"), 8).alias("zeta"), *shoeboxes.BOX, "reason")


@query(f"""
WITH {PLACED}, {VOXELS}, o AS (SELECT DISTINCT a.row_id, a.x, a.y, a.z FROM v a JOIN v b ON a.x = b.x AND a.y = b.y AND a.z = b.z AND a.row_id <> b.row_id AND b.front)
SELECT v.row_id, count(*) AS voxels, CAST(sum(front::INT) AS BIGINT) AS foreground, CAST(sum((o.row_id IS NOT NULL)::INT) AS BIGINT) AS overlapped, CAST(sum((front AND o.row_id IS NOT NULL)::INT) AS BIGINT) AS both
FROM v LEFT JOIN o ON v.row_id = o.row_id AND v.x = o.x AND v.y = o.y AND v.z = o.z GROUP BY 1
""")
def neighbour_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Voxels of each box, those in its foreground, and those in a neighbour's."""
    boxes = written(shoeboxes.reflection_boxes(predictions(spark, sf_dir).drop("px", "py"), {0: EXPERIMENT}, WIDTHS))
    return counted(shoeboxes.neighbour_masks(boxes, {0: EXPERIMENT}, WIDTHS))


def counted(masks: DataFrame) -> DataFrame:
    # bytes of a mask as hexadecimal digits, two a voxel: 5 and 3 are fore- and background, 25 and 23 overlapped
    digits = F.hex("mask")
    times = lambda what: (F.length(F.regexp_replace(digits, f"(?:(?!{what})..)|({what})", "$1")) / 2).cast("long")
    return masks.select("row_id", (F.length(digits) / 2).cast("long").alias("voxels"), times(".5").alias("foreground"), times("2.").alias("overlapped"), times("25").alias("both"))


@query(f"""
WITH {PLACED}, m AS (SELECT DISTINCT s_suppkey * 7 % 1000 AS x, s_suppkey * 13 % 750 AS y FROM supplier UNION SELECT c_custkey % 1000, c_custkey * 3 % 750 FROM customer)
SELECT row_id, EXISTS (SELECT 1 FROM m WHERE m.x = floor(p.x / 0.2) AND m.y = floor(p.y / 0.2)) OR p.x / 0.2 >= 1000 OR p.y / 0.2 >= 750 AS unobservable FROM p
""")
def unobservable_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    bad = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") * 7 % 1000).alias("x"), (F.col("s_suppkey") * 13 % 750).alias("y")).union(table(spark, sf_dir, "customer").select(F.col("c_custkey") % 1000, F.col("c_custkey") * 3 % 750))
    out = shoeboxes.unobservable(predictions(spark, sf_dir), bad.withColumn("panel", F.lit(0)), F.col("px"), F.col("py"), F.lit(1000), F.lit(750))
    return out.select("row_id", "unobservable")


TRIED = [0.12, 0.2, 0.28, 0.29, 0.3, 0.4, 0.7, 1.1]


def below(x: str) -> str:
    """The normal distribution function as geometry has it."""
    close = f"least(abs({x}), 7.07::DOUBLE)"
    tail = f"(exp(least(abs({x}), 38) ** 2 / -2) * {horner(geometry.TAIL_TOP, close)} / {horner(geometry.TAIL_BOTTOM, close)})"
    return f"CASE WHEN {x} > 0 THEN 1 - {tail} ELSE {tail} END"


@query(f"""
WITH l AS (SELECT 0.1 + (l_partkey % 90) / 100.0::DOUBLE AS zeta, radians((l_quantity - 25.5) * 0.02) / (0.1 + (l_partkey % 90) / 100.0::DOUBLE) AS delta FROM lineitem),
t AS (SELECT sigma, (delta + radians(0.05)) * zeta / radians(sigma) AS hi, (delta - radians(0.05)) * zeta / radians(sigma) AS lo FROM l, (SELECT unnest({TRIED})::DOUBLE AS sigma)),
s AS (SELECT sigma, sum(ln(greatest(({below("hi")} - {below("lo")}) / radians(0.1), 1e-300))) AS total FROM t GROUP BY 1)
SELECT sigma, round(total, 2) AS log_likelihood, total = (SELECT max(total) FROM s) AS best FROM s
""")
def range_likelihoods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How likely widths along the rotation make the samples of all order lines."""
    zeta = 0.1 + F.col("l_partkey") % 90 / 100.0
    samples = table(spark, sf_dir, "lineitem").select((F.radians((F.col("l_quantity") - 25.5) * 0.02) / zeta).alias("delta"), zeta.alias("zeta"), F.lit(1.0).alias("counts"))
    found = checkpoint(shoeboxes.range_likelihoods(samples, 0.1, TRIED))
    top = F.broadcast(found.agg(F.max("log_likelihood").alias("top")))  # one row
    sigma = F.element_at(F.array(*(F.lit(v) for v in TRIED)), F.col("nth") + 1)
    return found.join(top).select(sigma.alias("sigma"), F.round("log_likelihood", 2).alias("log_likelihood"), (F.col("log_likelihood") == F.col("top")).alias("best"))


# Orders in threes on one panel each, 2.2 pixels apart, so that their foregrounds touch; each has a flat background of 3.
STEP, LONG, HIGH, BACK = 2.2, 9, 7, 3.0


@query("SELECT o_orderkey AS row_id, round(o_totalprice, 2) AS intensity, count(*) OVER (PARTITION BY o_orderkey // 3) > 1 AS together FROM orders")
def joint_intensities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intensities of touching spots without noise: what was put in comes out."""
    boxes = written(touching_spots(spark, sf_dir))
    out = fits.fitted_intensities(boxes, ["panel"])
    return out.select("row_id", F.round("intensity", 2).alias("intensity"), F.col("component").isNotNull().alias("together"))


def touching_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of 9 x 7 pixels on one image, with what a spot and its mates put there; a spot is a Gaussian out to some 2.4 sigmas, of sum 1."""
    panel, nth = F.expr("o_orderkey DIV 3"), (F.col("o_orderkey") % 3).cast("int")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), panel.alias("panel"), nth.alias("nth"), F.col("o_totalprice").alias("planted"))
    mates = orders.groupBy("panel").agg(*(F.coalesce(F.sum(F.when(F.col("nth") == k, F.col("planted"))), F.lit(0.0)).alias(f"i{k}") for k in range(3)))
    low = [int(STEP * k) for k in range(3)]

    def spot(of: int, box: int) -> np.ndarray:
        """Spot `of` of a panel on the pixels of box `box`; it ends where its own box does."""
        y, x = (v.ravel() for v in np.mgrid[:HIGH, :LONG])
        x = x + low[box]
        raw = np.exp(-((x + 0.5 - LONG / 2 - STEP * of) ** 2 + (y + 0.5 - HIGH / 2) ** 2) / 2)
        return np.where((raw > 0.06) & (x >= low[of]) & (x < low[of] + LONG), raw, 0.0)

    sums = [spot(k, k).sum() for k in range(3)]
    parts = np.array([[spot(of, box) / sums[of] for of in range(3)] for box in range(3)])  # box, spot, pixel

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, k = batch.num_rows, batch.column("nth").to_numpy()
            strengths = np.stack([batch.column(f"i{j}").to_numpy() for j in range(3)], axis=1)
            pixels = BACK + np.einsum("ij,ijp->ip", strengths, parts[k])
            own = parts[k, k]
            lists = [pa.array([*v], type=pa.list_(pa.float64())) for v in (pixels, np.full_like(pixels, BACK), own)]
            masks = [m.tobytes() for m in np.where(own > 0, shoeboxes.VALID | shoeboxes.FOREGROUND, shoeboxes.VALID | shoeboxes.BACKGROUND).astype(np.uint8)]
            x0 = np.array(low)[k]
            ends = [pa.array(np.broadcast_to(v, n).astype(np.int32)) for v in (x0, x0 + LONG, 0, HIGH, 0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), batch.column("panel"), *ends, *lists, pa.array(masks, type=pa.binary())], names=["row_id", "panel", *shoeboxes.BOX, "pixels", "background", "profile", "mask"])

    rows = orders.join(mates, "panel").select("row_id", "panel", "nth", "i0", "i1", "i2")
    return rows.mapInArrow(run, f"row_id long, panel long, {', '.join(f'{c} int' for c in shoeboxes.BOX)}, pixels array<double>, background array<double>, profile array<double>, mask binary")
