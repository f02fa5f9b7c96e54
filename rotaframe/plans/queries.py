"""Operators applied to the driver's tables, each with the SQL that says the same.

Prices are taken in whole cents and quantities as whole numbers, so sums are
exact in any order and both engines divide the same numbers.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaframe.functions import geometry
from rotaframe.operators import images, joins, merging, selection, symmetry, windows

from . import scaling
from .registry import query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cents(column: str):
    return F.round(F.col(column) * 100).cast("long")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations: group part, value cents, weight quantity, shell by price."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supp"), F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"),
        cents("l_extendedprice").alias("x"), F.col("l_quantity").cast("long").alias("w"), F.round(F.col("l_discount") * 100).cast("long").alias("disc"),
        "l_returnflag", "l_linestatus", "l_shipdate",
    )


LINES = """SELECT l_partkey AS part, l_suppkey AS supp, l_orderkey AS ord, l_linenumber AS line, CAST(round(l_extendedprice * 100) AS BIGINT) AS x,
  CAST(l_quantity AS BIGINT) AS w, CAST(round(l_discount * 100) AS BIGINT) AS disc, l_returnflag, l_linestatus, l_shipdate FROM lineitem"""


@query(f"""
WITH li AS ({LINES}), s AS (SELECT part, x, CAST(part % 5 AS INTEGER) AS shell FROM li),
g AS (SELECT part, shell, count(*) AS n, CAST(sum(x) AS DOUBLE) / count(*) AS m, CAST(sum(x) AS DOUBLE) AS total FROM s GROUP BY 1, 2),
o AS (SELECT g.part, g.shell, g.n, g.total, sum(abs(s.x - g.m)) AS off FROM s JOIN g ON s.part = g.part GROUP BY 1, 2, 3, 4)
SELECT shell, CAST(sum(n) AS BIGINT) AS observations, count(*) AS "unique",
  round(sum(CASE WHEN n > 1 THEN off END) / sum(CASE WHEN n > 1 THEN total END), 8) AS r_merge,
  round(sum(CASE WHEN n > 1 THEN off * sqrt(n / (n - 1.0::DOUBLE)) END) / sum(CASE WHEN n > 1 THEN total END), 8) AS r_meas,
  round(sum(CASE WHEN n > 1 THEN off * sqrt(1 / (n - 1.0::DOUBLE)) END) / sum(CASE WHEN n > 1 THEN total END), 8) AS r_pim,
  round(CAST(sum(n) AS DOUBLE) / count(*), 8) AS multiplicity
FROM o GROUP BY ROLLUP (shell)
""")
def merging_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem(spark, sf_dir).withColumn("shell", (F.col("part") % 5).cast("int"))
    out = merging.agreement(rows, ["part"], "x", ["shell"])
    return out.select("shell", "observations", "unique", *(F.round(c, 8).alias(c) for c in ("r_merge", "r_meas", "r_pim", "multiplicity")))


@query(f"""
WITH li AS ({LINES}), s AS (SELECT part, count(*) AS n, CAST(sum(w) AS DOUBLE) AS sw, CAST(sum(w * w) AS DOUBLE) AS sw2, CAST(sum(w * x) AS DOUBLE) / CAST(sum(w) AS DOUBLE) AS mean FROM li GROUP BY 1),
o AS (SELECT li.part, sum(w * (x - mean) * (x - mean)) AS off FROM li JOIN s ON li.part = s.part GROUP BY 1)
SELECT part, n, round(mean, 4) AS mean, round(CASE WHEN n = 1 THEN sqrt(1 / sw) ELSE sqrt(greatest(sw / (sw * sw - sw2) * off / n, 1 / sw)) END, 2) AS sigma FROM s JOIN o USING (part)
""")
def merged_with_sigma(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem(spark, sf_dir)
    out = merging.merged_with_sigma(rows, ["part"], "x", "w")
    return out.select("part", "n", F.round("mean", 4).alias("mean"), F.round("sigma", 2).alias("sigma"))


@query(f"""
WITH li AS ({LINES}) SELECT part, round(CAST(sum(w * (disc + 1) * x) AS DOUBLE) / CAST(sum(w * (disc + 1) * (disc + 1)) AS DOUBLE), 4) AS merged, count(*) AS n FROM li GROUP BY 1
""")
def merged_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem(spark, sf_dir).select("part", "x", (F.lit(1.0) / F.col("w")).alias("v"), (F.col("disc") + 1).alias("g"))
    return merging.merged_scaled(rows, ["part"], "x", "v", "g").select("part", F.round("merged", 4).alias("merged"), "n")


@query(f"""
WITH li AS ({LINES}), h AS (SELECT part, x, row_number() OVER (PARTITION BY part ORDER BY ord, line, supp, x, l_shipdate) % 2 AS half FROM li),
g AS (SELECT part, avg(CASE WHEN half = 1 THEN x END) AS a, avg(CASE WHEN half = 0 THEN x END) AS b FROM h GROUP BY 1)
SELECT CAST(part % 5 AS INTEGER) AS shell, count(*) AS groups, round(CASE WHEN count(*) >= 3 THEN coalesce(corr(a, b), 0) ELSE 0 END, 7) AS cc_half FROM g WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1
""")
def cc_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    halves = merging.half_sets(lineitem(spark, sf_dir), ["part"], "x", F.struct("ord", "line", "supp", "x", "l_shipdate"))
    out = merging.correlation_of_halves(halves.withColumn("shell", (F.col("part") % 5).cast("int")), ["shell"])
    return out.select("shell", "groups", F.round("cc_half", 7).alias("cc_half"))


@query("""
WITH n AS (SELECT o_totalprice AS x, o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rn, count(*) OVER () AS nr FROM orders),
s AS (SELECT *, greatest(10, nr // 50) AS size FROM n), b AS (SELECT x, least(rn // size, greatest(nr // size - CASE WHEN nr % size < size // 2 THEN 1 ELSE 0 END, 0)) AS bin FROM s)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, min(x) AS low, max(x) AS high FROM b GROUP BY 1
""")
def equal_count_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = merging.equal_count_bins(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), [F.desc("o_totalprice"), F.asc("o_orderkey")])
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


@query(f"""
WITH li AS ({LINES}), s AS (SELECT part, disc, x, w, count(*) OVER g AS n, sum(w) OVER g AS sw, sum(w * x) OVER g AS swx FROM li WINDOW g AS (PARTITION BY part))
SELECT disc, count(*) AS n, round(avg(x / (CAST(swx - w * x AS DOUBLE) / CAST(sw - w AS DOUBLE))), 7) AS bias FROM s WHERE n > 1 GROUP BY 1
""")
def leave_one_out_bias(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = windows.leave_one_out(lineitem(spark, sf_dir).select("part", "disc", "x", "w"), ["part"], "x", "w").filter("others IS NOT NULL")
    return rows.groupBy("disc").agg(F.count("*").alias("n"), F.round(F.avg(F.col("x") / F.col("others")), 7).alias("bias"))


@query()
def reject_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem(spark, sf_dir).select("part", F.struct("ord", "line", "supp", "x").alias("s"), "x", F.lit(8.0e12).alias("v"))
    rows = rows.select("part", F.xxhash64("s").alias("row_id"), F.col("x").cast("double").alias("x"), "v")
    return windows.reject_outliers(rows, ["part"], "row_id", "x", "v", limit=2.0)


@query(f"""
WITH li AS ({LINES}), p AS (SELECT ord AS id, supp % 3 AS partial_id, part * 64 + line * 8 + supp % 8 AS row_id, w * 0.02::DOUBLE AS p, CAST(CASE WHEN disc = 0 THEN 0 ELSE x END AS DOUBLE) AS i, CAST(w AS DOUBLE) AS v, CAST(x AS DOUBLE) AS s, l_returnflag <> 'R' AS wanted FROM li),
q AS (SELECT *, wanted AND p < 0.99 AS piece FROM p), g AS (SELECT id, partial_id, count(*) AS n, min(row_id) AS first, sum(i * i / v) AS wt, sum(i * i / v * i) AS wi, sum(i * i / v * v) AS wv, sum(v) AS v, sum(s) AS s, sum(p) AS p FROM q WHERE piece GROUP BY 1, 2 HAVING count(*) >= 2)
SELECT id, partial_id, row_id, 1 AS pieces, i AS i_prf, v AS v_prf, s AS i_sum, v AS v_sum, round(p, 6) AS partiality FROM q WHERE NOT piece OR NOT EXISTS (SELECT 1 FROM g WHERE g.id = q.id AND g.partial_id = q.partial_id)
UNION ALL SELECT id, partial_id, first, n, round(CASE WHEN wt > 0 THEN wi / wt ELSE 0 END, 4), round(CASE WHEN wt > 0 THEN wv / wt ELSE v END, 6), s, v, round(p, 6) FROM g
""")
def combine_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem(spark, sf_dir).select(
        F.col("ord").alias("id"), (F.col("supp") % 3).alias("partial_id"), (F.col("part") * 64 + F.col("line") * 8 + F.col("supp") % 8).alias("row_id"), (F.col("w") * 0.02).alias("partiality"),
        F.when(F.col("disc") == 0, 0).otherwise(F.col("x")).cast("double").alias("i_prf"), F.col("w").cast("double").alias("v_prf"), F.col("x").cast("double").alias("i_sum"), F.col("w").cast("double").alias("v_sum"), (F.col("l_returnflag") != "R").alias("wanted"),
    )
    out = merging.combine_partials(rows, ["id", "partial_id"], wanted=F.col("wanted"))
    return out.select("id", "partial_id", "row_id", "pieces", F.round("i_prf", 4).alias("i_prf"), F.round("v_prf", 6).alias("v_prf"), "i_sum", "v_sum", F.round("partiality", 6).alias("partiality"))


@query("""
WITH a AS (SELECT o_custkey AS k, o_orderkey AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders WHERE o_orderstatus = 'F'),
b AS (SELECT o_custkey AS k, o_orderkey AS b, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rank FROM orders WHERE o_orderstatus = 'O')
SELECT k, rank, a, b FROM a JOIN b USING (k, rank)
""")
def keyed_rank_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderdate", "o_orderkey", "o_orderstatus")
    out = joins.keyed_rank_join(o.filter("o_orderstatus = 'F'"), o.filter("o_orderstatus = 'O'"), ["k"], ["o_orderdate", "o_orderkey"])
    return out.select("k", F.col("rank").cast("long").alias("rank"), F.col("o_orderkey").alias("a"), F.col("o_orderkey_r").alias("b"))


def micros(column: str):
    """Microseconds from 1970, whatever the session's time zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {column})")


@query("""
WITH e AS (SELECT event_id, user_id, epoch_us(ts) AS t, event_type FROM events), p AS (SELECT a.event_id AS a, b.event_id AS b, abs(a.t - b.t) AS distance,
  row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.t - b.t), b.event_id) AS rn FROM e a JOIN e b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'error')
SELECT a, b, distance FROM p WHERE rn = 1
""")
def nearest_crossing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", micros("ts").alias("t"), "event_type")
    out = joins.nearest_by_key(e.filter("event_type = 'click'").drop("event_type"), e.filter("event_type = 'error'").drop("event_type"), ["user_id"], "t", "event_id", "event_id")
    return out.select(F.col("event_id").alias("a"), F.col("event_id_r").alias("b"), "distance")


@query()
def observation_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", micros("ts").alias("t"), "event_type")
    return joins.greedy_pairs(e.filter("event_type = 'click'"), e.filter("event_type = 'error'"), ["user_id"], "t", "event_id", 3600e6)


@query("""
SELECT CAST(c_nationkey % 5 AS INTEGER) AS shell, count(*) AS predicted, CAST(sum(CASE WHEN n > 0 AND c_acctbal >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS seen,
  CAST(sum(CASE WHEN n IS NULL AND c_acctbal >= 0 THEN 1 ELSE 0 END) AS BIGINT) AS unseen, CAST(sum(CASE WHEN c_acctbal < 0 THEN 1 ELSE 0 END) AS BIGINT) AS unobservable
FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey GROUP BY 1
""")
def seen_and_unseen(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf_dir, "customer").join(seen, "c_custkey", "left").withColumn("shell", (F.col("c_nationkey") % 5).cast("int"))
    could, count = F.col("c_acctbal") >= 0, lambda c: F.sum(c.cast("long"))
    return rows.groupBy("shell").agg(F.count("*").alias("predicted"), count(could & F.col("n").isNotNull()).alias("seen"), count(could & F.col("n").isNull()).alias("unseen"), count(~could).alias("unobservable"))


VECTORS = "SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z FROM embeddings"


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), *(F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate("xyz")))


@query(f"""
WITH v AS ({VECTORS}), p AS (SELECT a.id AS a, b.id AS b, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM v a JOIN v b ON a.id % 2 = 0 AND b.id % 2 = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY d2, b) AS ra, row_number() OVER (PARTITION BY b ORDER BY d2, a) AS rb FROM p WHERE d2 <= 0.05 * 0.05)
SELECT a AS left_id, b AS right_id FROM r WHERE ra = 1 AND rb = 1
""")
def mutual_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return joins.mutual_nearest(v.filter("id % 2 = 0"), v.filter("id % 2 = 1"), ["x", "y", "z"], 0.05, "id").select("left_id", "right_id")


@query(f"""
WITH v AS ({VECTORS}), p AS (SELECT a.id, (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) + (a.z - b.z) * (a.z - b.z) AS d2 FROM v a JOIN v b ON a.id <> b.id AND a.id % 3 = b.id % 3)
SELECT id, round(sqrt(min(d2)), 9) AS distance FROM p WHERE d2 <= 0.1 * 0.1 AND d2 > 1e-8 GROUP BY 1
""")
def nearest_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).withColumn("block", F.col("id") % 3)
    return joins.nearest_neighbour(v, ["x", "y", "z"], 0.1, ["block"], "id").select("id", F.round("distance", 9).alias("distance"))


@query(f"""
WITH li AS ({LINES}), m AS (SELECT part % 50 AS h, supp % 20 AS k, CAST(sum(x) AS BIGINT) AS x FROM li GROUP BY 1, 2)
SELECT a.h, a.k, a.x, b.x AS x_mate FROM m a JOIN m b ON b.h = a.k AND b.k = a.h WHERE NOT (a.h = a.k)
""")
def symmetry_mates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lineitem(spark, sf_dir).groupBy((F.col("part") % 50).alias("h"), (F.col("supp") % 20).alias("k")).agg(F.sum("x").alias("x"))
    return joins.symmetry_mates(m, ["h", "k"], [F.col("k"), F.col("h")], "x")


@query(f"""
WITH li AS ({LINES}), m AS (SELECT supp % 20 AS ds, part % 40 AS h, sum(x) // 100000 AS x, CAST(count(*) AS DOUBLE) AS v FROM li GROUP BY 1, 2),
p AS (SELECT a.ds AS ds_a, b.ds AS ds_b, 1 / (a.v + b.v) AS w, CAST(a.x AS DOUBLE) AS x, CAST(b.x AS DOUBLE) AS y FROM m a JOIN m b ON a.h = b.h AND a.ds < b.ds),
s AS (SELECT ds_a, ds_b, count(*) AS n, sum(w) AS sw, sum(w * w) AS sw2, sum(w * x) AS sx, sum(w * y) AS sy, sum(w * x * x) AS sxx, sum(w * y * y) AS syy, sum(w * x * y) AS sxy FROM p GROUP BY 1, 2)
SELECT ds_a, ds_b, n, round((sxy - sx * sy / sw) / sqrt((sxx - sx * sx / sw) * (syy - sy * sy / sw)), 5) AS cc, round(sw * sw / sw2, 5) AS n_eff FROM s WHERE n >= 3
""")
def pair_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lineitem(spark, sf_dir).groupBy((F.col("supp") % 20).alias("ds"), (F.col("part") % 40).alias("h")).agg(F.floor(F.sum("x") / 100000).cast("double").alias("x"), F.count("*").cast("double").alias("v"))
    out = merging.pair_correlations(m, "ds", ["h"], "x", "v")
    return out.select("ds_a", "ds_b", "n", F.round("cc", 5).alias("cc"), F.round("n_eff", 5).alias("n_eff"))


BOXES = "SELECT event_id AS id, user_id, epoch_us(ts) // 60000000 AS t0, epoch_us(ts) // 60000000 + 1 + event_id % 90 AS t1 FROM events"


@query(f"WITH b AS ({BOXES}) SELECT x.id AS a, y.id AS b FROM b x JOIN b y ON x.user_id = y.user_id AND x.id < y.id AND x.t0 < y.t1 AND y.t0 < x.t1")
def tile_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    t0 = F.floor(micros("ts") / 60000000)
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", t0.alias("t0"), (t0 + 1 + F.col("event_id") % 90).alias("t1"))
    return joins.overlaps(e, "id", [("t0", "t1")], [64], ["user_id"]).select("a", "b")


@query("""
WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS t, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) > 3600000000 THEN 1 ELSE 0 END AS fresh FROM events),
c AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS chain FROM e)
SELECT user_id, CAST(chain AS BIGINT) AS chain, count(*) AS n, min(event_id) AS first_id, max(t) - min(t) AS length FROM c GROUP BY 1, 2
""")
def components_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", micros("ts").alias("t"))
    c = windows.chains(e, ["user_id"], "t", "event_id", 3600e6)
    return c.groupBy("user_id", "chain").agg(F.count("*").alias("n"), F.min("event_id").alias("first_id"), (F.max("t") - F.min("t")).alias("length"))


@query("""
WITH RECURSIVE e AS (SELECT o_orderkey AS a, -1 - o_custkey AS b FROM orders),
u AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r AS (SELECT a AS node, a AS seen FROM u UNION SELECT r.node, u.b FROM r JOIN u ON u.a = r.seen)
SELECT node, min(seen) AS component FROM r GROUP BY 1
""")
def connected_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders and their customers, those with numbers below 0."""
    e = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("a"), (-1 - F.col("o_custkey")).alias("b"))
    return joins.connected_components(e, "a", "b")


@query("""
WITH k AS (SELECT user_id, count(DISTINCT epoch_us(ts) // 86400000000) AS seen FROM events GROUP BY 1), f AS (SELECT count(DISTINCT epoch_us(ts) // 86400000000) AS n FROM events)
SELECT user_id, seen FROM k, f WHERE seen >= n * 0.5 AND seen >= 2
""")
def frequent_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", F.floor(micros("ts") / 86400000000))
    return selection.frequent_keys(e, ["user_id"], "day", 0.5)


@query("""
WITH r AS (SELECT l_returnflag, rank() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_returnflag, l_extendedprice) - 1) / 2.0::DOUBLE AS a,
  rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS b FROM lineitem)
SELECT l_returnflag, count(*) AS n, round(corr(a, b), 8) AS rho FROM r GROUP BY 1
""")
def spearman(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.spearman(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice", "l_quantity"), ["l_returnflag"], "l_extendedprice", "l_quantity")
    return out.select("l_returnflag", "n", F.round("rho", 8).alias("rho"))


@query(f"""
WITH li AS ({LINES}), r AS (SELECT disc AS bin, CAST(w AS DOUBLE) AS a, CAST(x AS DOUBLE) AS b, x / CAST(w AS DOUBLE) AS ratio FROM li),
m AS (SELECT bin, count(*) AS n, quantile_cont(a, 0.5) AS median_x, quantile_cont(ratio, 0.5) AS median_ratio, corr(a, b) AS pearson FROM r GROUP BY 1),
o AS (SELECT r.bin, abs(ratio - median_ratio) AS d FROM r JOIN m ON r.bin = m.bin), s AS (SELECT bin, quantile_cont(d, 0.5) * 1.4826::DOUBLE AS spread FROM o GROUP BY 1),
c AS (SELECT o.bin, sum(CASE WHEN d > greatest(5 * spread, 0.05) THEN 1 ELSE 0 END) AS outliers FROM o JOIN s ON o.bin = s.bin GROUP BY 1),
k AS (SELECT bin, rank() OVER (PARTITION BY bin ORDER BY a) + (count(*) OVER (PARTITION BY bin, a) - 1) / 2.0::DOUBLE AS ra, rank() OVER (PARTITION BY bin ORDER BY b) + (count(*) OVER (PARTITION BY bin, b) - 1) / 2.0::DOUBLE AS rb FROM r),
p AS (SELECT bin, corr(ra, rb) AS spearman FROM k GROUP BY 1)
SELECT m.bin, round(spearman, 8) AS spearman, n, median_x, round(median_ratio, 5) AS median_ratio, round(pearson, 8) AS pearson, round(spread, 4) AS spread, CAST(outliers AS BIGINT) AS outliers FROM m JOIN s ON m.bin = s.bin JOIN c ON m.bin = c.bin JOIN p ON m.bin = p.bin
""")
def trend_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lineitem(spark, sf_dir).select(F.col("disc").alias("bin"), F.col("w").cast("double").alias("a"), F.col("x").cast("double").alias("b"))
    out = windows.trend_table(rows, "a", "b")
    return out.select("bin", "n", "median_x", F.round("median_ratio", 5).alias("median_ratio"), F.round("pearson", 8).alias("pearson"), F.round("spearman", 8).alias("spearman"), F.round("spread", 4).alias("spread"), "outliers")


# Each flag is set by its own remainder of the part, in SQL and by the operator.
FLAG_SQL = " + ".join(f"CASE WHEN (l_partkey + l_suppkey) % {k + 2} = 0 THEN {1 << bit} ELSE 0 END" for k, bit in enumerate(selection.FLAGS.values()))


@query(f"""
WITH f AS (SELECT l_linenumber AS id, ({FLAG_SQL})::BIGINT AS flags FROM lineitem)
SELECT id, count(*) AS rows, {", ".join(f"CAST(sum(CASE WHEN flags & {1 << bit} <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS {name}" for name, bit in selection.FLAGS.items())} FROM f GROUP BY 1
""")
def flag_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("id"), F.lit(0).cast("long").alias("flags"), (F.col("l_partkey") + F.col("l_suppkey")).alias("_by"))
    for k, name in enumerate(selection.FLAGS):
        rows = rows.withColumn("flags", selection.set_flag(name, F.col("_by") % (k + 2) == 0))
    return selection.flag_counts(rows, "id")


@query("""
WITH r AS (SELECT i * 40 AS low, i * 40 + 9 AS high FROM range(0, 60) t(i))
SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM r WHERE epoch_us(o_orderdate) // 86400000000 - 9000 BETWEEN low AND high)
""")
def range_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranges = spark.range(60).select((F.col("id") * 40).alias("low"), (F.col("id") * 40 + 9).alias("high"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.floor(micros("o_orderdate") / 86400000000) - 9000).alias("day"))
    return joins.outside_ranges(rows, ranges, "day", "low", "high", 20).select("o_orderkey")


@query("""
SELECT s_suppkey AS id, s_nationkey AS nation FROM supplier UNION ALL
SELECT c_custkey + (SELECT max(s_suppkey) + 1 FROM supplier), c_nationkey FROM customer
""")
def combine_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("only_a"))
    b = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("only_b"))
    return joins.combine_runs([a, b], "id")[0].select("id", "nation")


@query("SELECT n_nationkey AS k, n_name AS name FROM nation UNION ALL SELECT r_regionkey, r_name FROM region")
def checked_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    return joins.checked_union(a, table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name")))


@query("SELECT o_orderkey, abs(o_totalprice - 250000) AS badness FROM orders ORDER BY badness DESC, o_orderkey LIMIT 25")
def worst_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.worst(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.abs(F.col("o_totalprice") - 250000), "o_orderkey", 25).select("o_orderkey", "badness")


@query("""
WITH s AS (SELECT l_partkey AS part, count(*) AS n, ('0x' || substr(md5(CAST(l_partkey AS VARCHAR)), 1, 15))::BIGINT AS h FROM lineitem GROUP BY 1 HAVING count(*) > 1),
b AS (SELECT *, count(*) OVER w - 1 AS g, sum(n) OVER w - n AS o FROM s WINDOW w AS (ORDER BY h, part))
SELECT l_partkey AS part, l_orderkey, l_linenumber FROM lineitem JOIN b ON part = l_partkey WHERE g < 100 OR o < 2000
""")
def sample_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), "l_orderkey", "l_linenumber")
    return selection.sample_groups(rows, ["part"], "l_orderkey", 100, 2000)


@query("""
WITH c AS (SELECT least(CAST(floor(o_totalprice / 500000 * 60) AS BIGINT), 59) AS "column", count(*) AS n FROM orders WHERE o_totalprice BETWEEN 0 AND 500000 GROUP BY 1)
SELECT i AS "column", coalesce(n, 0) AS n FROM range(0, 60) t(i) LEFT JOIN c ON c."column" = i
""")
def histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.histogram(table(spark, sf_dir, "orders"), "o_totalprice", 0.0, 500000.0, 60)


@query("SELECT l_linenumber AS frame, max(l_extendedprice) AS largest FROM lineitem WHERE l_quantity < 50 GROUP BY 1")
def largest_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").filter("l_quantity < 50").groupBy(F.col("l_linenumber").alias("frame")).agg(F.max("l_extendedprice").alias("largest"))


@query(f"""
WITH li AS ({LINES}), m AS (SELECT disc AS shell, avg(x) AS m FROM li GROUP BY 1), z AS (SELECT x / m AS z FROM li JOIN m ON li.disc = m.shell)
SELECT count(*) AS n, round(avg(abs(z - 1)), 8) AS mean_abs_e2, round(avg(z * z), 8) AS moment_2, {", ".join(f"round(avg(CASE WHEN z <= {k} / 10.0::DOUBLE THEN 1.0::DOUBLE ELSE 0 END), 8) AS n_{k}" for k in range(1, 11))} FROM z
""")
def intensity_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merging.intensity_moments(lineitem(spark, sf_dir).select(F.col("disc").alias("shell"), "x"), "shell", "x")
    return out.select("n", *(F.round(c, 8).alias(c) for c in ("mean_abs_e2", "moment_2", *(f"n_{k}" for k in range(1, 11)))))


@query(f"""
WITH li AS ({LINES}), m AS (SELECT part % 30 AS h, supp % 30 AS k, CAST(sum(x) AS DOUBLE) AS x FROM li GROUP BY 1, 2), f AS (SELECT h, k, x FROM m WHERE (h + k) % 2 = 0),
i AS (SELECT 'h,k' AS operator, h, k, x FROM m UNION ALL SELECT 'k,h', k, h, x FROM m UNION ALL SELECT '29-h,k', 29 - h, k, x FROM m),
r AS (SELECT operator, row_number() OVER (PARTITION BY operator ORDER BY f.x, f.h, f.k) AS a, row_number() OVER (PARTITION BY operator ORDER BY i.x, f.h, f.k) AS b FROM f JOIN i ON f.h = i.h AND f.k = i.k),
c AS (SELECT operator, count(*) AS common, corr(a, b) AS cc FROM r GROUP BY 1 HAVING count(*) >= 10)
SELECT operator, common, round(cc, 7) AS cc, operator = (SELECT operator FROM c ORDER BY coalesce(cc, -2) DESC, operator = 'h,k' DESC, operator DESC LIMIT 1) AS chosen FROM c
""")
def best_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = lineitem(spark, sf_dir).groupBy((F.col("part") % 30).alias("h"), (F.col("supp") % 30).alias("k")).agg(F.sum("x").cast("double").alias("x"))
    h, k = F.col("h"), F.col("k")
    out = joins.best_operator(m.filter((h + k) % 2 == 0), m, ["h", "k"], {"h,k": [h, k], "k,h": [k, h], "29-h,k": [29 - h, k]}, "x", "h,k")
    return out.select("operator", "common", F.round("cc", 7).alias("cc"), "chosen")


@query("SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 48 INTERSECT SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount > 0.08")
def common_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.filter("l_quantity > 48").select(F.col("l_partkey").alias("k")).intersect(li.filter("l_discount > 0.08").select("l_partkey"))


@query("SELECT DISTINCT l_partkey AS k FROM lineitem WHERE l_quantity > 48 EXCEPT SELECT DISTINCT l_partkey FROM lineitem WHERE l_discount > 0.08")
def unpartnered_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.filter("l_quantity > 48").select(F.col("l_partkey").alias("k")).distinct().exceptAll(li.filter("l_discount > 0.08").select("l_partkey").distinct())


@query("SELECT c_mktsegment AS sweep, quantile_cont(c_acctbal, 0.5) AS middle FROM customer GROUP BY 1")
def median_by_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("sweep")).agg(F.percentile("c_acctbal", 0.5).alias("middle"))


@query("""
WITH g AS (SELECT user_id, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY epoch_us(ts), event_id) AS gap FROM events)
SELECT user_id, count(gap) AS n, quantile_cont(gap, 0.5) AS turn FROM g WHERE gap IS NOT NULL GROUP BY 1
""")
def turn_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", micros("ts").alias("t"))
    return windows.gaps(e, ["user_id"], "t", "event_id").groupBy("user_id").agg(F.count("*").alias("n"), F.percentile("gap", 0.5).alias("turn"))


@query("SELECT o_orderkey FROM orders WHERE o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.5) FROM orders)")
def strong_half(spark: SparkSession, sf_dir: str) -> DataFrame:
    return selection.strong_half(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey")


@query("""
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'masked' WHEN c_mktsegment = 'BUILDING' THEN 'off the detector' ELSE 'unexplained' END AS reason
FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
""")
def explain_unpartnered(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return joins.explain_unpartnered(table(spark, sf_dir, "customer"), found, ["c_custkey"], "c_custkey", [("masked", F.col("c_acctbal") < 0), ("off the detector", F.col("c_mktsegment") == "BUILDING")], "unexplained")


@query("SELECT c_custkey, c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 2) AS has_crystal FROM customer")
def lattice_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    a, b = selection.split_by(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), models, "c_nationkey", F.col("n_regionkey") < 2)
    return a.select("c_custkey", F.lit(True).alias("has_crystal")).unionByName(b.select("c_custkey", F.lit(False).alias("has_crystal")))


@query("SELECT s_suppkey, s_nationkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def model_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    models = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    return joins.lookup(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), models, "s_nationkey")


@query("""
WITH u AS (SELECT DISTINCT l_partkey % 400 AS h, l_suppkey % 250 AS k FROM lineitem), p AS (SELECT a.i AS h, b.j AS k FROM range(0, 400) a(i), range(0, 250) b(j)),
x AS (SELECT CAST((p.h + p.k) // 16 AS INTEGER) AS shell, u.h IS NOT NULL AS seen FROM p LEFT JOIN u ON p.h = u.h AND p.k = u.k)
SELECT shell, count(*) AS possible, CAST(sum(CASE WHEN seen THEN 1 ELSE 0 END) AS BIGINT) AS seen, round(avg(CASE WHEN seen THEN 1.0::DOUBLE ELSE 0 END), 9) AS completeness FROM x GROUP BY ROLLUP (shell)
""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    shell = F.floor((F.col("h") + F.col("k")) / 16).cast("int").alias("shell")
    seen = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 400).alias("h"), (F.col("l_suppkey") % 250).alias("k")).distinct()
    possible = spark.range(400).withColumnRenamed("id", "h").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(249))))
    out = merging.completeness(seen.withColumn("shell", shell), possible.withColumn("shell", shell), "shell")
    return out.select("shell", "possible", "seen", F.round("completeness", 9).alias("completeness"))


@query("""
WITH i AS (SELECT CAST(l_partkey % 9 - 4 AS INTEGER) AS h, CAST(l_suppkey % 7 - 3 AS INTEGER) AS k, CAST(l_linenumber - 4 AS INTEGER) AS l FROM lineitem)
SELECT abs(h) AS h, abs(k) AS k, abs(l) AS l, count(*) AS n, CAST(sum(CASE WHEN h = 0 OR k = 0 OR l = 0 THEN 1 ELSE 0 END) AS BIGINT) AS centric,
  CAST(sum(CASE WHEN (h + k + l) % 2 <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS absent FROM i GROUP BY 1, 2, 3
""")
def symmetry_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    group = symmetry.SpaceGroup.of("222", "I")
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 9 - 4).cast("int").alias("h"), (F.col("l_suppkey") % 7 - 3).cast("int").alias("k"), (F.col("l_linenumber") - 4).alias("l"))
    own = rows.select(symmetry.unique_index(group).alias("u"), symmetry.is_centric(group).alias("c"), symmetry.is_absent(group).alias("a"))
    return own.groupBy("u.h", "u.k", "u.l").agg(F.count("*").alias("n"), F.sum(F.col("c").cast("long")).alias("centric"), F.sum(F.col("a").cast("long")).alias("absent"))


@query("""
WITH i AS (SELECT DISTINCT l_partkey % 9 AS h, l_suppkey % 7 AS k, l_linenumber AS l FROM lineitem)
SELECT h, k, l, k AS h2, h AS k2, -l AS l2 FROM i
""")
def reindexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 9).alias("h"), (F.col("l_suppkey") % 7).alias("k"), F.col("l_linenumber").alias("l")).distinct()
    out = rows.withColumns({"h2": F.col("h"), "k2": F.col("k"), "l2": F.col("l")})
    return symmetry.reindexed(out, ((0, 1, 0), (1, 0, 0), (0, 0, -1)), "h2", "k2", "l2")


@query("""
WITH p AS (SELECT p_partkey, p_size + 5.0::DOUBLE AS a, p_retailprice / 50 AS c, 1 + p_partkey % 4 AS h, p_partkey % 3 AS k, p_partkey % 5 AS l FROM part),
d AS (SELECT p_partkey, 1 / sqrt((4.0::DOUBLE / 3) * (h * h + h * k + k * k) / (a * a) + l * l / (c * c)) AS d FROM p)
SELECT p_partkey, round(d, 7) AS d, greatest(0, least(CAST(floor((1 / (d * d * d) - 1 / 8000.0::DOUBLE) / (1 - 1 / 8000.0::DOUBLE) * 20) AS INTEGER), 19)) AS shell, round(1 - exp(-0.9 * 0.45 / (0.5 + h / 10.0)), 9) AS qe FROM d JOIN p USING (p_partkey)
""")
def spacing_and_shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 5.0).alias("a"), (F.col("p_retailprice") / 50).alias("c"), (1 + F.col("p_partkey") % 4).alias("h"), (F.col("p_partkey") % 3).alias("k"), (F.col("p_partkey") % 5).alias("l"))
    d = geometry.d_spacing(F.col("h"), F.col("k"), F.col("l"), F.col("a"), F.col("a"), F.col("c"), F.lit(90.0), F.lit(90.0), F.lit(120.0))
    out = p.withColumn("d", d)
    return out.select("p_partkey", F.round("d", 7).alias("d"), merging.resolution_shell(F.col("d"), 1.0, 20.0, 20).alias("shell"), F.round(geometry.quantum_efficiency(F.lit(0.9), F.lit(0.45), 0.5 + F.col("h") / 10.0), 9).alias("qe"))


@query("""
SELECT o_orderkey, round(30.0::DOUBLE + (o_orderkey % 900 + 0.5::DOUBLE) * 0.1::DOUBLE, 9) AS phi, round((o_orderkey % 900 + 0.5::DOUBLE) / 900, 9) AS part,
  round(1 / 2.5 - (0.45 / (0.6 + (o_custkey % 40) / 100.0) + 1 / 2.5) * exp(-2.5 * (0.45 / (0.6 + (o_custkey % 40) / 100.0))), 9) AS depth FROM orders
""")
def scan_and_parallax(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("o_orderkey") % 900 + 0.5
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.round(geometry.z_to_phi(z, F.lit(1), F.lit(30.0), F.lit(0.1)), 9).alias("phi"), F.round(geometry.fraction_of_scan(z, F.lit(1), F.lit(900)), 9).alias("part"),
        F.round(geometry.parallax(0.6 + (F.col("o_custkey") % 40) / 100.0, F.lit(2.5), F.lit(0.45)), 9).alias("depth"),
    )


@query("""
WITH x AS (SELECT l_partkey AS part, l_quantity * 100000 AS prf, round(l_extendedprice * 100) AS s, l_quantity * 1000000 AS vp, l_linenumber * 9000000.0::DOUBLE AS vs FROM lineitem),
m AS (SELECT * FROM (VALUES (0.0::DOUBLE), (1e5::DOUBLE), (1e6::DOUBLE), (1e7::DOUBLE), ('inf'::DOUBLE)) t(mid)),
c AS (SELECT part, mid, prf, s, vp, vs, CASE WHEN mid = 0 THEN 1.0::DOUBLE WHEN isinf(mid) THEN 0 ELSE 1 / (1 + pow(greatest(s, 0) / mid, 3)) END AS w FROM x, m),
i AS (SELECT part, mid, w * prf + (1 - w) * s AS i, pow(w * sqrt(vp) + (1 - w) * sqrt(vs), 2) AS v FROM c), g AS (SELECT part, mid, count(*) AS n, sum(i / v) / sum(1 / v) AS mean FROM i GROUP BY 1, 2 HAVING count(*) > 1),
r AS (SELECT mid, sum(sqrt(n / (n - 1.0::DOUBLE)) * abs(i - mean)) / sum(i) AS r FROM i JOIN g USING (part, mid) GROUP BY 1)
SELECT mid, round(r, 7) AS r_meas, r = (SELECT min(r) FROM r) AS chosen FROM r
""")
def combination_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("part"), (F.col("l_quantity") * 100000).alias("i_prf"), F.round(F.col("l_extendedprice") * 100).alias("i_sum"), (F.col("l_quantity") * 1000000).alias("v_prf"), (F.col("l_linenumber") * 9000000.0).alias("v_sum"))
    return merging.combination_choice(rows, ["part"], [0.0, 1e5, 1e6, 1e7, float("inf")]).withColumn("r_meas", F.round("r_meas", 7))


@query()
def scaled_lineitems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines scaled over ship dates, parts as groups."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("row_id"), F.col("l_partkey").alias("part"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("i"), F.lit(90000.0).alias("v"),
        (micros("l_shipdate") / 86400e6 - 8000).alias("z"), (2.0 + F.col("l_linenumber") / 4).alias("d"),
    )
    kept, _ = scaling.scale(rows, ["part"], "row_id", scaling.Model(0.0, 3500.0, 6, 2))
    return kept.select("row_id", "part", F.round("scale", 4).alias("scale"), F.round("i_scaled", 1).alias("i_scaled"))


@query()
def spots_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All components of touching marks, those of one mark too: events as pixels of (user, minute of hour, hour), one day a sweep.

    Pixels of events without a time or user touch no other, so each is a component of its own.
    """
    e = table(spark, sf_dir, "events").withColumn("t", F.floor(micros("ts") / 60000000))
    pixels = e.select(F.floor(F.col("t") / 1440).alias("sweep"), F.floor(F.col("t") % 1440 / 60).cast("int").alias("frame"), (F.col("user_id") % 40).cast("int").alias("y"), F.floor(F.col("t") % 60 / 6).cast("int").alias("x"), F.lit(1).cast("long").alias("value"))
    once = pixels.groupBy("sweep", "frame", "y", "x").agg(F.sum("value").alias("value"))
    return images.measure_spots(images.pixel_components(once), least=1, most=None, peak_distance=None).select("sweep", "n_signal", "total", "x0", "x1", "y0", "y1", "z0", "z1")
