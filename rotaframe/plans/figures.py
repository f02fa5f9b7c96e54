"""Statistics of merged data, selections and experiment lists on the driver's tables, each with the SQL that says the same.

Order lines are observations: parts are groups, prices in cents intensities, quantities variances, discounts scales.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaframe.functions import geometry
from rotaframe.operators import joins, merging, selection, statistics, wilson
from rotaframe.operators.statistics import QUANTILE_BOTTOM, QUANTILE_TOP

from .queries import cents, micros, table
from .registry import query

OBSERVATIONS = """SELECT l_partkey AS part, CAST(l_partkey % 5 AS INTEGER) AS shell, l_linestatus = 'O' AS plus, l_partkey % 7 = 0 AS centric, round(l_extendedprice * 100) AS i,
  l_quantity * 4000000.0::DOUBLE AS v, l_quantity * 3000000.0::DOUBLE + l_linenumber * 100000.0::DOUBLE AS v0, 1 + round(l_discount * 100) / 100 AS g, l_orderkey AS ord, l_linenumber AS line, l_suppkey AS supp, l_shipdate AS day FROM lineitem"""
IN_ORDER = ["ord", "line", "supp", "i", "day"]


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("part"), (F.col("l_partkey") % 5).cast("int").alias("shell"), (F.col("l_linestatus") == "O").alias("plus"), (F.col("l_partkey") % 7 == 0).alias("centric"), F.round(F.col("l_extendedprice") * 100).alias("i"),
        (F.col("l_quantity") * 4000000.0).alias("v"), (F.col("l_quantity") * 3000000.0 + F.col("l_linenumber") * 100000.0).alias("v0"), (1 + F.round(F.col("l_discount") * 100) / 100).alias("g"),
        F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supp"), F.col("l_shipdate").alias("day"),
    )


def near(value, places: int):
    """value to so many places, reckoned as doubles: for many values Spark's round, which goes by decimals, takes longer than what they come from."""
    return F.rint(value * 10.0**places) / 10.0**places


def rounded(df: DataFrame, places: dict[str, int]) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


@query(f"""
WITH o AS (SELECT *, i / g AS x, g * g / v AS w, centric OR plus AS side FROM ({OBSERVATIONS})),
s AS (SELECT part, shell, side, count(*) AS n, sum(x) AS sx, sum(w) AS sw, sum(w * x) AS swx FROM o GROUP BY ALL), m AS (SELECT part, sum(sx) / sum(n) AS mean FROM s GROUP BY 1),
f AS (SELECT o.part, o.side, sum(abs(x - sx / n)) AS own, sum(abs(x - mean)) AS off FROM o JOIN s ON o.part = s.part AND o.side = s.side JOIN m ON o.part = m.part GROUP BY 1, 2),
a AS (SELECT part, shell, CAST(sum(n) AS BIGINT) AS n, sum(sw) AS sw, sum(swx) AS swx, sum(sx) AS sx, sum(off) AS off, count(*) AS sides, sum(CASE WHEN n > 1 THEN sx END) AS ba, sum(CASE WHEN n > 1 THEN own END) AS ma,
  sum(CASE WHEN n > 1 THEN own * sqrt(n / (n - 1.0::DOUBLE)) END) AS ea, sum(CASE WHEN n > 1 THEN own * sqrt(1 / (n - 1.0::DOUBLE)) END) AS pa FROM s JOIN f USING (part, side) GROUP BY 1, 2)
SELECT shell, CAST(sum(n) AS BIGINT) AS observations, count(*) AS "unique", round(sum(n) / CAST(count(*) AS DOUBLE), 8) AS multiplicity, round(sum(n) / CAST(sum(sides) AS DOUBLE), 8) AS anom_multiplicity,
  round(avg(swx / sw), 3) AS mean_i, round(avg(swx / sw * sqrt(sw)), 6) AS i_over_sigma,
  round(sum(CASE WHEN n > 1 THEN off END) / sum(CASE WHEN n > 1 THEN sx END), 8) AS r_merge, round(sum(CASE WHEN n > 1 THEN off * sqrt(n / (n - 1.0::DOUBLE)) END) / sum(CASE WHEN n > 1 THEN sx END), 8) AS r_meas,
  round(sum(CASE WHEN n > 1 THEN off * sqrt(1 / (n - 1.0::DOUBLE)) END) / sum(CASE WHEN n > 1 THEN sx END), 8) AS r_pim, round(sum(ma) / sum(ba), 8) AS r_merge_anom, round(sum(ea) / sum(ba), 8) AS r_meas_anom, round(sum(pa) / sum(ba), 8) AS r_pim_anom
FROM a GROUP BY ROLLUP (shell)
""")
def merging_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.merging_table(observations(spark, sf_dir), ["part"], "shell", "plus", "centric")
    return rounded(out, {"mean_i": 3, "i_over_sigma": 6} | {c: 8 for c in out.columns if c.startswith("r_") or c.endswith("multiplicity")})


PAIRS = f"""s AS (SELECT part, shell, plus, sum(g * g / v) AS w, sum(g * g / v * (i / g)) AS wx FROM ({OBSERVATIONS}) WHERE NOT centric GROUP BY ALL),
p AS (SELECT a.part, a.shell, a.wx / a.w AS ip, b.wx / b.w AS im, a.wx / a.w - b.wx / b.w AS di, sqrt(1 / a.w + 1 / b.w) AS sdi FROM s a JOIN s b ON a.part = b.part AND a.plus AND NOT b.plus)"""


@query(f"""
WITH {PAIRS} SELECT shell, count(*) AS anomalous_pairs, round(sum(abs(di)) / sum(sdi), 8) AS di_over_sig_di, round(sqrt(2 * sum(CASE WHEN ip > 0 AND im > 0 THEN (sqrt(ip) - sqrt(im)) ** 2 END) / sum(CASE WHEN ip > 0 AND im > 0 THEN ip + im END)), 8) AS df_over_f
FROM p GROUP BY ROLLUP (shell)
""")
def anomalous_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = statistics.friedel_pairs(observations(spark, sf_dir), ["part"], "shell", "plus", "centric")
    return rounded(statistics.anomalous_table(pairs, "shell"), {"di_over_sig_di": 8, "df_over_f": 8})


def horner(coefficients, r: str) -> str:
    out = "0.0::DOUBLE"
    for c in coefficients:
        out = f"({out} * {r} + {c!r}::DOUBLE)"
    return out


SLOPE = f"""q AS (SELECT shell, which, z, (row_number() OVER (PARTITION BY shell, which ORDER BY z, part) - 0.5::DOUBLE) / count(*) OVER (PARTITION BY shell, which) - 0.5 AS q, count(*) OVER (PARTITION BY shell, which) AS n FROM z),
r AS (SELECT *, 0.180625 - q * q AS r FROM q WHERE abs(q) <= 0.425), x AS (SELECT *, q * {horner(QUANTILE_TOP, "r")} / {horner(QUANTILE_BOTTOM, "r")} AS x FROM r)"""


@query(f"""
WITH {PAIRS}, o AS (SELECT *, count(*) FILTER (plus) OVER (PARTITION BY part) AS np, row_number() OVER (PARTITION BY part ORDER BY day, ord, line, supp, i) AS nth FROM ({OBSERVATIONS}) WHERE NOT centric),
t AS (SELECT part, shell, nth <= np AS plus, sum(g * g / v) AS w, sum(g * g / v * (i / g)) AS wx FROM o GROUP BY ALL),
z AS (SELECT part, shell, 'mates' AS which, di / sdi AS z FROM p UNION ALL SELECT a.part, a.shell, 'control', (a.wx / a.w - b.wx / b.w) / sqrt(1 / a.w + 1 / b.w) FROM t a JOIN t b ON a.part = b.part AND a.plus AND NOT b.plus), {SLOPE}
SELECT shell, which, round(CASE WHEN min(n) >= 10 THEN covar_pop(x, z) / var_pop(x) ELSE 0 END, 7) AS slope FROM x WHERE abs(x) < 0.9 GROUP BY 1, 2
""")
def anomalous_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, parts = observations(spark, sf_dir), []
    for which, dealt in (("mates", None), ("control", F.struct("day", "ord", "line", "supp", "i"))):
        pairs = statistics.friedel_pairs(rows, ["part"], "shell", "plus", "centric", dealt)
        slope = statistics.normal_slope(pairs.withColumn("z", F.col("di") / F.col("sdi")), "shell", "z", ["part"])
        parts.append(slope.select("shell", F.lit(which).alias("which"), F.round("slope", 7).alias("slope")))
    return parts[0].unionByName(parts[1])


@query(f"""
WITH h AS (SELECT part, shell, plus, i / g AS x, row_number() OVER (PARTITION BY part, plus ORDER BY {", ".join(IN_ORDER)}) % 2 AS half FROM ({OBSERVATIONS}) WHERE NOT centric),
m AS (SELECT part, shell, avg(x) FILTER (plus AND half = 1) - avg(x) FILTER (NOT plus AND half = 1) AS a, avg(x) FILTER (plus AND half = 0) - avg(x) FILTER (NOT plus AND half = 0) AS b FROM h GROUP BY 1, 2)
SELECT shell, count(*) AS pairs, round(CASE WHEN count(*) >= 3 THEN coalesce(corr(a, b), 0) ELSE 0 END, 8) AS cc_anom FROM m WHERE a IS NOT NULL AND b IS NOT NULL GROUP BY 1
""")
def anomalous_cc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.anomalous_cc(observations(spark, sf_dir), ["part"], "shell", "plus", "centric", F.struct(*IN_ORDER)), {"cc_anom": 8})


INDICES = f"SELECT part % 30 + 1 AS h, supp % 12 + 1 AS k, line AS l, plus, i - 300000.0::DOUBLE AS i, v * 100 AS v, 1.0::DOUBLE + part % 30 / 10.0::DOUBLE AS d FROM ({OBSERVATIONS})"


@query(f"""
WITH o AS (SELECT CASE WHEN plus THEN h ELSE -h END AS h, CASE WHEN plus THEN k ELSE -k END AS k, CASE WHEN plus THEN l ELSE -l END AS l, i, v, d FROM ({INDICES}) WHERE i / sqrt(v) >= -5)
SELECT h, k, l, count(*) AS n, round(sum(i / v) / sum(1 / v), 4) AS i, round(1 / sqrt(sum(1 / v)), 6) AS sigma, min(d) AS d FROM o GROUP BY 1, 2, 3
""")
def merged_apart(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).select((F.col("part") % 30 + 1).alias("h"), (F.col("supp") % 12 + 1).alias("k"), F.col("line").alias("l"), "plus", (F.col("i") - 300000.0).alias("i"), (F.col("v") * 100).alias("v"), (1.0 + F.col("part") % 30 / 10.0).alias("d"))
    return rounded(statistics.merged_apart(rows, ["h", "k", "l"], "plus"), {"i": 4, "sigma": 6})


@query(f"""
WITH o AS (SELECT part, i, v, row_number() OVER (PARTITION BY part ORDER BY {", ".join(IN_ORDER)}) % 2 AS half FROM ({OBSERVATIONS})),
m AS (SELECT part, count(*) AS n, sum(1 / v) AS sw, sum(i / v) / sum(1 / v) AS mean, avg(i) AS plain FROM o GROUP BY 1)
SELECT part, any_value(n) AS n, round(any_value(mean), 4) AS mean, round(any_value(1 / sqrt(sw)), 6) AS sigma, round(any_value(sqrt(n) / sqrt(sw)), 6) AS sigma_one, round(CASE WHEN any_value(n) > 1 THEN sum((i - mean) ** 2 / v) / (any_value(n) - 1) END, 3) AS chi2,
  round(CASE WHEN any_value(n) > 1 THEN sqrt(sum((i - plain) ** 2) / (any_value(n) - 1)) END, 3) AS scatter, round(avg(i) FILTER (half = 1), 4) AS half_1, round(avg(i) FILTER (half = 0), 4) AS half_2 FROM o JOIN m USING (part) GROUP BY 1
""")
def comparison_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.comparison_merge(observations(spark, sf_dir), ["part"], F.struct(*IN_ORDER))
    return rounded(out, {"mean": 4, "sigma": 6, "sigma_one": 6, "chi2": 3, "scatter": 3, "half_1": 4, "half_2": 4})


@query(f"""
WITH o AS (SELECT *, i / g AS x, g * g / v0 AS wr, g * g / v AS wf FROM ({OBSERVATIONS})), s AS (SELECT part, count(*) AS n, sum(wr) AS swr, sum(wr * x) AS sr, sum(wf) AS swf, sum(wf * x) AS sf FROM o GROUP BY 1),
z AS (SELECT sf / swf AS mean, ord, line, supp, i, day, (x - (sr - wr * x) / (swr - wr)) / sqrt(v0 / (g * g) + 1 / (swr - wr)) AS raw, (x - (sf - wf * x) / (swf - wf)) / sqrt(v / (g * g) + 1 / (swf - wf)) AS final FROM o JOIN s USING (part) WHERE n > 1),
b AS (SELECT *, (row_number() OVER (ORDER BY round(mean, 3), {", ".join(IN_ORDER)}) * 10 - 1) // count(*) OVER () AS bin FROM z),
m AS (SELECT bin, count(*) AS n, min(round(mean, 3)) AS lo, max(round(mean, 3)) AS hi, avg(raw * raw) AS raw_ms, avg(final * final) AS final_ms, list_sort(list(raw))[count(*) // 2 + 1] AS mr, list_sort(list(final))[count(*) // 2 + 1] AS mf FROM b GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, any_value(n) AS n, any_value(lo) AS lo, any_value(hi) AS hi, round(any_value(raw_ms), 4) AS raw_ms, round(any_value(final_ms), 4) AS final_ms,
  round((1.4826::DOUBLE * list_sort(list(abs(raw - mr)))[count(*) // 2 + 1]) ** 2, 4) AS raw_robust, round((1.4826::DOUBLE * list_sort(list(abs(final - mf)))[count(*) // 2 + 1]) ** 2, 4) AS final_robust FROM b JOIN m ON b.bin = m.bin GROUP BY 1
""")
def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = observations(spark, sf_dir).withColumn("row_id", F.struct(*IN_ORDER))
    off = statistics.sigma_deviations(rows, ["part"], "row_id").withColumn("mean", F.round("mean", 3))
    return rounded(statistics.calibration(off, [F.asc("mean"), F.asc("row_id")], "mean", 10), {c: 4 for c in ("raw_ms", "final_ms", "raw_robust", "final_robust")})


@query(f"""
WITH o AS ({OBSERVATIONS}), s AS (SELECT part, sum(g * i / v) / sum(g * g / v) AS m FROM o GROUP BY 1)
SELECT ord, line, supp, i, round(g * m, 3) AS model_i, round(v0 + line * greatest(g * m, 0), 1) AS v FROM o JOIN s USING (part)
""")
def model_variances(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.model_variances(observations(spark, sf_dir), ["part"], "v0", "line")
    return out.select("ord", "line", "supp", "i", F.round("model_i", 3).alias("model_i"), F.round("v", 1).alias("v"))


@query(f"""
WITH s AS (SELECT part, shell, count(*) AS n, sum(g * i / v) / sum(g * g / v) AS m FROM ({OBSERVATIONS}) GROUP BY 1, 2 HAVING count(*) > 1)
SELECT o.shell, round(sum(sqrt(n / (n - 1.0::DOUBLE)) * abs(i / g - m)) / sum(i / g), 8) AS r_meas FROM ({OBSERVATIONS}) o JOIN s ON o.part = s.part GROUP BY 1
""")
def weighted_rmeas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(merging.weighted_rmeas(observations(spark, sf_dir), ["part"], by=["shell"]), {"r_meas": 8})


SPOTS = "SELECT vec_id AS id, 0.05::DOUBLE + abs(embedding[1] + embedding[2]) AS s FROM (SELECT vec_id, CAST(embedding[1] AS DOUBLE) AS a, CAST(embedding[2] AS DOUBLE) AS b, [CAST(embedding[1] AS DOUBLE), CAST(embedding[2] AS DOUBLE)] AS embedding FROM embeddings)"


def spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), (0.05 + F.abs(at(0) + at(1))).alias("s"))


@query(f"""
WITH p AS ({SPOTS}), t AS (SELECT max(s * s) AS top FROM p), c AS (SELECT least(CAST(floor(s * s / top * 50) AS INTEGER), 49) AS bin, count(*) AS n FROM p, t GROUP BY 1)
SELECT CAST(r.i AS INTEGER) AS bin, round(CASE WHEN i > 0 THEN 1 / sqrt(top * i / 50) END, 9) AS d_max, round(1 / sqrt(top * (i + 1) / 50), 9) AS d_min, coalesce(n, 0) AS n FROM range(50) r(i) CROSS JOIN t LEFT JOIN c ON c.bin = r.i
""")
def resolution_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(statistics.resolution_counts(spots(spark, sf_dir), "s", 50), {"d_max": 9, "d_min": 9})


RINGS = " UNION ALL ".join(f"SELECT {d}::DOUBLE AS d" for d in statistics.ICE)


@query(f"""
WITH p AS (SELECT 0.2::DOUBLE + (l_partkey % 97) / 400.0::DOUBLE AS s FROM lineitem), t AS (SELECT count(*) AS n, min(s) AS lo, max(s) AS hi FROM p),
b AS (SELECT d, sqrt(1 / (d * d) - 0.002) AS a, sqrt(1 / (d * d) + 0.002) AS b FROM ({RINGS})), c AS (SELECT d, count(*) AS n FROM b JOIN p ON s BETWEEN a AND b.b GROUP BY 1)
SELECT b.d, c.n, round(t.n * (b.b ** 3 - a ** 3) / (hi ** 3 - lo ** 3), 6) AS expected FROM b JOIN c ON b.d = c.d, t WHERE b.b >= lo AND a <= hi AND c.n >= 20 AND c.n > 1.2 * t.n * (b.b ** 3 - a ** 3) / (hi ** 3 - lo ** 3)
""")
def ice_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select((0.2 + F.col("l_partkey") % 97 / 400.0).alias("s"))
    return rounded(statistics.ice_rings(rows, "s", times=1.2), {"expected": 6})


CENTROIDS = """SELECT l_orderkey * 8 + l_linenumber AS id, l_partkey % 1000 + 0.5::DOUBLE AS x_cal, l_suppkey % 900 + 0.25::DOUBLE AS y_cal, l_partkey % 1000 + 0.5::DOUBLE + (l_quantity - 25) / 20 + (l_partkey % 1000) / 2000.0::DOUBLE AS x_obs, l_suppkey % 900 + 0.25::DOUBLE + (l_discount - 0.05) * 20 AS y_obs FROM lineitem"""


def centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("l_partkey") % 1000 + 0.5, F.col("l_suppkey") % 900 + 0.25
    rows = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), x.alias("x_cal"), y.alias("y_cal"), (x + (F.col("l_quantity") - 25) / 20 + F.col("l_partkey") % 1000 / 2000.0).alias("x_obs"), (y + (F.col("l_discount") - 0.05) * 20).alias("y_obs"))
    return statistics.centroid_residuals(rows, F.lit(500.0), F.lit(450.0), clip=1.501)


POINTS = f"""c AS ({CENTROIDS}), d AS (SELECT id, x_cal - 500 AS x, y_cal - 450 AS y, x_obs - x_cal AS dx, y_obs - y_cal AS dy FROM c), p AS (SELECT *, sqrt(x * x + y * y) AS radius FROM d WHERE abs(dx) <= 1.501 AND abs(dy) <= 1.501),
r AS (SELECT id, x, y, dx, dy, radius, round((dx * x + dy * y) / radius, 9) AS radial, round((dy * x - dx * y) / radius, 9) AS tangential FROM p WHERE radius >= 1)"""


@query(f"""
WITH {POINTS}, n AS (SELECT *, row_number() OVER (ORDER BY radius, id, dx, dy) - 1 AS rn, count(*) OVER () AS total FROM r), b AS (SELECT *, least(rn // greatest(1, total // 8), 7) AS bin FROM n)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, round(min(radius), 9) AS radius_from, round(max(radius), 9) AS radius_to, list_sort(list(radial))[count(*) // 2 + 1] AS radial, list_sort(list(tangential))[count(*) // 2 + 1] AS tangential FROM b GROUP BY 1
""")
def residual_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = centroids(spark, sf_dir).withColumn("row", F.struct("id", "dx", "dy"))
    points = points.withColumns({"radial": F.round("radial", 9), "tangential": F.round("tangential", 9)})
    return rounded(statistics.residual_bins(points, "row", ["radial", "tangential"]), {"radius_from": 9, "radius_to": 9})


@query("SELECT o_orderkey, o_totalprice FROM (SELECT DISTINCT l_partkey AS place FROM lineitem WHERE l_quantity > 49) JOIN orders ON o_orderkey = place")
def rows_at_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    wanted = table(spark, sf_dir, "lineitem").filter("l_quantity > 49").select(F.col("l_partkey").alias("o_orderkey")).distinct()
    return selection.at_positions(orders, wanted.join(orders, "o_orderkey", "left_semi"), "o_orderkey")


FLAGGED = "SELECT l_orderkey AS ord, l_linenumber AS line, CASE WHEN l_returnflag = 'R' THEN 256 ELSE 0 END AS flags, l_partkey % 3 AS h, l_suppkey % 2 AS k, l_linenumber % 2 AS l, l_tax / l_discount AS xres, l_discount AS yres, l_tax AS zres FROM lineitem"


@query(f"SELECT ord, line, h, k, l, round(xres, 9) AS xres FROM ({FLAGGED}) WHERE flags & 256 <> 0 AND isfinite(xres) AND NOT (h = 0 AND k = 0 AND l = 0)")
def postrefinement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    ratio = F.when(F.col("l_discount") == 0, F.lit(None)).otherwise(F.col("l_tax") / F.when(F.col("l_discount") != 0, F.col("l_discount")))
    rows = li.select(F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"), F.when(F.col("l_returnflag") == "R", 256).otherwise(0).alias("flags"), (F.col("l_partkey") % 3).alias("h"), (F.col("l_suppkey") % 2).alias("k"), (F.col("l_linenumber") % 2).alias("l"), ratio.alias("xres"), F.col("l_discount").alias("yres"), F.col("l_tax").alias("zres"))
    return rounded(selection.for_postrefinement(rows), {"xres": 9}).select("ord", "line", "h", "k", "l", "xres")


@query("SELECT o_orderkey, ('0x' || substr(md5('0:' || o_orderkey), 1, 8))::BIGINT < 214748364 AS held_out FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_quantity > 45)")
def rows_to_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    excluded = table(spark, sf_dir, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return selection.held_out(table(spark, sf_dir, "orders").select("o_orderkey"), excluded, "o_orderkey", 0.05).select("o_orderkey", "held_out")


@query("""
WITH e AS (SELECT s_suppkey - (SELECT min(s_suppkey) FROM supplier) AS id, CAST(s_nationkey AS VARCHAR) AS beam, CAST(s_nationkey % 4 AS VARCHAR) AS detector FROM supplier
  UNION ALL SELECT c_custkey - (SELECT min(c_custkey) FROM customer) + (SELECT max(s_suppkey) - min(s_suppkey) + 1 FROM supplier), CAST(c_nationkey AS VARCHAR), CAST(c_nationkey % 4 AS VARCHAR) FROM customer)
SELECT id, beam, detector, dense_rank() OVER (ORDER BY beam) - 1 AS beam_id, dense_rank() OVER (ORDER BY detector) - 1 AS detector_id FROM e
""")
def joined_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = []
    for name, key, nation in (("supplier", "s_suppkey", "s_nationkey"), ("customer", "c_custkey", "c_nationkey")):
        own = table(spark, sf_dir, name)
        first = F.broadcast(own.agg(F.min(key).alias("first")))  # one row
        lists.append(own.join(first).select((F.col(key) - F.col("first")).alias("id"), F.col(nation).cast("string").alias("beam"), (F.col(nation) % 4).cast("string").alias("detector")))
    return selection.joined_experiments(lists, ["beam", "detector"]).select("id", "beam", "detector", "beam_id", "detector_id")


@query("""
WITH e AS (SELECT o_orderkey AS id, 1 + o_orderkey % 50 AS a, 1 + o_orderkey % 50 + o_custkey % 90 AS b FROM orders)
SELECT id, greatest(a, 40) AS first_image, least(b, 80) AS last_image, 10.0::DOUBLE + (greatest(a, 40) - a) * 0.5::DOUBLE AS start FROM e WHERE greatest(a, 40) <= least(b, 80)
""")
def sliced_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = 1 + F.col("o_orderkey") % 50
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), first.alias("first_image"), (first + F.col("o_custkey") % 90).alias("last_image"), F.lit(10.0).alias("start"), F.lit(0.5).alias("width"))
    return selection.sliced_experiments(rows, 40, 80).select("id", "first_image", "last_image", "start")


@query("""
WITH n AS (SELECT o_orderkey, o_totalprice AS mean, (row_number() OVER (ORDER BY o_orderkey) - 1) // 500 AS run FROM orders), m AS (SELECT run, avg(mean) AS m FROM n GROUP BY 1)
SELECT o_orderkey FROM n JOIN m USING (run) WHERE NOT (m > 0 AND mean / m >= 2.5)
""")
def wilson_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("mean"))
    return merging.without_wilson_outliers(rows, [F.asc("o_orderkey")], limit=2.5).select("o_orderkey")


@query("""
WITH n AS (SELECT o_totalprice AS x, (row_number() OVER (ORDER BY o_totalprice, o_orderkey) * 7 - 1) // count(*) OVER () AS bin FROM orders)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS n, min(x) AS low, max(x) AS high FROM n GROUP BY 1
""")
def edge_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    binned = merging.edge_bins(table(spark, sf_dir, "orders").select("o_totalprice", "o_orderkey"), [F.asc("o_totalprice"), F.asc("o_orderkey")], 7)
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"))


LOSSES = f"""o AS (SELECT ord, line, supp, part, day, i, v, (5.0::DOUBLE + line) / (year(o_orderdate) - 1985) AS level FROM ({OBSERVATIONS}) JOIN orders ON o_orderkey = ord),
u AS (SELECT part, count(*) AS n, list_sort(list(level))[CAST((3 * (count(*) - 1)) // 4 + 1 AS BIGINT)] AS upper FROM o GROUP BY 1),
t AS (SELECT o.*, n, least(greatest(CASE WHEN n >= 3 THEN level / upper ELSE level END, 0), 10) AS ratio FROM o JOIN u USING (part)),
p AS (SELECT *, least(greatest(1 / (1 + exp((ratio - 0.6) / 0.1)), 0.01), 0.99) AS prior FROM t)"""


def chance(rows: str) -> str:
    """Rows with mean: the spread about it and the chance of a loss."""
    close = lambda x: f"least(abs({x}), 7.07::DOUBLE)"
    tail = lambda x: f"(exp(least(abs({x}), 38) ** 2 / -2) * {horner(geometry.TAIL_TOP, close(x))} / {horner(geometry.TAIL_BOTTOM, close(x))})"
    below = lambda x: f"CASE WHEN {x} > 0 THEN 1 - {tail(x)} ELSE {tail(x)} END"
    return f"""SELECT *, CASE WHEN good + bad > 0 THEN bad / (good + bad) ELSE prior END AS chance FROM (SELECT *, (1 - prior) * exp(-0.5 * (i - mean) * (i - mean) / spread) / sqrt(2 * pi() * spread) AS good,
      CASE WHEN mean > 0 THEN prior * ({below("hi")} - {below("lo")}) / mean ELSE 0 END AS bad FROM (SELECT *, v * greatest(1, greatest(mean, 0) / greatest(i, sqrt(v))) AS spread, (mean - i) / sqrt(v) AS hi, -i / sqrt(v) AS lo FROM ({rows})))"""


def lines_with_backgrounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines with a background by their number and an expected one by the year of their order."""
    rows = observations(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ord"), F.year("o_orderdate").alias("year")), "ord")
    return rows.select(F.struct(*IN_ORDER).alias("row_id"), "part", "i", "v", (5.0 + F.col("line")).alias("background"), (F.col("year") - 1985.0).alias("expected"))


@query(f"""
WITH {LOSSES} SELECT ord, line, supp, part, n, round(ratio, 8) AS ratio, round(prior, 8) AS prior FROM p
""")
def attenuation_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = statistics.attenuation_priors(lines_with_backgrounds(spark, sf_dir), ["part"], "row_id")
    return out.select("row_id.ord", "row_id.line", "row_id.supp", "part", "n", F.round("ratio", 8).alias("ratio"), F.round("prior", 8).alias("prior"))


@query(f"""
WITH RECURSIVE {LOSSES}, g AS (SELECT part, sum((1 - prior) / v * i) / sum((1 - prior) / v) AS mean FROM p WHERE n >= 3 GROUP BY 1),
r(k, part, mean, moves) AS (SELECT 0, part, mean, true FROM g UNION ALL
  SELECT k + 1, part, new, abs(new - mean) > 1e-9 + 1e-6 * abs(mean) FROM (SELECT part, any_value(k) AS k, any_value(mean) AS mean, sum((1 - chance) / spread * i) / sum((1 - chance) / spread) AS new FROM ({chance("SELECT p.*, k, mean FROM p JOIN r ON p.part = r.part WHERE moves AND k < 30")}) GROUP BY part)),
m AS (SELECT part, arg_max(mean, k) AS mean FROM r GROUP BY 1), c AS ({chance("SELECT p.*, mean FROM p JOIN m ON p.part = m.part")}),
j AS (SELECT part, any_value(mean) * sqrt(sum((1 - chance) / v)) >= 3 AS judged FROM c GROUP BY 1)
SELECT ord, line, supp, i, round(ratio, 6) AS ratio, judged, round(CASE WHEN judged THEN chance ELSE prior END, 4) AS probability FROM c JOIN j ON c.part = j.part
UNION ALL SELECT ord, line, supp, i, round(ratio, 6), false, round(prior, 4) FROM p WHERE n < 3
""")
def attenuated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines judged as attenuated by their number as a background."""
    out = statistics.judge_attenuation(lines_with_backgrounds(spark, sf_dir), ["part"], "row_id")
    return out.select("row_id.ord", "row_id.line", "row_id.supp", "row_id.i", F.round("ratio", 6).alias("ratio"), "judged", F.round("probability", 4).alias("probability"))


# A beam of 0.9 Angstrom along -z, an axis along x, a panel of 200 x 150 mm at 250 mm. u: the unit ray, e1 and e2: the reflection's own frame.
RAYS = """p AS (SELECT l_orderkey AS ord, l_linenumber AS line, l_partkey AS part, l_partkey % 200 + 0.25::DOUBLE AS x, l_suppkey % 150 + 0.5::DOUBLE AS y, l_linenumber * 0.3::DOUBLE AS phi FROM lineitem),
l AS (SELECT *, sqrt((x - 100) ** 2 + (75 - y) ** 2 + 62500) AS len FROM p), u AS (SELECT *, (x - 100) / len AS ux, (75 - y) / len AS uy, -250 / len AS uz, 1 / 0.9::DOUBLE AS k FROM l)"""


def rays(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, dict]:
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"), F.col("l_partkey").alias("part"), (F.col("l_partkey") % 200 + 0.25).alias("x"), (F.col("l_suppkey") % 150 + 0.5).alias("y"), (F.col("l_linenumber") * 0.3).alias("phi"))
    v = geometry.vec
    return rows, {"origin": v(-100, 75, -250), "fast": v(1, 0, 0), "slow": v(0, -1, 0), "s0": v(0, 0, -1 / 0.9), "axis": v(1, 0, 0)}


@query(f"""
WITH {RAYS}, e AS (SELECT *, -uy / sqrt(ux * ux + uy * uy) AS e1x, ux / sqrt(ux * ux + uy * uy) AS e1y FROM u), n AS (SELECT *, sqrt((x - 99) ** 2 + (75 - y - 0.5) ** 2 + 62500) AS nlen FROM e),
q AS (SELECT *, (x - 99) / nlen - ux AS ox, (75 - y - 0.5) / nlen - uy AS oy, -250 / nlen - uz AS oz FROM n)
SELECT ord, line, part, round(ux * k, 9) AS qx, round(uy * k * cos(phi) + (uz * k + k) * sin(phi), 9) AS qy, round(-uy * k * sin(phi) + (uz * k + k) * cos(phi), 9) AS qz, round(abs(uy) / ((1 - 1.98::DOUBLE) * (1 - uy * uy) + 0.99::DOUBLE * (1 + uz * uz)), 9) AS lp,
  round(-uy / sqrt(ux * ux + uy * uy), 9) AS zeta, round(e1x * ox + e1y * oy, 9) AS eps1, round(-uz * e1y * ox + uz * e1x * oy + (ux * e1y - uy * e1x) * oz, 9) AS eps2 FROM q
""")
def ray_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, g = rays(spark, sf_dir)
    bind = geometry.Steps(rows)
    lab = bind(geometry.lab_position(F.col("x"), F.col("y"), g["origin"], g["fast"], g["slow"]))
    beside = geometry.lab_position(F.col("x") + 1, F.col("y") + 0.5, g["origin"], g["fast"], g["slow"])
    q = bind(geometry.reciprocal_point(lab, g["s0"], g["axis"], F.col("phi"), bind))
    s1, other = (bind(geometry.scaled(geometry.unit(v, bind), F.lit(1 / 0.9))) for v in (lab, beside))
    lp = geometry.lorentz_polarization(g["s0"], s1, g["axis"], geometry.vec(0, 1, 0), F.lit(0.99), bind)
    a, b = geometry.kabsch_epsilon(s1, other, g["s0"], bind)
    zeta = geometry.zeta(g["s0"], s1, g["axis"], bind)
    values = {"qx": q.x, "qy": q.y, "qz": q.z, "lp": lp, "zeta": zeta, "eps1": a, "eps2": b}
    return bind.df.select("ord", "line", "part", *(near(v, 9).alias(k) for k, v in values.items()))


@query(f"""
WITH {RAYS}, d AS (SELECT *, 0.45 / -uz AS path FROM u), m AS (SELECT *, 1 / 2.5::DOUBLE - (path + 1 / 2.5::DOUBLE) * exp(-2.5 * path) AS depth, 2.5 * path * exp(-2.5 * path) * path / uz AS slope FROM d)
SELECT ord, line, part, round((1 + (1 - ux * ux) / len * depth + ux * slope * (ux * uz) / len) / 0.172, 8) AS xx, round((ux * uy / len * depth + ux * slope * -(uy * uz) / len) / 0.172, 8) AS xy,
  round((ux * uy / len * depth + -uy * slope * (ux * uz) / len) / 0.172, 8) AS yx, round((1 + (1 - uy * uy) / len * depth + -uy * slope * -(uy * uz) / len) / 0.172, 8) AS yy FROM m
""")
def pixel_jacobian(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, g = rays(spark, sf_dir)
    bind = geometry.Steps(rows)
    j = geometry.mm_to_px_jacobian(F.col("x"), F.col("y"), F.lit(0.172), g["origin"], g["fast"], g["slow"], F.lit(2.5), F.lit(0.45), bind)
    return bind.df.select("ord", "line", "part", *(near(v, 8).alias(k) for k, v in j.items()))


@query(f"""
WITH {RAYS}, g AS (SELECT i AS panel, -90.1 + 60 * (i % 3) AS ox, 70.0 - 75 * (i // 3) AS oy, -240.0::DOUBLE - i AS oz FROM range(6) t(i)),
r AS (SELECT DISTINCT ord, line, part, ux, uy, uz FROM u), h AS (SELECT ord, line, part, ux, uy, panel, ux * oz / uz - ox AS xm, oy - uy * oz / uz AS ym FROM r, g), f AS (SELECT *, row_number() OVER (PARTITION BY ord, line, part, ux, uy ORDER BY panel) AS nth FROM h WHERE xm BETWEEN 0 AND 62 AND ym BETWEEN 0 AND 70)
SELECT ord, line, part, panel, round(xm, 8) AS x_mm, round(ym, 8) AS y_mm FROM f WHERE nth = 1
""")
def first_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, g = rays(spark, sf_dir)
    bind = geometry.Steps(rows)
    ray = geometry.unit(geometry.lab_position(F.col("x"), F.col("y"), g["origin"], g["fast"], g["slow"]), bind)
    own = bind.df.select("ord", "line", "part", F.lit(0).alias("detector"), ray.alias("s1")).distinct()
    i = F.col("id")
    panels = spark.range(6).select(F.lit(0).alias("detector"), i.alias("panel"), F.struct((-90.1 + 60 * (i % 3)).alias("x"), (70.0 - 75 * F.floor(i / 3)).alias("y"), (-240.0 - i).alias("z")).alias("origin"), g["fast"].alias("fast"), g["slow"].alias("slow"), F.lit(62.0).alias("width"), F.lit(70.0).alias("height"))
    return joins.first_panel(own, panels, "detector").select("ord", "line", "part", "panel", near(F.col("x_mm"), 8).alias("x_mm"), near(F.col("y_mm"), 8).alias("y_mm"))


HALVES = f"""h AS (SELECT part, any_value(1.0::DOUBLE + (part * 7919 % 4001) / 1000.0::DOUBLE) AS d, avg(i) FILTER (half = 1) AS a, avg(i) FILTER (half = 0) AS b FROM (SELECT part, i, row_number() OVER (PARTITION BY part ORDER BY {", ".join(IN_ORDER)}) % 2 AS half FROM ({OBSERVATIONS})) GROUP BY 1)"""


@query(f"""
WITH {HALVES}, n AS (SELECT *, row_number() OVER (ORDER BY d DESC, part) - 1 AS rn, count(*) OVER () AS nr FROM h WHERE a IS NOT NULL AND b IS NOT NULL),
s AS (SELECT *, greatest(10, nr // 50) AS size FROM n), b AS (SELECT *, least(rn // size, greatest(nr // size - CASE WHEN nr % size < size // 2 THEN 1 ELSE 0 END, 0)) AS bin FROM s)
SELECT CAST(bin AS INTEGER) AS bin, count(*) AS groups, min(d) AS d_min, round(coalesce(corr(a, b), 0), 8) AS cc_half FROM b GROUP BY 1
""")
def cc_half_by_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shells of equal counts with their CC half; the critical value, which SQL lacks the distribution for, is tested apart."""
    rows = observations(spark, sf_dir).withColumn("d", 1.0 + F.col("part") * 7919 % 4001 / 1000.0)
    out = merging.cc_half_by_resolution(rows, ["part"], "i", "d", F.struct(*IN_ORDER))
    return out.select("bin", "groups", "d_min", F.round("cc_half", 8).alias("cc_half"))


# Vectors of a lattice of 40 x 50 x 60 Angstrom and a planted scale and tensor.
PLANTED = (9.0, (18.0, 22.0, 30.0, 3.0, -2.0, 1.5))
FALLING = """SELECT l_orderkey AS ord, l_linenumber AS line, l_suppkey AS supp, l_partkey AS part, (1 + l_partkey % 17) / 40.0::DOUBLE AS x, (1 + l_suppkey % 19) / 50.0::DOUBLE AS y, (1 + l_orderkey % 23) / 60.0::DOUBLE AS z FROM lineitem"""


@query(f"SELECT ord, line, supp, part, 1.0::DOUBLE AS i FROM (SELECT *, x * x + y * y + z * z AS s FROM ({FALLING}))")
def wilson_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intensities that fall off as a tensor says come out level, once the tensor is found."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(F.col("l_orderkey").alias("ord"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("supp"), F.col("l_partkey").alias("part"), ((1 + F.col("l_partkey") % 17) / 40.0).alias("x"), ((1 + F.col("l_suppkey") % 19) / 50.0).alias("y"), ((1 + F.col("l_orderkey") % 23) / 60.0).alias("z"))
    x, y, z = F.col("x"), F.col("y"), F.col("z")
    b = PLANTED[1]
    fall = 0.5 * (x * x * b[0] + y * y * b[1] + z * z * b[2]) + x * y * b[3] + x * z * b[4] + y * z * b[5]
    rows = rows.withColumns({"i": F.exp(PLANTED[0] - fall), "sigma": F.lit(1.0), "d": 1 / F.sqrt(x * x + y * y + z * z), "row_id": F.struct("ord", "line", "supp", "part")})
    return wilson.normalised(rows, "row_id").select("ord", "line", "supp", "part", F.round("i", 5).alias("i"))
