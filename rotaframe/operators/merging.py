"""Grouped statistics of repeated observations: merging, agreement and completeness.

All are DataFrame aggregations with map-side partial sums. A group is given by
its key columns (the symmetry-unique index, as a rule); shells and other bins
come as columns. Names of value columns are parameters; results have fixed names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def combine_partials(rows: DataFrame, keys: list[str], row_id: str = "row_id", partiality: str = "partiality", profile: str = "i_prf", profile_var: str = "v_prf", total: str = "i_sum", total_var: str = "v_sum", full: float = 0.99, wanted: Column | None = None) -> DataFrame:
    """Rows with the pieces of a reflection split over images made one; all other rows stay as they are, with 1 as `pieces`.

    Pieces are wanted rows under `full` partiality with positive variances and a key without nulls, and only where a key has
    two or more. Profile values and their variances are means weighted by I^2 / var (0 and the sum of the variances
    where nothing weighs); sums, their variances and partialities are added. The row with the least id carries the result.
    """
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    piece = F.coalesce((F.lit(True) if wanted is None else wanted) & (F.col(partiality) < full) & (F.col(profile_var) > 0) & (F.col(total_var) > 0) & known, F.lit(False))
    rows = rows.withColumn("_piece", piece)
    weight = F.col(profile) * F.col(profile) / F.col(profile_var)
    sums = rows.filter("_piece").groupBy(*keys).agg(
        F.count("*").alias("_n"),
        F.min(row_id).alias("_first"),
        *(F.sum(v).cast("double").alias(n) for n, v in (("_w", weight), ("_wi", weight * F.col(profile)), ("_wv", weight * F.col(profile_var)), ("_v", F.col(profile_var)))),
        *(F.sum(c).alias(f"_{c}") for c in (total, total_var, partiality)),
    )
    weighs = F.col("_w") > 0
    new = {
        profile: F.when(weighs, F.col("_wi") / F.col("_w")).otherwise(F.lit(0.0)),
        profile_var: F.when(weighs, F.col("_wv") / F.col("_w")).otherwise(F.col("_v")),
        **{c: F.col(f"_{c}") for c in (total, total_var, partiality)},
    }
    held = rows.join(sums.filter("_n >= 2"), keys, "left")
    joined = F.col("_piece") & F.col("_n").isNotNull()
    kept = held.filter(~joined | (F.col(row_id) == F.col("_first")))
    columns = [(F.when(joined, new[c]).otherwise(F.col(c)) if c in new else F.col(c)).alias(c) for c in rows.columns if c != "_piece"]
    return kept.select(*columns, F.when(joined, F.col("_n")).otherwise(F.lit(1)).cast("long").alias("pieces"))


def correct_intensity(rows: DataFrame) -> DataFrame:
    """Profile values times lp / qe, sums times lp / (qe p); variances by the square of the factor."""
    f, g = F.col("lp") / F.col("qe"), F.col("lp") / (F.col("qe") * F.col("partiality"))
    return rows.withColumns({"i_prf": F.col("i_prf") * f, "v_prf": F.col("v_prf") * f * f, "i_sum": F.col("i_sum") * g, "v_sum": F.col("v_sum") * g * g})


def merged_scaled(rows: DataFrame, keys: list[str], value: str = "i", variance: str = "v", scale: str = "g") -> DataFrame:
    """Best value of each group: sum(w g I) / sum(w g^2) with w = 1 / var; 0 where nothing weighs."""
    w, g = 1 / F.col(variance), F.col(scale)
    top, bottom = F.sum(w * g * F.col(value)), F.sum(w * g * g)
    return rows.groupBy(*keys).agg(F.coalesce(F.when(bottom > 0, top / bottom), F.lit(0.0)).alias("merged"), F.count("*").alias("n"))


def merged_with_sigma(rows: DataFrame, keys: list[str], value: str, weight: str) -> DataFrame:
    """Weighted mean with the larger of its internal and external error; a single observation keeps its own.

    Deviations are squared after the mean is known, so values far from 0 lose nothing.
    """
    w, x = F.col(weight).cast("double"), F.col(value)
    means = rows.groupBy(*keys).agg(F.count("*").alias("n"), F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"), (F.sum(w * x) / F.sum(w)).alias("mean"))
    off = rows.join(means.select(*keys, "mean"), keys).groupBy(*keys).agg(F.sum(w * (x - F.col("mean")) * (x - F.col("mean"))).alias("spread"))
    scatter = F.col("sw") / (F.col("sw") * F.col("sw") - F.col("sw2")) * F.col("spread")
    sigma = F.when(F.col("n") == 1, F.sqrt(1 / F.col("sw"))).otherwise(F.sqrt(F.greatest(scatter / F.col("n"), 1 / F.col("sw"))))
    return means.join(off, keys).select(*keys, "n", "mean", sigma.alias("sigma"))


def agreement(rows: DataFrame, keys: list[str], value: str, by: list[str], absolute_denominator: bool = False) -> DataFrame:
    """Rmerge, Rmeas and Rpim over groups of two or more, and their plain counts, by bins (`by`) with an overall row.

    by: columns that are constant in a group, such as its shell. The overall row has nulls there.
    """
    # two levels of sums: no observation is shuffled twice, and a large group is reduced on the map side first
    means = rows.groupBy(*keys).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    off = rows.join(means, keys).withColumn("off", F.abs(F.col(value) - F.col("mean")))
    each = off.groupBy(*keys, *by, "n").agg(F.sum("off").alias("off"), F.sum(F.abs(value) if absolute_denominator else F.col(value)).alias("total"))
    many = F.col("n") >= 2
    total = F.sum(F.when(many, F.col("total")))
    out = each.rollup(*by).agg(
        F.sum("n").alias("observations"),
        F.count("*").alias("unique"),
        (F.sum(F.when(many, F.col("off"))) / total).alias("r_merge"),
        (F.sum(F.when(many, F.col("off") * F.sqrt(F.col("n") / (F.col("n") - 1)))) / total).alias("r_meas"),
        (F.sum(F.when(many, F.col("off") * F.sqrt(1 / (F.col("n") - 1)))) / total).alias("r_pim"),
    )
    return out.withColumn("multiplicity", F.col("observations") / F.col("unique"))


def half_sets(rows: DataFrame, keys: list[str], value: str, order: Column) -> DataFrame:
    """Means of two halves of each group, dealt by the parity of the rank in `order`; groups of two or more."""
    w = Window.partitionBy(*keys).orderBy(order)
    half = rows.withColumn("half", F.row_number().over(w) % 2)
    out = half.groupBy(*keys).agg(F.avg(F.when(F.col("half") == 1, F.col(value))).alias("first"), F.avg(F.when(F.col("half") == 0, F.col(value))).alias("second"))
    return out.filter("first IS NOT NULL AND second IS NOT NULL")


def correlation_of_halves(halves: DataFrame, by: list[str], least: int = 3) -> DataFrame:
    """CC half by bins: Pearson's r over groups, 0 under `least` of them."""
    return halves.groupBy(*by).agg(F.count("*").alias("groups"), F.when(F.count("*") >= least, F.coalesce(F.corr("first", "second"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("cc_half"))


def cc_half_by_resolution(rows: DataFrame, keys: list[str], value: str, d: str, order: Column, least: int = 10, bins: int = 50, significance: float = 0.1) -> DataFrame:
    """By bins of equal counts of groups, from low resolution to high: bin, groups, d_min (that of its last group), cc_half and critical.

    Groups of two or more observations count; d is constant in a group. critical is what the correlation of that many
    unrelated pairs exceeds by chance in `significance` of all cases, null for two groups or fewer.
    """
    from rotaframe.functions.stats import student_t_quantile

    halves = half_sets(rows, keys, value, order).join(rows.groupBy(*keys).agg(F.min(d).alias("_d")), keys)
    binned = equal_count_bins(halves, [F.desc("_d"), *(F.asc(k) for k in keys)], least, bins)
    found = correlation_of_halves(binned, ["bin"]).join(binned.groupBy("bin").agg(F.min("_d").alias("d_min")), "bin")
    critical = F.udf(lambda n: None if n <= 2 else (t := student_t_quantile(1 - significance, n - 2)) / (n - 2 + t * t) ** 0.5, "double")  # a row a bin
    return found.select("bin", "groups", "d_min", "cc_half", critical("groups").alias("critical"))


def resolution_shell(d: Column, d_min: float, d_max: float, shells: int) -> Column:
    """Shells of equal steps of 1/d^3, from 0 at d_max; values beyond the ends go to the end shells."""
    low, high = 1 / d_max**3, 1 / d_min**3
    at = (1 / (d * d * d) - low) / (high - low) * shells
    return F.greatest(F.lit(0), F.least(F.floor(at), F.lit(shells - 1))).cast("int")


def equal_count_bins(rows: DataFrame, order: list[Column], least: int = 10, bins: int = 50) -> DataFrame:
    """Bins of max(least, n / bins) rows in the given order; a remainder of under half a bin joins the last one.

    Numbers rows by a range partitioning with running offsets, not in one task.
    """
    numbered = number_rows(rows, order)
    size = F.greatest(F.lit(least), F.floor(F.col("n_rows") / bins))
    whole = F.floor(F.col("n_rows") / size)
    last = F.greatest(F.when(F.col("n_rows") - whole * size < F.floor(size / 2), whole - 1).otherwise(whole), F.lit(0))
    return numbered.withColumn("bin", F.least(F.floor(F.col("row_number") / size), last).cast("int"))


def edge_bins(rows: DataFrame, order: list[Column], bins: int) -> DataFrame:
    """Bins whose edges are the integers n * b / bins."""
    at = F.expr(f"((row_number + 1) * {bins} - 1) DIV n_rows")
    return number_rows(rows, order).withColumn("bin", at.cast("int"))


def without_wilson_outliers(unique: DataFrame, order: list[Column], value: str = "mean", shell: int = 500, limit: float = 16.0) -> DataFrame:
    """Rows whose value is under `limit` times the mean of their run of `shell` rows in the given order; all of a run whose mean isn't positive."""
    numbered = number_rows(unique, order).withColumn("_run", F.expr(f"row_number DIV {shell}"))
    means = numbered.groupBy("_run").agg(F.avg(value).alias("_mean"))
    keep = ~((F.col("_mean") > 0) & (F.col(value) / F.col("_mean") >= limit))
    return numbered.join(means, "_run").filter(keep).drop("_run", "_mean", "row_number", "n_rows")


def order_statistics(rows: DataFrame, by: list[str], value: str, around: float, at: dict[str, str]) -> DataFrame:
    """(by, n, a column for each name of at): the exact values at ranks of each group, ascending from 0, as values_at_ranks finds them."""
    return values_at_ranks(rows, by, value, around, at).groupBy(*by, "n").agg(*(F.max(F.when(F.col("name") == k, F.col("_v"))).alias(k) for k in at))


def values_at_ranks(rows: DataFrame, by: list[str], value: str, around: float, at: dict[str, str]) -> DataFrame:
    """(by, n, name, _v): the exact values at ranks of each group, ascending from 0.

    at: the rank of each name as SQL of the group's size n; around: about where they lie, as a share of the group.
    Nothing is sorted: an approximate bracket cuts each group in three, all parts are counted, and in the part that a rank
    lies in rows are counted by value, so equal values are one row however many they are. The bracket only says how
    much is left to place, not what comes out. rows are read three times, so a costly input should be stored first.
    Null values are left out.
    """
    own = rows.select(*by, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    low, high = max(0.0, around - 0.005), min(1.0, around + 0.005)
    bounds = own.groupBy(*by).agg(F.count("*").alias("n"), F.percentile_approx("_v", [low, high], 1000).alias("_b"))
    parted = own.join(bounds.select(*by, F.col("_b")[0].alias("_low"), F.col("_b")[1].alias("_high")), by)
    parted = parted.select(*by, "_v", F.when(F.col("_v") < F.col("_low"), 0).when(F.col("_v") <= F.col("_high"), 1).otherwise(2).alias("_part"))
    counts = parted.groupBy(*by).agg(F.count("*").alias("n"), *(F.sum((F.col("_part") == i).cast("long")).alias(f"_n{i}") for i in range(2)))
    ranks = counts.select(*by, "n", "_n0", "_n1", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), F.expr(v).cast("long").alias("rank")) for k, v in at.items()))).alias("_r")).select(*by, "n", "_n0", "_n1", "_r.*")
    first = F.when(F.col("rank") < F.col("_n0"), F.lit(0)).when(F.col("rank") < F.col("_n0") + F.col("_n1"), F.lit(1)).otherwise(F.lit(2))
    wanted = ranks.withColumn("_part", first)
    wanted = wanted.withColumn("_rest", F.col("rank") - F.when(F.col("_part") == 0, F.lit(0)).when(F.col("_part") == 1, F.col("_n0")).otherwise(F.col("_n0") + F.col("_n1")))
    cells = parted.join(wanted, [*by, "_part"], "left_semi").groupBy(*by, "_part", "_v").agg(F.count("*").alias("_k"))
    upto = F.sum("_k").over(Window.partitionBy(*by, "_part").orderBy("_v"))
    met = cells.withColumn("_upto", upto).join(wanted.select(*by, "n", "name", "_part", "_rest"), [*by, "_part"])
    return met.filter((F.col("_upto") > F.col("_rest")) & (F.col("_upto") - F.col("_k") <= F.col("_rest"))).select(*by, "n", "name", "_v")


def medians(rows: DataFrame, by: str, values: list[str], upper: bool = False) -> DataFrame:
    """(by, a column for each value): exact medians of each group, of all values in one go.

    upper: the upper of two middle values, else their mean. No task holds a group's values, so few large groups and many equal values are no burden. Null values are left out.
    """
    each = F.explode(F.array(*(F.struct(F.lit(v).alias("_which"), F.col(v).cast("double").alias("_value")) for v in values))).alias("_e")
    found = values_at_ranks(rows.select(by, each).select(by, "_e.*"), [by, "_which"], "_value", 0.5, {"upper": "n DIV 2"} if upper else {"lower": "(n - 1) DIV 2", "upper": "n DIV 2"})
    return found.groupBy(by).agg(*(F.avg(F.when(F.col("_which") == v, F.col("_v"))).alias(v) for v in values))


def group_medians(rows: DataFrame, by: str, value: str, upper: bool = False) -> DataFrame:
    """(by, median) of one value, as medians."""
    return medians(rows.select(by, F.col(value).alias("median")), by, ["median"], upper).filter("median IS NOT NULL")


def number_rows(rows: DataFrame, order: list[Column]) -> DataFrame:
    """row_number from 0 in the given total order, and n_rows; slices are sorted apart and counted.

    Finding the ranges evaluates what comes after the last shuffle of rows once more.
    """
    from .storage import checkpoint

    held = checkpoint(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    held = held.withColumns({"_slice": F.shiftright("_at", 33), "_in": F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))})
    counts = held.groupBy("_slice").agg(F.count("*").alias("_n"))  # one row a slice
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.withColumns({"_start": F.coalesce(F.sum("_n").over(before), F.lit(0)), "n_rows": F.sum("_n").over(Window.partitionBy(F.lit(0)))}).drop("_n")
    return held.join(F.broadcast(starts), "_slice").withColumn("row_number", F.col("_start") + F.col("_in")).drop("_at", "_slice", "_in", "_start")


def running_sums(rows: DataFrame, order: list[Column], weight: str) -> DataFrame:
    """rows with `before`: the sum of weight over all rows before it in the given total order; slices are summed apart, in Arrow batches."""
    from .storage import checkpoint

    whole = rows.schema[weight].dataType.typeName() in ("byte", "short", "integer", "long")
    kind, array = ("long", pa.int64()) if whole else ("double", pa.float64())
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_slice": F.spark_partition_id(), "before": F.col(weight).cast(kind)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            own = np.nan_to_num(batch.column("before").to_numpy(zero_copy_only=False)).astype(array.to_pandas_dtype())
            upto = np.cumsum(own) + total
            total = upto[-1] if len(upto) else total
            yield batch.set_column(batch.schema.get_field_index("before"), "before", pa.array(upto - own, type=array))

    held = checkpoint(ranged.mapInArrow(run, ranged.schema))
    sums = held.groupBy("_slice").agg(F.sum(F.col(weight).cast(kind)).alias("_sum"))  # one row a slice
    starts = sums.select("_slice", F.coalesce(F.sum("_sum").over(Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    return held.join(F.broadcast(starts), "_slice").withColumn("before", F.col("_start") + F.col("before")).drop("_slice", "_start")


def pair_correlations(sets: DataFrame, dataset: str, keys: list[str], value: str, variance: str, least: int = 3) -> DataFrame:
    """Weighted correlation of every two data sets over their common keys, and the effective number of pairs.

    Weights are 1 / (var_a + var_b); n_eff = (sum w)^2 / sum w^2. One join on the keys and one aggregation by pair.
    """
    # a shift changes no correlation, and values far from 0 lose nothing
    means = sets.groupBy(dataset).agg(F.avg(value).alias("_mean"))
    sets = sets.join(means, dataset).withColumn(value, F.col(value) - F.col("_mean"))
    side = lambda s: sets.select(*keys, *(F.col(c).alias(f"{n}_{s}") for c, n in ((dataset, "ds"), (value, "x"), (variance, "v"))))
    both = side("a").join(side("b"), keys).filter("ds_a < ds_b").withColumn("w", 1 / (F.col("v_a") + F.col("v_b")))
    w, x, y = F.col("w"), F.col("x_a"), F.col("x_b")
    s = both.groupBy("ds_a", "ds_b").agg(F.count("*").alias("n"), F.sum(w).alias("sw"), F.sum(w * w).alias("sw2"), F.sum(w * x).alias("sx"), F.sum(w * y).alias("sy"), F.sum(w * x * x).alias("sxx"), F.sum(w * y * y).alias("syy"), F.sum(w * x * y).alias("sxy"))
    cov = F.col("sxy") - F.col("sx") * F.col("sy") / F.col("sw")
    norm = F.sqrt((F.col("sxx") - F.col("sx") * F.col("sx") / F.col("sw")) * (F.col("syy") - F.col("sy") * F.col("sy") / F.col("sw")))
    return s.filter(F.col("n") >= least).select("ds_a", "ds_b", "n", F.when(norm > 0, cov / norm).otherwise(F.lit(0.0)).alias("cc"), (F.col("sw") * F.col("sw") / F.col("sw2")).alias("n_eff"))


def weighted_rmeas(rows: DataFrame, keys: list[str], value: str = "i", variance: str = "v", scale: str = "g", by: list[str] | None = None) -> DataFrame:
    """Rmeas about the weighted mean of each group, over groups of two or more; by: columns that are constant in a group."""
    by = by or []
    own = [*keys, *by]
    g, w, x = F.col(scale), F.col(scale) * F.col(scale) / F.col(variance), F.col(value) / F.col(scale)
    sums = rows.groupBy(*own).agg(F.count("*").alias("_n"), F.sum(w).alias("_den"), F.sum(g * F.col(value) / F.col(variance)).alias("_num")).filter("_n >= 2 AND _den > 0")
    off = F.sqrt(F.col("_n") / (F.col("_n") - 1)) * F.abs(x - F.col("_num") / F.col("_den"))
    out = rows.join(sums, own).groupBy(*by).agg(F.sum(off).alias("_top"), F.sum(x).alias("_bottom"))
    return out.select(*by, F.when(F.col("_bottom") > 0, F.col("_top") / F.col("_bottom")).otherwise(F.lit(0.0)).alias("r_meas"))


def combined_intensity(rows: DataFrame, mid: Column) -> DataFrame:
    """i and v from profile (i_prf, v_prf) and sum (i_sum, v_sum): w = 1 / (1 + (I_sum / I_mid)^3) of the profile.

    I_mid 0: profiles alone; infinite: sums alone; a row without a sum keeps its profile. Sigmas are mixed as values are.
    """
    w = F.when(F.col("i_sum").isNull() | (mid == 0), F.lit(1.0)).when(mid == float("inf"), F.lit(0.0)).otherwise(1 / (1 + F.pow(F.greatest(F.col("i_sum"), F.lit(0.0)) / mid, F.lit(3.0))))
    sigma = F.col("_w") * F.sqrt("v_prf") + (1 - F.col("_w")) * F.sqrt(F.coalesce("v_sum", "v_prf"))
    out = rows.withColumn("_w", w)
    return out.withColumns({"i": F.col("_w") * F.col("i_prf") + (1 - F.col("_w")) * F.coalesce("i_sum", F.lit(0.0)), "v": sigma * sigma}).drop("_w")


def combination_choice(rows: DataFrame, keys: list[str], candidates: list[float] | None = None, scale: str | None = None) -> DataFrame:
    """Weighted Rmeas of combined intensities for each I_mid, and which is best: the least, the first of equal ones.

    candidates: 0, infinity and the powers of ten from 10 to under the largest sum, unless given.
    """
    spark = rows.sparkSession
    if candidates is None:
        biggest = max(1.0, rows.agg(F.max("i_sum")).first()[0] or 1.0)
        candidates = [0.0, float("inf")]
        while (power := 10.0 ** (len(candidates) - 1)) < biggest:
            candidates.append(power)
    mids = F.broadcast(spark.createDataFrame([(float(c), i) for i, c in enumerate(candidates)], "mid double, nth int"))  # as long as the list
    scaled = rows.withColumn("_g", F.col(scale) if scale else F.lit(1.0))
    found = weighted_rmeas(combined_intensity(scaled.join(mids), F.col("mid")), keys, "i", "v", "_g", ["mid", "nth"])
    best = found.agg(F.min_by("mid", F.struct("r_meas", "nth")).alias("best"))  # one row
    return found.join(F.broadcast(best)).select("mid", "r_meas", (F.col("mid") == F.col("best")).alias("chosen"))


def completeness(unique: DataFrame, possible: DataFrame, shell: str) -> DataFrame:
    """Observed over possible unique reflections by shell, and over all (null shell)."""
    seen = unique.rollup(shell).agg(F.count("*").alias("seen"))
    could = possible.rollup(shell).agg(F.count("*").alias("possible"))
    return could.join(seen, could[shell].eqNullSafe(seen[shell]), "left").select(could[shell], "possible", F.coalesce("seen", F.lit(0)).alias("seen"), (F.coalesce("seen", F.lit(0)) / F.col("possible")).alias("completeness"))


def intensity_moments(rows: DataFrame, shell: str, value: str) -> DataFrame:
    """Mean |E^2 - 1|, second moment and N(z) at z = 0.1 ... 1 of values normalised in their shell."""
    z = F.col(value) / F.col("shell_mean")
    means = rows.groupBy(shell).agg(F.avg(value).alias("shell_mean"))
    normal = rows.join(means, shell).filter("shell_mean > 0").withColumn("z", z)
    below = [F.avg((F.col("z") <= k / 10).cast("double")).alias(f"n_{k}") for k in range(1, 11)]
    return normal.agg(F.count("*").alias("n"), F.avg(F.abs(F.col("z") - 1)).alias("mean_abs_e2"), F.avg(F.col("z") * F.col("z")).alias("moment_2"), *below)
