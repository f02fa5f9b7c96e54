"""Row selection: filters, samples, limits, counts of keys and flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .merging import group_medians, number_rows

# Bits of the flags column.
FLAGS = {
    "predicted": 0, "observed": 1, "indexed": 2, "used_in_refinement": 3, "strong": 5, "integrated_sum": 8, "integrated_prf": 9, "overlapped_bg": 11, "overlapped_fg": 12,
    "foreground_bad": 14, "background_bad": 15, "centroid_outlier": 17, "failed_summation": 19, "excluded_for_scaling": 23, "outlier_in_scaling": 24, "scaled": 26,
}


def has_flag(name: str, column: str = "flags") -> Column:
    return F.col(column).bitwiseAND(F.lit(1 << FLAGS[name])) != 0


def set_flag(name: str, where: Column, column: str = "flags") -> Column:
    """The flags with one set where a condition holds and cleared elsewhere."""
    bit = F.lit(1 << FLAGS[name])
    cleared = F.col(column).bitwiseAND(F.bitwise_not(bit))
    return F.when(where, cleared.bitwiseOR(bit)).otherwise(cleared)


def flag_counts(rows: DataFrame, by: str, column: str = "flags") -> DataFrame:
    """Rows of each id, and those with each flag."""
    return rows.groupBy(by).agg(F.count("*").alias("rows"), *(F.sum(has_flag(n, column).cast("long")).alias(n) for n in FLAGS))


def for_scaling(rows: DataFrame, d_min: float, d_max: float, least_partiality: float = 0.4) -> DataFrame:
    """Rows fit for scaling: integrated, positive variance, finite values, in resolution, partial enough, indexed."""
    finite = ~F.isnan("i") & (F.abs("i") < float("inf"))
    return rows.filter(has_flag("integrated_prf") & (F.col("v") > 0) & finite & F.col("d").between(d_min, d_max) & (F.col("partiality") >= least_partiality) & ~((F.col("h") == 0) & (F.col("k") == 0) & (F.col("l") == 0)))


def strong_half(rows: DataFrame, value: str) -> DataFrame:
    """Rows at or above the median."""
    middle = group_medians(rows.withColumn("_all", F.lit(0)), "_all", value).select(F.col("median").alias("_median"))  # one row
    return rows.join(F.broadcast(middle), F.col(value) >= F.col("_median")).drop("_median")


def sample_groups(rows: DataFrame, keys: list[str], row_id: str, groups: int, observations: int) -> DataFrame:
    """Whole groups of two or more in a hashed order, until both numbers are reached; a sampling operator.

    Groups before the end are found by running sums over hash bins, then within one bin; no global order is made in a task.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1").withColumn("_h", F.conv(F.substring(F.md5(F.concat_ws("|", *keys).cast("binary")), 1, 15), 16, 10).cast("long"))
    sizes = sizes.withColumn("_bin", F.shiftright("_h", 48))
    bins = sizes.groupBy("_bin").agg(F.count("*").alias("_g"), F.sum("_n").alias("_o"))  # 4096 rows at most
    w = Window.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumns({"_g0": F.coalesce(F.sum("_g").over(w), F.lit(0)), "_o0": F.coalesce(F.sum("_o").over(w), F.lit(0))})
    open_bins = bins.filter((F.col("_g0") < groups) | (F.col("_o0") < observations)).select("_bin", "_g0", "_o0")
    inside = sizes.join(F.broadcast(open_bins), "_bin")
    own = Window.partitionBy("_bin").orderBy("_h", *keys).rowsBetween(Window.unboundedPreceding, -1)
    before_g = F.col("_g0") + F.coalesce(F.count("*").over(own), F.lit(0))
    before_o = F.col("_o0") + F.coalesce(F.sum("_n").over(own), F.lit(0))
    chosen = inside.withColumns({"_bg": before_g, "_bo": before_o}).filter((F.col("_bg") < groups) | (F.col("_bo") < observations))
    return rows.join(chosen.select(*keys), keys, "left_semi")


def frequent_keys(rows: DataFrame, keys: list[str], frames: str, fraction: float, least: int = 2) -> DataFrame:
    """Keys seen in at least a fraction of all frames and `least` of them, most first (hot pixels)."""
    seen = rows.groupBy(*keys).agg(F.countDistinct(frames).alias("seen"))
    total = rows.agg(F.countDistinct(frames).alias("_frames"))
    hot = seen.join(F.broadcast(total), (F.col("seen") >= F.col("_frames") * fraction) & (F.col("seen") >= least))
    return hot.drop("_frames").orderBy(F.desc("seen"), *keys)


def worst(rows: DataFrame, by: Column, row_id: str, n: int) -> DataFrame:
    """The n rows with the largest value, ties by id: a top-k, not a sort of all."""
    return rows.withColumn("badness", by).orderBy(F.desc("badness"), row_id).limit(n)


def split_by(rows: DataFrame, models: DataFrame, key: str, has: Column) -> tuple[DataFrame, DataFrame]:
    """Rows whose model has something, and the others."""
    with_it = models.filter(has).select(key)
    return rows.join(with_it, key, "left_semi"), rows.join(with_it, key, "left_anti")


def histogram(rows: DataFrame, at: str, low: float, high: float, columns: int) -> DataFrame:
    """Counts in equal columns of [low, high); empty ones too."""
    bin_of = F.least(F.floor((F.col(at) - low) / (high - low) * columns), F.lit(columns - 1)).cast("long")
    found = rows.filter((F.col(at) >= low) & (F.col(at) <= high)).groupBy(bin_of.alias("column")).agg(F.count("*").alias("n"))
    every = rows.sparkSession.range(columns).withColumnRenamed("id", "column")
    return every.join(found, "column", "left").select("column", F.coalesce("n", F.lit(0)).alias("n"))


def at_positions(rows: DataFrame, positions: DataFrame, row_id: str = "row_id") -> DataFrame:
    """The rows of a table at the given positions, as often as each is given; a position that no row has is an error.

    The error is raised by the task that meets it, so no job runs before the result is used.
    """
    wanted = positions.select(F.col(positions.columns[0]).alias("_at"))
    found = wanted.join(rows.withColumn("_known", F.lit(True)), F.col("_at") == F.col(row_id), "left")
    checked = F.when(F.col("_known"), F.col("_at")).otherwise(F.raise_error(F.concat(F.lit("no row at position "), F.col("_at").cast("string"))).cast("long"))
    return found.withColumn(row_id, checked.cast(rows.schema[row_id].dataType)).select(*rows.columns)


def for_postrefinement(rows: DataFrame, residuals: tuple[str, str, str] = ("xres", "yres", "zres")) -> DataFrame:
    """Rows summed in integration with finite residuals on all three axes and an index."""
    finite = F.lit(True)
    for c in residuals:
        finite = finite & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return rows.filter(has_flag("integrated_sum") & finite & ~((F.col("h") == 0) & (F.col("k") == 0) & (F.col("l") == 0)))


def held_out(rows: DataFrame, excluded: DataFrame, row_id: str, part: float, seed: int = 0) -> DataFrame:
    """Rows that aren't excluded, with `held_out`: a hashed share of them (the first 32 bits of the MD5 of `seed:id`), the same in every run."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(row_id).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long")
    return rows.join(excluded.select(row_id).distinct(), row_id, "left_anti").withColumn("held_out", bits < int(part * (1 << 32)))


def joined_experiments(lists: list[DataFrame], models: list[str]) -> DataFrame:
    """Experiment lists made one: ids follow on in the order of the lists, and a model met in several is kept once, by its content.

    Each list has id (from 0) and models as strings. Columns `<model>_id` name the distinct models, numbered by content.
    """
    out = None
    for n, own in enumerate(lists):
        own = own.withColumn("_list", F.lit(n))
        out = own if out is None else out.unionByName(own)
    sizes = out.groupBy("_list").agg((F.max("id") + 1).alias("_size"))  # a row a list
    before = Window.orderBy("_list").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_list", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"))
    out = out.join(F.broadcast(starts), "_list").withColumn("id", F.col("id") + F.col("_start")).drop("_list", "_start")
    for m in models:
        numbered = number_rows(out.select(m).filter(F.col(m).isNotNull()).distinct(), [F.asc(m)]).select(m, F.col("row_number").alias(f"{m}_id"))
        out = out.join(numbered, m, "left")
    return out


def sliced_experiments(experiments: DataFrame, first: int, last: int) -> DataFrame:
    """Experiments whose scan meets images first to last, cut to them; ids stay. Columns first_image, last_image, start (degrees), width."""
    low, high = F.greatest("first_image", F.lit(first)), F.least("last_image", F.lit(last))
    cut = experiments.withColumns({"_low": low, "_high": high}).filter("_low <= _high")
    cut = cut.withColumns({"start": F.col("start") + (F.col("_low") - F.col("first_image")) * F.col("width"), "first_image": F.col("_low"), "last_image": F.col("_high")})
    return cut.drop("_low", "_high")
