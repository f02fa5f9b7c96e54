"""Exact dedup by a heavy-hitter split, in DataFrame functions alone.

Every row is reduced to its row number, id and SHA-256 digest; the texts are
read once and never shuffled. A Misra-Gries summary with a fixed number of
counters (Spark's freqItems, which decrements all counters when a new item
finds none free) names every digest that more than one row in `counters` has.
Its candidates are counted exactly, and those that prove frequent, `counters`
rows at most, are broadcast: their copies are settled on the map side. All
other digests are grouped and joined by an ordinary shuffle, where no group
holds more than one row in `counters`.

Defined cases: a null text counts as empty; null ids sort below all others;
repeated rows (same id, same text) are copies, of which one row stays; an empty
table gives an empty result; columns beyond the two named ones are not read, so
their names can't clash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, text_or_empty, with_own_names


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = 512) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for each row of docs.

    Of equal texts, the row with the largest id stays.
    """
    rows = checkpoint(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.monotonically_increasing_id().alias("row"),
            F.unhex(F.sha2(text_or_empty(text_col).cast("binary"), 256)).alias("digest"),
        )
    )
    winners = _winners(rows, counters)
    frequent = rows.join(F.broadcast(winners), "digest")
    others = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    rare = others.join(_groups(others), "digest")
    return frequent.unionByName(rare).select(
        "doc_id",
        F.col("best.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("best.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def _groups(rows: DataFrame) -> DataFrame:
    return rows.groupBy("digest").agg(F.count("*").alias("group_size"), F.max(F.struct("doc_id", "row")).alias("best"))


def _winners(rows: DataFrame, counters: int) -> DataFrame:
    """The digests proven to be in at least one row in `counters`; so at most `counters` of them."""
    n = rows.count()
    summary = rows.select(F.hex("digest").alias("digest")).stat.freqItems(["digest"], 1 / counters)
    candidates = summary.select(F.explode("digest_freqItems").alias("hex")).select(F.unhex("hex").alias("digest"))
    verified = _groups(rows.join(F.broadcast(candidates), "digest"))
    return checkpoint(verified.filter((F.col("group_size") > 1) & (F.col("group_size") * counters >= n)))


@with_own_names
def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that exact_dedup keeps, with all their columns."""
    verdict = exact_dedup(docs, id_col, text_col)
    dropped = verdict.filter(~F.col("kept")).groupBy(F.col("doc_id").alias("_drop_id")).agg(F.count("*").alias("_drops"))
    held = docs.join(dropped, F.col(id_col).eqNullSafe(F.col("_drop_id")), "left")
    alone = held.filter(F.col("_drops").isNull()).select(*docs.columns)
    # an id that also has a row that stays: repeated rows, or one id on several texts
    again = held.filter(F.col("_drops").isNotNull())
    stays = verdict.filter("kept").select(F.col("doc_id").alias("_keep_id"), F.col("text_sha256").alias("_keep_sha"))
    match = F.col(id_col).eqNullSafe(F.col("_keep_id")) & (F.sha2(text_or_empty(text_col).cast("binary"), 256) == F.col("_keep_sha"))
    return alone.unionByName(again.join(stays, match, "left_semi").select(*docs.columns).dropDuplicates([id_col, text_col]))
