"""Queries of the operators on training text, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .exact_dedup import exact_dedup

    return exact_dedup(table(spark, sf_dir, "documents"))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)
"""


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import quality

    return quality(table(spark, sf_dir, "documents")).drop("spans")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import substring_dedup

    out = substring_dedup(table(spark, sf_dir, "documents"), length=400, keep_first=False)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat_format import chat_format

    return chat_format(table(spark, sf_dir, "conversations"))


def op5_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_output import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix

    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "copies")


#: Labelled rows of either label that the lexicon is learned from, at most.
TOXIC_SAMPLE = 3000


def is_held_out(column: str = "doc_id"):
    return F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(3)) == 1


def learned_lexicon(spark: SparkSession, sf_dir: str):
    from .toxicity import learn, training_rows

    labels = table(spark, sf_dir, "labels").filter(~is_held_out())
    try:
        return learn(*training_rows(table(spark, sf_dir, "documents"), labels, TOXIC_SAMPLE))
    finally:
        give_back()  # the driver's memory, of the texts


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxicity

    out = toxicity(table(spark, sf_dir, "documents"), learned_lexicon(spark, sf_dir))
    return out.select("doc_id", F.coalesce(is_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"), "weight", "n_words")


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import jaccard_join

    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard

    out = shard(table(spark, sf_dir, "documents"), shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import round_trip

    return round_trip(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .prefix_trie import prefix_trie

    return prefix_trie(table(spark, sf_dir, "conversations"))


#: Nodes are named by all their turns; an ancestor's name is a prefix of theirs. The CRC is taken bit by bit.
OP12_SQL = """
WITH turns AS (
    SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS place, strlen(text) AS n_bytes,
           md5(length(role) || ':' || role || ':' || text) AS own
    FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
convs AS (
    SELECT conv_id, conv_id - conv_id % 5 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)), lambda crc, c:
               list_reduce(list_concat([xor(crc, c)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 9 AS h
    FROM (SELECT DISTINCT conv_id FROM turns)),
built AS (
    SELECT c.conv_id, 0 AS part, t.place, t.n_bytes, t.own FROM convs c JOIN turns t ON t.conv_id = c.base AND t.place <= c.h
    UNION ALL
    SELECT c.conv_id, 1, t.place, t.n_bytes, t.own FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.place > c.h),
prefixes AS (
    SELECT conv_id, row_number() OVER w AS depth, n_bytes, string_agg(own, '') OVER w AS name, count(*) OVER (PARTITION BY conv_id) AS length
    FROM built WINDOW w AS (PARTITION BY conv_id ORDER BY part, place)
    UNION ALL
    SELECT c.conv_id, 0, 0, '', coalesce(b.length, 0) FROM convs c LEFT JOIN (SELECT conv_id, count(*) AS length FROM built GROUP BY conv_id) b USING (conv_id)),
nodes AS (
    SELECT name, depth, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * max(n_bytes) AS saved,
           sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE depth = length), '')) AS ends_sha256
    FROM prefixes GROUP BY name, depth),
linked AS (
    SELECT n.*, p.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth = n.depth + 1 AND left(c.name, 32 * n.depth) = n.name) AS n_children
    FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.name = left(n.name, 32 * (n.depth - 1))),
below AS (
    SELECT left(name, 32 * d) AS name, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum(saved) AS saved_tokens
    FROM (SELECT name, n_children, saved, unnest(range(depth + 1)) AS d FROM linked) GROUP BY 1)
SELECT conv_id, depth::BIGINT AS depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens::BIGINT AS saved_tokens, ends_sha256
FROM linked JOIN below USING (name)
"""


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    return align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_exact_dedup, op2_quality, op3_substring_dedup, op4_chat_format, op5_token_output, op6_mixing, op7_toxicity, op8_jaccard_join, op9_sharding, op10_packing, op11_sentencepiece, op12_prefix_trie, op13_alignment)}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op12_prefix_trie": OP12_SQL}
