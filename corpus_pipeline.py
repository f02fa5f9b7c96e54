"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input.

Defined cases: a null text counts as empty in every stage and stays null in its row; empty texts are copies of one
another in exact dedup, linked with nothing in near dedup and never needed by the mixture; rows with a null id are
kept by toxicity and near dedup like others; of repeated rows one stays in exact dedup; an empty table gives an empty
result after every stage; columns beyond doc_id, text and source may have any name and go through unchanged up to
the mixture, and packing returns pieces instead.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotaframe.llm import exact_dedup, jaccard_join, mixing, packing, toxicity
from rotaframe.llm.common import shared_folder, table
from rotaframe.llm.queries import learned_lexicon, vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents with a toxicity score of 0.7 or more go."""
    return toxicity.drop_toxic(docs, learned_lexicon(spark, sf_dir), 0.7)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 1: of equal texts, the document with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: of documents linked by five-word shingles at a Jaccard similarity of 0.75, the one with the least doc_id stays."""
    return jaccard_join.keep_one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: documents as often as the mixture takes them."""
    return mixing.repeat_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: pieces of documents in sequences of 4096 token ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: Learned weights, components and token ids can't be said in SQL; tests/llm/test_pipeline.py holds run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        out = out.withColumns({c: F.col(c).cast("string") for c, kind in out.dtypes if kind == "void"})
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return docs
