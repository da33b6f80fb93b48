"""The corpus pipeline: documents in, sharded training data out.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame that is written as Parquet and read again as the next
stage's ``docs``.  All but the last return the columns of ``documents``.

Edge cases, for every stage: an empty table gives an empty one; rows with NULLs, empty or very long texts stay unless the
stage's own decision drops them (a row without words has no near copies and no benchmark passage); repeated rows are
one class of near copies; extra columns come through under any name, the last stage apart, which returns its own.  Without
labels of both kinds the quality model scores all texts alike, by the share of good labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mediafold.llm import decontaminate, minhash_join, mixing, quality, sharding
from mediafold.llm.common import documents, held_out, set_apart, stored
from mediafold.sources.tables import load

QUALITY_THRESHOLD = 0.7
N_SHARDS = 40


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents that the additive quality model rejects; ids are only used to find training labels."""
    model = quality.fit(docs, load(spark, sf_dir, "labels"), lambda c: ~held_out(c, 4, 2))
    inside, restored = set_apart(docs)
    return restored(quality.with_score(inside, model, "_quality").where(F.col("_quality") >= QUALITY_THRESHOLD))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each class of five-word Jaccard similarity 0.8 or more."""
    return minhash_join.keep_one(docs, minhash_join.jaccard_classes(docs, threshold=0.8))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut benchmark passages out of the texts; clean documents stay as they are."""
    return decontaminate.remove_spans(docs, load(spark, sf_dir, "benchmark"), window=10)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put all documents into the order in which every source follows its target weight."""
    return mixing.in_mixed_order(docs, mixing.pfair_mix(docs))


def deal_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deal all documents to shards of near equal bytes; slots inside a shard follow the mixed order.

    Rows read from Parquet have no order, so the order, which depends on the documents alone, is drawn up again here.
    """
    return sharding.kd_shards(docs, n_shards=N_SHARDS, placed=mixing.pfair_mix(docs))


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", cut_benchmark),
    ("mixing sources to target weights", mix_sources),
    ("sharding", deal_shards),
]

#: A trained model and a tree of cuts are beyond SQL; the tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn over the whole table ``documents``; the result has one row per document kept."""
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, f"stage{i}")
    return docs
