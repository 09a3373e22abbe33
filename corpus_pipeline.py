"""From documents to packed training sequences: a classifier, near copies, a mix of sources, packing."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tidegrid.llm import jaccard, mixing, packing, quality
from tidegrid.llm.common import shared_path, table

#: Documents with a smaller probability of good quality go.
LEAST_QUALITY = 0.3


def classify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects; it learns from the labelled ones among them."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.with_score(docs, model, score="__quality").where(f"__quality >= {LEAST_QUALITY}").drop("__quality")


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, the one with the smallest id."""
    return jaccard.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's target asks."""
    return mixing.mix(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the tokens of what is left into sequences."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", classify), ("near copies", deduplicate), ("mix", mix), ("pack", pack)]

#: Neither the trained classifier nor the packing can be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``, each written as Parquet to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            path = shared_path(spark, f"stage-{k}")
            out.write.parquet(path)
            out = spark.read.parquet(path)
        docs = out
    return docs
