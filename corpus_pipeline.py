"""Documents to packed training sequences: each stage is one operator of ``ledgerlens.llm``.

A stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as
the next one's documents.  All but the last return the columns of the documents.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ledgerlens.llm import compression_quality, exact_dedup, mixing, near_dedup, packing
from ledgerlens.llm.common import by_name, stage


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return compression_quality.keep(docs, by_name(spark, sf_dir, "labels"))


def unique_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return exact_dedup.keep(docs)


def one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dedup.keep(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mix(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [("quality", good_quality), ("exact_dedup", unique_texts), ("near_dedup", one_of_near_copies), ("mixing", mixed), ("packing", packed)]

#: Trained scores and a tokenizer lie on the way, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = by_name(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stage(docs, name)
    return docs
