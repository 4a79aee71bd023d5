"""The corpus pipeline: quality, exact and near duplicates, mixing, packing.

Every stage takes (spark, docs, sf_dir) and gives a DataFrame, which run() writes as Parquet
and reads back as the next stage's docs. All but the last give the columns of documents. The
training order of mix is the order of its rows in its files, by which pack goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lingmill.llm import exact_dedup, jaccard_join, mixing, packing, quality_classifier
from lingmill.llm.common import stage, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, learnt from the table labels, does not reject."""
    return quality_classifier.accept(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by n-gram Jaccard similarity."""
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix in training order: a document stands as often as its source's target takes it.

    Whole documents only: of the one document per source that the target cuts, a lap counts
    where at least half of it is taken.
    """
    return mixing.repeated(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed token stream, in the mix's training order, with the check sums of their ids."""
    pieces = packing.pack(packing.in_file_order(docs), packing.default_tokenizer(), section=packing.SECTION)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("mix", mix), ("pack", pack)]

#: A trained classifier, shingle sets and token ids are beyond SQL; tests hold the stages
#: against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that are left of the table documents after all stages."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
