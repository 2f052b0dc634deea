"""A training-data pipeline of five stages over the table documents.

Each stage takes (spark, docs, sf_dir) and works on all rows of docs. All but the last return the columns of docs, extra ones with them. Null texts count as empty. Rows without an id are no copies and hold no items, and stay where the classifier keeps them. Rows that repeat an id share its fate: where one of its texts goes as a copy or a leak, the id goes. Empty input gives empty output in every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factloom.llm import decontamination, exact_dedup, near_dedup, packing, quality
from factloom.llm.common import importable, saved
from factloom.llm.queries import table, tokenizer

#: Ids of rows that go that may be broadcast; more of them are joined by shuffle.
BROADCAST_IDS = 1_000_000


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids."""
    ids = saved(ids.select("doc_id").distinct(), "dropped")
    return docs.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_anti").select(docs.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier predicts as good. Without labels for any of them, all are."""
    score = quality.scorer(quality.train(docs, table(spark, sf_dir, "labels")))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.where(score(text) >= quality.THRESHOLD)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal normalised text: the smallest id; rows that repeat it stay with it."""
    importable(spark)
    return without(docs, exact_dedup.exact_dedup(docs).where("NOT kept"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the smallest id that a chain of links reaches."""
    importable(spark)
    return without(docs, near_dedup.near_dedup(docs).where("NOT kept AND doc_id IS NOT NULL"))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; without items, all."""
    return without(docs, decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, in sequences; rows that repeat an id are packed as they come, rows without one too."""
    importable(spark)
    return packing.pack(docs, tokenizer())


STAGES = [
    ("quality classifier", keep_quality),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: A trained classifier and a tokenizer are not SQL.
ORACLE_SQL = None
