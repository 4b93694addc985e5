"""Corpus pipeline: each stage applies one corpus operator to the documents that the stage before it kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet in the shared folder of
spark.checkpoint.dir and reads it again for the next stage. All stages but the last return the columns of documents.
Stages that drop rows number them first and decide on each row by itself, so rows without a doc_id or of one doc_id are told apart.

Defined results, stage by stage those of its operator: null texts count as empty, are kept by the filtering stages (as one group of
copies) and leave in the mix, which takes words; rows without a doc_id and rows that repeat one are rows of their own; empty and
very long texts are read whole; an empty table passes every stage; columns beyond those of documents are carried along under their
names, also where an operator uses such a name itself.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evalgate.llm import exact_dedup, mixing, pieces, simhash_dedup, toxicity
from evalgate.llm.common import free_name, numbered, table
from evalgate.session import checkpointed, shared_folder

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


#: Most dropped rows that are broadcast to the documents; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def _without(keyed: DataFrame, row: str, dropped: DataFrame) -> DataFrame:
    """The numbered rows but for the dropped numbers, each row by itself."""
    dropped = checkpointed(dropped.select(row))
    if dropped.count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return keyed.join(dropped, row, "left_anti").drop(row)


def _by_row(keyed: DataFrame, row: str) -> DataFrame:
    """What a dedup operator sees: the row's number in place of doc_id."""
    return keyed.select(F.col(row).alias("doc_id"), "text")


def _not_chosen(keyed: DataFrame, row: str, groups: DataFrame, chosen: Callable[[Column], Column]) -> DataFrame:
    """Rows of `groups` (row, group) but the chosen one of each group, by doc_id (null is the smallest) and then by number."""
    members = checkpointed(groups.join(keyed.select(row, F.col("doc_id").cast("long").alias("id")), row).select(row, "group", "id"))
    stays = members.groupBy("group").agg(chosen(F.struct("id", row)).alias("best")).select(F.col("best").getField(row).alias(row))
    return members.join(stays, row, "left_anti")


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the compression-distance score accepts."""
    keyed, row = numbered(docs)
    return _without(keyed, row, toxicity.scored(keyed, table(spark, sf_dir, "labels"), row=row).filter("predicted <> 0"))


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    keyed, row = numbered(docs)
    groups = exact_dedup.deduplicate(_by_row(keyed, row)).select(F.col("doc_id").alias(row), F.col("keep_id").alias("group"))
    return _without(keyed, row, _not_chosen(keyed, row, groups, F.max))


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints: the one with the smallest doc_id."""
    keyed, row = numbered(docs)
    groups = simhash_dedup.near_duplicates(_by_row(keyed, row)).select(F.col("doc_id").alias(row), F.col("component_id").alias("group"))
    return _without(keyed, row, _not_chosen(keyed, row, groups, F.min))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The texts in the shares of their sources' weights; a document comes once for each pass that takes words of it.

    The stage's documents are a written table, whose scan numbers its rows alike every time.
    """
    row = free_name("__row", docs)
    return mixing.mixed_texts(docs.withColumn(row, F.monotonically_increasing_id()), row=row)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text of the mix: doc_id, n_tokens, ids and the hash of the text that they decode to."""
    return pieces.tokenized(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", without_toxic), ("exact_dedup", without_copies), ("simhash_dedup", without_near_copies), ("mixing", mixed), ("pieces", encoded),
]

#: The stages rest on XXH64 and trained models, which the check SQL cannot express; tests compare them with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, place = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{number}_{name}")
        docs = spark.read.parquet(f"{place}/{number}_{name}")
    return docs
