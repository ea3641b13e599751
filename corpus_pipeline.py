"""A corpus from raw documents to packed sequences: quality, toxicity, exact and near duplicates, packing.

Each stage takes the documents that the stage before has kept; all but the last return the columns of documents."""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convan.functions.session import reachable
from convan.llm import exact_dedup, near_dedup, packing, quality, toxicity
from convan.llm.common import crc_of_id, saved, table


def fresh(name: str) -> str:
    """A column name that no table has."""
    return f"_{name}_{uuid.uuid4().hex}"


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier gives at least 0.7.

    Null and empty texts are scored like texts without words; repeated rows share a decision; without labels every score is 0.5,
    so all documents go; an empty table stays empty. Columns may have any name."""
    model = quality.fit(docs, table(spark, sf_dir, "labels").where(crc_of_id() % 4 != 2))
    name = fresh("quality")
    return docs.withColumn(name, quality.score(docs, model)).where(F.col(name) >= 0.7).drop(name)


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity lexicon gives less than 0.5.

    Null and empty texts have no hits and stay; repeated rows share a decision; without labels the starting lexicon decides; an
    empty table stays empty. Columns may have any name."""
    lexicon = toxicity.fit(docs, table(spark, sf_dir, "labels").where(crc_of_id() % 5 != 0))
    name = fresh("toxicity")
    return docs.withColumn(name, toxicity.score(docs, lexicon)).where(F.col(name) < 0.5).drop(name)


def no_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts: that with the largest id.

    Null texts equal empty ones. A row with a null id stays only if all ids of its group are null. Where an id repeats with
    different texts, each text is a group of its own; of rows with the same id and text one stays, the least by its columns."""
    kept = exact_dedup.exact_dedup(docs, keep="max").where("kept").select(F.struct("doc_id", "text_sha256").alias("_key"))
    # Structs, as null ids equal each other in them. Repeated rows are reduced before they meet.
    key = F.struct("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256")).alias("_key")
    rows = docs.groupBy(key).agg(F.min(F.struct(*docs.columns)).alias("_row"))
    return rows.join(kept.hint("merge"), "_key", "left_semi").select("_row.*")


def no_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that with the smallest id, null ids last, and of those with the same id that with the smallest digest of its text.

    Rows go by a number of their own in that order, so null and repeated ids neither lose rows nor join groups."""
    order = [F.col("doc_id").asc_nulls_last(), F.sha2(F.coalesce("text", F.lit("")), 256)]
    number = fresh("row")
    rows = saved(docs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(number, F.monotonically_increasing_id()), "rows")
    kept = near_dedup.near_dedup(rows.select(number, "text"), id_col=number).where("kept").select(number)
    return rows.join(kept.hint("merge"), number, "left_semi").select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their sequences: null and empty texts are a piece of the end id alone, repeated rows are packed each, an empty table has no pieces."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality classifier", good_quality), ("toxicity", not_toxic), ("exact dedup", no_copies), ("near dedup", no_near_copies), ("packing", packed)]
ORACLE_SQL = None  # SQL can't express the fitted stages; tests hold the stages after the fitted ones against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's result written in the shared folder and read again."""
    reachable(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
