"""Corpus pipeline: drop low-quality documents, exact copies and near copies, mask secrets, pack into sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept; all but the last return the
columns of `documents`, and further ones as they are. Between stages the rows are written once as Parquet and read again.

Null and empty texts count as empty: they have the classifier's score of no evidence, are one group of exact copies, have no
near copies and no secrets, and are one end token to pack. Ids may repeat, be negative or null; stages work by row. Empty
tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.llm import compression_quality, exact_dedup, near_join, packing, secret_scan
from riskloom.llm.common import broadcast_if_small, durable, id_remainder, new_name


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the compression classifier scores 0.5 or more; it learns from the labels of the training part alone."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = compression_quality.fit(docs, labels, id_remainder("doc_id", 3) != 1)
    return compression_quality.good_documents(docs, model)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts that are equal without white space."""
    return exact_dedup.deduplicate(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, of the smallest id, of each component of near-duplicate documents; a null id is larger than all others.

    Every row is a document of its own, whatever its id: rows get keys in the order of their ids, so a component's smallest key is
    the row that stays. Ids and all other columns are returned as they are.
    """
    key, columns = new_name(), docs.columns
    # keys rise with the ids: ranges are sorted in parallel, and a key is its partition's number and the place in it
    ordered = docs.repartitionByRange(F.asc_nulls_last("doc_id")).sortWithinPartitions(F.asc_nulls_last("doc_id"))
    docs = durable(ordered.withColumn(key, F.monotonically_increasing_id()))
    found = durable(near_join.near_components(docs, id_col=key).select(F.col("doc_id").alias(key), "component_id"))
    dropped = durable(found.where(F.col("component_id") != F.col(key)).select(key))
    return docs.join(broadcast_if_small(dropped, dropped.count(), 16), key, "left_anti").select(*columns)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; secrets are masked in their texts."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packed pieces of all documents."""
    return packing.pack(docs)


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("secrets", secrets), ("pack", pack)]

#: The classifier, the tokenizer and the packing can't be expressed in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
