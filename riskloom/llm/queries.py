"""The registered corpus queries: thin functions that apply each operator to its whole table and shape the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown_lm, collocations, compression_quality, contextual_pii, exact_dedup, near_join, packing, repetition, sampled_pieces, secret_scan, simple8b, spelling, suffix_dedup
from .common import id_remainder


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_pieces.segmentations(_table(spark, sf_dir, "documents"))


def op2_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_lm.score(_table(spark, sf_dir, "documents"), id_remainder("doc_id", 7) == 2)


def op3_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_join.near_components(_table(spark, sf_dir, "documents"))


def op4_island_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op5_simple8b(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = simple8b.folder(spark, "token-ids")
    return simple8b.digests(simple8b.write(_table(spark, sf_dir, "documents"), place), place)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))


def op7_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = repetition.measures(_table(spark, sf_dir, "documents"))
    kept = (~repetition.base_failed() & ~repetition.repetitive()).alias("kept")
    return measured.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", repetition.base_failed().alias("base_failed"), kept)


def op8_compression_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = compression_quality.fit(docs, _table(spark, sf_dir, "labels"), id_remainder("doc_id", 3) != 1)
    return compression_quality.score(docs, model).select(
        "doc_id", (id_remainder("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "difference"
    )


def op9_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contextual_pii.digest(contextual_pii.find(_table(spark, sf_dir, "documents")))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.scan(_table(spark, sf_dir, "documents")))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.report(_table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_sampled_pieces": op1_sampled_pieces,
    "op2_brown_lm": op2_brown_lm,
    "op3_near_join": op3_near_join,
    "op4_island_packing": op4_island_packing,
    "op5_simple8b": op5_simple8b,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_repetition": op7_repetition,
    "op8_compression_quality": op8_compression_quality,
    "op9_contextual_pii": op9_contextual_pii,
    "op10_secret_scan": op10_secret_scan,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_collocations": op13_collocations,
}

ORACLES = {"op6_exact_dedup": exact_dedup.ORACLE, "op13_collocations": collocations.ORACLE}
