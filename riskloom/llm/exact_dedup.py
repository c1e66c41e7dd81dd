"""Exact dedup: 128-bit content hashes find the groups, bytes are compared inside them, one row of each group stays.

Everything is DataFrame operations. The wide text column is never shuffled for the grouping: one pass turns each text
into (id, length, digest), and all grouping works on those narrow rows with map-side partial aggregation, so that a
group of copies of any size is only a counter. Bytes are compared by a second pass over the texts of repeated hashes
alone, again through partial aggregation: a group whose texts are all equal arrives as one row per task.

Defined results: null text counts as empty; empty texts form one group; of rows that repeat an id inside a group all
are marked kept if the id is the one that stays; a null id never wins a tie against another id. `deduplicate` works by
row, not by id: it leaves exactly one row of each group, whatever ids repeat or are null. Further columns don't matter. An
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import JAVA_SPACE, broadcast_if_small, durable, new_name


def normalised(text: Column) -> Column:
    """The text without ASCII white space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{JAVA_SPACE}+", "")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bytes: int = 16, row_col: str | None = None) -> DataFrame:
    """One row per row of `docs`: its id, keep_id, group_size, kept, text_sha256; with `row_col`, a unique key of rows, also row, keep_row.

    Of the rows with equal normalised texts, the one with the most code points in its text stays, then the smallest id.
    `hash_bytes` is the length of the grouping hash, a prefix of the text's SHA-256; tests shorten it to force collisions.
    """
    row = [F.col(row_col).alias("row")] if row_col else []
    keys = ["doc_id", *(["row"] if row_col else [])]
    source = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *row)
    digest = F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256))
    prints = durable(source.select(*keys, F.length("text").alias("points"), digest.alias("sha")))
    prints = prints.withColumn("h", F.substring("sha", 1, hash_bytes))
    best = F.max(F.struct("points", (-F.col("doc_id")).alias("order"), *([(-F.col("row")).alias("row_order")] if row_col else [])))
    kept = [(-F.col("best.order")).alias("keep_id"), *([(-F.col("best.row_order")).alias("keep_row")] if row_col else [])]
    repeated = prints.groupBy("h").agg(F.count("*").alias("group_size"), best.alias("best")).where("group_size > 1")
    repeated = durable(repeated.select("h", "group_size", *kept))
    n = repeated.count()

    candidates = source.withColumn("norm", normalised(F.col("text")))
    candidates = candidates.withColumn("h", F.substring(F.unhex(F.sha2(F.col("norm").cast("binary"), 256)), 1, hash_bytes))
    candidates = candidates.join(broadcast_if_small(repeated.select("h"), n, 48), "h", "left_semi")
    texts = candidates.groupBy("h", "norm").count()
    collided = durable(texts.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h"))
    clashes = collided.count()
    if clashes:
        repeated = repeated.join(collided, "h", "left_anti")
    result = prints.join(broadcast_if_small(repeated, n, 64), "h", "left")
    if clashes:
        exact = candidates.join(broadcast_if_small(collided, clashes, 48), "h", "left_semi")
        exact = exact.withColumn("points", F.length("text"))
        groups = exact.groupBy("h", "norm").agg(F.count("*").alias("group_size"), best.alias("best"))
        split = exact.join(groups, ["h", "norm"]).select(
            *keys, *kept, "group_size", F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256")
        )
        result = result.join(broadcast_if_small(collided, clashes, 48), "h", "left_anti")
    result = result.select(
        *keys,
        *(F.when(F.col("group_size").isNull(), F.col(own)).otherwise(F.col(keep)).alias(keep) for own, keep in zip(keys, ("keep_id", "keep_row"))),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
    if clashes:
        result = result.unionByName(split)
    rows = ["row", "keep_row"] if row_col else []
    return result.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256", *rows)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` that stay, with all their columns: one row of each group of equal texts."""
    # written once: the keys must be the same in every pass
    key = new_name()
    rows = durable(docs.withColumn(key, F.monotonically_increasing_id()))
    groups = exact_groups(rows, id_col, text_col, row_col=key)
    dropped = durable(groups.where("row <> keep_row").select(F.col("row").alias(key)))
    left = rows.join(broadcast_if_small(dropped, dropped.count(), 16), key, "left_anti")
    return left.select(*docs.columns)


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(t) DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM g
"""
