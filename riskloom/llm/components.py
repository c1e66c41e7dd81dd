"""Connected components of an edge table, by minimum labels with pointer jumping; every step is a join or a grouping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, durable, gathered


def components(edges: DataFrame) -> DataFrame:
    """(node, comp) for all nodes of `edges` (columns a, b; a written table): comp is the smallest node that is reachable."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    n = both.count()
    labels = durable(gathered(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("comp")), n))
    while True:
        known = broadcast_if_small(labels, n, 16)
        near = both.join(known.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("m"))
        hooked = near.join(known, "node").select("node", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        target = known.select(F.col("node").alias("comp"), F.col("comp").alias("next"))
        moved = durable(gathered(hooked.join(target, "comp", "left").select("node", "old", F.least("comp", F.coalesce("next", "comp")).alias("comp")), n))
        labels = moved.select("node", "comp")
        if not moved.where("comp <> old").limit(1).count():
            return labels
