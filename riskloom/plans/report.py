"""The evaluation report: summaries by split and cohort, calibration bands, archetypes and rings, uplift by links, world figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.world import World
from . import evaluation
from .policy import ACTIONS


def grouped_precision(df: DataFrame, by: list[str], score: str = "p_abuse", label: str = "abuse_label") -> DataFrame:
    """`by` and average_precision inside each group: one step per distinct score; groups are few, so scores are summed first."""
    steps = df.where(F.col(label).isNotNull()).groupBy(*by, score).agg(F.count("*").alias("n"), F.sum(label).alias("pos"))
    upto = Window.partitionBy(*by).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    steps = steps.select(*by, "pos", F.sum("pos").over(upto).alias("hits"), F.sum("n").over(upto).alias("seen"))
    return steps.groupBy(*by).agg(F.round(F.try_divide(F.sum(F.col("pos") * F.col("hits") / F.col("seen")), F.sum("pos")), 6).alias("average_precision"))


def summary(df: DataFrame, by: list[str], score: str = "p_abuse", label: str = "abuse_label") -> DataFrame:
    """n, positives, prevalence, brier, average_precision of each group."""
    known = df.where(F.col(label).isNotNull())
    figures = known.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(label).cast("long").alias("positives"), F.round(F.sum(label) / F.count("*"), 6).alias("prevalence"), F.round(F.avg(F.pow(F.col(score) - F.col(label), 2)), 6).alias("brier"))
    return figures.join(grouped_precision(df, by, score, label), by, "left")


def equal_width_error(df: DataFrame, by: list[str], least: float = 0.05, bins: int = 10, score: str = "p_abuse", label: str = "abuse_label") -> DataFrame:
    """n and calibration error over scores of `least` or more, in bins of equal width; the last one includes 1."""
    known = df.where(F.col(label).isNotNull() & (F.col(score) >= least))
    bin_ = F.least(F.floor((F.col(score) - least) / ((1 - least) / bins)), F.lit(bins - 1))
    one = known.groupBy(*by, bin_.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("p"), F.avg(label).alias("rate"))
    return one.groupBy(*by).agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("p") - F.col("rate"))) / F.sum("n"), 5).alias("error"))


def bands_by_split(df: DataFrame, splits: tuple[str, ...] = ("CALIBRATION", "TEST"), score: str = "p_abuse", label: str = "abuse_label") -> DataFrame:
    """split, band, n, positives, rate of the six fixed risk bands; empty bands are there."""
    band = F.lit(len(evaluation.BANDS) - 1)
    for i, (_, hi) in reversed(list(enumerate(evaluation.BANDS[:-1]))):
        band = F.when(F.col(score) < hi, i).otherwise(band)
    all_ = df.sparkSession.createDataFrame([(s, i) for s in splits for i in range(len(evaluation.BANDS))], "split string, band int")
    found = df.where(F.col(label).isNotNull() & F.col("split").isin(*splits)).groupBy("split", band.alias("band")).agg(F.count("*").alias("n"), F.sum(label).cast("long").alias("positives"))
    out = all_.join(F.broadcast(found), ["split", "band"], "left")
    return out.select("split", "band", F.coalesce("n", F.lit(0)).alias("n"), "positives", F.round(F.try_divide("positives", "n"), 6).alias("rate"))


def cohort_of() -> Column:
    """All cohorts of a row as an array of (family, cohort)."""
    families = {
        "account_age": F.when(F.col("account_age_days") < 30, "<30").when(F.col("account_age_days") <= 365, "30-365").otherwise(">365"),
        "value": F.when(F.col("value") < 2000, "<2k").when(F.col("value") <= 10000, "2-10k").otherwise(">10k"), "payment": F.when(F.col("payment_method") == "COD", "COD").otherwise("PREPAID"),
        "multi_tenant": F.when(F.col("address_multi_tenant"), "yes").otherwise("no"), "archetype": F.col("archetype"),
    }
    return F.array(*(F.struct(F.lit(n).alias("family"), c.alias("cohort")) for n, c in families.items()))


def cohort_metrics(df: DataFrame) -> DataFrame:
    """family, cohort and the summary of each cohort."""
    rows = df.select("p_abuse", "abuse_label", F.explode(cohort_of()).alias("x")).select("p_abuse", "abuse_label", "x.*")
    return summary(rows, ["family", "cohort"])


def with_truth(df: DataFrame, w: World) -> DataFrame:
    return df.join(w.truth, "c", "left")


def ring_actions(df: DataFrame) -> DataFrame:
    """ring and its orders by action, zeros included."""
    return df.where("ring is not null").groupBy("ring").pivot("action", list(ACTIONS)).count().na.fill(0).select("ring", *(F.col(a).alias(f"n_{a.lower()}") for a in ACTIONS))


def ring_recall(df: DataFrame, ring: str = "R3", least: float = 0.5) -> DataFrame:
    """n, caught, recall of a ring's confirmed orders at a score."""
    out = df.where((F.col("ring") == ring) & (F.col("abuse_label") == 1)).agg(F.count("*").alias("n"), F.count_if(F.col("p_abuse") >= least).alias("caught"))
    return out.select("n", "caught", F.round(F.try_divide("caught", "n"), 6).alias("recall"))


def uplift(df: DataFrame) -> DataFrame:
    """with_links, without_links, uplift: average precision of the score, and of it without its link features."""
    z = "-3.5D + 1.1D * claims_180d + 0.000004D * value"
    plain = df.withColumn("p_plain", F.expr(f"round(1 / (1 + exp(-({z}))), 6)"))
    full = evaluation.average_precision(df).select(F.col("average_precision").alias("with_links"))
    return full.crossJoin(evaluation.average_precision(plain, score="p_plain").select(F.col("average_precision").alias("without_links"))).withColumn("uplift", F.round(F.col("with_links") - F.col("without_links"), 6))


def separation(df: DataFrame) -> DataFrame:
    """n, correlation of the two scores; 0 for one row or none, or where a score doesn't vary."""
    out = df.agg(F.count("*").alias("n"), F.corr("p_abuse", "p_return").alias("r"))
    return out.select("n", F.round(F.when(F.col("n") <= 1, 0.0).otherwise(F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0))), 6).alias("correlation"))


def guardrail_overlap(df: DataFrame) -> DataFrame:
    """avoided_blocks, several: orders that guardrails kept from being blocked, and those that more than one did."""
    n = sum((F.col(g).cast("int") for g in ("g3", "g4")), F.col("g2").cast("int"))
    return df.where("cost_optimal = 'BLOCK'").agg(F.count_if(n >= 1).alias("avoided_blocks"), F.count_if(n >= 2).alias("several"))


def world_figures(w: World) -> DataFrame:
    """One row: orders, accounts, return and claim rates, the median ring's orders, the share of orders with a claim before."""
    of = Window.partitionBy("c").orderBy("t0").rangeBetween(Window.unboundedPreceding, -1)
    o = w.orders.withColumn("before", F.coalesce(F.sum(F.when(F.col("claimed").isNotNull(), 1).otherwise(0)).over(of), F.lit(0)))
    figures = o.agg(
        F.count("*").alias("orders"), F.count_distinct("c").alias("accounts"), F.round(F.avg(F.col("returned").isNotNull().cast("int")), 6).alias("return_rate"),
        F.round(F.avg(F.col("claimed").isNotNull().cast("int")), 6).alias("claim_rate"), F.round(F.avg((F.col("before") > 0).cast("int")), 6).alias("prior_claim_share"),
    )
    rings = w.orders.join(w.truth, "c").where("ring is not null").groupBy("ring").count().agg(F.median("count").alias("median_ring_orders"))
    return figures.crossJoin(rings)


def provenance(df: DataFrame, key: str = "k") -> DataFrame:
    """rows, digest: which rows a report is about, whatever their order."""
    from ..sources.log import fingerprint

    return fingerprint(df.select(key))
