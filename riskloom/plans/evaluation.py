"""Offline evaluation: ranking and calibration metrics, realised costs, strategy comparison, threshold tuning."""

from __future__ import annotations

from dataclasses import fields
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from ..sources.world import DAY, World
from . import audit, policy
from .policy import ACTIONS, Policy

#: Normal quantile of a two-sided interval of 95 % (fixed value).
Z = 1.959963984540054
#: Risk bands [low, high), the last one closed (fixed values).
BANDS = ((0.0, 0.05), (0.05, 0.15), (0.15, 0.30), (0.30, 0.50), (0.50, 0.70), (0.70, 1.0))


def as_of(w: World) -> int:
    """The instant after which nothing is known: a day after the last order."""
    return (w.orders.agg(F.max("t0")).first()[0] or 0) + DAY


def frame(w: World, split: str | None = None) -> DataFrame:
    """Decided orders with their labels: one row per order (of a split)."""
    keys = w.splits.where(F.col("split") == split) if split else None
    return labelled(policy.decide(policy.contexts(w, keys)), w)


def labelled(df: DataFrame, w: World) -> DataFrame:
    """`df` with each order's labels and split."""
    return df.join(w.labels(as_of(w)), "k").join(w.splits, "k")


def scored_frame(w: World) -> DataFrame:
    """Scored orders with their labels, for what reads no decision."""
    return labelled(policy.scored(w), w)


def average_precision(df: DataFrame, score: str = "p_abuse", label: str = "abuse_label") -> DataFrame:
    """One row: n, positives, average_precision; one step per distinct score. Running sums are taken inside ranges of scores, with the ranges' offsets."""
    by_score = df.where(F.col(label).isNotNull()).groupBy(score).agg(F.count("*").alias("n"), F.sum(label).alias("pos"))
    placed = written(by_score.repartitionByRange(F.desc(score)).withColumn("_part", F.spark_partition_id()))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = placed.groupBy("_part").agg(F.sum("n").alias("_n"), F.sum("pos").alias("_pos"))
    offsets = sums.select("_part", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in ("_n", "_pos")))
    upto = Window.partitionBy("_part").orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    steps = placed.join(F.broadcast(offsets), "_part")
    steps = steps.select("n", "pos", (F.sum("pos").over(upto) + F.col("_pos_before")).alias("hits"), (F.sum("n").over(upto) + F.col("_n_before")).alias("seen"))
    out = steps.agg(F.sum("n").alias("n"), F.sum("pos").alias("positives"), F.sum(F.col("pos") * F.col("hits") / F.col("seen")).alias("s"))
    return out.select("n", "positives", F.round(F.try_divide("s", "positives"), 6).alias("average_precision"))


def brier(df: DataFrame, score: str = "p_abuse", label: str = "abuse_label") -> DataFrame:
    return df.where(F.col(label).isNotNull()).agg(F.count("*").alias("n"), F.round(F.avg(F.pow(F.col(score) - F.col(label), 2)), 6).alias("brier"))


def reliability(df: DataFrame, score: str = "p_abuse", label: str = "abuse_label", bins: int = 10) -> DataFrame:
    """bin, n, mean_p, rate: equal-count bins by score; rows with equal scores split by time and id."""
    known = audit.ranked(df.where(F.col(label).isNotNull()).select(score, label, "t0", "k"), score, "t0", "k")
    # the bins of ntile: the first ones have one row more
    known = known.crossJoin(F.broadcast(known.agg(F.count("*").alias("_all"))))
    known = known.withColumn("bin", F.expr(f"cast(if(rank < (_all % {bins}) * (_all div {bins} + 1), rank div (_all div {bins} + 1), (rank - _all % {bins}) div greatest(_all div {bins}, 1)) as int) + 1"))
    return known.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg(score), 6).alias("mean_p"), F.round(F.avg(label), 6).alias("rate"))


def calibration_error(df: DataFrame, **names) -> DataFrame:
    return reliability(df, **names).agg(F.sum("n").alias("n"), F.round(F.sum(F.col("n") * F.abs(F.col("mean_p") - F.col("rate"))) / F.sum("n"), 5).alias("ece"))


def wilson(k: Column, n: Column) -> tuple[Column, Column]:
    p, z2 = k / n, Z * Z
    mid = (p + z2 / (2 * n)) / (1 + z2 / n)
    half = F.lit(Z) / (1 + z2 / n) * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    return F.greatest(mid - half, F.lit(0.0)), F.least(mid + half, F.lit(1.0))


def risk_bands(df: DataFrame, score: str = "p_abuse", label: str = "abuse_label") -> DataFrame:
    """band, n, positives, rate with its Wilson interval; empty bands are there with nulls."""
    spark = df.sparkSession
    bands = spark.createDataFrame([(i, lo, hi) for i, (lo, hi) in enumerate(BANDS)], "band int, lo double, hi double")
    case = F.lit(len(BANDS) - 1)
    for i, (_, hi) in reversed(list(enumerate(BANDS[:-1]))):
        case = F.when(F.col(score) < hi, i).otherwise(case)
    found = df.where(F.col(label).isNotNull()).groupBy(case.alias("band")).agg(F.count("*").alias("n"), F.sum(label).alias("positives"))
    found = bands.join(F.broadcast(found), "band", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    low, high = wilson(F.col("positives"), F.col("n"))
    rate = F.try_divide("positives", "n")
    return found.select("band", "n", "positives", F.round(rate, 6).alias("rate"), F.round(F.when(F.col("n") > 0, low), 6).alias("low"), F.round(F.when(F.col("n") > 0, high), 6).alias("high"))


def realised(action: Column, y: Policy = Policy()) -> Column:
    """Cost that an action had, by the true label: the abusive part by the returned share if the order came back."""
    abusive = F.when(F.col("abuse_label") == 1, 1.0).otherwise(0.0)
    share = F.when(F.col("return_label") == 1, F.coalesce("returned_fraction", F.lit(1.0))).otherwise(1.0)
    out = F.lit(None).cast("double")
    for a, (x, g, o) in policy.costs(abusive, F.col("value"), F.col("clv"), y).items():
        out = F.when(action == a, x * share + g + o).otherwise(out)
    return F.round(out, 4)


def strategies(tau: tuple = (0.7, 0.4)) -> Column:
    """All strategies' actions as an array of (strategy, action): the frame is read once for all of them."""
    named = {"POLICY": F.col("action"), "FIXED_THRESHOLD": policy.fixed_threshold(F.col("p_abuse"), *tau), "RULE_BASED": policy.rule_based(), "ALLOW_ALL": F.lit("ALLOW")}
    return F.array(*(F.struct(F.lit(n).alias("strategy"), a.alias("chosen")) for n, a in named.items()))


def backtest(df: DataFrame, y: Policy = Policy(), tau: tuple = (0.7, 0.4), by: tuple[str, ...] = ()) -> DataFrame:
    """One row per strategy (and value of `by`): realised cost, loss prevented against allowing all, blocks, friction and reviews,
    cost per detected abuse, genuine revenue preserved, precision and expected recall.
    """
    inputs = ["value", "clv", "abuse_label", "return_label", "returned_fraction", *by, *(["y"] if "y" in df.columns else [])]
    rows = df.where("abuse_label is not null").select(*inputs, F.explode(strategies(tau)).alias("s")).select("*", "s.*")
    rows = rows.withColumn("cost", realised(F.col("chosen"), y)).withColumn("allowed", realised(F.lit("ALLOW"), y))
    bad, good, chosen = F.col("abuse_label") == 1, F.col("abuse_label") == 0, F.col("chosen")
    caught = F.when(chosen == "BLOCK", 1.0).when(chosen == "MANUAL_REVIEW", y.review_detection_rate).when(chosen == "PREPAID_ONLY", y.prepaid_deterrence_rate).otherwise(0.0)
    total = lambda x, digits=4: F.sum(x.cast(f"decimal(20,{digits})"))
    out = rows.groupBy(*by, "strategy").agg(
        F.count("*").alias("n"), total(F.col("cost")).alias("cost"), total(F.when(bad, F.col("allowed") - F.col("cost")).otherwise(0.0)).alias("prevented"),
        F.count_if(good & (chosen == "BLOCK")).alias("genuine_blocks"), F.count_if(good & (chosen != "ALLOW")).alias("friction"), F.count_if(chosen == "MANUAL_REVIEW").alias("reviews"),
        F.count_if(chosen == "BLOCK").alias("blocks"), F.count_if(bad & (chosen == "BLOCK")).alias("true_blocks"), F.sum(F.when(bad, caught)).alias("caught"), F.count_if(bad).alias("abusive"),
        F.count_if(good).alias("genuine"), total(F.when(good, F.col("value")).otherwise(0.0), 2).alias("revenue"), total(F.when(good & (chosen != "BLOCK"), F.col("value")).otherwise(0.0), 2).alias("preserved"),
    )
    share = lambda a, b: F.round(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), 6)
    return out.select(
        *by, "strategy", "n", F.round(F.col("cost").cast("double") / F.col("n") * 1000, 2).alias("cost_per_1000"), F.round(F.col("prevented").cast("double"), 1).alias("loss_prevented"),
        share("genuine_blocks", "genuine").alias("genuine_block_rate"), share("friction", "genuine").alias("friction_rate"), F.round(F.col("reviews") / F.col("n") * 1000, 4).alias("reviews_per_1000"),
        F.round(F.try_divide(F.col("cost").cast("double"), F.col("caught")), 2).alias("cost_per_detected"), share("preserved", "revenue").alias("revenue_preserved"),
        share("true_blocks", "blocks").alias("block_precision"), share("caught", "abusive").alias("expected_recall"),
    )


def tune_thresholds(df: DataFrame, y: Policy = Policy(), steps: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """tau_block, tau_review, cost: the cheapest pair of the grid, for each value of `by`; among ties the higher block, then review threshold.

    The grid is small; orders are reduced to sums by score cell first, so the grid never multiplies orders.
    """
    spark = df.sparkSession
    cell = F.least(F.floor(F.col("p_abuse") * steps + 1e-9), F.lit(steps - 1)).cast("int")
    cents = lambda a: F.sum(realised(F.lit(a), y).cast("decimal(20,4)")).alias(a.lower())
    cells = df.where("abuse_label is not null").groupBy(*by, cell.alias("cell")).agg(cents("ALLOW"), cents("MANUAL_REVIEW"), cents("BLOCK"))
    axis = spark.range(1, steps + 1).select(F.col("id").cast("int").alias("i"))
    grid = axis.withColumnRenamed("i", "b").join(F.broadcast(axis.withColumnRenamed("i", "r")), F.expr("r <= b"))
    cost = F.expr(f"case when b < {steps} and cell >= b then block when r < {steps} and cell >= r then manual_review else allow end")
    priced = grid.crossJoin(F.broadcast(cells)).groupBy(*by, "b", "r").agg(F.sum(cost).alias("cost"))
    best = priced.groupBy(*by).agg(F.min(F.struct("cost", (-F.col("b")).alias("nb"), (-F.col("r")).alias("nr"))).alias("x"))
    return best.select(*by, (-F.col("x.nb") / steps).alias("tau_block"), (-F.col("x.nr") / steps).alias("tau_review"), F.round(F.col("x.cost").cast("double"), 2).alias("cost"))


def guardrail_price(df: DataFrame, y: Policy = Policy()) -> DataFrame:
    """guardrail, n, extra_cost: orders whose action a guardrail changed, and realised cost against the unconstrained choice."""
    known = df.where("abuse_label is not null").withColumn("extra", realised(F.col("action"), y) - realised(F.col("cost_optimal"), y))
    by = F.array_compact(F.array(*(F.when(F.col(g) & (F.col("cost_optimal") == removed), g.upper()) for g, removed in (("g2", "BLOCK"), ("g3", "BLOCK"), ("g4", "BLOCK"), ("g5", "ALLOW")))))
    return known.where("action <> cost_optimal").select(F.explode(by).alias("guardrail"), "extra").groupBy("guardrail").agg(F.count("*").alias("n"), F.round(F.sum(F.col("extra").cast("decimal(20,4)")).cast("double"), 2).alias("extra_cost"))


def action_distribution(df: DataFrame) -> DataFrame:
    """split and the number of orders by action, zeros included."""
    return df.groupBy("split").pivot("action", list(ACTIONS)).count().na.fill(0).select("split", *(F.col(a).alias(f"n_{a.lower()}") for a in ACTIONS))


def cohorts(df: DataFrame) -> DataFrame:
    """family, cohort, n, friction_rate, mean_p: several cohort families in one grouped pass."""
    families = {
        "account_age": F.when(F.col("account_age_days") < 30, "<30").when(F.col("account_age_days") <= 365, "30-365").otherwise(">365"),
        "value": F.when(F.col("value") < 2000, "<2k").when(F.col("value") <= 10000, "2-10k").otherwise(">10k"),
        "payment": F.when(F.col("payment_method") == "COD", "COD").otherwise("PREPAID"), "multi_tenant": F.when(F.col("address_multi_tenant"), "yes").otherwise("no"),
    }
    rows = df.select("action", "p_abuse", F.explode(F.array(*(F.struct(F.lit(n).alias("family"), c.alias("cohort")) for n, c in families.items()))).alias("x")).select("action", "p_abuse", "x.*")
    return rows.groupBy("family", "cohort").agg(F.count("*").alias("n"), F.round(F.avg((F.col("action") != "ALLOW").cast("int")), 6).alias("friction_rate"), F.round(F.sum(F.col("p_abuse").cast("decimal(10,6)")).cast("double") / F.count("*"), 5).alias("mean_p"))


def label_sensitivity(df: DataFrame) -> DataFrame:
    """variant, average_precision with unresolved disputes taken as clean, as abuse, or left out."""
    out, df = None, written(df.select("k", "p_abuse", "abuse_label", "abuse_status"))
    for name, value in (("excluded", None), ("as_0", 0), ("as_1", 1)):
        label = F.when(F.col("abuse_status") == "UNRESOLVED", F.lit(value).cast("int")).otherwise(F.col("abuse_label"))
        one = average_precision(df.withColumn("variant_label", label), label="variant_label").select(F.lit(name).alias("variant"), "n", "positives", "average_precision")
        out = one if out is None else out.unionByName(one)
    return out


SENSITIVITY = {
    "margin": ("gross_margin_rate",), "logistics": ("reverse_logistics_cost",), "recovery": ("allow_recovery_rate", "prepaid_recovery_rate"),
    "review": ("review_cost",), "churn": ("prepaid_churn_rate", "block_churn_rate"), "detection": ("review_detection_rate", "prepaid_deterrence_rate"),
}


def scenarios(df: DataFrame) -> tuple[DataFrame, SimpleNamespace]:
    """`df` once for each scaled policy, as columns parameter, factor and y (a struct of policy values), and y's values as columns."""
    spark = df.sparkSession
    names = [f.name for f in fields(Policy)]
    rows = [(p, factor, *(float(getattr(y, n)) for n in names)) for p, values in SENSITIVITY.items() for factor in (0.5, 1.5) for y in [Policy().scaled(values, factor)]]
    table = spark.createDataFrame(rows, "parameter string, factor double, " + ", ".join(f"`{n}` double" for n in names)).select("parameter", "factor", F.struct(*names).alias("y"))
    return df.crossJoin(F.broadcast(table)), SimpleNamespace(**{n: F.col(f"y.{n}") for n in names})


def cost_sensitivity(df: DataFrame) -> DataFrame:
    """parameter, factor, strategy, cost_per_1000 of the last orders, decided again under scaled assumptions; the thresholds are
    tuned again on the calibration orders, and the true costs scale as well. One pass over the frame for all scenarios.
    """
    keep = ["split", "p_abuse", "value", "clv", "abuse_label", "return_label", "returned_fraction", "return_rate", "matured_returns", "account_age_days", "payment_method"]
    inputs = [c for c in df.columns if not c.startswith("cost_") and c not in ("action", "status", "n_counted", "g2", "g3", "g4", "g5")]
    crossed, y = scenarios(written(df.where("split in ('CALIBRATION', 'TEST') and abuse_label is not null").select(*inputs)))
    by = ("parameter", "factor")
    tuned = written(tune_thresholds(crossed.where("split = 'CALIBRATION'"), y, by=by)).drop("cost")
    decided = policy.decide(crossed.where("split = 'TEST'"), y).select(*by, "y", "action", *keep).join(F.broadcast(tuned), list(by), "left")
    tau = (F.coalesce("tau_block", F.lit(1.0)), F.coalesce("tau_review", F.lit(1.0)))
    return backtest(decided, y, tau, by).select(*by, "strategy", "cost_per_1000")


def _draws(score: float, positives: int, negatives: int, resamples: int) -> tuple[np.ndarray, np.ndarray]:
    """How often the rows of a score are in each resample: a sum of n Poisson numbers is one of mean n. Seeded by the score, so passes agree."""
    seed = int(np.float64(score).view(np.uint64))
    rng = np.random.Generator(np.random.Philox(key=seed))
    return rng.poisson(positives, resamples), rng.poisson(negatives, resamples)


def bootstrap_interval(df: DataFrame, resamples: int = 1000, score: str = "p_abuse", label: str = "abuse_label", by: tuple[str, ...] = ()) -> DataFrame:
    """low, high of the average precision by Poisson resamples, for each value of `by`.

    Rows are reduced to the counts of each distinct score first; no row is multiplied. Scores are dealt in ranges; one pass sums each
    range's resampled counts, one more takes the precision at every score with the sums of the ranges before.
    """
    cells = df.where(F.col(label).isNotNull()).groupBy(*by, F.col(score).cast("double").alias("score")).agg(F.sum(F.col(label)).cast("long").alias("pos"), (F.count("*") - F.sum(F.col(label))).cast("long").alias("neg"))
    group = F.to_json(F.struct(*by)) if by else F.lit("{}")
    placed = written(cells.select(group.alias("g"), "score", "pos", "neg").repartitionByRange("g", F.desc("score")).sortWithinPartitions("g", F.desc("score")).withColumn("part", F.spark_partition_id()))
    placed = placed.select("part", "g", "score", "pos", "neg")

    def sums(key, table):
        hits, seen = np.zeros(resamples), np.zeros(resamples)
        for s, p, n in zip(*(table.column(c).to_pylist() for c in ("score", "pos", "neg"))):
            a, b = _draws(s, p, n, resamples)
            hits, seen = hits + a, seen + a + b
        return pa.table([pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()]), pa.array([hits]), pa.array([seen])], names=["part", "g", "hits", "seen"])

    totals = placed.groupBy("part", "g").applyInArrow(sums, "part int, g string, hits array<double>, seen array<double>")
    before, whole = {}, {}
    for part, g, hits, seen in sorted(totals.collect()):  # one row a range of scores
        old = whole.get(g, (np.zeros(resamples), np.zeros(resamples)))
        before[part, g] = old
        whole[g] = (old[0] + hits, old[1] + seen)

    def precision(key, table):
        hits, seen = before[key[0].as_py(), key[1].as_py()]
        out = np.zeros(resamples)
        order = np.argsort(-table.column("score").to_numpy(), kind="stable").tolist()
        rows = list(zip(*(table.column(c).to_pylist() for c in ("score", "pos", "neg"))))
        for i in order:
            a, b = _draws(*rows[i], resamples)
            hits, seen = hits + a, seen + a + b
            out += np.divide(a * hits, seen, out=np.zeros(resamples), where=seen > 0)
        return pa.table([pa.array([key[1].as_py()] * resamples), pa.array(np.arange(resamples)), pa.array(out)], names=["g", "r", "s"])

    known = df.sparkSession.createDataFrame([(g, r, float(n)) for g, (hits, _) in whole.items() for r, n in enumerate(hits) if n > 0], "g string, r long, positives double")
    ap = placed.groupBy("part", "g").applyInArrow(precision, "g string, r long, s double").groupBy("g", "r").agg(F.sum("s").alias("s")).join(F.broadcast(known), ["g", "r"])
    ap = ap.select("g", (F.col("s") / F.col("positives")).alias("ap"))
    out = ap.groupBy("g").agg(F.percentile("ap", 0.025).alias("low"), F.percentile("ap", 0.975).alias("high"))
    kinds = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in by)
    return out.select(*(F.from_json("g", kinds)[c].alias(c) for c in by), "low", "high") if by else ap.agg(F.percentile("ap", 0.025).alias("low"), F.percentile("ap", 0.975).alias("high"))
