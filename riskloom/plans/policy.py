"""Expected-cost policy: corroborating signals, guardrails, four actions' costs, the decision, and baselines.

All of it is column algebra on one row per order: no shuffle, one whole-stage-generated projection.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import component, history, links
from ..sources.world import DAY, World

#: From the least severe to the most.
ACTIONS = ("ALLOW", "PREPAID_ONLY", "MANUAL_REVIEW", "BLOCK")
SIGNALS = ("DEVICE", "PAYMENT_TOKEN", "ADDRESS", "TEMPORAL_BURST", "ACCOUNT_CLAIMS")


@dataclass(frozen=True)
class Policy:
    """Policy values (fixed values of version 1.0)."""

    gross_margin_rate: float = 0.30
    reverse_logistics_cost: float = 150.0
    clv_floor: float = 2000.0
    clv_cap: float = 100000.0
    allow_recovery_rate: float = 0.15
    prepaid_deterrence_rate: float = 0.30
    prepaid_recovery_rate: float = 0.50
    prepaid_abandonment_rate: float = 0.08
    prepaid_churn_rate: float = 0.02
    prepaid_friction_cost: float = 30.0
    review_cost: float = 250.0
    review_detection_rate: float = 0.80
    review_abandonment_rate: float = 0.05
    review_false_cancel_rate: float = 0.03
    block_churn_rate: float = 0.60
    block_support_cost: float = 100.0
    block_min_p: float = 0.70
    block_min_signals: int = 2
    exposure_value: float = 10000.0
    exposure_min_p: float = 0.40
    degraded_review_value: float = 5000.0
    tie_tolerance: float = 1.0

    def __post_init__(self) -> None:
        for f in fields(self):
            v = getattr(self, f.name)
            if v < 0 or f.name.endswith("_rate") and v > 1:
                raise ValueError(f"{f.name} is out of range: {v}")
        if self.clv_floor > self.clv_cap:
            raise ValueError("clv_floor is above clv_cap")

    def scaled(self, names: tuple[str, ...], factor: float) -> Policy:
        """Some values times a factor; rates stay within [0, 1]."""
        return replace(self, **{n: min(1.0, getattr(self, n) * factor) if n.endswith("_rate") else getattr(self, n) * factor for n in names})


def totals_at(p: float, value: float, clv: float, y: Policy = Policy()) -> dict[str, float]:
    """Each action's expected cost for plain numbers."""
    q, clv = 1 - p, min(max(clv, y.clv_floor), y.clv_cap)
    margin, loss = y.gross_margin_rate * value, lambda recovery: value * (1 - recovery) + y.reverse_logistics_cost
    false_block = margin + y.block_churn_rate * clv + y.block_support_cost
    return {
        "ALLOW": p * loss(y.allow_recovery_rate),
        "PREPAID_ONLY": p * (1 - y.prepaid_deterrence_rate) * loss(y.prepaid_recovery_rate) + q * (y.prepaid_abandonment_rate * margin + y.prepaid_churn_rate * clv + y.prepaid_friction_cost),
        "MANUAL_REVIEW": p * (1 - y.review_detection_rate) * loss(y.allow_recovery_rate) + q * (y.review_abandonment_rate * margin + y.review_false_cancel_rate * false_block) + y.review_cost,
        "BLOCK": q * false_block,
    }


def costs(p: Column, value: Column, clv: Column, y: Policy = Policy()) -> dict[str, tuple[Column, Column, Column]]:
    """Expected abusive, genuine and operational cost of each action; the return probability is no input."""
    q = 1 - p
    clv = F.least(F.greatest(clv, F.lit(y.clv_floor)), F.lit(y.clv_cap))
    margin = F.lit(y.gross_margin_rate) * value
    loss = lambda recovery: value * (1 - recovery) + y.reverse_logistics_cost
    false_block = margin + F.lit(y.block_churn_rate) * clv + y.block_support_cost
    zero = F.lit(0.0)
    return {
        "ALLOW": (p * loss(y.allow_recovery_rate), zero, zero),
        "PREPAID_ONLY": (
            p * (1 - y.prepaid_deterrence_rate) * loss(y.prepaid_recovery_rate),
            q * (F.lit(y.prepaid_abandonment_rate) * margin + F.lit(y.prepaid_churn_rate) * clv + y.prepaid_friction_cost), zero,
        ),
        "MANUAL_REVIEW": (
            p * (1 - y.review_detection_rate) * loss(y.allow_recovery_rate),
            q * (F.lit(y.review_abandonment_rate) * margin + F.lit(y.review_false_cancel_rate) * false_block), F.lit(y.review_cost),
        ),
        "BLOCK": (zero, q * false_block, zero),
    }


def totals(p: Column, value: Column, clv: Column, y: Policy = Policy()) -> dict[str, Column]:
    return {a: F.round(x + g + o, 2) for a, (x, g, o) in costs(p, value, clv, y).items()}


def cheapest(cost: dict[str, Column], allowed: dict[str, Column], tolerance: float) -> Column:
    """The least severe allowed action within the tolerance of the cheapest one."""
    best = F.least(*(F.when(allowed[a], cost[a]) for a in ACTIONS))
    out = F.lit(None).cast("string")
    for a in reversed(ACTIONS):
        out = F.when(allowed[a] & (cost[a] - best <= tolerance), a).otherwise(out)
    return out


def signals() -> dict[str, tuple[Column, Column, Column]]:
    """Of each signal: observed, counted, weight (0 if not observed). Thresholds are fixed values."""
    c = F.col
    seen = {
        "DEVICE": (c("device_confirmed_weight") >= 0.3) | (c("device_others_30d") >= 3), "PAYMENT_TOKEN": c("token_others_30d") >= 2,
        "ADDRESS": c("address_confirmed_weight") >= 0.3, "TEMPORAL_BURST": (c("linked_orders_24h") >= 3) | (c("same_sku_7d") >= 2), "ACCOUNT_CLAIMS": c("claims_180d") >= 1,
    }
    counted = dict(seen)
    counted["ADDRESS"] = seen["ADDRESS"] & ~c("address_multi_tenant")
    counted["TEMPORAL_BURST"] = seen["TEMPORAL_BURST"] & F.arrays_overlap("burst_kinds", F.array(F.lit("DEVICE"), F.lit("PAYMENT_TOKEN")))
    weight = {"DEVICE": c("device_weight"), "PAYMENT_TOKEN": c("token_weight"), "ADDRESS": c("address_weight"), "TEMPORAL_BURST": c("burst_weight"), "ACCOUNT_CLAIMS": F.lit(1.0)}
    return {s: (seen[s], counted[s], F.when(seen[s], weight[s]).otherwise(0.0)) for s in SIGNALS}


def scores(df: DataFrame) -> DataFrame:
    """p_abuse and p_return by a fixed logistic scorecard; trained models are in `models`."""
    z = "-3.5D + 2.5D * device_confirmed_weight + 0.2D * device_others_30d + 0.4D * token_others_30d + 1.1D * claims_180d + 1.2D * address_confirmed_weight + 0.000004D * value"
    r = "-1.4D + 3.0D * return_rate_smoothed + 0.03D * discount_pct + 0.15D * returns_90d"
    return df.withColumn("p_abuse", F.expr(f"round(1 / (1 + exp(-({z}))), 6)")).withColumn("p_return", F.expr(f"round(1 / (1 + exp(-({r}))), 6)"))


def scored(w: World, keys: DataFrame | None = None) -> DataFrame:
    """All inputs of the scores, one row per order (of `keys`, with k); links of accounts further away aren't read."""
    o = history.profile(w)
    o = o if keys is None else o.join(keys.select("k"), "k", "left_semi")
    rates = history.return_rates(o, "c", "t0", "value", "discount_pct", "payment_method", "n_items", "prior_orders", "returns_90d", "claims_180d", "account_age_days", "clv", "basis")
    return scores(rates.join(links.evidence(w), "k"))


def contexts(w: World, keys: DataFrame | None = None) -> DataFrame:
    """All inputs of a decision, one row per order (of `keys`): the scores' inputs and the bursts of the order's component."""
    reached = None if keys is None else component.reached(w, keys)
    return scored(w, keys).join(component.burst_features(w, reached), "k")


def guarded(df: DataFrame, y: Policy = Policy(), graph_age: Column | None = None) -> DataFrame:
    """Adds n_counted, and of each guardrail whether it removes its action: g2, g3, g4 (BLOCK), g5 (ALLOW)."""
    s = signals()
    number = lambda x: x.cast("int")
    counted = sum((number(s[k][1]) for k in SIGNALS[1:]), number(s["DEVICE"][1]))
    anchor = s["DEVICE"][1] | s["PAYMENT_TOKEN"][1] | s["ACCOUNT_CLAIMS"][1]
    strong = F.lit(False)
    for k in SIGNALS:
        strong = strong | (s[k][1] & (s[k][2] >= 0.3))
    old = F.lit(False) if graph_age is None else graph_age > DAY
    df = df.withColumn("n_counted", counted).withColumn("g2", (F.col("n_counted") < y.block_min_signals) | ~anchor).withColumn("g3", F.col("p_abuse") < y.block_min_p)
    return df.withColumn("g4", ((F.col("n_counted") > 0) & ~strong) | old).withColumn("g5", (F.col("p_abuse") >= y.exposure_min_p) & (F.col("value") >= y.exposure_value))


def decide(df: DataFrame, y: Policy = Policy()) -> DataFrame:
    """Adds the four costs, cost_optimal, action, status. Without a score: review of large orders, else allow, no costs."""
    df = guarded(df, y)
    cost = totals(F.col("p_abuse"), F.col("value"), F.col("clv"), y)
    df = df.withColumns({f"cost_{a.lower()}": c for a, c in cost.items()})
    cost = {a: F.col(f"cost_{a.lower()}") for a in ACTIONS}
    free = {a: F.lit(True) for a in ACTIONS}
    allowed = {"ALLOW": ~F.col("g5"), "PREPAID_ONLY": F.lit(True), "MANUAL_REVIEW": F.lit(True), "BLOCK": ~(F.col("g2") | F.col("g3") | F.col("g4"))}
    degraded = F.when(F.col("value") >= y.degraded_review_value, "MANUAL_REVIEW").otherwise("ALLOW")
    df = df.withColumn("cost_optimal", F.when(F.col("p_abuse").isNotNull(), cheapest(cost, free, y.tie_tolerance)))
    df = df.withColumn("action", F.when(F.col("p_abuse").isNull(), degraded).otherwise(cheapest(cost, allowed, y.tie_tolerance)))
    return df.withColumn("status", F.when(F.col("action") == "MANUAL_REVIEW", "PENDING_REVIEW").otherwise("AUTO_APPLIED"))


def fixed_threshold(p: Column, block: Column | float, review: Column | float) -> Column:
    """A threshold of 1 never fires."""
    block, review = (x if isinstance(x, Column) else F.lit(x) for x in (block, review))
    return F.when((block < 1) & (p >= block), "BLOCK").when((review < 1) & (p >= review), "MANUAL_REVIEW").otherwise("ALLOW")


def rule_based() -> Column:
    """First matching rule on return history, new accounts and cash orders (fixed values)."""
    return (
        F.when((F.col("return_rate") >= 0.5) & (F.col("matured_returns") >= 5), "BLOCK").when((F.col("account_age_days") < 30) & (F.col("value") >= 15000), "MANUAL_REVIEW")
        .when((F.col("payment_method") == "COD") & (F.col("value") >= 5000), "PREPAID_ONLY").otherwise("ALLOW")
    )


def slope_check(w: World, y: Policy = Policy(), steps: int = 61, least: float = 500.0, most: float = 200000.0) -> DataFrame:
    """pair, violations, least_gap: whether costs fall ever more slowly with p from action to action; equal slopes are in order.

    The grid has values from `least` to `most` in equal ratios, and CLVs from the floor to the cap in equal steps.
    """
    spark = w.spark
    axis = spark.range(steps).select(F.col("id").alias("i"))
    grid = axis.crossJoin(F.broadcast(axis.withColumnRenamed("i", "j"))).select(
        F.when(F.col("i") == steps - 1, most).otherwise(least * F.pow(F.lit(most / least), F.col("i") / (steps - 1))).alias("value"),
        F.when(F.col("j") == steps - 1, y.clv_cap).otherwise(y.clv_floor + (y.clv_cap - y.clv_floor) * F.col("j") / (steps - 1)).alias("clv"),
    )
    at = lambda p: totals(F.lit(p), F.col("value"), F.col("clv"), y)
    zero, one = at(0.0), at(1.0)
    slope = {a: one[a] - zero[a] for a in ACTIONS}
    pairs = F.array(*(F.struct(F.lit(f"{a}>{b}").alias("pair"), F.round(slope[a] - slope[b], 2).alias("gap")) for a, b in zip(ACTIONS, ACTIONS[1:])))
    return grid.select(F.explode(pairs).alias("x")).select("x.*").groupBy("pair").agg(F.count_if(F.col("gap") < 0).alias("violations"), F.min("gap").alias("least_gap"))


def slope_orders(df: DataFrame, y: Policy = Policy()) -> DataFrame:
    """pair, orders, violations: over the decided orders' own values, how often costs rise faster with p for the more severe of two actions."""
    at = lambda p: totals(F.lit(p), F.col("value"), F.col("clv"), y)
    zero, one = at(0.0), at(1.0)
    slope = {a: one[a] - zero[a] for a in ACTIONS}
    pairs = F.array(*(F.struct(F.lit(f"{a}>{b}").alias("pair"), (F.round(slope[a] - slope[b], 2) < 0).alias("bad")) for a, b in zip(ACTIONS, ACTIONS[1:])))
    return df.select(F.explode(pairs).alias("x")).groupBy("x.pair").agg(F.count("*").alias("orders"), F.count_if("x.bad").alias("violations"))
