"""Checks of inputs and results, as rows that break a rule: requests, admission, decisions' inputs and outputs, joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .policy import ACTIONS, Policy


class Rejected(ValueError):
    """A precondition of a join doesn't hold."""


def failures(rules: dict[str, Column]) -> Column:
    """The names of the rules that don't hold; a rule that is null doesn't hold."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items()), F.lit(None).cast("string")))


def request_failures() -> Column:
    """Of a request (order_id, account_id, lines, discount_pct, payment_method, payment_token_id): the rules that it breaks. Forms and limits are fixed values."""
    lines = F.col("lines")
    return failures({
        "order_id": F.col("order_id").rlike("^ORD-[A-Z0-9-]{3,40}$"), "account_id": F.col("account_id").rlike("^ACC-[A-Z0-9-]{3,40}$"), "line_count": F.size(lines).between(1, 50),
        "price": F.forall(lines, lambda x: (x["unit_price_inr"] > 0) & (x["unit_price_inr"] <= 500000)), "quantity": F.forall(lines, lambda x: x["quantity"].between(1, 20)),
        "discount": F.col("discount_pct").between(0, 90), "token_iff_prepaid": (F.col("payment_method") == "COD") == F.col("payment_token_id").isNull(),
    })


def admission(requests: DataFrame, accounts: DataFrame, clock: int, last_event: int) -> DataFrame:
    """`requests` with rejected: FUTURE after the clock, UNKNOWN_ACCOUNT, TOO_OLD at or before the last event of history, else null."""
    known = accounts.select("account_id", F.lit(True).alias("_known")).distinct()
    reason = F.when(F.col("placed_at") > clock, "FUTURE").when(F.col("_known").isNull(), "UNKNOWN_ACCOUNT").when(F.col("placed_at") <= last_event, "TOO_OLD")
    return requests.join(known, "account_id", "left").withColumn("rejected", reason).drop("_known")


def context_failures() -> Column:
    """Of a decision's inputs: what can't be decided on. A score is there unless the row is degraded, and in [0, 1]; the value is above 0."""
    p = F.col("p_abuse")
    return failures({"score": p.isNull() | p.between(0, 1), "return_score": F.col("p_return").isNull() | F.col("p_return").between(0, 1), "value": F.col("value") > 0, "clv": F.col("clv") >= 0})


def decision_failures(y: Policy = Policy()) -> Column:
    """Of a decided row: the invariants that don't hold; an empty array for every row that `policy.decide` makes."""
    cost = F.create_map(*(x for a in ACTIONS for x in (F.lit(a), F.col(f"cost_{a.lower()}"))))
    scored = F.col("p_abuse").isNotNull()
    feasible = F.when(F.col("action") == "ALLOW", ~F.col("g5")).when(F.col("action") == "BLOCK", ~(F.col("g2") | F.col("g3") | F.col("g4"))).otherwise(True)
    left = F.least(F.when(~F.col("g5"), F.col("cost_allow")), F.col("cost_prepaid_only"), F.col("cost_manual_review"), F.when(~(F.col("g2") | F.col("g3") | F.col("g4")), F.col("cost_block")))
    return failures({
        "action": F.col("action").isin(*ACTIONS), "feasible": ~scored | feasible, "within_tolerance": ~scored | (cost[F.col("action")] - left <= y.tie_tolerance + 1e-9),
        "status": (F.col("action") == "MANUAL_REVIEW") == (F.col("status") == "PENDING_REVIEW"), "degraded": scored | (F.col("cost_optimal").isNull() & F.col("action").isin("ALLOW", "MANUAL_REVIEW")),
    })


def one_to_one(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """The inner join of two tables whose keys don't repeat; a key that does is an error."""
    for name, df in (("left", left), ("right", right)):
        if df.groupBy(key).count().where("count > 1").limit(1).count():
            raise Rejected(f"{key} repeats on the {name} side")
    return left.join(right, key)


def mismatches(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """column, mismatches: how many keys of both tables disagree in each column that both have; nulls are equal."""
    shared = [c for c in left.columns if c in right.columns and c != key]
    both = left.select(key, *(F.col(c).alias(f"l_{c}") for c in shared)).join(right.select(key, *(F.col(c).alias(f"r_{c}") for c in shared)), key)
    rows = both.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column"), (~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}"))).alias("bad")) for c in shared))).alias("x")).select("x.*")
    return rows.groupBy("column").agg(F.count_if("bad").alias("mismatches"))


def with_truth(orders: DataFrame, truth: DataFrame, key: str = "account_id") -> DataFrame:
    """Orders with their account's row of a small table of truths; orders of accounts without one stay."""
    return orders.join(truth, key, "left")
