"""Reviewer queries: the queue with its filters, evidence class, activity metrics, checkout outcomes, attempt log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.world import DAY, World
from . import policy

SORTS = {"newest": ("-t0", "k"), "oldest": ("t0", "k"), "p_abuse": ("-p_abuse", "k"), "value": ("-value", "k")}
OUTCOMES = {"ALLOW": "CONFIRMED", "MANUAL_REVIEW": "CONFIRMED", "PREPAID_ONLY": "PREPAID_REQUIRED", "BLOCK": "DECLINED"}


def evidence_class() -> Column:
    """STRONG if a counted link signal weighs 0.3 or more, WEAK_ONLY if links were only observed weakly, else NONE."""
    s = policy.signals()
    names = [n for n in policy.SIGNALS if n != "ACCOUNT_CLAIMS"]
    strong, seen = F.lit(False), F.lit(False)
    for n in names:
        strong, seen = strong | (s[n][1] & (s[n][2] >= 0.3)), seen | s[n][0]
    return F.when(strong, "STRONG").when(seen, "WEAK_ONLY").otherwise("NONE")


def queue(df: DataFrame, action: str | None = None, status: str | None = None, min_p: float | None = None, min_value: float | None = None, evidence: str | None = None, sort: str = "newest", limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of decisions: filters, then one of four orders with a total tie-break, then the page."""
    df = df.withColumn("evidence", evidence_class())
    for condition in (
        action and F.col("action") == action, status and F.col("status") == status, F.col("p_abuse") >= min_p if min_p is not None else None,
        F.col("value") >= min_value if min_value is not None else None, evidence and F.col("evidence") == evidence,
    ):
        if isinstance(condition, Column):
            df = df.where(condition)
    order = [F.desc(x[1:]) if x.startswith("-") else F.asc(x) for x in SORTS[sort]]
    return df.orderBy(*order).offset(offset).limit(limit).select("k", "t0", "value", "p_abuse", "action", "status", "evidence")


def queue_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("action").agg(F.count("*").alias("n"))


def activity(df: DataFrame) -> DataFrame:
    """One row: decisions, reviews, blocks, expected savings against allowing all, orders with weak evidence only."""
    return df.withColumn("evidence", evidence_class()).agg(
        F.count("*").alias("decisions"), F.count_if(F.col("status") == "PENDING_REVIEW").alias("reviews"), F.count_if(F.col("action") == "BLOCK").alias("blocks"),
        F.round(F.sum((F.col("cost_allow") - F.expr("case action when 'ALLOW' then cost_allow when 'PREPAID_ONLY' then cost_prepaid_only when 'MANUAL_REVIEW' then cost_manual_review else cost_block end")).cast("decimal(20,2)")).cast("double"), 2).alias("expected_savings"),
        F.count_if(F.col("evidence") == "WEAK_ONLY").alias("weak_only"),
    )


def rates(decided: DataFrame, overridden: DataFrame, records: DataFrame) -> DataFrame:
    """One row: decisions, override_rate, explanation_coverage, version_traceability.

    `overridden` has the k of applied overrides; `records` (k, policy_version, model_version, explained, said_policy, said_model) are
    the audit records: one is traceable if it names both versions and its stored ones are these.
    """
    n = decided.agg(F.count("*").alias("decisions"))
    over = overridden.select("k").distinct().agg(F.count("*").alias("overridden"))
    whole = F.coalesce((F.col("said_policy") == F.col("policy_version")) & (F.col("said_model") == F.col("model_version")), F.lit(False))
    said = records.agg(F.count("*").alias("records"), F.count_if("explained").alias("explained"), F.count_if(whole).alias("traceable"))
    share = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0)), 6)
    return n.crossJoin(over).crossJoin(said).select("decisions", share("overridden", "decisions").alias("override_rate"), share("explained", "decisions").alias("explanation_coverage"), share("traceable", "records").alias("version_traceability"))


def checkout(df: DataFrame) -> DataFrame:
    """k, outcome: allowed and reviewed orders look alike to the customer."""
    case = F.create_map(*(F.lit(x) for pair in OUTCOMES.items() for x in pair))
    return df.select("k", case[F.col("action")].alias("outcome"))


def event_micros(events: DataFrame) -> DataFrame:
    """event_id, user_id, event_type, value, cart, t of the event stream table."""
    t = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))")
    return events.select("event_id", "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("long").alias("cart"), t.alias("t"))


def attempt_log(events: DataFrame) -> DataFrame:
    """event_id, attempts_24h (this one included), carts_24h (distinct, this one's included) of every attempt.

    A cart is in the window from an attempt on until the user's next one with it, or for a day: these spans don't overlap, so
    a running sum of their beginnings and ends counts the carts without pairs of attempts. The own cart is counted apart.
    """
    e = event_micros(events)
    by = Window.partitionBy("user_id", "cart")
    e = e.withColumn("next", F.lead("t").over(by.orderBy("t", "event_id"))).withColumn("last", F.max("t").over(by.orderBy("t").rangeBetween(Window.unboundedPreceding, -1)))
    end = F.least("next", F.col("t") + DAY)
    ends = e.where("cart is not null").select("user_id", end.alias("t"), F.lit(-1).alias("d"))
    of = Window.partitionBy("user_id").orderBy("t")
    rows = e.select("user_id", "t", F.when(F.col("cart").isNotNull(), 1).otherwise(0).alias("d"), "event_id", "cart", "last")
    rows = rows.unionByName(ends.select("*", F.lit(None).cast(e.schema["event_id"].dataType).alias("event_id"), F.lit(None).cast("long").alias("cart"), F.lit(None).cast("long").alias("last")))
    known = F.col("event_id").isNotNull()
    rows = rows.withColumn("active", F.coalesce(F.sum("d").over(of.rangeBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = rows.withColumn("attempts_24h", F.sum(known.cast("int")).over(of.rangeBetween(-DAY, -1))).where(known)
    own = F.coalesce(F.col("last") >= F.col("t") - DAY, F.lit(False)).cast("int")
    carts = F.when(F.col("cart").isNull(), 1).otherwise(F.col("active") - own + 1).cast("long")
    return rows.select("event_id", (F.coalesce("attempts_24h", F.lit(0)) + 1).alias("attempts_24h"), carts.alias("carts_24h"))


def snapshot(w: World, clock: int) -> DataFrame:
    """k, t0 and what was known of each order before `clock`: later orders and outcomes aren't there."""
    known = ["delivered", "returned", "claimed", "flagged", "resolved"]
    return w.orders.where(F.col("t0") < clock).select("k", "c", "t0", "value", *(F.when(F.col(x) < clock, F.col(x)).alias(x) for x in known))


def validation(w: World) -> DataFrame:
    """rule, violations: what must not occur in the world's tables."""
    o = w.orders
    checks = {
        "duplicate_order": o.groupBy("k").count().where("count > 1"), "account_after_order": o.join(w.accounts.select("c", "created"), "c").where("created >= t0"),
        "event_before_order": w.events.join(o.select("k", "t0"), "k").where("t < t0"), "token_iff_prepaid": o.where("(payment_method = 'COD') <> (token_id is null)"),
    }
    out = None
    for name, bad in checks.items():
        one = bad.agg(F.count("*").alias("violations")).select(F.lit(name).alias("rule"), "violations")
        out = one if out is None else out.unionByName(one)
    return out
