"""What a reviewer reads: an order with its decision, lines, past and evidence; audit pages; policy values; options to try."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import links
from ..sources.world import DAY, World
from . import policy
from .policy import Policy


def risk_summary() -> Column:
    """One sentence on a decided row's links: confirmed accounts in the component, else counted signals, else discounts, else none.

    Reads n_bad, component_size and n_discounted beside the decision's inputs.
    """
    s = policy.signals()
    counted = F.array_compact(F.array(*(F.when(s[n][1], F.lower(F.replace(F.lit(n), F.lit("_"), F.lit(" ")))) for n in policy.SIGNALS if n != "ACCOUNT_CLAIMS")))
    accounts = F.concat(F.col("component_size").cast("string"), F.when(F.col("component_size") == 1, " account").otherwise(" accounts"))
    return (
        F.when(F.col("p_abuse").isNull(), "No relationship evidence without a score").when(F.col("n_bad") > 0, F.concat(F.lit("Linked to "), accounts, F.lit(", "), F.col("n_bad").cast("string"), F.lit(" with confirmed abuse")))
        .when(F.size(counted) > 0, F.concat(F.lit("Relationship evidence: "), F.array_join(counted, ", "))).when(F.col("n_discounted") > 0, "Shared identifiers count less").otherwise("No relationship evidence")
    )


def graph_summary(df: DataFrame) -> DataFrame:
    """k, component_size, confirmed_accounts, hops, weak_evidence_only: the links of an order in numbers."""
    from .review import evidence_class

    hops = F.when(F.col("proximity") > 0, F.round(1 / F.col("proximity") - 1).cast("int"))
    return df.select("k", "component_size", F.col("n_bad").alias("confirmed_accounts"), hops.alias("hops"), (evidence_class() == "WEAK_ONLY").alias("weak_evidence_only"))


def page(events: DataFrame, order: Column | None = None, event_type: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of audit events, newest first, with the number of all that match."""
    df = events if order is None else events.where(F.col("k") == order)
    df = df if event_type is None else df.where(F.col("event_type") == event_type)
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(F.desc("seq")).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def past(w: World, keys: DataFrame) -> DataFrame:
    """k, what, of, t: the earlier orders and events of the accounts of the orders `keys` (k), strictly before each order."""
    asked = w.orders.join(keys.select("k"), "k", "left_semi").select("k", "c", "t0")
    own = w.orders.select("c", F.lit("ORDER").alias("what"), F.col("k").alias("of"), F.col("t0").alias("t")).unionByName(w.events.select("c", F.col("event_type").alias("what"), F.col("k").alias("of"), "t"))
    return asked.join(own, "c").where("t < t0").select("k", "what", "of", "t")


def detail(w: World, decided: DataFrame, keys: DataFrame) -> DataFrame:
    """One row per order of `keys`: its decision, lines, the account's past, baselines, link kinds and discounts."""
    asked = keys.select("k")
    d = decided.join(asked, "k", "left_semi").select("k", "c", "t0", "value", "p_abuse", "p_return", "clv", "action", "status", policy.fixed_threshold(F.col("p_abuse"), 0.7, 0.4).alias("fixed_threshold"), policy.rule_based().alias("rule_based"))
    lines = w.lines.join(asked, "k", "left_semi").groupBy("k").agg(F.sort_array(F.collect_list(F.struct("sku", "category", "qty", "amount"))).alias("lines"))
    earlier = past(w, keys).groupBy("k").agg(F.count_if(F.col("what") == "ORDER").alias("earlier_orders"), F.count_if(F.col("what") == "RETURNED").alias("earlier_returns"), F.max("t").alias("last_seen"))
    found = links.discounted(w).join(asked, F.col("q") == F.col("k"), "left_semi").groupBy(F.col("q").alias("k")).agg(F.sort_array(F.collect_list(F.struct("kind", "reason", "weight"))).alias("discounts"))
    out = d.join(lines, "k", "left").join(earlier, "k", "left").join(found, "k", "left")
    return out.na.fill(0, ["earlier_orders", "earlier_returns"])


def assumptions(spark: SparkSession, y: Policy = Policy()) -> DataFrame:
    """name, value, version: every value of the policy, with a digest of them all."""
    values = asdict(y)
    digest = hashlib.sha256(json.dumps(values, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    return spark.createDataFrame([(k, float(v), digest) for k, v in values.items()], "name string, value double, version string")


def options(w: World, before: int, discounted: int = 3, new: int = 2) -> DataFrame:
    """c, option: accounts to build an order for: the newest ones with discounted links, accounts without an order before, and
    the account whose device has most accounts.
    """
    o = w.orders.where(F.col("t0") < before)
    known = links.discounted(w).select(F.col("q").alias("k")).distinct().join(o, "k").groupBy("c").agg(F.max("t0").alias("t")).orderBy(F.desc("t"), "c").limit(discounted).select("c", F.lit("DISCOUNTED").alias("option"))
    fresh = w.accounts.join(o.select("c"), "c", "left_anti").orderBy(F.desc("created"), "c").limit(new).select("c", F.lit("NEW").alias("option"))
    shared = o.groupBy("device_id").agg(F.count_distinct("c").alias("n"), F.min("c").alias("c")).orderBy(F.desc("n"), "device_id").limit(1).select("c", F.lit("SHARED_DEVICE").alias("option"))
    return known.unionByName(fresh).unionByName(shared)


def read_back(decisions: DataFrame, events: DataFrame) -> DataFrame:
    """Each decision with the record that was made with it (null where there is none)."""
    made = events.where("event_type = 'DECISION_CREATED'").groupBy("k").agg(F.min_by("payload", "seq").alias("record"), F.min("seq").alias("created_seq"))
    return decisions.join(made, "k", "left")


def link_reasons(w: World) -> DataFrame:
    """q, kind, ident, other, reason: why a link counts less, if it does; old links (over 90 days) are stale as well."""
    fan = links.high_fanout(w).withColumn("fan", F.lit(True))
    found = links.links(w).join(fan, "q", "left")
    n = F.count("*").over(Window.partitionBy("q", "kind", "ident"))
    clean = F.max(F.col("confirmed").cast("int")).over(Window.partitionBy("q", "kind", "ident")) == 0
    address = F.col("kind") == "ADDRESS"
    stale = ((F.col("reliability") >= links.RELIABLE_WEIGHT) & (F.col("weight") < links.RELIABLE_WEIGHT)) | (F.col("last") < F.col("t0") - 90 * DAY)
    reason = (
        F.when(address & F.coalesce("fan", F.lit(False)), "HIGH_FANOUT_IDENTIFIER").when(address & F.col("multi_tenant"), "MULTI_TENANT_ADDRESS").when(address & (n <= links.HOUSEHOLD) & clean, "HOUSEHOLD_PATTERN")
        .when(F.col("sequential"), "SEQUENTIAL_DEVICE_USE").when(stale, "STALE_RELATIONSHIP")
    )
    return found.select("q", "kind", "ident", "other", reason.alias("reason"))
