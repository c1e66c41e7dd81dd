"""Relationship evidence: other accounts' earlier uses of an order's identifiers, with decayed weights.

The core is an as-of join: equality on the identifier shuffles, the time bound is part of the join condition. Each use lasts
until the account's next one, so exactly one use of an account is its last before t0: the join gives one row per (order,
identifier, other account) and nothing is grouped after it. Identifiers with many accounts are found first, by a running
count over the beginnings and ends of uses, and an address that links nobody is kept out of the join. A hot identifier is a
skewed join key: AQE splits it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from ..sources.world import DAY, World

#: Base reliability and half-life in days, by kind (fixed values).
RELIABILITY = {"DEVICE": 0.8, "ADDRESS": 0.4, "PAYMENT_TOKEN": 0.9}
HALF_LIFE = {"DEVICE": 30.0, "ADDRESS": 45.0, "PAYMENT_TOKEN": 60.0}
SEQUENTIAL, SEQUENTIAL_IDLE = 0.2, 60 * DAY
MULTI_TENANT = 0.1
FANOUT, FANOUT_WINDOW = 25, 90 * DAY
RELIABLE_WEIGHT, RELIABLE_WINDOW = 0.25, 90 * DAY
HOUSEHOLD = 3
CAP_DEVICE_ACCOUNTS = 25
#: Kinds as numbers, as in `component.numbered`.
_ADDRESS, _DEVICE, _TOKEN = 1, 2, 3


def by_kind(values: dict[str, float]) -> Column:
    return F.expr("case kind " + " ".join(f"when '{k}' then {v}D" for k, v in values.items()) + " end")


def by_number(values: dict[str, float]) -> Column:
    numbers = {"ADDRESS": _ADDRESS, "DEVICE": _DEVICE, "PAYMENT_TOKEN": _TOKEN}
    return F.expr("case kind " + " ".join(f"when {numbers[k]} then {v}D" for k, v in values.items()) + " end")


def query_uses(w: World) -> DataFrame:
    """q, self, t0, kind, ident, own_first: the identifiers of each order, with the account's own first use of it up to then."""
    own = w.edges.groupBy("kind", "ident", "c").agg(F.min("t").alias("own_first"))
    return w.uses.select(F.col("k").alias("q"), "c", F.col("t").alias("t0"), "kind", "ident").join(own, ["kind", "ident", "c"]).select("q", F.col("c").alias("self"), "t0", "kind", "ident", "own_first")


def token_queries(w: World) -> DataFrame:
    """The payment tokens to look at: the order's own, or all earlier tokens of the account for an order without one."""
    paid = query_uses(w).where("kind = 'PAYMENT_TOKEN'")
    cash = w.orders.where("token_id is null").select(F.col("k").alias("q"), F.col("c").alias("self"), "t0")
    earlier = w.edges.where("kind = 'PAYMENT_TOKEN'").select(F.col("c").alias("self"), "kind", "ident", "t")
    earlier = cash.join(earlier, "self").where("t < t0").groupBy("q", "self", "t0", "kind", "ident").agg(F.min("t").alias("own_first"))
    return paid.unionByName(earlier)


def links(w: World, queries: DataFrame | None = None) -> DataFrame:
    """One row per (order, identifier, other account): first and last earlier use, whether sequential, reliability, weight, confirmed."""
    queries = query_uses(w) if queries is None else queries
    found = queries.join(_spans(w).withColumnRenamed("c", "other"), ["kind", "ident"]).where("other <> self and last < t0 and (next is null or next >= t0)").drop("next")
    # the order's own use lasts to t0, so only the other account can have been idle before
    sequential = (F.col("kind") == "DEVICE") & (F.col("first") < F.col("own_first")) & (F.col("last") + SEQUENTIAL_IDLE <= F.col("own_first"))
    found = found.withColumn("sequential", sequential)
    found = found.join(w.multi_tenant, "ident", "left").withColumn("multi_tenant", F.coalesce((F.col("kind") == "ADDRESS") & (F.col("since") < F.col("t0")), F.lit(False)))
    reliability = F.when(F.col("sequential"), F.lit(SEQUENTIAL)).when(F.col("multi_tenant"), F.lit(MULTI_TENANT)).otherwise(by_kind(RELIABILITY))
    found = found.withColumn("reliability", reliability).withColumn("weight", F.col("reliability") * F.pow(F.lit(0.5), (F.col("t0") - F.col("last")) / DAY / by_kind(HALF_LIFE)))
    confirmed = w.accounts.select(F.col("c").alias("other"), "confirmed")
    found = found.join(confirmed, "other", "left").withColumn("confirmed", F.coalesce(F.col("confirmed") < F.col("t0"), F.lit(False)))
    return found.drop("since")


def within(days: int) -> Column:
    return F.col("last") >= F.col("t0") - days * DAY


def _spans(w: World) -> DataFrame:
    """kind, ident, c, last, next, first: every distinct use, until the account's next use; and the account's first one."""
    of = Window.partitionBy("kind", "ident", "c").orderBy("t")
    edges = w.uses.select("kind", "ident", "c", "t").repartition("ident").distinct()  # one shuffle serves uses, spans and what joins them by ident
    return edges.select("kind", "ident", "c", F.col("t").alias("last"), F.lead("t").over(of).alias("next"), F.first("t").over(of).alias("first"))


def span_steps(spans: DataFrame) -> DataFrame:
    """ident, t, d: an account counts (+1) after its use, and no more (-1) after its next use or 90 days."""
    end = F.least("next", F.col("last") + FANOUT_WINDOW)
    both = F.array(F.struct(F.col("last").alias("t"), F.lit(1).alias("d")), F.struct(end.alias("t"), F.lit(-1).alias("d")))
    return spans.select("ident", F.explode(both).alias("x")).select("ident", "x.t", "x.d")


def high_fanout(w: World) -> DataFrame:
    """q: orders whose address has more than 25 accounts in the 90 days before, the order's own included.

    An account is in the window from its use until 90 days after it or its next use, whichever is first; these spans don't
    overlap, so a running sum of their beginnings and ends counts accounts, without pairs.
    """
    steps = span_steps(_spans(w).where("kind = 'ADDRESS'"))
    steps = steps.select("ident", "t", "d", F.lit(None).cast(w.uses.schema["k"].dataType).alias("q"), F.lit(False).alias("own"))
    before = Window.partitionBy("ident", "c").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.max("t").over(before) >= F.col("t") - FANOUT_WINDOW, F.lit(False))
    orders = w.uses.where("kind = 'ADDRESS'").select("ident", "t", F.lit(0).alias("d"), F.col("k").alias("q"), own.alias("own"))
    running = Window.partitionBy("ident").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    counted = steps.unionByName(orders).withColumn("n", F.coalesce(F.sum("d").over(running), F.lit(0)))
    return counted.where(F.col("q").isNotNull() & (F.col("n") - F.col("own").cast("int") + 1 > FANOUT)).select("q")


def _known_uses(w: World) -> DataFrame:
    """k, id, kind (a number), c, t, confirmed, since, first, next, own, last of every use, each identifier's in one task.

    `next`: the account's next use, and `last` whether no other order of it has this very use, by place: one row of an instant is
    last, and has `next`. `own`: the account's use before was within the fan-out window. Kept worlds have uses in buckets by
    identifier, so nothing is shuffled; else they are shuffled by `id`, an identifier with its kind's number.
    """
    if w.numbered is not None:
        uses = w.numbered[0].where("c is not null and t is not null")
    else:
        confirmed = w.accounts.where("confirmed is not null").select("c", "confirmed")
        o = w.orders.select("k", "c", F.col("t0").alias("t"), "device_id", "address_id", "token_id").join(confirmed, "c", "left")
        uses = o.select("k", "c", "t", "confirmed", F.expr(f"stack(3, {_DEVICE}, device_id, {_ADDRESS}, address_id, {_TOKEN}, token_id) as (kind, ident)")).where("ident is not null and c is not null and t is not null")
        uses = uses.withColumn("id", F.concat("kind", "ident")).drop("ident").repartition("id").join(w.multi_tenant.select(F.concat(F.lit(str(_ADDRESS)), "ident").alias("id"), "since"), "id", "left")
    of = Window.partitionBy("id", "c").orderBy("t")
    before = F.max("t").over(of.rangeBetween(Window.unboundedPreceding, -1))
    uses = uses.withColumns({"first": F.first("t").over(of), "next": F.lead("t").over(of), "own": F.coalesce(before >= F.col("t") - FANOUT_WINDOW, F.lit(False))})
    return uses.withColumn("last", F.coalesce(F.col("next") > F.col("t"), F.lit(True)))


def _with_fan(uses: DataFrame) -> DataFrame:
    """`uses` with fan: the use is of an address that has too many accounts then; see `high_fanout`."""
    step = lambda t, d, use: F.struct(t.alias("t"), F.lit(d).alias("d"), F.lit(use).alias("use"))
    asked, end = step(F.col("t"), 0, True), F.least("next", F.col("t") + FANOUT_WINDOW)
    steps = F.when(F.col("last") & (F.col("kind") == _ADDRESS), F.array(asked, step(F.col("t"), 1, False), step(end, -1, False))).otherwise(F.array(asked))
    rows = uses.withColumn("x", F.explode(steps)).select("id", "kind", "c", "k", F.col("x.t").alias("t"), "x.d", "x.use", "first", "own", "since")
    running = Window.partitionBy("id").orderBy("t").rangeBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("n", F.coalesce(F.sum("d").over(running), F.lit(0))).where("use")
    return rows.withColumn("fan", (F.col("kind") == _ADDRESS) & (F.col("n") - F.col("own").cast("int") + 1 > FANOUT)).drop("d", "use", "n", "own")


def _others_met(queries: DataFrame, uses: DataFrame) -> DataFrame:
    """`queries` (id, kind, c, t, first) with each other account's last use before t, which is `last`, and its weight; t becomes t0."""
    others = uses.where("last").select("id", F.col("c").alias("other"), F.col("t").alias("last"), "next", F.col("first").alias("others_first"), F.col("confirmed").alias("confirmed_at"), F.col("since").alias("mt_since"))
    met = queries.join(others, "id").where("other <> c and last < t and (next is null or next >= t)").withColumnRenamed("t", "t0")
    sequential = (F.col("kind") == _DEVICE) & (F.col("others_first") < F.col("first")) & (F.col("last") + SEQUENTIAL_IDLE <= F.col("first"))
    shared = (F.col("kind") == _ADDRESS) & F.coalesce(F.col("mt_since") < F.col("t0"), F.lit(False))
    reliability = F.when(sequential, F.lit(SEQUENTIAL)).when(shared, F.lit(MULTI_TENANT)).otherwise(by_number(RELIABILITY))
    weight = reliability * F.pow(F.lit(0.5), (F.col("t0") - F.col("last")) / DAY / by_number(HALF_LIFE))
    confirmed = F.coalesce(F.col("confirmed_at") < F.col("t0"), F.lit(False))
    return met.withColumns({"reliability": reliability, "weight": weight, "sequential": sequential, "multi_tenant": shared, "near": within(30), "confirmed": confirmed})


def evidence(w: World) -> DataFrame:
    """k and the link features of devices, tokens and addresses of every order.

    Uses meet the other accounts' ones and are summed up where their identifier is, so only sums, one row per order and
    kind, are shuffled to the orders. An order without a token looks at its account's earlier ones (`token_queries`).
    """
    uses = _known_uses(w)
    asked = _with_fan(uses)

    sums = [
        F.count_if(F.col("near") & ~F.col("sequential")).alias("n"), F.sum(F.when(F.col("near"), F.col("weight")).otherwise(0.0)).alias("near_weight"),
        F.sum(F.when(F.col("confirmed"), F.col("weight")).otherwise(0.0)).alias("confirmed_weight"), F.max("weight").alias("weight"), F.count_if("confirmed").alias("n_confirmed"),
    ]
    own = _others_met(asked.where("not fan").select("id", "kind", "c", "t", "first", "k"), uses).groupBy("id", "kind", "k").agg(*sums).drop("id")
    # cash orders: other accounts count once, on whichever earlier token
    tokens = uses.where(f"kind = {_TOKEN} and t = first and last").select("id", "kind", "c", "first")
    cash = w.orders.where("token_id is null").select("k", "c", F.col("t0").alias("t")).join(tokens, "c").where("first < t")
    cash = _others_met(cash, uses).groupBy("k", "id").agg(F.max("weight").alias("cash_weight"), F.collect_list(F.when(F.col("near"), F.col("other"))).alias("others"))
    flags = asked.where(f"kind = {_ADDRESS} and (fan or since < t)").select("k", "fan", F.coalesce(F.col("since") < F.col("t"), F.lit(False)).alias("shared"))
    parts = own.unionByName(cash.drop("id"), True).unionByName(flags, True)
    at = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    by = parts.groupBy("k").agg(
        F.least(F.coalesce(at(_DEVICE, "n"), F.lit(0)), F.lit(CAP_DEVICE_ACCOUNTS)).alias("device_others_30d"), at(_DEVICE, "confirmed_weight").alias("device_confirmed_weight"), at(_DEVICE, "weight").alias("device_weight"),
        at(_DEVICE, "n_confirmed").alias("device_confirmed_peers"),
        F.coalesce(at(_TOKEN, "n"), F.size(F.array_distinct(F.flatten(F.collect_list("others"))))).alias("token_others_30d"), F.coalesce(at(_TOKEN, "weight"), F.max("cash_weight")).alias("token_weight"),
        at(_ADDRESS, "near_weight").alias("address_weighted_30d"), at(_ADDRESS, "confirmed_weight").alias("address_confirmed_weight"), at(_ADDRESS, "weight").alias("address_weight"),
        F.max("fan").alias("high_fanout"), F.max("shared").alias("address_multi_tenant"),
    )
    out = w.orders.select("k").join(by, "k", "left")
    zero = lambda name: F.coalesce(name, F.lit(0.0)).alias(name)
    none = lambda name: F.coalesce(name, F.lit(0)).cast("long").alias(name)
    no = lambda name: F.coalesce(name, F.lit(False)).alias(name)
    return out.select(
        "k", none("device_others_30d"), zero("device_confirmed_weight"), zero("device_weight"), none("device_confirmed_peers"), none("token_others_30d"), zero("token_weight"),
        zero("address_weighted_30d"), zero("address_confirmed_weight"), zero("address_weight"), no("high_fanout"), no("address_multi_tenant"),
    )


def reuse_velocity(w: World) -> DataFrame:
    """k, reuse_7d: accounts, the own one included, whose first use of one of the order's identifiers is in the last 7 days."""
    first = w.edges.groupBy("kind", "ident", F.col("c").alias("other")).agg(F.min("t").alias("first"))
    uses = w.uses.select(F.col("k").alias("q"), F.col("t").alias("t0"), "kind", "ident")
    recent = uses.join(first, ["kind", "ident"]).where(f"first >= t0 - {7 * DAY} and first < t0").groupBy(F.col("q").alias("k")).agg(F.count("*").alias("reuse_7d"))
    return w.orders.select("k").join(recent, "k", "left").select("k", F.coalesce("reuse_7d", F.lit(0)).alias("reuse_7d"))


def new_device(w: World) -> DataFrame:
    """k, new_device: 1 if the account hasn't used the device before."""
    first = w.edges.where("kind = 'DEVICE'").groupBy("ident", "c").agg(F.min("t").alias("first"))
    o = w.orders.select("k", "c", "t0", F.col("device_id").alias("ident"))
    return o.join(first, ["ident", "c"]).select("k", F.when(F.col("first") < F.col("t0"), 0).otherwise(1).alias("new_device"))


def discounted(w: World) -> DataFrame:
    """q, kind, reason, weight: at most one discount per identifier, by precedence.

    Links are summed up where their identifier is, so neither uses nor links are shuffled to it or to an order.
    """
    uses = _known_uses(w)
    asked = _with_fan(uses)
    names = F.expr(f"case kind when {_ADDRESS} then 'ADDRESS' when {_DEVICE} then 'DEVICE' else 'PAYMENT_TOKEN' end").alias("kind")
    wide = asked.where("fan").select(F.col("k").alias("q"), names, F.lit("HIGH_FANOUT_IDENTIFIER").alias("reason"), F.lit(0.0).alias("weight"))
    found = _others_met(asked.where("not fan").select("id", "kind", "c", "t", "first", "k"), uses)
    one = found.groupBy("id", "kind", "k").agg(
        F.count("*").alias("n"), F.max("weight").alias("strongest"), F.max(F.col("confirmed").cast("int")).alias("any_confirmed"), F.max(F.col("multi_tenant").cast("int")).alias("mt"),
        F.max(F.when(F.col("sequential"), F.col("weight"))).alias("sequential"),
        F.max(F.when((F.col("reliability") >= RELIABLE_WEIGHT) & (F.col("weight") < RELIABLE_WEIGHT), F.col("weight"))).alias("stale"),
    ).withColumnRenamed("k", "q").withColumn("kind", names)
    address = F.col("kind") == "ADDRESS"
    reason = (
        F.when(address & (F.col("mt") == 1), "MULTI_TENANT_ADDRESS")
        .when(address & (F.col("n") <= HOUSEHOLD) & (F.col("any_confirmed") == 0), "HOUSEHOLD_PATTERN")
        .when((F.col("kind") == "DEVICE") & F.col("sequential").isNotNull(), "SEQUENTIAL_DEVICE_USE").when(F.col("stale").isNotNull(), "STALE_RELATIONSHIP")
    )
    weight = F.expr("case reason when 'SEQUENTIAL_DEVICE_USE' then sequential when 'STALE_RELATIONSHIP' then stale else strongest end")
    return wide.unionByName(one.withColumn("reason", reason).where("reason is not null").select("q", "kind", "reason", F.round(weight, 4).alias("weight")))
