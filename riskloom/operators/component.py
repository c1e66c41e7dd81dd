"""The component of accounts that are reliably linked to an order's account, as of the order's time.

A use of an identifier links reliably until its weight has decayed or the account's next use takes its place: one span a
use. Spans of two accounts on one identifier that overlap are a pair with a beginning and an end; multi-tenant flags and times
at which an address has too many accounts are cut out of the spans before pairs are made, so a busy address makes none.
Pairs are written once, in buckets by account. The breadth-first search runs for all orders at once: each level is one join of the
frontier's accounts to the pairs with a time bound, and one shuffle by order. Only orders that have found an account at a level go on to the next one.

Ranks keep the order of discovery (parent, then identifier, then account), which decides the kinds of links, the
weakest weight on the path and the parent; at most `MOST` accounts are kept per order, as the definition says.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written, written_by
from ..sources.world import DAY, World
from .links import FANOUT, FANOUT_WINDOW, HALF_LIFE, RELIABILITY, RELIABLE_WEIGHT, RELIABLE_WINDOW, span_steps

MOST = 200
MAX_HOPS = 6
PRIOR_CONFIRMED, PRIOR_ACCOUNTS = 1, 10
#: Kinds as numbers, in the order of discovery.
_KINDS = ("ADDRESS", "DEVICE", "PAYMENT_TOKEN")
_KIND = "case kind " + " ".join(f"when '{k}' then {i}" for i, k in enumerate(_KINDS, 1)) + " end"
#: Days after which a use of each kind no longer links reliably, a day added; the weight itself decides.
_REACH = {k: min(RELIABLE_WINDOW / DAY, HALF_LIFE[k] * math.log2(RELIABILITY[k] / RELIABLE_WEIGHT)) + 1 for k in RELIABILITY}
_END = (1 << 63) - 1


def _by(values: dict[str, float]) -> Column:
    return F.expr("case kind " + " ".join(f"when {i} then {values[k]}D" for i, k in enumerate(_KINDS, 1)) + " end")


def _weight(last: str) -> Column:
    return _by(RELIABILITY) * F.pow(F.lit(0.5), (F.col("t0") - F.col(last)) / DAY / _by(HALF_LIFE))


def _reliable(last: str, weight: str) -> Column:
    return (F.col(weight) >= RELIABLE_WEIGHT) & (F.col(last) >= F.col("t0") - RELIABLE_WINDOW)


def numbered(w: World) -> tuple[DataFrame, DataFrame]:
    """(k, c, t, kind, id, since, confirmed) of every use, and (id, ident): numbers stand for identifiers, as they are a few bytes in all shuffles.

    Numbers rise with kind and identifier, which is the order of discovery. `since`: the identifier is multi-tenant after it.
    `confirmed`: the account's first confirmed abuse. An account's uses of an identifier are one row until they are dealt to the
    identifiers, so that its name is shuffled once for all of them.
    """
    uses = w.uses.select("k", "c", "t", F.expr(_KIND).alias("kind"), "ident")
    mine = uses.groupBy("c", "kind", "ident").agg(F.collect_list(F.struct("k", "t")).alias("rows"))
    mine = mine.join(w.accounts.where("confirmed is not null").select("c", "confirmed"), "c", "left")
    found = uses.select("c", "kind", "ident").distinct().select("kind", "ident").distinct().join(w.multi_tenant, "ident", "left")
    found = written(found.select("kind", "ident", "since"))
    # ranges are sorted in parallel, and a number is a partition's number and the place in it
    names = written(found.repartitionByRange("kind", "ident").sortWithinPartitions("kind", "ident").withColumn("id", F.monotonically_increasing_id()))
    dealt = mine.join(names, ["kind", "ident"]).select("c", "confirmed", "kind", "id", "since", "rows").repartition(int(w.spark.conf.get("spark.sql.shuffle.partitions")), "id")
    dealt = dealt.withColumn("row", F.explode("rows")).select("row.k", "c", "row.t", "kind", "id", "since", "confirmed")
    return written_by(dealt, "id", dealt=True), names.select("id", "ident")


def _numbered(w: World) -> tuple[DataFrame, DataFrame]:
    return w.numbered or numbered(w)


def _uses_until_next(uses: DataFrame) -> DataFrame:
    """kind, id, c, since, last, next: every distinct use, until the account's next one."""
    of = Window.partitionBy("id", "c").orderBy("t")
    edges = uses.select("kind", "id", "c", "t", "since").distinct()
    return edges.select("kind", "id", "c", "since", F.col("t").alias("last"), F.lead("t").over(of).alias("next"))


def _quiet(spans: DataFrame) -> DataFrame:
    """id, lo, hi, full of addresses that ever have more than `FANOUT` accounts: the times (lo, hi] with at most that many in the window, and
    whether that number is reached, so that one account more is too many.
    """
    hot = spans.groupBy("id").agg(F.count_distinct("c").alias("n")).where(f"n > {FANOUT}").select("id")
    steps = span_steps(spans.join(hot, "id", "left_semi").withColumnRenamed("id", "ident")).withColumnRenamed("ident", "id").groupBy("id", "t").agg(F.sum("d").alias("d"))
    by = Window.partitionBy("id").orderBy("t")
    level = F.when(F.col("n") > FANOUT, 2).when(F.col("n") == FANOUT, 1).otherwise(0)
    counted = steps.withColumn("n", F.sum("d").over(by)).withColumn("level", level)
    counted = counted.withColumn("before", F.lag("level").over(by)).where("before is null or before <> level")
    counted = counted.withColumn("hi", F.lead("t").over(by)).select("id", F.col("t").alias("lo"), F.coalesce("hi", F.lit(_END)).alias("hi"), "level")
    return counted.where("level < 2").select("id", "lo", "hi", (F.col("level") == 1).alias("full"))


def _reliable_spans(uses: DataFrame) -> DataFrame:
    """kind, id, c, t, lo, hi, full: each use with the times (lo, hi] at which it may link."""
    end = F.least("next", F.col("last") + (_by(_REACH) * DAY).cast("long"), "since")
    spans = _uses_until_next(uses).select("kind", "id", "c", F.col("last").alias("t"), F.col("last").alias("lo"), end.alias("hi")).where("lo < hi")
    quiet = written(_quiet(_uses_until_next(uses.where("kind = 1"))))
    # each of these addresses has a quiet time, after its last use at least; other identifiers have none here and aren't cut
    cut = spans.join(quiet.select("id", F.col("lo").alias("since"), F.col("hi").alias("until"), "full"), "id", "left")
    cut = cut.withColumn("lo", F.greatest("lo", "since")).withColumn("hi", F.least("hi", "until")).where("lo < hi")
    return cut.select("kind", "id", "c", "t", "lo", "hi", F.coalesce("full", F.lit(False)).alias("full"))


def _pairs(spans: DataFrame) -> DataFrame:
    """account, other, kind, id, last, last2, lo, hi, full: two accounts' spans of an identifier, at the times (lo, hi] of both."""
    one = spans.select("kind", "id", F.col("c").alias("account"), F.col("t").alias("last"), "lo", "hi", "full")
    two = spans.select(F.col("kind").alias("kind2"), "id", F.col("c").alias("other"), F.col("t").alias("last2"), F.col("lo").alias("lo2"), F.col("hi").alias("hi2"), F.col("full").alias("full2"))
    # the same columns of both sides, so that Spark shuffles the spans once; overlapping ones have the same kind and the same quiet times
    met = one.join(two, "id").where("account <> other and lo < hi2 and lo2 < hi")
    return met.select("account", "other", F.greatest("kind", "kind2").alias("kind"), "id", "last", "last2", F.greatest("lo", "lo2").alias("lo"), F.least("hi", "hi2").alias("hi"), (F.col("full") & F.col("full2")).alias("full"))


def _busy(orders: DataFrame, uses: DataFrame, spans: DataFrame) -> DataFrame:
    """q, id: orders whose own account used an address that may be full before the window and not in it, and so is one more."""
    full = spans.where("full").select("id").distinct()
    own = uses.where("kind = 1").select("id", "c", "t").join(full, "id", "left_semi").distinct()
    by = Window.partitionBy("id", "c").orderBy("t")
    own = own.withColumns({"before": F.lag("t").over(by), "next": F.coalesce(F.lead("t").over(by), F.lit(_END))})
    # after its first use at that instant only, and after each use from the window's end until the next one
    times = F.array(F.when(F.col("before").isNull(), F.struct((F.col("t") - 1).alias("lo"), F.col("t").alias("hi"))), F.struct((F.col("t") + FANOUT_WINDOW).alias("lo"), F.col("next").alias("hi")))
    times = own.select("id", F.col("c").alias("self"), F.explode(times).alias("x")).where("x.lo < x.hi").select("id", "self", "x.lo", "x.hi")
    return orders.join(times, "self").where("lo < t0 and t0 <= hi").select("q", "id")


def _kind_names() -> Column:
    """The kinds of a code, which has one digit to the base of 4 a kind, the first one last."""
    digits = F.transform(F.array(*(F.lit(i) for i in range(len(_KINDS)))), lambda i: F.pmod(F.floor(F.col("kinds") / F.pow(F.lit(4), i)), F.lit(4)).cast("int"))
    return F.transform(F.filter(digits, lambda d: d > 0), lambda d: F.element_at(F.array(*(F.lit(k) for k in _KINDS)), d))


def _with_kind() -> Column:
    """The code `kinds` with the row's `kind` put last, if it isn't there yet."""
    at = lambda place: F.pmod(F.floor(F.col("kinds") / 4**place), F.lit(4))
    there = (at(0) == F.col("kind")) | (at(1) == F.col("kind")) | (at(2) == F.col("kind"))
    place = F.when(F.col("kinds") == 0, 1).when(F.col("kinds") < 4, 4).otherwise(16)
    return F.when(there, F.col("kinds")).otherwise(F.col("kinds") + place * F.col("kind")).cast("int")


def _reached(w: World, keys: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """`search` with the number of an identifier in place of itself, and (id, ident)."""
    o = w.orders if keys is None else w.orders.join(keys.select("k"), "k", "left_semi")
    start = o.select(F.col("k").alias("q"), F.col("c").alias("self"), "t0")
    uses, names = _numbered(w)
    spans = written_by(_reliable_spans(uses), "id", dealt=True)
    linked = written_by(_pairs(spans), "account")
    busy = written(_busy(start, uses, spans)) if spans.where("full").limit(1).count() else None
    nothing = lambda name: F.lit(None).cast(w.orders.schema[name].dataType)
    many = (F.col("lo") < F.col("t0")) & (F.col("t0") <= F.col("hi"))
    first = {"rank": F.lit(0).cast("long"), "n": F.lit(1).cast("long"), "kinds": F.lit(0), "bottleneck": F.lit(1.0)}
    columns = ["q", "self", "t0", "account", "other", "rank", "n", "kinds", "bottleneck", "kind", "id", "later", "last", "last2", "full"]
    # the order's own uses are at its own time; the account's other identifiers are as old as its last use. An own identifier's
    # last use before is there too, and loses to the own use by `later`
    own = uses if keys is None else uses.join(keys.select("k"), "k", "left_semi")
    own = own.where("since is null or since >= t").select(F.col("k").alias("q"), F.col("c").alias("self"), F.col("t").alias("t0"), "id")
    own = own.join(spans.withColumnRenamed("c", "other").withColumnRenamed("t", "last2"), "id").where(many & (F.col("other") != F.col("self"))).withColumns(first | {"account": F.col("self"), "last": F.col("t0"), "later": F.lit(False)})
    met = start.join(linked.withColumnRenamed("account", "self"), "self").where(many).withColumns(first | {"account": F.col("self"), "later": F.lit(True)})
    met, level = own.select(columns).unionByName(met.select(columns)), 0
    parts = [start.select("q", "self", "t0", F.col("self").alias("account"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("rank"), F.lit(0).alias("kinds"), F.lit(1.0).alias("bottleneck"), nothing("c").alias("parent"), F.lit(None).cast("long").alias("id"))]
    of = Window.partitionBy("q")
    while True:
        met = met.withColumns({"w": _weight("last"), "w2": _weight("last2")}).where(_reliable("last", "w") & _reliable("last2", "w2"))
        met = met.where("other <> self").select("q", "self", "t0", "other", "full", "kind", F.struct("rank", "id", "later", F.least("bottleneck", "w", "w2").alias("bottleneck"), _with_kind().alias("kinds"), "account", "n").alias("b")).drop("kind")
        # what is known of an order comes to its rows by the one shuffle that all steps of a level need: accounts seen, addresses with one account more
        for p in parts[1:]:
            met = met.unionByName(p.select("q", F.col("account").alias("other"), F.lit(True).alias("seen")), True)
        met = met if "seen" in met.columns else met.withColumn("seen", F.lit(None).cast("boolean"))
        if busy is None:
            met = met.repartition("q")
        else:
            met = met.unionByName(busy.withColumnRenamed("id", "more"), True).repartition("q").withColumn("more", F.collect_set("more").over(of)).where("seen or (b is not null and not (full and array_contains(more, b.id)))")
        found = met.groupBy("q", F.col("other").alias("account")).agg(F.max("self").alias("self"), F.max("t0").alias("t0"), F.min("b").alias("b"), F.max("seen").alias("seen")).where("seen is null")
        level += 1
        found = found.withColumn("rank", F.row_number().over(of.orderBy("b.rank", "b.id", "account")) + F.col("b.n") - 1).where(f"rank < {MOST}")
        found = found.select("q", "self", "t0", "account", F.lit(level).alias("depth"), "rank", F.col("b.kinds").alias("kinds"), F.col("b.bottleneck").alias("bottleneck"), F.col("b.account").alias("parent"), F.col("b.id").alias("id"), (F.col("b.n") + F.count("*").over(of)).alias("n"))
        frontier = written(found)
        if not frontier.limit(1).count():
            break
        parts.append(frontier.drop("n"))
        met = frontier.select("q", "self", "t0", "account", "rank", "kinds", "bottleneck", "n").join(linked, "account").where(many).withColumn("later", F.lit(False)).select(columns)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.withColumn("kinds", _kind_names()), names


def search(w: World, keys: DataFrame | None = None) -> DataFrame:
    """q, self, t0, account, depth, kinds, bottleneck, parent, ident, rank: the accounts of each order's component (of the orders
    `keys`, with k), the own one included; parent and ident are how an account was reached.
    """
    reached, names = _reached(w, keys)
    return reached.join(names, "id", "left").drop("id")


def reached(w: World, keys: DataFrame) -> DataFrame:
    """`search` without the identifiers, for features."""
    return _reached(w, keys)[0]


def components(w: World) -> DataFrame:
    """The search from every order of `w`, without identifiers, made once for all plans on it."""
    if "_components" not in w.__dict__:
        w.__dict__["_components"] = _reached(w)[0]
    return w.__dict__["_components"]


def component_features(w: World, reached: DataFrame | None = None) -> DataFrame:
    """k, component_size, n_bad, abuse_ratio, proximity: of every order's component; the own confirmation is no evidence."""
    confirmed = w.accounts.select(F.col("c").alias("account"), "confirmed")
    all_ = (components(w) if reached is None else reached).join(confirmed, "account", "left").withColumn("bad", (F.col("account") != F.col("self")) & F.coalesce(F.col("confirmed") < F.col("t0"), F.lit(False)))
    one = all_.groupBy(F.col("q").alias("k")).agg(F.count("*").alias("component_size"), F.count_if("bad").alias("n_bad"), F.min(F.when(F.col("bad") & (F.col("depth") <= MAX_HOPS), F.col("depth"))).alias("hops"))
    ratio = (F.col("n_bad") + PRIOR_CONFIRMED) / (F.col("component_size") + PRIOR_ACCOUNTS)
    return one.select("k", "component_size", "n_bad", ratio.alias("abuse_ratio"), F.coalesce(1 / (1 + F.col("hops")), F.lit(0.0)).alias("proximity"))


def burst_features(w: World, reached: DataFrame | None = None) -> DataFrame:
    """k, linked_orders_24h, same_sku_7d, burst_kinds, burst_weight, recent_claims_30d of every order's component."""
    all_ = components(w) if reached is None else reached
    skus = w.orders.select(F.col("k").alias("q"), "skus")
    peers = w.orders.select(F.col("c").alias("account"), F.col("t0").alias("t"), F.col("skus").alias("theirs"))
    near = all_.where("account <> self").join(peers, "account").where(f"t < t0 and t >= t0 - {7 * DAY}").join(skus, "q")
    near = near.withColumn("day", F.col("t") >= F.col("t0") - DAY).withColumn("same", F.arrays_overlap("skus", "theirs")).where("day or same")
    burst = near.groupBy(F.col("q").alias("k")).agg(F.count_if("day").alias("linked_orders_24h"), F.count_if("same").alias("same_sku_7d"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("kinds")))).alias("burst_kinds"), F.max("bottleneck").alias("burst_weight"))
    flags = w.events.where("event_type in ('CLAIM_FILED', 'QC_FLAGGED')").select(F.col("c").alias("account"), "t")
    claims = all_.join(flags, "account").where(f"t < t0 and t >= t0 - {30 * DAY}").groupBy(F.col("q").alias("k")).agg(F.count("*").alias("recent_claims_30d"))
    start = w.orders.select("k") if reached is None else all_.where("depth = 0").select(F.col("q").alias("k"))
    out = start.join(burst, "k", "left").join(claims, "k", "left")
    return out.select("k", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("linked_orders_24h", "same_sku_7d", "recent_claims_30d")), F.coalesce("burst_kinds", F.array().cast("array<string>")).alias("burst_kinds"), F.coalesce("burst_weight", F.lit(0.0)).alias("burst_weight"))
