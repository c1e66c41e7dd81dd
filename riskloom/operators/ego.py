"""The graph that a reviewer sees of an order: its identifiers, linked accounts with the paths that reach them, and recent orders.

What must be drawn is every account whose order or confirmation counts as evidence, and all accounts on the search's path
to it. The nodes have a budget: candidates come in a fixed order, and one is drawn if its parent is, and if it and the
identifier that it hangs on fit into what is left. That fold runs as one expression over each order's candidates, which are
bounded before: an account that shares an identifier with the order costs one node, so only the first `NODES` of a kind can
ever be drawn; accounts further away are at most as many as a component has; of an account's orders only the newest count.

Defined results: an order without links has its own nodes only; ties go to the smaller id; orders that aren't in the world have no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written
from ..sources.world import DAY, World
from . import component, links

#: Most nodes of a graph, the order and its account included (fixed value).
NODES = 40


def discount(fan: Column, household: Column) -> Column:
    """Why another account's link isn't evidence, by precedence; null if it is."""
    stale = (F.col("weight") < links.RELIABLE_WEIGHT) | (F.col("last") < F.col("t0") - links.RELIABLE_WINDOW)
    return (
        F.when(fan, "HIGH_FANOUT_IDENTIFIER").when(F.col("multi_tenant"), "MULTI_TENANT_ADDRESS").when(household, "HOUSEHOLD_PATTERN")
        .when(F.col("sequential"), "SEQUENTIAL_DEVICE_USE").when(stale, "STALE_RELATIONSHIP")
    )


def direct_links(w: World, keys: DataFrame) -> DataFrame:
    """The links of the orders `keys` (k) through their own identifiers, each with its discount reason (null: it is evidence)."""
    asked = links.query_uses(w).join(keys.select(F.col("k").alias("q")), "q", "left_semi")
    fan = links.high_fanout(w).withColumn("fan", F.lit(True))
    found = links.links(w, asked).join(fan, "q", "left")
    of = Window.partitionBy("q", "kind", "ident")
    address, wide = F.col("kind") == "ADDRESS", F.coalesce("fan", F.lit(False))
    house = address & (F.count("*").over(of) <= links.HOUSEHOLD) & (F.max(F.col("confirmed").cast("int")).over(of) == 0)
    return found.withColumn("discount", discount(address & wide, house)).drop("fan")


def _recent(w: World, reached: DataFrame) -> DataFrame:
    """q, account, k, t: orders of the component's other accounts in the 24 hours before."""
    placed = w.orders.select(F.col("c").alias("account"), "k", F.col("t0").alias("t"))
    return reached.where("account <> self").select("q", "t0", "account").join(placed, "account").where(f"t < t0 and t >= t0 - {DAY}").select("q", "account", "k", "t")


def _closed(wanted: DataFrame, reached: DataFrame) -> DataFrame:
    """`wanted` (q, account) and all accounts on their paths; the loop ends when a step finds no further parent."""
    paths = reached.where("depth > 0 and parent <> self").select("q", "account", F.col("parent"))
    known = written(wanted.distinct())
    step = known
    while True:
        step = written(step.join(paths, ["q", "account"]).select("q", F.col("parent").alias("account")).distinct().join(known, ["q", "account"], "left_anti"))
        if not step.limit(1).count():
            return known
        known = written(known.unionByName(step))


def ego(w: World, keys: DataFrame) -> DataFrame:
    """q, shown, total, nodes of the orders `keys` (k); nodes are (kind, id, parent, via, depth, confirmed, weight) in the order they were drawn."""
    reached = written(component.search(w, keys))
    direct = written(direct_links(w, keys))
    recent = written(_recent(w, reached))
    peers = direct.where("kind = 'DEVICE' and confirmed").select("q", F.col("other").alias("account"))
    must = written(_closed(recent.select("q", "account").unionByName(peers), reached))
    own = reached.where("depth = 0").select("q", "self", "t0")
    idents = own.join(w.uses.select(F.col("k").alias("q"), "kind", "ident"), "q").select("q", "kind", "ident").distinct()

    # hops through other identifiers than the order's own: both ends hang on the hop's identifier
    hops = reached.where("depth > 0").join(must, ["q", "account"], "left_semi").join(idents.select("q", "ident"), ["q", "ident"], "left_anti").select("q", "self", "t0", "account", "parent", "ident")
    ends = hops.select("q", "t0", "account", "ident").unionByName(hops.where("parent <> self").select("q", "t0", F.col("parent").alias("account"), "ident")).distinct()
    uses = w.edges.select(F.col("c").alias("account"), "kind", "ident", "t")
    weighed = ends.join(uses, ["account", "ident"]).where("t < t0").groupBy("q", "t0", "account", "kind", "ident").agg(F.max("t").alias("last"))
    weight = links.by_kind(links.RELIABILITY) * F.pow(F.lit(0.5), (F.col("t0") - F.col("last")) / DAY / links.by_kind(links.HALF_LIFE))
    far = weighed.withColumn("weight", weight).select("q", "account", "weight", F.lit(False).alias("direct"))

    flags = w.accounts.select(F.col("c").alias("account"), F.col("confirmed").alias("since"))
    facts = direct.select("q", F.col("other").alias("account"), "weight", F.lit(True).alias("direct")).unionByName(far)
    facts = facts.groupBy("q", "account").agg(F.max("weight").alias("weight"), F.bool_or("direct").alias("direct")).join(own, "q").where("account <> self").join(flags, "account", "left")
    facts = facts.withColumn("confirmed", F.coalesce(F.col("since") < F.col("t0"), F.lit(False))).drop("since")
    via = reached.where("depth > 0").select("q", "account", F.col("depth").alias("hops"), "parent", "ident")
    facts = facts.join(via, ["q", "account"], "left").join(must.withColumn("must", F.lit(True)), ["q", "account"], "left").withColumn("must", F.coalesce("must", F.lit(False)))
    further = ~F.col("direct") & F.col("ident").isNotNull()
    other = further & (F.col("parent") != F.col("self"))
    facts = written(facts.select(
        "q", "account", "weight", "confirmed", "must", "direct", F.when(other, F.col("parent")).alias("parent"), F.when(further, F.col("ident")).alias("via"),
        F.when(other, F.greatest("hops", F.lit(2))).otherwise(1).alias("depth"),
    ))
    rank = [F.col("confirmed").cast("int") * -1, -F.col("weight"), F.col("account")]
    place = F.row_number().over(Window.partitionBy("q", "must", "direct").orderBy(*rank))
    accounts = facts.withColumn("n", place).where(f"not direct or n <= {NODES}")
    accounts = accounts.select("q", F.struct(
        F.when(F.col("must"), 0).otherwise(2).alias("phase"), F.when(F.col("must"), F.col("depth")).otherwise(0).alias("first"), (-F.col("confirmed").cast("int")).alias("bad"), (-F.col("weight")).alias("light"), F.col("account").alias("name"),
        F.lit(0).cast("long").alias("age"), F.lit(None).cast(w.orders.schema["k"].dataType).alias("k"), "parent", "via", "depth", "confirmed", "weight").alias("x"))
    newest = F.row_number().over(Window.partitionBy("q", "account").orderBy(F.desc("t"), "k"))
    placed = recent.join(facts.select("q", "account", "confirmed", "weight", "depth"), ["q", "account"]).withColumn("n", newest)
    drawn = placed.where(f"n <= {NODES}").select("q", F.struct(
        F.lit(1).alias("phase"), F.lit(0).alias("first"), (-F.col("confirmed").cast("int")).alias("bad"), (-F.col("weight")).alias("light"), F.col("account").alias("name"),
        (-F.col("t")).alias("age"), "k", F.lit(None).cast(w.orders.schema["c"].dataType).alias("parent"), F.lit(None).cast("string").alias("via"), "depth", "confirmed", "weight").alias("x"))
    lists = accounts.unionByName(drawn).groupBy("q").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    counts = facts.groupBy("q").agg(F.count("*").alias("n_accounts")).join(recent.join(facts, ["q", "account"], "left_semi").groupBy("q").agg(F.count("*").alias("n_orders")), "q", "left")
    paths = hops.groupBy("q").agg(F.count_distinct("ident").alias("n_paths"))
    heads = own.join(idents.groupBy("q").agg(F.sort_array(F.collect_set(F.struct("kind", "ident"))).alias("idents")), "q", "left").join(lists, "q", "left").join(counts, "q", "left").join(paths, "q", "left")
    heads = heads.withColumn("idents", F.coalesce("idents", F.expr("array()").cast("array<struct<kind:string,ident:string>>")))
    node = "struct<kind:string,id:string,parent:string,via:string,depth:int,confirmed:boolean,weight:double>"
    fold = f"""aggregate(coalesce(xs, array()), named_struct('left', {NODES} - 2 - size(idents), 'kept', array(cast(self as string)), 'via', cast(array() as array<string>), 'out', cast(array() as array<{node}>)),
      (a, x) -> case
        when x.phase = 1 and a.left > 0 and array_contains(a.kept, cast(x.name as string)) then named_struct('left', a.left - 1, 'kept', a.kept, 'via', a.via,
          'out', concat(a.out, array(named_struct('kind', 'ORDER', 'id', cast(x.k as string), 'parent', cast(x.name as string), 'via', cast(null as string), 'depth', x.depth, 'confirmed', x.confirmed, 'weight', x.weight))))
        when x.phase <> 1 and (x.parent is null or array_contains(a.kept, cast(x.parent as string))) and a.left >= 1 + if(x.via is null or array_contains(a.via, x.via), 0, 1) then named_struct(
          'left', a.left - 1 - if(x.via is null or array_contains(a.via, x.via), 0, 1), 'kept', concat(a.kept, array(cast(x.name as string))), 'via', if(x.via is null or array_contains(a.via, x.via), a.via, concat(a.via, array(x.via))),
          'out', concat(a.out, if(x.via is null or array_contains(a.via, x.via), cast(array() as array<{node}>), array(named_struct('kind', 'IDENTIFIER', 'id', x.via, 'parent', cast(x.parent as string), 'via', cast(null as string), 'depth', x.depth, 'confirmed', false, 'weight', cast(null as double)))),
            array(named_struct('kind', 'ACCOUNT', 'id', cast(x.name as string), 'parent', cast(x.parent as string), 'via', x.via, 'depth', x.depth, 'confirmed', x.confirmed, 'weight', x.weight))))
        else a end, a -> a.out)"""
    heads = heads.withColumn("nodes", F.expr(fold))
    total = 2 + F.size("idents") + sum((F.coalesce(c, F.lit(0)) for c in ("n_accounts", "n_orders")), F.coalesce("n_paths", F.lit(0)))
    return heads.select("q", (2 + F.size("idents") + F.size("nodes")).cast("long").alias("shown"), total.cast("long").alias("total"), "idents", "nodes")
