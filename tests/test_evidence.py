"""Link evidence on one shuffle of the uses against the links themselves."""

import random
from functools import cached_property

import pytest
from pyspark.sql import functions as F

from riskloom.operators import links
from riskloom.sources.world import DAY, World


class Drawn(World):
    """Orders of few accounts on few identifiers: cash orders after several tokens, one instant twice, busy and shared addresses."""

    @cached_property
    def orders(self):
        rng, out = random.Random(3), []
        for k in range(600):
            c = rng.randrange(45)
            confirmed = rng.randrange(400) * DAY if c % 7 == 0 and rng.random() < 0.3 else None
            out.append((k, c, rng.randrange(300) * DAY, f"d{rng.randrange(12)}", "busy" if c % 3 else f"a{rng.randrange(9)}", None if k % 4 == 0 else f"t{rng.randrange(10)}", confirmed))
        return self.spark.createDataFrame(out, "k long, c long, t0 long, device_id string, address_id string, token_id string, confirmed long").cache()

    @cached_property
    def multi_tenant(self):
        return self.spark.createDataFrame([("a1", 100 * DAY), ("busy", 150 * DAY)], "ident string, since long")


@pytest.fixture(scope="module")
def world(spark):
    return Drawn(spark, "")


def test_evidence_equals_sums_of_links(world):
    fan = links.high_fanout(world).withColumn("fan", F.lit(True))
    q, near = links.query_uses(world), links.within(30)
    of = lambda x: {r["q"]: r for r in x.collect()}
    by = lambda x: x.groupBy("q").agg(F.count_if(near & ~F.col("sequential")).alias("n"), F.count_distinct(F.when(near, F.col("other"))).alias("others"), F.sum(F.when(near, F.col("weight")).otherwise(0.0)).alias("near"), F.sum(F.when(F.col("confirmed"), F.col("weight")).otherwise(0.0)).alias("bad"), F.max("weight").alias("w"), F.count_if("confirmed").alias("n_bad"))
    device, token = of(by(links.links(world, q.where("kind = 'DEVICE'")))), of(by(links.links(world, links.token_queries(world))))
    address, wide = of(by(links.links(world, q.where("kind = 'ADDRESS'").join(fan, "q", "left_anti")))), {r["q"] for r in fan.collect()}
    shared = {"a1": 100 * DAY, "busy": 150 * DAY}
    orders = {r["k"]: r for r in world.orders.collect()}
    found = {r["k"]: r for r in links.evidence(world).collect()}
    assert found.keys() == orders.keys() and wide and any(o["token_id"] is None and token.get(k) for k, o in orders.items())
    for k, r in found.items():
        d, t, a = device.get(k), token.get(k), address.get(k)
        assert (r["device_others_30d"], r["device_confirmed_peers"], r["token_others_30d"]) == (min(d["n"], 25) if d else 0, d["n_bad"] if d else 0, t["others"] if t else 0)
        want = [d["bad"] if d else 0, d["w"] if d else 0, t["w"] if t else 0, a["near"] if a else 0, a["bad"] if a else 0, a["w"] if a else 0]
        assert [r[c] for c in ("device_confirmed_weight", "device_weight", "token_weight", "address_weighted_30d", "address_confirmed_weight", "address_weight")] == pytest.approx(want)
        assert (r["high_fanout"], r["address_multi_tenant"]) == (k in wide, shared.get(orders[k]["address_id"], 1 << 62) < orders[k]["t0"])


def test_uses_are_shuffled_once(spark, world):
    """One shuffle of the orders' uses to their identifiers serves both sides of the join, and link rows aren't shuffled."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = links.evidence(world)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("ReusedExchange") >= 1
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(other" in line]
