"""The reviewer's graph against a plain greedy choice, over made worlds with paths of several hops."""

import random

import pytest
from pyspark.sql import functions as F

from riskloom.operators import component, ego
from riskloom.sources import log
from riskloom.sources.world import DAY


@pytest.fixture(scope="module")
def world(spark):
    """Chains of accounts that share tokens and devices, with a device that very many use."""
    rng = random.Random(3)
    ident = lambda kind, n: f"{kind}{n:031x}"
    orders, events, accounts = [], [], []
    for c in range(160):
        accounts.append((f"ACC-{c:03d}", -10 * DAY, "HISTORY"))
        for j in range(3):
            k = f"ORD-{c:03d}{j}"
            t = DAY * rng.randrange(20) + rng.randrange(DAY)
            device = ident("d", 999) if c % 3 == 0 and j == 0 else ident("d", c // 4 if j else c)
            orders.append((k, f"ACC-{c:03d}", t, 100.0, 0.0, 1, "STANDARD", "PREPAID_UPI", device, ident("a", c // 3), ident("b", (c + 2 * j) // 5), "HISTORY"))
            if c % 11 == 0:
                events += [(len(events), k, "DELIVERED", t + 1, None), (len(events) + 1, k, "ABUSE_CONFIRMED", t + DAY, None)]
    frame = lambda rows, name: spark.createDataFrame(rows, log.SCHEMAS[name])
    kinds = {"d": "DEVICE", "a": "ADDRESS", "b": "PAYMENT_TOKEN"}
    idents = {i: kinds[i[0]] for o in orders for i in o[8:11]}
    lines = [(o[0], 1, "s", "p", "v", "HOME", 100.0, 1) for o in orders]
    return log.LogWorld(log.EventLog(frame(accounts, "accounts"), frame([(i, k, None) for i, k in idents.items()], "identifiers"), frame(orders, "orders"), frame(lines, "order_lines"), frame(events, "order_events"))).kept()


def chosen(o, reached, direct, recent, confirmed, edges):
    """Nodes to draw, one by one, from what the search and the links have found."""
    own = {i for i in (o["device_id"], o["address_id"], o["token_id"]) if i}
    by = {r["account"]: r for r in reached}
    must = {a for a, _, _ in recent} | {r["other"] for r in direct if r["kind"] == "DEVICE" and r["confirmed"]}
    for a in list(must):
        while a in by and by[a]["parent"] not in (None, o["c"]):
            a = by[a]["parent"]
            must.add(a)
    facts = {}
    for r in direct:
        f = facts.setdefault(r["other"], {"weight": 0.0, "direct": True})
        f["weight"] = max(f["weight"], r["weight"])
    hops = set()
    for a in must & set(by):
        via = by[a]["ident"]
        if via is not None and via not in own:
            hops.add(via)
            for holder in {a, by[a]["parent"]} - {o["c"]}:
                f = facts.setdefault(holder, {"weight": 0.0, "direct": False})
                f["weight"] = max(f["weight"], edges(holder, via, o["t0"]))
    for a, f in facts.items():
        f |= {"confirmed": confirmed.get(a, 1 << 62) < o["t0"], "parent": None, "via": None, "depth": 1}
        if not f["direct"] and a in by and by[a]["ident"] is not None:
            f["via"] = by[a]["ident"]
            if by[a]["parent"] != o["c"]:
                f |= {"parent": by[a]["parent"], "depth": max(by[a]["depth"], 2)}
    rank = lambda a: (not facts[a]["confirmed"], -facts[a]["weight"], a)
    left, kept, shown_via, out = ego.NODES - 2 - len(own), {o["c"]}, set(), []

    def take(a):
        nonlocal left
        f = facts[a]
        need = int(f["via"] is not None and f["via"] not in shown_via)
        if a in kept or f["parent"] is not None and f["parent"] not in kept or 1 + need > left:
            return
        if need:
            shown_via.add(f["via"])
            out.append(("IDENTIFIER", f["via"]))
        kept.add(a)
        out.append(("ACCOUNT", a))
        left -= 1 + need

    for a in sorted(must & set(facts), key=lambda a: (facts[a]["depth"], rank(a))):
        take(a)
    for a, k, t in sorted((x for x in recent if x[0] in facts), key=lambda x: (rank(x[0]), -x[2], x[1])):
        if a in kept and left > 0:
            out.append(("ORDER", k))
            left -= 1
    for a in sorted(set(facts) - must, key=rank):
        take(a)
    total = 2 + len(own) + len(hops) + len(facts) + sum(x[0] in facts for x in recent)
    return out, total, {a for a in must if a in facts}


def test_graph_equals_a_plain_choice(world):
    keys = world.orders.where("substring(k, 8) = '2'")
    reached, direct = component.search(world, keys).collect(), ego.direct_links(world, keys).collect()
    orders = {r["k"]: r for r in world.orders.collect()}
    confirmed = {r["c"]: r["confirmed"] for r in world.accounts.where("confirmed is not null").collect()}
    uses = [(o["c"], o[i], kind, o["t0"]) for o in orders.values() for i, kind in (("device_id", "DEVICE"), ("address_id", "ADDRESS"), ("token_id", "PAYMENT_TOKEN"))]

    def edges(account, ident, t0):
        kind, last = max((kind, t) for c, i, kind, t in uses if c == account and i == ident and t < t0)
        from riskloom.operators import links

        return links.RELIABILITY[kind] * 0.5 ** ((t0 - last) / DAY / links.HALF_LIFE[kind])

    capped = far = 0
    for r in ego.ego(world, keys).collect():
        o = orders[r["q"]]
        mine = [x for x in reached if x["q"] == r["q"]]
        linked = {x["account"] for x in mine} - {o["c"]}
        recent = [(x["c"], x["k"], x["t0"]) for x in orders.values() if x["c"] in linked and o["t0"] - DAY <= x["t0"] < o["t0"]]
        want, total, must = chosen(o, mine, [x for x in direct if x["q"] == r["q"]], recent, confirmed, edges)
        got = [(n["kind"], n["id"]) for n in r["nodes"]]
        assert got == want and r["total"] == total and r["shown"] == len(want) + 5 <= ego.NODES, r["q"]
        drawn = {o["c"]} | {i for kind, i in got if kind == "ACCOUNT"}
        assert all(n["parent"] is None or n["parent"] in drawn for n in r["nodes"])
        capped += total > r["shown"]
        far += any(n["depth"] > 1 for n in r["nodes"])
    assert capped and far


def test_search_has_parents(world):
    rows = component.search(world, world.orders.where("substring(k, 8) = '1'")).collect()
    depth = {(r["q"], r["account"]): r["depth"] for r in rows}
    assert all(depth[r["q"], r["parent"]] == r["depth"] - 1 for r in rows if r["depth"]) and max(depth.values()) > 1
    assert F is not None
