import os

import duckdb
import pytest
from pyspark.sql import functions as F

from riskloom.functions import money
from riskloom.plans import audit, evaluation, policy
from riskloom.plans.oracles import ORACLES
from riskloom.plans.registry import QUERIES

CHEAP = ["order_value", "primary_category", "variants_same_product", "account_history", "return_rates", "customer_value", "labels", "splits", "links", "reuse_velocity", "new_device",
         "discounted_links", "decide", "attempt_log", "as_of_snapshot", "world_validation", "placeholders", "backtest"]


def plain(v):
    if v is None or isinstance(v, (str, bool)):
        return v
    return round(float(v), 9)


@pytest.fixture(scope="module")
def duck(small):
    con = duckdb.connect()
    for name in os.listdir(small):
        path = f"{small}/{name}" if os.path.isfile(f"{small}/{name}") else f"{small}/{name}/*.parquet"
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", CHEAP)
def test_equals_sql(spark, small, duck, name):
    df = QUERIES[name](spark, small)
    columns = sorted(df.columns)
    found = duck.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    expected = sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr) == expected


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize(("value", "clv", "back", "share", "bad", "action", "cost"), [
    (10000.0, 2000.0, 1, 1.0, 1, "BLOCK", 0.0), (4000.0, 5000.0, 0, 0.0, 1, "MANUAL_REVIEW", 960.0), (2000.0, 2000.0, 1, 0.5, 1, "PREPAID_ONLY", 402.5),
    (1000.0, 10000.0, 0, 0.0, 0, "BLOCK", 6400.0), (5000.0, 3000.0, 1, 1.0, 0, "MANUAL_REVIEW", 427.0), (3000.0, 1000.0, 0, None, 0, "PREPAID_ONLY", 142.0),
])
def test_realised_costs(spark, value, clv, back, share, bad, action, cost):
    row = spark.createDataFrame([(value, clv, back, share, bad, action)], "value double, clv double, return_label int, returned_fraction double, abuse_label int, chosen string")
    assert row.select(evaluation.realised(F.col("chosen"))).first()[0] == pytest.approx(cost)


def test_degraded_orders_have_no_score(spark, small):
    df = QUERIES["decide"](spark, small)
    assert df.where("action is null or status is null").count() == 0
    base = policy.contexts(__import__("riskloom.sources.world", fromlist=["World"]).World(spark, small)).limit(20).withColumn("p_abuse", F.lit(None).cast("double"))
    rows = policy.decide(base).select("value", "action", "cost_optimal").collect()
    assert all(r["action"] == ("MANUAL_REVIEW" if r["value"] >= 5000 else "ALLOW") and r["cost_optimal"] is None for r in rows)


def test_chain_finds_tampering(spark):
    records = spark.createDataFrame([(i, i // 2, f"p{i}") for i in range(25)], "k long, t0 long, payload string")
    chain = audit.chained(records, block=10).persist()
    assert audit.verify(chain).first()[:2] == (25, 0)
    edited = chain.withColumn("payload", F.when(F.col("seq") == 13, "x").otherwise(F.col("payload")))
    assert audit.verify(edited).first().first_broken_seq == 13
    assert audit.roots(chain).where("level = 0").count() == 3


def test_money_text(spark):
    row = spark.createDataFrame([(12345678.4, -999.6, 0.0, 0.0005, 0.4567)], "a double, b double, c double, d double, e double")
    out = row.select(money.rupees(F.col("a")), money.rupees(F.col("b")), money.percent(F.col("c")), money.percent(F.col("d")), money.percent(F.col("e"))).first()
    assert tuple(out) == ("₹1,23,45,678", "-₹1,000", "0%", "<0.1%", "45.7%")


def test_hmac(spark):
    import hashlib
    import hmac

    got = spark.createDataFrame([("abc",), ("",)], "v string").select(money.hmac_sha256("key", F.col("v"))).collect()
    assert [r[0] for r in got] == [hmac.new(b"key", v, hashlib.sha256).hexdigest() for v in (b"abc", b"")]


def test_idempotent_scoring(spark):
    requests = spark.createDataFrame([(1, 1, 5.0), (2, 1, 5.0), (3, 1, 6.0), (4, 2, 1.0), (5, 3, 9.0)], "request_id long, k long, value double")
    stored = spark.createDataFrame([(2,), (3,)], "k long").join(requests.where("k = 2"), "k", "left").select("k", F.sha2(F.concat_ws("|", "k", "value"), 256).alias("fingerprint"))
    got = {r.request_id: r.outcome for r in audit.score_batch(requests, stored, ["k", "value"]).collect()}
    assert got == {1: "CREATED", 2: "REPLAYED", 3: "CONFLICT", 4: "REPLAYED", 5: "CONFLICT"}


def test_component_against_breadth_first_search(spark, small):
    from riskloom.operators import component, links
    from riskloom.sources.world import DAY, World

    w = World(spark, small)
    rows = {r.k: r.component_size for r in component.component_features(w).collect()}
    orders = w.orders.select("k", "c", "t0", "device_id", "address_id", "token_id").collect()
    since = {r.ident: r.since for r in w.multi_tenant.collect()}
    kinds = ("DEVICE", "ADDRESS", "PAYMENT_TOKEN")
    uses = [(kind, o[3 + i], o.c, o.t0) for o in orders for i, kind in enumerate(kinds) if o[3 + i]]
    at, by = {}, {}
    for kind, ident, c, t in uses:
        at.setdefault((kind, ident), []).append((c, t))
        by.setdefault(c, []).append((kind, ident, t))

    def fresh(kind, last, t0):
        return last >= t0 - links.RELIABLE_WINDOW and links.RELIABILITY[kind] * 0.5 ** ((t0 - last) / DAY / links.HALF_LIFE[kind]) >= 0.25

    for o in orders[::37]:
        seen, queue = {o.c}, [o.c]
        while queue:
            a = queue.pop()
            last = {}
            for kind, ident, t in by[a]:
                if t < o.t0:
                    last[kind, ident] = max(last.get((kind, ident), t), t)
            if a == o.c:
                last |= {(kind, o[3 + i]): o.t0 for i, kind in enumerate(kinds) if o[3 + i]}
            for (kind, ident), t in last.items():
                if not fresh(kind, t, o.t0) or kind == "ADDRESS" and ident in since and since[ident] < o.t0:
                    continue
                users = {}
                for c, u in at[kind, ident]:
                    if u < o.t0:
                        users[c] = max(users.get(c, u), u)
                if kind == "ADDRESS" and len({c for c, u in users.items() if u >= o.t0 - 90 * DAY} | ({o.c} if o.c in users or ident == o.address_id else set())) > 25:
                    continue
                for c, u in users.items():
                    if c not in seen and fresh(kind, u, o.t0):
                        seen.add(c)
                        queue.append(c)
        assert rows[o.k] == len(seen), o


def test_stream_equals_batch(spark, small, tmp_path):
    from riskloom.streaming import attempts

    folder = tmp_path / "events"
    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(str(folder))
    found = attempts.run_once(attempts.attempts_by_window(attempts.event_stream(spark, str(folder))), "attempts", str(tmp_path / "state"), "complete")
    batch = attempts.attempts_by_window(events.withColumn("ts", F.col("ts").cast("timestamp")))
    assert found.exceptAll(batch).count() == 0 and batch.exceptAll(found).count() == 0


def test_slope_grid_has_the_whole_range(spark):
    world = type("W", (), {"spark": spark})()
    y, (v, c) = policy.Policy(), (200000.0, 100000.0)
    got = {r.pair: (r.violations, r.least_gap) for r in policy.slope_check(world, y).collect()}
    slope = {}
    for value in [500 * 400 ** (i / 60) for i in range(60)] + [v]:
        for clv in [2000 + (c - 2000) * j / 60 for j in range(60)] + [c]:
            m = 0.3 * value
            block = m + 0.6 * clv + 100
            at = {"ALLOW": 0.85 * value + 150, "PREPAID_ONLY": 0.7 * (0.5 * value + 150) - (0.08 * m + 0.02 * clv + 30), "MANUAL_REVIEW": 0.2 * (0.85 * value + 150) - (0.05 * m + 0.03 * block), "BLOCK": -block}
            for a, b in zip(policy.ACTIONS, policy.ACTIONS[1:]):
                slope.setdefault(f"{a}>{b}", []).append(at[a] - at[b])
    for pair, gaps in slope.items():
        assert got[pair][1] == pytest.approx(min(gaps), abs=0.05) and got[pair][0] == sum(g < -0.005 for g in gaps)


def test_bootstrap_has_a_thousand_resamples():
    import inspect

    assert inspect.signature(evaluation.bootstrap_interval).parameters["resamples"].default == 1000


def test_chain_finds_lost_and_replaced_blocks(spark):
    records = spark.createDataFrame([(i, i // 2, f"p{i}") for i in range(35)], "k long, t0 long, payload string").repartition(4)
    chain = audit.chained(records, block=10).persist()
    kept = audit.roots(chain).persist()
    assert [r.k for r in chain.orderBy("seq").collect()] == list(range(35)) and tuple(audit.verify(chain, kept).first()) == (35, 0, None)
    assert audit.verify(chain.where("block <> 1")).first().broken > 0
    assert audit.verify(chain.where("seq not in (18, 19)")).first().first_broken_seq == 20
    other = audit.chained(records.withColumn("payload", F.when(F.col("k") == 13, "x").otherwise(F.col("payload"))), block=10)
    replaced = chain.where("block <> 1").unionByName(other.where("block = 1"))
    assert audit.verify(replaced).first().broken == 0 and audit.verify(replaced, kept).first().first_broken_seq == 10
    assert audit.verify(chain.where("seq < 33"), kept).first().broken == 1 and audit.verify(chain.where("block < 3"), kept).first().first_broken_seq == 30


def test_reliability_bins_equal_ntile(spark):
    from pyspark.sql import Window

    for n in (0, 7, 10, 103):
        df = spark.range(n).select((F.col("id") * 37 % 101).alias("k"), F.col("id").alias("t0"), (F.col("id") % 9 / 9).alias("p_abuse"), (F.col("id") % 2).alias("abuse_label"))
        want = df.withColumn("bin", F.ntile(10).over(Window.orderBy("p_abuse", "t0", "k"))).groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("p_abuse"), 6).alias("mean_p"), F.round(F.avg("abuse_label"), 6).alias("rate"))
        got = evaluation.reliability(df)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.dtypes == want.dtypes


def test_average_precision_over_ranges(spark):
    rows = [((i * 37 % 211) / 211, i * 53 % 7 == 0) for i in range(400)]
    pos, hits, seen, want = sum(y for _, y in rows), 0, 0, 0.0
    for p in sorted({p for p, _ in rows}, reverse=True):
        new = [y for q, y in rows if q == p]
        hits, seen = hits + sum(new), seen + len(new)
        want += sum(new) * hits / seen
    found = evaluation.average_precision(spark.createDataFrame([(p, int(y)) for p, y in rows], "p_abuse double, abuse_label int"))
    assert tuple(found.first()) == (400, pos, round(want / pos, 6))
    assert "SinglePartition" not in "".join(x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "p_abuse" in x)


def test_log_round_trip_and_errors(spark, small, tmp_path):
    from riskloom.sources import log
    from riskloom.sources.world import World

    made = log.of_world(World(spark, small))
    log.write(made, str(tmp_path / "log"))
    back = log.read(spark, str(tmp_path / "log"))
    for name, df in made.tables().items():
        assert log.fingerprint(df.select(*log.KEYS[name])).collect() == log.fingerprint(back.tables()[name].select(*log.KEYS[name])).collect()
    with pytest.raises(log.LogError):
        log.read(spark, str(tmp_path / "none"))
    assert log.history(back).orders.where("source <> 'HISTORY'").count() == 0


def test_log_labels_use_the_first_events(spark):
    from riskloom.sources import log

    day = 86_400_000_000
    orders = spark.createDataFrame([("A", 0), ("B", 0), ("C", 0), ("D", 0), ("E", 0)], "order_id string, placed_at long")
    rows = [
        (1, "A", "DELIVERED", 1), (2, "A", "DELIVERED", 40), (3, "A", "EXCHANGE_REQUESTED", 20), (4, "A", "RETURN_REQUESTED", 25), (5, "A", "ABUSE_CLEARED", 30), (6, "A", "ABUSE_CONFIRMED", 35),
        (7, "B", "RETURN_REQUESTED", 0), (8, "B", "DELIVERED", 2), (9, "B", "CLAIM_FILED", 3), (10, "C", "DELIVERED", 95), (11, "D", "DELIVERED", 1), (12, "D", "RETURN_REQUESTED", 31), (13, "D", "ABUSE_CONFIRMED", 62),
    ]
    events = spark.createDataFrame([(i, o, e, t * day, 0.5 if i == 4 else None) for i, o, e, t in rows], log.SCHEMAS["order_events"])
    got = {r.order_id: tuple(r)[1:] for r in log.labels(log.EventLog(None, None, orders, None, events), 100 * day).collect()}
    assert got == {"A": (1, "EXCHANGE", 1.0, "CLEARED", 0), "B": (0, "NONE", 0.0, "UNRESOLVED", None), "C": (None, None, None, "NOT_MATURED", None), "D": (1, "FULL", 1.0, "NO_CLAIM", 0), "E": (None, None, None, "NOT_MATURED", None)}


def test_identifiers_that_are_known(spark):
    from riskloom.sources import log

    bad = log.rejected_ids("secret")
    df = spark.createDataFrame([("0" * 32,), ("a" * 32,), (bad[0],), ("short",), (None,)], "i string")
    assert [r[0] for r in df.select(log.known_identifier(F.col("i"), bad)).collect()] == [False, True, False, False, False]


def test_catalog_rejects_what_it_cant_evaluate(tmp_path):
    from riskloom.plans import explain

    assert len(explain.catalog()) == 12
    for predicate in ("f(x) > 1", "a or b", "1 < x < 2", "x > 'a'", "x ="):
        with pytest.raises(explain.CatalogError):
            explain.checked(predicate)
    (tmp_path / "c.toml").write_text('[[codes]]\ncode = "A"\n')
    with pytest.raises(explain.CatalogError):
        explain.catalog(str(tmp_path / "c.toml"))


def test_words_and_templates(spark):
    from riskloom.plans import explain

    df = spark.createDataFrame([(1, ["a"]), (3, ["a", "b"]), (0, ["a", "b", "c"])], "n int, w array<string>")
    rows = df.select(explain.filled("{n} {n:claim|claims}.", {"n": F.col("n")}), explain.joined_words(F.col("w"))).collect()
    assert [tuple(r) for r in rows] == [("1 claim.", "a"), ("3 claims.", "a and b"), ("0 claims.", "a, b and c")]


def test_overrides_are_optimistic(spark):
    from riskloom.plans import audit

    d = spark.createDataFrame([(1, "ALLOW", True), (2, "BLOCK", False)], "k long, action string, g2 boolean")
    asked = [(1, 1, "ALLOW", "BLOCK", "OTHER"), (2, 1, "ALLOW", "BLOCK", "INDEPENDENT_EVIDENCE_OF_ABUSE"), (3, 1, "ALLOW", "BLOCK", "OTHER"), (4, 2, "BLOCK", "ALLOW", "OTHER")]
    r = spark.createDataFrame(asked, "seq long, k long, expected_action string, new_action string, reason string")
    got = {x.seq: (x.outcome, x.warning, x.previous_action) for x in audit.overrides(d, r).collect()}
    assert got == {1: ("REJECTED", None, "ALLOW"), 2: ("APPLIED", "G2", "ALLOW"), 3: ("CONFLICT", None, "BLOCK"), 4: ("APPLIED", None, "BLOCK")}


def test_appended_records_verify(spark):
    from riskloom.plans import audit

    rows = lambda a, b: spark.createDataFrame([(i, i * 10, f"p{i}") for i in range(a, b)], "k long, t0 long, payload string")
    chain = audit.append(audit.chained(rows(0, 25), 10), rows(25, 37), 10)
    out = audit.verify(chain).first()
    assert (out.rows_checked, out.broken) == (37, 0) and sorted(r.seq for r in chain.select("seq").collect()) == list(range(37))
    assert audit.verify(chain.where("block <> 1")).first().broken > 0


def test_uuid5(spark):
    import uuid

    from riskloom.functions import money

    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    names = ["a", "order é", ""]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(money.uuid5(space, F.col("n"))).collect()]
    assert got == [str(uuid.uuid5(uuid.UUID(space), n)) for n in names]
