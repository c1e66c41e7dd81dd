"""A log in which events repeat: the latest delivery before an order counts, first resolutions decide, truth is an input."""

import pytest

from riskloom.operators import history
from riskloom.plans import evaluation, policy, report
from riskloom.sources import log
from riskloom.sources.world import World

DAY = 86_400_000_000


@pytest.fixture(scope="module")
def repeated(spark):
    """Two accounts: one whose first order is delivered on days 5 and 40, one that is cleared on day 10 and confirmed on day 30."""
    frame = lambda rows, name: spark.createDataFrame(rows, log.SCHEMAS[name])
    order = lambda k, c, day, value=50000.0: (k, c, day * DAY, value, 0.0, 1, "STANDARD", "COD", "1" * 32, "2" * 32, None, "HISTORY")
    orders = [order("o1", "a", 0), order("o2", "a", 38), order("o3", "a", 50), order("o4", "a", 75), order("p1", "b", 1), order("p2", "b", 400), order("q1", "d", 2)]
    events = [(1, "o1", "DELIVERED", 5 * DAY, None), (2, "o1", "DELIVERED", 40 * DAY, None), (3, "p1", "DELIVERED", 3 * DAY, None), (4, "p1", "CLAIM_FILED", 4 * DAY, None),
              (5, "p1", "ABUSE_CLEARED", 10 * DAY, None), (6, "p1", "ABUSE_CONFIRMED", 30 * DAY, None), (7, "o1", "RETURN_REQUESTED", 20 * DAY, 0.5), (8, "o1", "RETURN_REQUESTED", 45 * DAY, 1.0), (9, "none", "DELIVERED", DAY, None)]
    accounts = [("a", -DAY, "HISTORY"), ("b", -DAY, "HISTORY"), ("d", -DAY, "DEMO")]
    lines = [(k, 1, "s", "p", "v", "HOME", 100.0, 1) for k, *_ in orders]
    return log.EventLog(frame(accounts, "accounts"), frame([], "identifiers"), frame(orders, "orders"), frame(lines, "order_lines"), frame(events, "order_events"))


def test_latest_delivery_before_the_order_counts(repeated):
    h = {r["k"]: r for r in history.account_history(log.LogWorld(repeated)).collect()}
    assert [(h[k]["matured"], h[k]["matured_returns"]) for k in ("o1", "o2", "o3", "o4")] == [(0, 0), (1, 1), (0, 0), (1, 1)]
    assert [h[k]["returns_90d"] for k in ("o2", "o3")] == [1, 2]


def test_value_follows_the_state_of_delivery(repeated):
    plain = log.replace(repeated, order_events=repeated.order_events.where("event_type = 'DELIVERED'"))
    w = log.LogWorld(plain)
    floor = {r["k"]: r["clv"] for r in history.customer_value(w).collect()}
    assert floor["o2"] > floor["o3"] and floor["o4"] > floor["o1"]


def test_first_resolution_decides_the_label(repeated):
    w = log.LogWorld(repeated)
    frame = evaluation.labelled(policy.scored(w), w)
    row = frame.where("k = 'p1'").first()
    assert (row["abuse_status"], row["abuse_label"]) == ("CLEARED", 0)
    assert w.accounts.where("c = 'b'").first()["confirmed"] == 30 * DAY


def test_splits_count_days_and_keep_demo_accounts_apart(repeated):
    found = {r["k"]: r["split"] for r in log.LogWorld(repeated).splits.collect()}
    assert (found["o1"], found["p2"], found["q1"]) == ("TRAIN", "RECENT", "RECENT")


def test_truth_is_an_input(spark, repeated):
    known = spark.createDataFrame([("a", "RING", "R3"), ("b", "NORMAL", None), ("d", "NORMAL", None)], "account_id string, archetype string, ring string")
    for truth, kinds in ((known, {"RING", "NORMAL"}), (None, {"UNKNOWN"})):
        w = log.LogWorld(repeated, truth=truth).kept()
        frame = report.with_truth(evaluation.labelled(policy.scored(w), w), w)
        assert {r["cohort"] for r in report.cohort_metrics(frame).where("family = 'archetype'").collect()} == kinds
        assert report.ring_recall(frame).first()["n"] == 0
        assert report.world_figures(w).first()["orders"] == 7


def test_events_meet_their_orders_once(spark, small):
    """Outcomes, deliveries and events read one written table, and a plan without categories doesn't read the parts."""
    x = log.LogWorld(log.of_world(World(spark, small).kept())).kept()
    for df in (x.deliveries, x.events):
        assert "Join" not in df._jdf.queryExecution().optimizedPlan().toString()
    skus = x.lines.select("k", "sku")
    assert "p_type" not in skus._jdf.queryExecution().optimizedPlan().toString()
    plain = log.LogWorld(log.of_world(World(spark, small).kept()))
    for name in ("deliveries", "events", "orders"):
        one, other = getattr(x, name), getattr(plain, name)
        assert sorted(map(str, one.select(other.columns).collect())) == sorted(map(str, other.collect()))
