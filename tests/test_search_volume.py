"""What the component search shuffles, and its rule for an address that has as many accounts as may link."""

import random

from pyspark.sql import functions as F

from riskloom.operators import component
from riskloom.operators.links import FANOUT_WINDOW
from riskloom.sources.store import written_by
from riskloom.sources.world import DAY, World


def test_bucketed_rows_are_not_shuffled_again(spark):
    rows = written_by(spark.range(200).select((F.col("id") % 20).alias("account"), "id"), "account")
    asked = spark.range(20).withColumnRenamed("id", "account")
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")
    before = {name: spark.conf.get(name) for name in names}
    for name, value in zip(names, ("-1", "false")):
        spark.conf.set(name, value)
    try:
        joined = asked.join(rows, "account")
        assert joined._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
        assert joined.count() == 200
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def test_numbers_rise_with_kind_and_identifier(spark, small):
    uses, names = component._numbered(World(spark, small).kept())
    assert dict(names.dtypes)["id"] == "bigint" and "ident" not in uses.columns
    rows = uses.select("kind", "id").distinct().join(names, "id").orderBy("id").collect()
    assert [(r["kind"], r["ident"]) for r in rows] == sorted({(r["kind"], r["ident"]) for r in rows}) and len(rows) == names.count()


def test_kinds_are_kept_in_order(spark):
    codes = spark.createDataFrame([(0, 2), (2, 1), (6, 2), (6, 3), (54, 1)], "kinds int, kind int")
    got = [r["k"] for r in codes.select(component._with_kind().alias("kinds")).select(component._kind_names().alias("k")).collect()]
    d, a, t = "DEVICE", "ADDRESS", "PAYMENT_TOKEN"
    assert got == [[d], [d, a], [d, a], [d, a, t], [d, a, t]]


def test_busy_orders_against_definition(spark):
    """An order's account is one more where it used the address up to then, but not within the window before."""
    rng = random.Random(7)
    uses = [(k, rng.randrange(4), rng.randrange(0, 400, 10) * DAY, 1, rng.randrange(3), None) for k in range(150)]
    orders = [(k, c, t) for k, c, t, *_ in uses]
    table = spark.createDataFrame(uses, "k long, c long, t long, kind int, id long, since long")
    spans = spark.createDataFrame([(0, True), (1, True), (2, False)], "id long, full boolean")
    found = sorted((r["q"], r["id"]) for r in component._busy(spark.createDataFrame(orders, "q long, self long, t0 long"), table, spans).collect())
    want = []
    for q, c, t0 in orders:
        for ident in (0, 1):
            own = [t for _, a, t, _, i, _ in uses if (a, i) == (c, ident) and t <= t0]
            if own and not any(t0 - FANOUT_WINDOW <= t < t0 for t in own):
                want.append((q, ident))
    assert found == sorted(want) and want
