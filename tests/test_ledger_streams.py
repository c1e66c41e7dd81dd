"""Atomic decision writes and the chain's columns; keyed streams against batch queries, late rows."""

import pytest
from pyspark.sql import functions as F

from riskloom.operators import links
from riskloom.plans import audit, ledger, review
from riskloom.sources.world import DAY, World
from riskloom.streaming import keyed
from riskloom.streaming.attempts import run_once


def decisions(spark, first, n=5):
    return spark.range(first, first + n).select(
        F.col("id").alias("k"), (F.col("id") % 3).alias("c"), (F.col("id") * 1000).alias("t0"), (F.col("id") * 1.5).alias("value"), F.lit(0.25).alias("p_abuse"), F.lit("ALLOW").alias("action"), F.lit("AUTO_APPLIED").alias("status"))


def test_batch_is_shown_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    book = ledger.Ledger(spark, f"file://{tmp_path}/book")
    assert book.decisions() is None and book.verify() == {"rows_checked": 0, "broken": 0, "bad_heads": []}
    assert book.commit("a", decisions(spark, 0))
    for broken in ("_write_events", "_put"):
        with monkeypatch.context() as m:
            def stop(*_):
                raise OSError("lost")

            m.setattr(book, broken, stop)
            with pytest.raises(OSError):
                book.commit("b", decisions(spark, 10))
        assert book.decisions().count() == book.events().count() == 5
    assert book.commit("b", decisions(spark, 10)) and not book.commit("b", decisions(spark, 10))
    assert book.decisions().count() == book.events().count() == 10
    assert [m["number"] for m in book.manifests()] == [0, 1]
    assert sorted(r["seq"] for r in book.events().collect()) == list(range(10))
    assert book.verify() == {"rows_checked": 10, "broken": 0, "bad_heads": []}
    assert book.commit("empty", decisions(spark, 50, 0)) and book.decisions().count() == 10


def test_second_writer_on_the_same_head_conflicts(spark, tmp_path, monkeypatch):
    one, two = (ledger.Ledger(spark, f"file://{tmp_path}/book") for _ in range(2))
    known = one.manifests()
    assert one.commit("a", decisions(spark, 0))
    monkeypatch.setattr(two, "manifests", lambda: known)
    with pytest.raises(ledger.CommitConflict):
        two.commit("b", decisions(spark, 10))
    monkeypatch.undo()
    assert two.commit("b", decisions(spark, 10)) and two.decisions().count() == 10


def test_stream_commits_each_batch_once(spark, tmp_path):
    for i in range(3):
        decisions(spark, 10 * i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    book = ledger.Ledger(spark, f"file://{tmp_path}/book")
    for _ in range(2):
        stream = spark.readStream.schema(decisions(spark, 0).schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        stream.writeStream.foreachBatch(book.sink()).option("checkpointLocation", str(tmp_path / "point")).trigger(availableNow=True).start().awaitTermination()
    assert book.decisions().count() == book.events().count() == 15
    book.sink()(decisions(spark, 0), 0)  # a batch that comes once more
    assert book.decisions().count() == 15 and book.verify()["broken"] == 0


def test_changed_column_beside_a_whole_payload_is_found(spark):
    df = decisions(spark, 0, 50)
    events = audit.chained(audit.payload(df)).join(df.drop("t0").join(df.select("k", "t0"), "k"), "k")
    assert audit.column_faults(events).count() == 0
    changed = events.withColumn("value", F.expr("if(k = 7, value + 0.01, value)")).withColumn("action", F.expr("if(k in (3, 9), 'BLOCK', action)")).withColumn("p_abuse", F.expr("if(k = 4, null, p_abuse)"))
    assert audit.verify(changed).first()["broken"] == 0
    found = {r["column"]: (r["n"], r["first_seq"]) for r in audit.column_faults(changed).collect()}
    assert found == {"value": (1, 7), "action": (2, 3), "p_abuse": (1, 4)}


def test_tree_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(audit, "FAN", 3)
    chain = audit.chained(audit.payload(decisions(spark, 0, 55)), block=5).persist()
    kept = audit.roots(chain).persist()
    assert {(r["level"], r["n"]) for r in kept.groupBy("level").agg(F.count("*").alias("n")).collect()} == {(0, 11), (1, 4), (2, 2), (3, 1)}
    assert audit.verify(chain, kept).first()["broken"] == 0
    assert audit.verify(chain.where("block < 10"), kept).first()["first_broken_seq"] == 50
    forged = kept.withColumn("hash", F.expr("if(level = 1 and node = 2, repeat('0', 64), hash)"))
    assert audit.verify(chain, forged).first()["broken"] >= 1


@pytest.fixture(scope="module")
def replayed(tmp_path_factory):
    """Writes rows as files in the order of a column and gives them as a stream, a file at a time."""

    def make(spark, df, by, files=4):
        path = tmp_path_factory.mktemp("replay") / "in"
        bounds = df.approxQuantile(by, [i / files for i in range(1, files)], 0.01)
        edges = [None, *bounds, None]
        for low, high in zip(edges, edges[1:]):
            part = df if low is None else df.where(F.col(by) > low)
            (part if high is None else part.where(F.col(by) <= high)).coalesce(1).write.mode("append").parquet(str(path))
        return path, spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(path))

    return make


def test_trailing_attempts_equal_the_batch_query(spark, small, replayed, tmp_path):
    events = spark.read.parquet(f"{small}/events.parquet")
    rows = review.event_micros(events).select("event_id", "user_id", "cart", "t")
    path, stream = replayed(spark, rows, "t")
    out = run_once(keyed.attempts(stream), "exact_attempts", str(tmp_path / "a"))
    assert out.where("late").count() == 0
    got = out.select("event_id", "attempts_24h", "carts_24h")
    want = review.attempt_log(events)
    assert got.count() == want.count() and got.exceptAll(want).count() == 0
    # a row from before what its key has applied: returned as late, and nothing else changes
    some = rows.groupBy("user_id").agg(F.max("t").alias("last"), F.min("t").alias("t")).where("last > t").orderBy("user_id").limit(3)
    some.select((F.col("user_id") + 10**9).cast("long").alias("event_id"), "user_id", F.lit(1).cast("long").alias("cart"), "t").coalesce(1).write.mode("append").parquet(str(path))
    after = rows.groupBy("user_id").agg(F.max("t").alias("t")).join(some.select("user_id"), "user_id").select((F.col("user_id") + 2 * 10**9).cast("long").alias("event_id"), "user_id", F.lit(2).cast("long").alias("cart"), (F.col("t") + DAY // 2).alias("t"))
    after.coalesce(1).write.mode("append").parquet(str(path))
    again = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(path))
    out = run_once(keyed.attempts(again), "late_attempts", str(tmp_path / "b")).persist()
    assert {r["late"]: r["n"] for r in keyed.late_rows(out).collect()} == {False: rows.count() + 3, True: 3}
    assert out.where("late").select("attempts_24h").distinct().collect()[0][0] is None


def test_identifier_state_equals_the_batch_features(spark, small, replayed, tmp_path):
    w = World(spark, small).kept()
    uses = w.uses.select("k", "c", "kind", "ident", "t")
    path, stream = replayed(spark, uses, "t")
    out = run_once(keyed.identifier_uses(stream), "identifier_state", str(tmp_path / "a")).persist()
    assert out.where("late").count() == 0 and out.count() == uses.count()
    velocity = out.groupBy("k").agg(F.sum("reuse_7d").alias("reuse_7d"))
    assert velocity.exceptAll(links.reuse_velocity(w)).count() == 0
    device = out.where("kind = 'DEVICE'").select("k", F.col("new_for_account").cast("int").alias("new_device"))
    assert device.exceptAll(links.new_device(w)).count() == 0
    others = out.where("kind = 'DEVICE'").groupBy("k").agg(F.max("others_30d").alias("n")).where("n > 0")
    batch = links.links(w).where(f"kind = 'DEVICE' and last >= t0 - {30 * DAY}").groupBy(F.col("q").alias("k")).agg(F.count("*").alias("n"))
    assert others.exceptAll(batch).count() == 0 and batch.exceptAll(others).count() == 0
