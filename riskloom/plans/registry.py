"""The registered queries of the decision engine; each takes (spark, sf_dir)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import money
from ..operators import component, ego, history, links
from ..sources.store import written
from ..sources import log
from ..sources.world import World
from . import audit, boosting, evaluation, explain, guards, models, order_view, policy, report, review

Query = Callable[[SparkSession, str], DataFrame]


def _r(name: str, digits: int) -> Column:
    return F.round(name, digits).alias(name)


def _decided(w: World, keys: DataFrame | None = None) -> DataFrame:
    return policy.decide(policy.contexts(w, keys))


def _middle(w: World) -> int:
    row = w.orders.agg(F.expr("(min(t0) + max(t0)) div 2")).first()
    return row[0] or 0


def _chain_verified(decided: DataFrame) -> DataFrame:
    chain = written(audit.chained(audit.payload(decided)))
    return audit.verify(chain, written(audit.roots(chain)))


def _chain_columns(w: World) -> DataFrame:
    """column, n of stored columns that were changed beside whole payloads: every 97th order's value and every 89th one's action."""
    d = written(_decided(w))
    events = audit.chained(audit.payload(d)).join(d.select("k", *audit.CHECKED), "k")
    changed = events.withColumn("value", F.expr("if(k % 97 = 0, value + 1, value)")).withColumn("action", F.expr("if(k % 89 = 0, concat(action, '*'), action)"))
    return audit.column_faults(changed).select("column", "n")


def _consistency(w: World) -> DataFrame:
    """column, mismatches between the orders and a copy of them in which every 31st value and every 37th method differ."""
    o = w.orders.select("k", "value", "payment_method", "n_items", "token_id")
    copy = o.withColumn("value", F.expr("if(k % 31 = 0, value + 1, value)")).withColumn("payment_method", F.expr("if(k % 37 = 0, null, payment_method)"))
    return guards.mismatches(o, copy, "k")


def _events(w: World) -> DataFrame:
    """seq, k, event_type, payload: an audit event for every order, and an override for every 40th."""
    made = w.orders.select((F.col("k") * 2).alias("seq"), "k", F.lit("DECISION_CREATED").alias("event_type"), F.concat(F.lit("made "), "k").alias("payload"))
    return made.unionByName(w.orders.where("k % 40 = 0").select((F.col("k") * 2 + 1).alias("seq"), "k", F.lit("OVERRIDE_APPLIED").alias("event_type"), F.concat(F.lit("changed "), "k").alias("payload")))


def _audit_page(w: World) -> DataFrame:
    """The second page of the overrides, newest first."""
    return order_view.page(_events(w), event_type="OVERRIDE_APPLIED", limit=10, offset=10)


def _read_back(w: World) -> DataFrame:
    """Every third order with the record that was made with it; records of every fifth order are missing."""
    return order_view.read_back(w.orders.where("k % 3 = 0").select("k", "value"), _events(w).where("k % 5 <> 0"))


def _rates(w: World) -> DataFrame:
    """Rates over a log of records in which every 7th order was overridden, twice every 14th, every 10th lacks an explanation, and every 13th names another model."""
    o = w.orders.select("k")
    overridden = o.where("k % 7 = 0").unionByName(o.where("k % 14 = 0"))
    records = o.select("k", F.lit("v1.0").alias("policy_version"), F.lit("m1").alias("model_version"), (F.col("k") % 10 != 0).alias("explained"), F.lit("v1.0").alias("said_policy"), F.expr("case when k % 13 = 0 then 'm2' when k % 17 = 0 then null else 'm1' end").alias("said_model"))
    return review.rates(o, overridden, records)


def _current_actions(w: World) -> DataFrame:
    d = written(_decided(w))
    overrides = d.where("k % 101 = 0 or (k % 103 = 0 and action <> 'BLOCK')").select("k", F.col("k").alias("seq"), F.expr("if(k % 101 = 0, 'ALLOW', 'MANUAL_REVIEW')").alias("new_action"))
    return audit.current_actions(d, overrides)


def _log_snapshot(w: World) -> DataFrame:
    """table, rows of the log at the middle of its time."""
    out = None
    for name, df in log.snapshot(log.of_world(w), _middle(w)).tables().items():
        one = df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = one if out is None else out.unionByName(one)
    return out


def _eventful(w: World) -> World:
    """The world as a log in which events repeat."""
    return log.LogWorld(log.eventful(log.of_world(w)), truth=w.truth.withColumn("account_id", F.concat(F.lit("ACC-"), "c"))).kept()


def _log_history(w: World) -> DataFrame:
    """What the repeated events of a log change: maturity, value, and labels by the first events."""
    x = _eventful(w)
    h, values, known = history.account_history(x), history.customer_value(x), x.labels(evaluation.as_of(x))
    out = h.join(values, "k").join(known, "k").select("k", "prior_orders", "returns_90d", "claims_180d", "matured", "matured_returns", _r("account_age_days", 6), _r("clv", 4), "return_label", "abuse_status")
    return out.withColumn("k", F.expr("cast(substring(k, 5) as bigint)"))


def _override_outcomes(w: World) -> DataFrame:
    """Two requests for every 50th order: one expects the decision and blocks, the next expects a block and allows."""
    d = written(_decided(w, w.orders.where("k % 50 = 0")))
    first = d.select((F.col("k") * 2).alias("seq"), "k", F.col("action").alias("expected_action"), F.lit("BLOCK").alias("new_action"), F.expr("if(k % 100 = 0, 'INDEPENDENT_EVIDENCE_OF_ABUSE', 'OTHER')").alias("reason"))
    second = d.select((F.col("k") * 2 + 1).alias("seq"), "k", F.lit("BLOCK").alias("expected_action"), F.lit("ALLOW").alias("new_action"), F.lit("OTHER").alias("reason"))
    return audit.overrides(d, first.unionByName(second))


#: Fewer trees than the fixed number for the registered queries, at a rate to match.
_SETTINGS = models.Settings(trees=40, rate=0.2)


def _features(w: World, *splits: str, of: Callable = models.features) -> DataFrame:
    """The labelled features of the orders of some splits; others aren't searched from."""
    return written(evaluation.labelled(of(w, written(w.splits.where(F.col("split").isin(*splits)).select("k"))), w))


def _points(w: World, frame: DataFrame) -> DataFrame:
    """k, variant, delta of the last orders by a trained, calibrated abuse model."""
    trained = models.train(frame, _SETTINGS)
    return models.ablation(trained.abuse, frame.where("split = 'TEST'"), trained.vector["values"], explain.GROUPS, trained.calibrate["abuse"])


def _attributions(w: World) -> DataFrame:
    return _points(w, _features(w, "TRAIN", "CALIBRATION", "TEST"))


def _explained(w: World) -> DataFrame:
    """Reasons of the last orders with the points of a trained model, the redundancy of each and the dominant group."""
    frame = _features(w, "TRAIN", "CALIBRATION", "TEST")
    points = written(_points(w, frame).select("k", F.col("variant").alias("feature"), F.col("delta").alias("pp")))
    # what the features were made from is in the frame
    out = explain.assessed(w, points, explain.with_discounts(w, frame.where("split = 'TEST'")))
    codes = F.array_join(F.transform("reasons", lambda r: F.concat(r["code"], F.when(r["redundant"], "*").otherwise(""))), ",")
    return out.select("k", codes.alias("reasons"), "dominant_group", "prediction_text")


def _trained(w: World) -> DataFrame:
    """model, average_precision on later orders: boosted trees, and a logistic model of the same numbers."""
    df = _features(w, "TRAIN", "TEST")
    known, later = df.where("split = 'TRAIN'"), df.where("split = 'TEST'")
    numbers = [f for f in models.ABUSE if f != "primary_category"]
    scored = {"trees": boosting.predict(models.fit(models.SPECS["abuse"], known, settings=_SETTINGS), later), "logistic": models.fit_logistic(known, numbers)(later, "score")}
    return _compared({name: x.withColumn("score", F.round("score", 9)) for name, x in scored.items()})


def _compared(scored: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, x in scored.items():
        one = evaluation.average_precision(x, score="score").select(F.lit(name).alias("model"), "n", "positives", "average_precision")
        out = one if out is None else out.unionByName(one)
    return out


def _trained_returns(w: World) -> DataFrame:
    df = _features(w, "TRAIN", "CALIBRATION", "TEST", of=models.return_features)
    model = models.fit(models.SPECS["return"], df.where("split = 'TRAIN'"), settings=_SETTINGS)
    curve = models.calibrate_isotonic(boosting.predict(model, df.where("split = 'CALIBRATION'")), "score", "return_label")
    return curve(boosting.predict(model, df.where("split = 'TEST'"))).select("k", "score", "score_calibrated", "return_label")


def _without_links(w: World) -> DataFrame:
    """model, average_precision of the sigmoid-calibrated abuse model, and of one trained without link features."""
    df, scored = _features(w, "TRAIN", "CALIBRATION", "TEST"), {}
    for name, names in (("full", models.ABUSE), ("without_links", tuple(f for f in models.ABUSE if f not in models.GRAPH))):
        model = models.fit(models.SPECS["abuse"], df.where("split = 'TRAIN'"), names, _SETTINGS)
        curve = models.calibrate_sigmoid(boosting.predict(model, df.where("split = 'CALIBRATION'")), "score", "abuse_label")
        scored[name] = curve(boosting.predict(model, df.where("split = 'TEST'"))).withColumn("score", F.round("score_calibrated", 9))
    return _compared(scored)


def _reference(w: World) -> DataFrame:
    """feature, number, level of the reference vector of the calibration orders."""
    values = models.reference(evaluation.labelled(models.features(w), w).where("split = 'CALIBRATION'"), {})["values"]
    rows = [(f, None, v) if isinstance(v, str) else (f, round(v, 6), None) for f, v in sorted(values.items())]
    return w.spark.createDataFrame(rows, "feature string, number double, level string")


def _idempotent(w: World) -> DataFrame:
    """Every third order was decided before; every fifth request comes twice, every seventh of these with another value."""
    requests = w.orders.select(F.col("k").alias("request_id"), "k", "c", "value").unionByName(
        w.orders.where("k % 5 = 0").select((F.col("k") + 1_000_000_000_000).alias("request_id"), "k", "c", F.expr("if(k % 7 = 0, value + 1, value)").alias("value")))
    stored = w.orders.where("k % 3 = 0").select("k", F.sha2(F.concat_ws("|", "k", "c", "value"), 256).alias("fingerprint"))
    return audit.score_batch(requests, stored, ["k", "c", "value"])


#: One entry per query: from the world to a result.
_WORLD: dict[str, Callable[[World], DataFrame]] = {
    "order_value": lambda w: w.orders.select("k", "value", "n_items", "discount_pct", "payment_method", "delivery_speed"),
    "primary_category": history.primary_category,
    "variants_same_product": history.variants_same_product,
    "account_history": lambda w: history.account_history(w).withColumn("account_age_days", F.round("account_age_days", 6)),
    "return_rates": lambda w: history.return_rates(history.account_history(w)).select("k", _r("return_rate_smoothed", 9), _r("return_rate", 9)),
    "customer_value": lambda w: history.customer_value(w).select("k", _r("clv", 4), "basis"),
    "labels": lambda w: w.labels(evaluation.as_of(w)).withColumn("returned_fraction", F.round("returned_fraction", 9)),
    "splits": lambda w: w.splits,
    "links": lambda w: links.links(w).select("q", "kind", "ident", "other", "first", "last", "sequential", "multi_tenant", "confirmed", _r("weight", 9)),
    "link_evidence": lambda w: (e := links.evidence(w)).select(*(_r(c, 9) if t == "double" else c for c, t in e.dtypes)),
    "reuse_velocity": links.reuse_velocity,
    "new_device": links.new_device,
    "discounted_links": links.discounted,
    "component": lambda w: component.component_features(w).select("k", "component_size", _r("abuse_ratio", 9), _r("proximity", 9)),
    "burst": lambda w: component.burst_features(w).withColumn("burst_kinds", F.array_join("burst_kinds", ",")).withColumn("burst_weight", F.round("burst_weight", 9)),
    "scores": lambda w: policy.scored(w).select("k", "p_abuse", "p_return"),
    "guardrails": lambda w: policy.guarded(policy.contexts(w)).select("k", "n_counted", "g2", "g3", "g4", "g5"),
    "action_costs": lambda w: _decided(w).select("k", *(_r(f"cost_{a.lower()}", 1) for a in policy.ACTIONS)),
    "decide": lambda w: _decided(w).select("k", "value", "p_abuse", "cost_optimal", "action", "status"),
    "baselines": lambda w: policy.scored(w).select("k", policy.fixed_threshold(F.col("p_abuse"), 0.7, 0.4).alias("fixed_threshold"), policy.rule_based().alias("rule_based"), F.lit("ALLOW").alias("allow_all")),
    "slope_check": policy.slope_check,
    "slope_orders": lambda w: policy.slope_orders(history.customer_value(w).join(w.orders.select("k", "value"), "k")),
    "average_precision": lambda w: evaluation.average_precision(evaluation.scored_frame(w)),
    "brier": lambda w: evaluation.brier(evaluation.scored_frame(w)),
    "reliability": lambda w: evaluation.reliability(evaluation.scored_frame(w)),
    "calibration_error": lambda w: evaluation.calibration_error(evaluation.scored_frame(w)),
    "risk_bands": lambda w: evaluation.risk_bands(evaluation.scored_frame(w)),
    "backtest": lambda w: evaluation.backtest(evaluation.frame(w)),
    "tune_thresholds": lambda w: evaluation.tune_thresholds(evaluation.frame(w, "CALIBRATION")),
    "guardrail_price": lambda w: evaluation.guardrail_price(evaluation.frame(w)).withColumn("extra_cost", F.round("extra_cost", 1)),
    "action_distribution": lambda w: evaluation.action_distribution(evaluation.frame(w)),
    "label_counts": lambda w: w.labels(evaluation.as_of(w)).join(w.splits, "k").groupBy("split", "abuse_status").agg(F.count("*").alias("n"), F.count("abuse_label").alias("labelled")),
    "cohorts": lambda w: evaluation.cohorts(evaluation.frame(w)),
    "label_sensitivity": lambda w: evaluation.label_sensitivity(evaluation.scored_frame(w)),
    "cost_sensitivity": lambda w: evaluation.cost_sensitivity(evaluation.frame(w)),
    "bootstrap_interval": lambda w: evaluation.bootstrap_interval(evaluation.scored_frame(w)),
    "intervals_by_split": lambda w: evaluation.bootstrap_interval(evaluation.scored_frame(w), by=("split",)).select("split", _r("low", 9), _r("high", 9)),
    "queue": lambda w: review.queue(_decided(w).where("action <> 'ALLOW'"), sort="p_abuse").select("k", "t0", "value", "p_abuse", "action"),
    "queue_counts": lambda w: review.queue_counts(_decided(w)),
    "activity_metrics": lambda w: review.activity(_decided(w)),
    "activity_rates": _rates,
    "checkout": lambda w: review.checkout(_decided(w)),
    "attempt_log": lambda w: review.attempt_log(w.table("events")),
    "as_of_snapshot": lambda w: review.snapshot(w, _middle(w)),
    "world_validation": review.validation,
    "chain_verify": lambda w: _chain_verified(_decided(w)),
    "chain_columns": _chain_columns,
    "numbered_events": lambda w: log.numbered(log.of_world(w).order_events).select("event_id", "order_id", "event_type"),
    "consistency": _consistency,
    "joined_once": lambda w: guards.one_to_one(w.orders.select("k", "value"), history.primary_category(w), "k"),
    "audit_page": _audit_page,
    "records_read_back": _read_back,
    "provenance": lambda w: report.provenance(w.labels(evaluation.as_of(w)).where("abuse_label is not null")),
    "identifier_ids": lambda w: w.table("customer").select("c_custkey", money.identifier_id("secret", F.lit("DEVICE"), F.expr("if(c_custkey % 9 = 0, ' N/A ', c_name)")).alias("ident"), money.quantised(F.col("c_acctbal") / 3).cast("double").alias("third")),
    "idempotent_scoring": _idempotent,
    "current_actions": lambda w: _current_actions(w),
    "placeholders": lambda w: w.table("customer").select("c_custkey", (money.is_placeholder("c_mktsegment") | money.is_placeholder((F.col("c_custkey") % 10).cast("string"))).alias("placeholder")),
    "hmac_ids": lambda w: w.table("customer").select("c_custkey", F.substring(money.hmac_sha256("secret", F.col("c_name")), 1, 32).alias("ident")),
    "money_text": lambda w: w.orders.select("k", money.rupees(F.col("value")).alias("rupees"), money.percent(F.col("discount_pct") / 100).alias("discount")),
    "reason_codes": lambda w: explain.assessed(w).select("k", F.array_join(F.transform(F.concat("reasons", "mitigating"), lambda r: F.concat_ws(":", r["code"], r["strength"])), ",").alias("reasons")),
    "attributions": _attributions,
    "explained_points": _explained,
    "reference_vector": _reference,
    "train_abuse": _trained,
    "train_return": _trained_returns,
    "train_without_links": _without_links,
    "event_labels": lambda w: log.labels(log.of_world(w), evaluation.as_of(w)).withColumn("returned_fraction", F.round("returned_fraction", 9)),
    "log_violations": lambda w: log.violations(log.of_world(w)),
    "log_snapshot": _log_snapshot,
    "log_fingerprint": lambda w: log.fingerprint(log.of_world(w).accounts.select("account_id", "created_at")),
    "latest_identifiers": lambda w: log.latest_identifiers(log.of_world(w), _middle(w)),
    "new_accounts": lambda w: log.new_accounts(log.of_world(w), _middle(w)).select("account_id"),
    "log_decide": lambda w: policy.decide(policy.contexts(log.LogWorld(log.of_world(w)).kept())).select("k", "value", "p_abuse", "action"),
    "log_history": lambda w: _log_history(w),
    "log_backtest": lambda w: evaluation.backtest(evaluation.frame(_eventful(w))),
    "log_splits": lambda w: _eventful(w).splits.groupBy("split").agg(F.count("*").alias("n")),
    "reason_texts": lambda w: explain.assessed(w).select("k", F.array_join(F.transform("reasons", lambda r: r["code"]), ",").alias("reasons"), F.array_join(F.transform("mitigating", lambda r: r["code"]), ",").alias("mitigating"), F.array_join(F.transform("reasons", lambda r: r["text"]), " ").alias("text"), "rule"),
    "cost_rows": lambda w: (d := _decided(w)).select("k", F.explode(explain.cost_rows(d)).alias("x")).select("k", "x.action", "x.feasible", F.array_join("x.excluded_by", ",").alias("excluded_by"), "x.rank"),
    "policy_texts": lambda w: _decided(w).select("k", explain.policy_text().alias("text")),
    "risk_summary": lambda w: explain.evidence(w).select("k", order_view.risk_summary().alias("summary")),
    "graph_summary": lambda w: order_view.graph_summary(explain.evidence(w)),
    "ego_graph": lambda w: ego.ego(w, w.orders.where("k % 100 = 0")).select(F.col("q").alias("k"), "shown", "total", F.array_join(F.transform("nodes", lambda n: F.concat_ws(":", n["kind"], n["id"], F.coalesce(n["parent"], F.lit("")), n["depth"].cast("string"))), ",").alias("nodes")),
    "order_detail": lambda w: order_view.detail(w, _decided(w, w.orders.where("k % 100 = 0")), w.orders.where("k % 100 = 0")).select("k", "value", "action", "fixed_threshold", "rule_based", F.size("lines").cast("long").alias("n_lines"), "earlier_orders", "earlier_returns", "last_seen"),
    "account_past": lambda w: order_view.past(w, w.orders.where("k % 100 = 0")),
    "assumptions": lambda w: order_view.assumptions(w.spark).select("name", "value"),
    "build_options": lambda w: order_view.options(w, _middle(w)),
    "link_reasons": order_view.link_reasons,
    "decision_failures": lambda w: _decided(w).agg(F.count("*").alias("n"), F.count_if(F.size(guards.decision_failures()) > 0).alias("failed"), F.count_if(F.size(guards.context_failures()) > 0).alias("bad_inputs")),
    "admission": lambda w: guards.admission((x := log.of_world(w)).orders.select("order_id", F.when(F.expr("substring(order_id, 5) % 7 = 0"), "ACC-NONE").otherwise(F.col("account_id")).alias("account_id"), "placed_at"), x.accounts, _middle(w) + 86_400_000_000 * 100, _middle(w)).groupBy("rejected").agg(F.count("*").alias("n")),
    "requests": lambda w: (x := log.of_world(w)).orders.join(x.order_lines.groupBy("order_id").agg(F.collect_list(F.struct("unit_price_inr", "quantity")).alias("lines")), "order_id").select("order_id", F.array_join(guards.request_failures(), ",").alias("failed")),
    "override_outcomes": _override_outcomes,
    "appeals": lambda w: audit.appeals(w.orders.where("k % 10 = 0").select(F.col("k").alias("seq"), F.expr("k div 20").alias("k"))),
    "seeded": lambda w: audit.seeded(_decided(w)).agg(F.count("*").alias("n"), F.count_if(F.col("action") != "ALLOW").alias("flagged")),
    "summary_by_split": lambda w: report.summary(evaluation.scored_frame(w), ["split"]),
    "equal_width_error": lambda w: report.equal_width_error(evaluation.scored_frame(w), ["split"]),
    "bands_by_split": lambda w: report.bands_by_split(evaluation.scored_frame(w)),
    "cohort_metrics": lambda w: report.cohort_metrics(report.with_truth(evaluation.scored_frame(w), w)),
    "ring_actions": lambda w: report.ring_actions(report.with_truth(evaluation.frame(w), w)),
    "ring_recall": lambda w: report.ring_recall(report.with_truth(evaluation.scored_frame(w), w)),
    "archetype_backtest": lambda w: evaluation.backtest(report.with_truth(evaluation.frame(w), w), by=("archetype",)).where("strategy = 'POLICY'").select("archetype", "n", "cost_per_1000", "genuine_block_rate", "friction_rate"),
    "link_uplift": lambda w: report.uplift(written(evaluation.scored_frame(w))),
    "separation": lambda w: report.separation(policy.scored(w)),
    "guardrail_overlap": lambda w: report.guardrail_overlap(_decided(w)),
    "world_figures": report.world_figures,
    "keyed_ids": lambda w: w.table("customer").select("c_custkey", money.keyed_id("secret", "ACC", F.col("c_name"), 10).alias("account_id"), money.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col("c_name")).alias("uuid"), F.round(money.logit(F.col("c_acctbal") / 10000), 9).alias("logit")),
    "identifier_labels": lambda w: w.uses.select("kind", "ident").distinct().select("ident", money.masked(F.col("kind"), F.col("ident")).alias("label")),
}


#: Queries that use the world's tables once; all others write the orders first and read those.
_ONCE = {"order_value", "primary_category", "variants_same_product", "customer_value", "slope_check", "attempt_log", "placeholders", "hmac_ids", "money_text", "assumptions", "keyed_ids"}


def _query(name: str, build: Callable[[World], DataFrame]) -> Query:
    return lambda spark, sf_dir: build(World(spark, sf_dir) if name in _ONCE else World(spark, sf_dir).kept())


QUERIES: dict[str, Query] = {name: _query(name, build) for name, build in _WORLD.items()}
