"""An event log as input: accounts, identifiers, orders, order lines and outcome events, in Parquet folders of these names.

Times are timestamps or BIGINT microseconds since 1970; they are read as microseconds. `LogWorld` gives the log the shape
that all features, policies and evaluations work on; `of_world` makes a log of the star tables.

Defined results: missing tables or columns are an error that names them; events before their order and events of unknown orders
don't count; identifiers that identify nobody never link; orders without lines have no items; empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import money
from .store import written, written_by
from .world import DAY, KINDS, World

#: Columns of each table. Key columns come first.
SCHEMAS = {
    "accounts": "account_id string, created_at long, source string",
    "identifiers": "identifier_id string, kind string, multi_tenant_set_at long",
    "orders": "order_id string, account_id string, placed_at long, order_value_inr double, discount_pct double, n_items long, delivery_speed string, payment_method string, "
    "device_id string, address_id string, payment_token_id string, source string",
    "order_lines": "order_id string, line_no int, sku_id string, product_id string, variant string, category string, unit_price_inr double, quantity long",
    "order_events": "event_id long, order_id string, event_type string, occurred_at long, returned_value_fraction double",
}
KEYS = {"accounts": ["account_id"], "identifiers": ["identifier_id"], "orders": ["order_id"], "order_lines": ["order_id", "line_no"], "order_events": ["event_id"]}
#: Names of outcome events (fixed values).
BACK = ("RETURN_REQUESTED", "EXCHANGE_REQUESTED")
DISPUTES = ("CLAIM_FILED", "QC_FLAGGED")
RESOLUTIONS = ("ABUSE_CONFIRMED", "ABUSE_CLEARED")
#: Last day of each split, counted from the first day of history (fixed values).
SPLIT_DAYS = (("TRAIN", 200), ("GAP", 230), ("CALIBRATION", 275), ("GAP", 305), ("TEST", 365))


class LogError(ValueError):
    """The log can't be read or isn't whole."""


@dataclass(frozen=True)
class EventLog:
    accounts: DataFrame
    identifiers: DataFrame
    orders: DataFrame
    order_lines: DataFrame
    order_events: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in SCHEMAS}


def _typed(df: DataFrame, name: str) -> DataFrame:
    wanted = T._parse_datatype_string(SCHEMAS[name])
    missing = [f.name for f in wanted if f.name not in df.columns]
    if missing:
        raise LogError(f"{name} has no column {', '.join(missing)}")
    kinds = dict(df.dtypes)
    return df.select(*((F.unix_micros(f.name) if kinds[f.name].startswith("timestamp") else F.col(f.name)).cast(f.dataType).alias(f.name) for f in wanted))


def read(spark: SparkSession, folder: str, made_by: str = "write") -> EventLog:
    """The log in `folder`; all columns are projected at the scan. A missing table is an error that says what makes it."""
    found = {}
    for name in SCHEMAS:
        try:
            found[name] = _typed(spark.read.parquet(f"{folder}/{name}"), name)
        except AnalysisException as e:
            raise LogError(f"{folder}/{name} isn't there: run {made_by} first") from e
    return EventLog(**found)


def write(log: EventLog, folder: str) -> None:
    """One Parquet folder a table; each is replaced as a whole."""
    for name, df in log.tables().items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def history(log: EventLog, source: str = "HISTORY") -> EventLog:
    """The orders of one source, with their lines and events."""
    orders = log.orders.where(F.col("source") == source)
    ids = orders.select("order_id")
    return replace(log, orders=orders, order_lines=log.order_lines.join(ids, "order_id", "left_semi"), order_events=log.order_events.join(ids, "order_id", "left_semi"))


def snapshot(log: EventLog, clock: int) -> EventLog:
    """What the log held before `clock`: no later accounts, orders or events, only lines of the orders left, no later flags."""
    orders = log.orders.where(F.col("placed_at") < clock)
    return EventLog(
        log.accounts.where(F.col("created_at") < clock),
        log.identifiers.withColumn("multi_tenant_set_at", F.when(F.col("multi_tenant_set_at") < clock, F.col("multi_tenant_set_at"))),
        orders, log.order_lines.join(orders.select("order_id"), "order_id", "left_semi"), log.order_events.where(F.col("occurred_at") < clock),
    )


def violations(log: EventLog, first: int | None = None, last: int | None = None) -> DataFrame:
    """rule, violations: repeated keys, orders before their account or outside [first, last), events before their order or of
    none, cash orders with a token or others without one, lines of no order.
    """
    o = log.orders
    of = o.select("order_id", "account_id", "placed_at")
    checks = {f"duplicate_{name}": log.tables()[name].groupBy(*keys).count().where("count > 1") for name, keys in KEYS.items()}
    checks["order_before_account"] = of.join(log.accounts, "account_id").where("placed_at <= created_at")
    checks["order_without_account"] = of.join(log.accounts, "account_id", "left_anti")
    checks["event_before_order"] = log.order_events.join(of, "order_id").where("occurred_at < placed_at")
    checks["event_without_order"] = log.order_events.join(of, "order_id", "left_anti")
    checks["line_without_order"] = log.order_lines.join(of, "order_id", "left_anti")
    checks["token_iff_prepaid"] = o.where("(payment_method = 'COD') <> (payment_token_id is null)")
    if first is not None and last is not None:
        checks["order_outside_days"] = o.where((F.col("placed_at") < first) | (F.col("placed_at") >= last))
    counted = [bad.agg(F.count("*").alias("violations")).select(F.lit(rule).alias("rule"), "violations") for rule, bad in checks.items()]
    out = counted[0]
    for one in counted[1:]:
        out = out.unionByName(one)
    return out


def fingerprint(df: DataFrame) -> DataFrame:
    """rows, fingerprint: a digest of the rows as a multiset, whatever their order; one partial aggregation, nothing is sorted."""
    text = F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in sorted(df.columns)))
    part = F.conv(F.substring(F.sha2(text, 256), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(part), F.lit(0)).cast("string").alias("sum")).select("rows", F.sha2(F.concat_ws(":", F.col("rows").cast("string"), "sum"), 256).alias("fingerprint"))


def outcomes(log: EventLog, before: int | None = None) -> DataFrame:
    """order_id and, of its events (before an instant): first delivery, first return or exchange, first dispute of each
    kind, first resolution and confirmation, and what came back.
    """
    e = log.order_events.join(log.orders.select("order_id", "placed_at"), "order_id").where("occurred_at >= placed_at")
    return _outcomes(e if before is None else e.where(F.col("occurred_at") < before))


def _outcomes(e: DataFrame) -> DataFrame:
    """`outcomes` of events that aren't before their order."""
    at = lambda *kinds: F.when(F.col("event_type").isin(*kinds), F.col("occurred_at"))
    first = lambda value, *kinds: F.min_by(value, F.when(F.col("event_type").isin(*kinds), F.struct("occurred_at", "event_id")))
    return e.groupBy("order_id").agg(
        F.min(at("DELIVERED")).alias("delivered"), F.min(at(*BACK)).alias("returned"), first("event_type", *BACK).alias("back"),
        first("returned_value_fraction", *BACK).alias("fraction"), F.min(at("CLAIM_FILED")).alias("claimed"), F.min(at("QC_FLAGGED")).alias("flagged"),
        F.min(at(*RESOLUTIONS)).alias("resolved"), first("event_type", *RESOLUTIONS).alias("resolution"), F.min(at("ABUSE_CONFIRMED")).alias("confirmed"),
    )


def labels(log: EventLog, as_of: int, window: int = 30 * DAY, dispute: int = 60 * DAY) -> DataFrame:
    """Labels of every order from its events before `as_of`: return label, type and fraction, abuse status and label.

    A return counts from the first delivery to 30 days after it, a dispute or resolution to 60 days after it; the first one
    inside decides. Orders without events are there too.
    """
    e = log.order_events.where(F.col("occurred_at") < as_of)
    first = e.where("event_type = 'DELIVERED'").join(log.orders.select("order_id", "placed_at"), "order_id").where("occurred_at >= placed_at").groupBy("order_id").agg(F.min("occurred_at").alias("delivered"))
    inside = e.join(first, "order_id").withColumn("late", F.col("occurred_at") - F.col("delivered")).where(f"late >= 0 and late <= {max(window, dispute)}")
    when = lambda limit, *kinds: F.when(F.col("event_type").isin(*kinds) & (F.col("late") <= limit), F.struct("occurred_at", "event_id"))
    found = inside.groupBy("order_id").agg(
        F.min_by("event_type", when(window, *BACK)).alias("back"), F.min_by("returned_value_fraction", when(window, *BACK)).alias("part"),
        F.min_by("event_type", when(dispute, *RESOLUTIONS)).alias("resolution"), F.count(when(dispute, *DISPUTES)).alias("disputes"),
    )
    o = log.orders.select("order_id").join(first, "order_id", "left").join(found, "order_id", "left")
    closed, settled = F.col("delivered") + window < as_of, F.col("delivered") + dispute < as_of
    label = F.when(F.col("delivered").isNull() | ~closed, None).when(F.col("back").isNotNull(), 1).otherwise(0)
    part = F.coalesce("part", F.lit(1.0))
    status = (
        F.when(F.col("delivered").isNull(), "NOT_MATURED").when(F.col("resolution") == "ABUSE_CONFIRMED", "CONFIRMED").when(F.col("resolution") == "ABUSE_CLEARED", "CLEARED")
        .when(~settled, "NOT_MATURED").when(F.col("disputes") > 0, "UNRESOLVED").otherwise("NO_CLAIM")
    )
    o = o.withColumn("return_label", label).withColumn("abuse_status", status)
    return o.select(
        "order_id", "return_label",
        F.when(F.col("return_label") == 0, "NONE").when(F.col("return_label") == 1, F.when(F.col("back") == "EXCHANGE_REQUESTED", "EXCHANGE").when(part < 1, "PARTIAL").otherwise("FULL")).alias("return_type"),
        F.when(F.col("return_label") == 0, 0.0).when(F.col("return_label") == 1, part).alias("returned_fraction"), "abuse_status",
        F.when(F.col("abuse_status") == "CONFIRMED", 1).when(F.col("abuse_status").isin("CLEARED", "NO_CLAIM"), 0).alias("abuse_label"),
    )


def split_of(t: Column, first_day: Column, demo: Column | None = None) -> Column:
    """The split of an instant by its day, from 1 on the first day of history; accounts made by hand are always RECENT."""
    day = F.floor((t - first_day) / DAY) + 1
    out = F.lit("RECENT")
    for name, last in reversed(SPLIT_DAYS):
        out = F.when(day <= last, name).otherwise(out)
    return out if demo is None else F.when(demo, "RECENT").otherwise(out)


def latest_identifiers(log: EventLog, before: int) -> DataFrame:
    """account_id, device_id, address_id of its newest order before an instant, and its newest token that isn't null."""
    o = log.orders.where(F.col("placed_at") < before)
    newest = F.struct("placed_at", "order_id")
    return o.groupBy("account_id").agg(
        F.max_by("device_id", newest).alias("device_id"), F.max_by("address_id", newest).alias("address_id"), F.max_by("payment_token_id", F.when(F.col("payment_token_id").isNotNull(), newest)).alias("payment_token_id")
    )


def new_accounts(log: EventLog, t0: int) -> DataFrame:
    """Accounts that have no order before `t0`."""
    earlier = log.orders.where(F.col("placed_at") < t0).select("account_id")
    return log.accounts.join(earlier, "account_id", "left_anti")


def numbered(events: DataFrame) -> DataFrame:
    """`events` with event_id from 1 in the order of time, order and type; ranges are numbered in parallel."""
    from ..plans.audit import ranked

    return ranked(events.drop("event_id"), "occurred_at", "order_id", "event_type").withColumn("event_id", F.col("rank") + 1).drop("rank")


def known_identifier(ident: Column, rejected: list[str] | None = None) -> Column:
    """Whether an id can be a node: 32 hex digits, not all zero, not one of the ids of placeholder values."""
    good = F.coalesce(ident.rlike("^[0-9a-f]{32}$") & ~ident.rlike("^0+$"), F.lit(False))
    return good & ~ident.isin(rejected) if rejected else good


def rejected_ids(secret: str) -> list[str]:
    """The ids that placeholder values have under `secret`."""
    import hashlib
    import hmac

    return [hmac.new(secret.encode(), f"{kind}:{value}".encode(), hashlib.sha256).hexdigest()[:32] for kind in KINDS for value in money.PLACEHOLDERS]


class LogWorld(World):
    """A log in the shape of the order world: keys k and c are the log's ids."""

    def __init__(self, log: EventLog, secret: str | None = None, truth: DataFrame | None = None) -> None:
        super().__init__(log.orders.sparkSession, "")
        object.__setattr__(self, "log", log)
        object.__setattr__(self, "secret", secret)
        object.__setattr__(self, "rejected", rejected_ids(secret) if secret else None)
        object.__setattr__(self, "known_truth", truth)

    def kept(self) -> World:
        return KeptLogWorld(self.log, self.secret, self.known_truth)

    @cached_property
    def placed(self) -> DataFrame:
        """The events of known orders that aren't before them, with c, t0 and value of the order."""
        of = self.log.orders.select(F.col("order_id"), F.col("account_id").alias("c"), F.col("placed_at").alias("t0"), F.col("order_value_inr").alias("value"))
        return self.log.order_events.join(of, "order_id").where("occurred_at >= t0")

    @cached_property
    def deliveries(self) -> DataFrame:
        """A later delivery of an order takes the place of the one before, from its own time on."""
        e = self.placed
        first = F.min(F.when(F.col("event_type").isin(*BACK), F.col("occurred_at"))).over(Window.partitionBy("order_id"))
        seen = e.withColumn("returned", first).where("event_type = 'DELIVERED'").select("order_id", "c", "t0", "value", "returned", F.col("occurred_at").alias("delivered")).distinct()
        until = F.lead("delivered").over(Window.partitionBy("order_id").orderBy("delivered"))
        return seen.withColumn("until", until).withColumnRenamed("order_id", "k")

    @cached_property
    def truth(self) -> DataFrame:
        """The table that was given with the log (account_id, archetype, ring); without one nothing is known of any account."""
        if self.known_truth is None:
            return self.log.accounts.select(F.col("account_id").alias("c"), F.lit("UNKNOWN").alias("archetype"), F.lit(None).cast("string").alias("ring"))
        return self.known_truth.select(F.col("account_id").alias("c"), "archetype", "ring")

    def labels(self, as_of: int) -> DataFrame:
        """By the first events inside the windows; see the function `labels`."""
        return labels(self.log, as_of).withColumnRenamed("order_id", "k")

    @cached_property
    def splits(self) -> DataFrame:
        """By the order's day, counted from the day of the first order."""
        first = self.log.orders.agg(F.min("placed_at").alias("first")).select((F.col("first") - F.pmod("first", F.lit(DAY))).alias("first"))
        demo = self.log.accounts.select("account_id", (F.col("source") == "DEMO").alias("demo"))
        days = self.log.orders.join(demo, "account_id", "left").crossJoin(F.broadcast(first))
        return days.select(F.col("order_id").alias("k"), split_of(F.col("placed_at"), F.col("first"), F.coalesce("demo", F.lit(False))).alias("split"))

    @cached_property
    def lines(self) -> DataFrame:
        amount = (F.col("unit_price_inr") * F.col("quantity")).cast("decimal(18,2)")
        return self.log.order_lines.select(F.col("order_id").alias("k"), F.col("sku_id").alias("sku"), F.col("product_id").alias("product"), "variant", F.coalesce("category", F.lit("OTHER")).alias("category"), F.col("quantity").alias("qty"), amount.alias("amount"))

    @cached_property
    def variants(self) -> DataFrame:
        return self.lines.select("k", "product", "variant")

    @cached_property
    def orders(self) -> DataFrame:
        skus = self.lines.groupBy("k").agg(F.sort_array(F.collect_set("sku")).alias("skus"))
        flags = self.log.identifiers.where("multi_tenant_set_at is not null").select(F.col("identifier_id").alias("address_id"), F.lit(True).alias("shared_address"))
        found = _outcomes(self.placed).withColumnRenamed("order_id", "k").withColumn("exchanged", F.coalesce(F.col("back") == "EXCHANGE_REQUESTED", F.lit(False))).drop("back", "resolution")
        known = lambda c: F.when(known_identifier(F.col(c), self.rejected), F.col(c))
        o = self.log.orders.select(
            F.col("order_id").alias("k"), F.col("account_id").alias("c"), F.col("placed_at").alias("t0"), F.col("order_value_inr").alias("value"), "discount_pct", "n_items", "delivery_speed", "payment_method",
            known("device_id").alias("device_id"), known("address_id").alias("address_id"), known("payment_token_id").alias("token_id"),
        )
        o = o.join(skus, "k", "left").join(found, "k", "left").join(flags, "address_id", "left")
        return o.withColumns({"skus": F.coalesce("skus", F.array().cast("array<string>")), "exchanged": F.coalesce("exchanged", F.lit(False)), "shared_address": F.coalesce("shared_address", F.lit(False)), "fraction": F.coalesce("fraction", F.lit(1.0))})

    @cached_property
    def accounts(self) -> DataFrame:
        first = self.orders.groupBy("c").agg(F.min("confirmed").alias("confirmed"))
        return self.log.accounts.select(F.col("account_id").alias("c"), F.col("created_at").alias("created")).join(first, "c", "left")

    @cached_property
    def events(self) -> DataFrame:
        kind = F.when(F.col("event_type").isin(*BACK), "RETURNED").when(F.col("event_type").isin(*RESOLUTIONS), "RESOLVED").otherwise(F.col("event_type"))
        return self.placed.select(F.col("order_id").alias("k"), "c", kind.alias("event_type"), F.col("occurred_at").alias("t"))

    @cached_property
    def multi_tenant(self) -> DataFrame:
        return self.log.identifiers.where("multi_tenant_set_at is not null").select(F.col("identifier_id").alias("ident"), F.col("multi_tenant_set_at").alias("since"))


class KeptLogWorld(LogWorld):
    """A log's world that writes what several plans read, each table at its first use; orders and accounts in buckets by account, events in buckets by order."""

    @cached_property
    def placed(self) -> DataFrame:
        return written_by(LogWorld.placed.func(self), "order_id")

    @cached_property
    def orders(self) -> DataFrame:
        return written_by(LogWorld.orders.func(self), "c")

    @cached_property
    def accounts(self) -> DataFrame:
        return written_by(LogWorld.accounts.func(self), "c")

    @cached_property
    def numbered(self) -> tuple[DataFrame, DataFrame]:
        from ..operators import component

        return component.numbered(self)

    @cached_property
    def multi_tenant(self) -> DataFrame:
        return written(LogWorld.multi_tenant.func(self))


def of_world(w: World) -> EventLog:
    """The star tables' world as a log. Ids are text; the two dispute times, returns and resolutions become events."""
    o = w.orders
    order, account = F.concat(F.lit("ORD-"), F.col("k")), F.concat(F.lit("ACC-"), F.col("c"))
    accounts = w.accounts.select(account.alias("account_id"), F.col("created").alias("created_at"), F.lit("HISTORY").alias("source"))
    kinds = w.uses.select(F.col("ident").alias("identifier_id"), "kind").distinct()
    identifiers = kinds.join(w.multi_tenant.select(F.col("ident").alias("identifier_id"), F.col("since").alias("multi_tenant_set_at")), "identifier_id", "left")
    orders = o.select(
        order.alias("order_id"), account.alias("account_id"), F.col("t0").alias("placed_at"), F.col("value").alias("order_value_inr"), "discount_pct", "n_items", "delivery_speed", "payment_method", "device_id", "address_id",
        F.col("token_id").alias("payment_token_id"), F.when(F.col("k") % 50 == 0, "LIVE").otherwise("HISTORY").alias("source"),
    )
    number = F.row_number().over(Window.partitionBy("k").orderBy("sku", "amount", "qty")).cast("int")
    lines = w.lines.select(order.alias("order_id"), number.alias("line_no"), F.col("sku").cast("string").alias("sku_id"), F.col("product").cast("string").alias("product_id"), F.col("variant").cast("string").alias("variant"), "category", (F.col("amount") / F.col("qty")).cast("double").alias("unit_price_inr"), F.col("qty").alias("quantity"))
    back, resolution = "if(exchanged, 'EXCHANGE_REQUESTED', 'RETURN_REQUESTED')", "if(confirmed is not null, 'ABUSE_CONFIRMED', 'ABUSE_CLEARED')"
    stack = f"stack(5, 0, 'DELIVERED', delivered, 1, {back}, returned, 2, 'CLAIM_FILED', claimed, 3, 'QC_FLAGGED', flagged, 4, {resolution}, resolved) as (n, event_type, occurred_at)"
    events = o.select("k", "fraction", F.expr(stack)).where("occurred_at is not null")
    events = events.select((F.col("k") * 5 + F.col("n")).alias("event_id"), order.alias("order_id"), "event_type", "occurred_at", F.when(F.col("n") == 1, F.col("fraction")).alias("returned_value_fraction"))
    return EventLog(accounts, identifiers, orders, lines, events)


def eventful(log: EventLog) -> EventLog:
    """A log of `of_world` in which every fifth order is delivered twice, and every third one that was resolved is resolved again, the other way."""
    number = F.expr("cast(substring(order_id, 5) as bigint)")
    e = log.order_events.withColumn("n", number)
    again = e.where("event_type = 'DELIVERED' and n % 5 = 0").withColumn("occurred_at", F.col("occurred_at") + 35 * DAY)
    other = F.when(F.col("event_type") == "ABUSE_CONFIRMED", "ABUSE_CLEARED").otherwise("ABUSE_CONFIRMED")
    turned = e.where(F.col("event_type").isin(*RESOLUTIONS) & (F.col("n") % 3 == 0)).withColumn("event_type", other).withColumn("occurred_at", F.col("occurred_at") + 5 * DAY)
    more = again.unionByName(turned).withColumn("event_id", -1 - F.col("event_id"))
    return replace(log, order_events=log.order_events.unionByName(more.drop("n")))
