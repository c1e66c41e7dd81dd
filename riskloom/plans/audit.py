"""Tamper-evident records: a hash chain over decisions, its verification, idempotent scoring, overrides."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.store import written

GENESIS = "0" * 64
#: Most nodes below a node of the tree over a chain's blocks.
FAN = 256
#: Columns that are stored beside a payload and must equal it, and those that are amounts.
CHECKED = ("c", "t0", "value", "clv", "p_abuse", "p_return", "cost_allow", "cost_block", "cost_optimal", "action", "status")
MONEY = ("value", "clv", "cost_allow", "cost_prepaid_only", "cost_manual_review", "cost_block")


def payload(df: DataFrame) -> DataFrame:
    """The canonical record of a decision."""
    kept = ["k", "c", "t0", "value", "clv", "p_abuse", "p_return", "cost_allow", "cost_prepaid_only", "cost_manual_review", "cost_block", "g2", "g3", "g4", "g5", "cost_optimal", "action", "status"]
    return canonical(df.select(*(c for c in kept if c in df.columns)))


def ranked(df: DataFrame, *order: str) -> DataFrame:
    """`df` with rank, from 0 by these columns: ranges are sorted in parallel, and only the ranges' sizes meet in one task."""
    place = F.monotonically_increasing_id()
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_place", place)).withColumn("_part", F.shiftright("_place", 33))
    sizes = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    upto = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_offset"))
    rank = F.col("_offset") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(offsets), "_part").withColumn("rank", rank).drop("_part", "_place", "_offset")


def chained(records: DataFrame, block: int = 1000) -> DataFrame:
    """seq, prev_hash, event_hash: each record's hash covers the one before it.

    A chain is serial by definition. Records are hashed into blocks that chain inside, in parallel over blocks; the first
    record of a block is linked to the number of its block, and `roots` is a tree over the blocks' last hashes.
    """
    return hashed(ranked(records, "t0", "k").withColumnRenamed("rank", "seq").withColumn("block", F.expr(f"cast(seq div {block} as long)")))


def hashed(numbered: DataFrame) -> DataFrame:
    rows = numbered.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("seq", "k", "payload"))).alias("r"))
    start = F.sha2(F.concat(F.lit(GENESIS), F.col("block").cast("string")), 256)
    hashes = F.expr("aggregate(r, named_struct('h', s, 'out', cast(array() as array<string>)), (a, x) -> named_struct('h', sha2(concat(a.h, x.payload), 256), 'out', array_append(a.out, sha2(concat(a.h, x.payload), 256))), a -> a.out)")
    rows = rows.withColumn("s", start).withColumn("hashes", hashes)
    prev = F.concat(F.array("s"), F.slice("hashes", 1, F.size("hashes") - 1))
    return rows.select("block", F.explode(F.arrays_zip("r", F.col("hashes").alias("event_hash"), prev.alias("prev_hash"))).alias("z")).select("block", "z.r.*", "z.prev_hash", "z.event_hash")


def leaves(chain: DataFrame) -> DataFrame:
    """level (0), node (the block), hash (its last one), first_seq, last_seq: one row per block."""
    return chain.groupBy(F.col("block").alias("node")).agg(F.max_by("event_hash", "seq").alias("hash"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq")).select(F.lit(0).alias("level"), "node", "hash", "first_seq", "last_seq")


def _above(nodes: DataFrame) -> DataFrame:
    """The next level of the tree: each node's hash covers the numbers and hashes of at most `FAN` nodes."""
    part = F.array_sort(F.collect_list(F.struct("node", "hash")))
    text = F.array_join(F.transform(part, lambda x: F.concat_ws(":", x["node"].cast("string"), x["hash"])), ",")
    return nodes.groupBy((F.col("level") + 1).alias("level"), F.expr(f"node div {FAN}").alias("node")).agg(F.sha2(text, 256).alias("hash"), F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"))


def tree(nodes: DataFrame) -> DataFrame:
    """The leaves and all levels above them, up to one node."""
    level = written(nodes)
    out = level
    while level.where("node > 0").limit(1).count():
        level = written(_above(level))
        out = out.unionByName(level)
    return out


def tree_top(nodes: DataFrame) -> str | None:
    """The hash of the top; None without nodes."""
    row = tree(nodes).agg(F.max_by("hash", "level")).first()
    return row[0]


def roots(chain: DataFrame) -> DataFrame:
    """The tree over the chain's blocks, to be kept apart from the chain: it shows what the chain alone can't, such as a lost end or a
    block hashed anew.
    """
    return tree(leaves(chain))


def verify(chain: DataFrame, recorded: DataFrame | None = None) -> DataFrame:
    """rows_checked, broken, first_broken_seq: broken rows and blocks; parallel over blocks.

    A row is broken if its hash, its link to the row before or its number doesn't hold. A block is if it doesn't go on where
    the one before ends, or, given the `recorded` tree, if it isn't what was recorded, or is missing; so is a node of the recorded
    tree that doesn't cover the nodes below it. Rows lost at the end of the chain show only against a recorded tree.
    """
    order = Window.partitionBy("block").orderBy("seq")
    before, number = F.lag("event_hash").over(order), F.lag("seq").over(order)
    expected = F.coalesce(before, F.sha2(F.concat(F.lit(GENESIS), F.col("block").cast("string")), 256))
    bad = (F.col("prev_hash") != expected) | (F.sha2(F.concat("prev_hash", "payload"), 256) != F.col("event_hash")) | F.coalesce(F.col("seq") != number + 1, F.lit(False))
    blocks = chain.withColumn("bad", bad).groupBy("block").agg(
        F.count("*").alias("n"), F.count_if("bad").alias("bad_rows"), F.min(F.when(F.col("bad"), F.col("seq"))).alias("bad_seq"),
        F.min("seq").alias("first"), F.max("seq").alias("last"), F.max_by("event_hash", "seq").alias("h"),
    )
    ends = blocks.select((F.col("block") + 1).alias("block"), (F.col("last") + 1).alias("next"))
    blocks = blocks.join(ends, "block", "left").withColumn("wrong", F.col("first") != F.coalesce("next", F.lit(0)))
    at = F.col("first")
    if recorded is not None:
        kept = recorded.where("level = 0").select(F.col("node").alias("block"), F.col("hash").alias("root"), "first_seq", "last_seq")
        blocks = blocks.join(kept, "block", "full")
        same = (F.col("h") == F.col("root")) & (F.col("first") == F.col("first_seq")) & (F.col("last") == F.col("last_seq"))
        blocks = blocks.withColumn("wrong", F.coalesce("wrong", F.lit(True)) | ~F.coalesce(same, F.lit(False)))
        at = F.coalesce("first_seq", "first")
        again = _above(recorded).join(recorded.select("level", "node", F.col("hash").alias("stored")), ["level", "node"], "full").where("level > 0")
        top = recorded.agg(F.max("level").alias("top"))
        nodes = again.crossJoin(F.broadcast(top)).where("level <= top and (stored is null or hash is null or hash <> stored)").select(
            F.col("node").alias("block"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("bad_rows"), F.lit(None).cast("long").alias("bad_seq"), F.lit(True).alias("wrong"), F.coalesce("first_seq", F.lit(0)).cast("long").alias("at"))
        blocks = blocks.withColumn("at", at).select(*nodes.columns).unionByName(nodes)
        at = F.col("at")
    return blocks.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_checked"), F.coalesce(F.sum(F.coalesce("bad_rows", F.lit(0)) + F.col("wrong").cast("long")), F.lit(0)).alias("broken"),
        F.min(F.least("bad_seq", F.when(F.col("wrong"), at))).alias("first_broken_seq"),
    )


def column_faults(events: DataFrame) -> DataFrame:
    """column, n, first_seq: stored columns that differ from what the payload says, though the payload and its hash may be whole."""
    present = [c for c in CHECKED if c in events.columns]
    kinds = dict(events.dtypes)
    schema = ", ".join(f"`{c}` {_kind(c, kinds[c])}" for c in present)
    parsed = events.withColumn("_said", F.from_json("payload", schema))
    differ = F.array_compact(F.array(*(F.when(~F.col(c).cast(_kind(c, kinds[c])).eqNullSafe(F.col("_said")[c]), F.lit(c)) for c in present)))
    return parsed.select("seq", F.explode(differ).alias("column")).groupBy("column").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))


def score_batch(requests: DataFrame, decisions: DataFrame, fingerprint: list[str]) -> DataFrame:
    """outcome per request: CREATED for new orders, REPLAYED for an equal request of a decided one, CONFLICT otherwise."""
    print_ = F.sha2(F.concat_ws("|", *fingerprint), 256)
    first = Window.partitionBy("k").orderBy("request_id")
    r = requests.withColumn("fingerprint", print_).withColumn("n", F.row_number().over(first)).withColumn("leader", F.first("fingerprint").over(first))
    known = decisions.select("k", F.col("fingerprint").alias("stored"))
    outcome = (
        F.when(F.col("stored").isNotNull(), F.when(F.col("stored") == F.col("fingerprint"), "REPLAYED").otherwise("CONFLICT"))
        .when(F.col("n") == 1, "CREATED").when(F.col("leader") == F.col("fingerprint"), "REPLAYED").otherwise("CONFLICT")
    )
    return r.join(known, "k", "left").select("request_id", "k", outcome.alias("outcome"))


def current_actions(decisions: DataFrame, overrides: DataFrame) -> DataFrame:
    """k, action, current_action: the newest override stands; nothing is updated in place."""
    last = overrides.groupBy("k").agg(F.max_by("new_action", "seq").alias("new_action"))
    return decisions.join(last, "k", "left").select("k", "action", F.coalesce("new_action", "action").alias("current_action"))


def _kind(column: str, kind: str) -> str:
    """The type that a column has in a payload: amounts to two decimals, other fractions to six."""
    return "decimal(28,2)" if column in MONEY else "decimal(28,6)" if kind in ("double", "float") else kind


def canonical(df: DataFrame) -> DataFrame:
    """k, t0, payload: a row as JSON with sorted keys and no spaces; amounts to two decimals, other fractions to six."""
    kinds = dict(df.dtypes)
    row = F.struct(*(F.col(c).cast(_kind(c, kinds[c])).alias(c) for c in sorted(df.columns)))
    return df.select("k", "t0", F.to_json(row, {"ignoreNullFields": "false"}).alias("payload"))


def append(chain: DataFrame, records: DataFrame, block: int = 1000) -> DataFrame:
    """The chain with `records` (k, t0, payload) after its last row, in blocks of their own; one writer at a time."""
    last = chain.agg(F.coalesce(F.max("seq"), F.lit(-1)).alias("_seq"), F.coalesce(F.max("block"), F.lit(-1)).alias("_block"))
    more = ranked(records, "t0", "k").withColumnRenamed("rank", "seq").crossJoin(F.broadcast(last))
    more = more.withColumn("block", F.col("_block") + 1 + F.expr(f"cast(seq div {block} as long)")).withColumn("seq", F.col("_seq") + 1 + F.col("seq"))
    return chain.unionByName(hashed(more.select("block", "seq", "k", "payload")))


def events_of(events: DataFrame, event_id: str | None = None, order: str | None = None) -> DataFrame:
    """Audit events by id, or of an order by seq."""
    df = events.where(F.col("event_id") == event_id) if event_id is not None else events
    return (df.where(F.col("k") == order) if order is not None else df).orderBy("seq")


def overrides(decisions: DataFrame, requests: DataFrame) -> DataFrame:
    """seq, k, outcome, warning, previous_action of each request (seq, k, expected_action, new_action, reason), in the order of seq.

    A request applies if it expects the action that stands then; blocking without corroboration (g2) needs independent
    evidence as its reason, and is warned of. Each order's requests are folded by themselves.
    """
    step = """aggregate(r, named_struct('now', action, 'out', cast(array() as array<struct<seq:bigint,outcome:string,warning:string,previous_action:string>>)), (a, x) ->
        named_struct('now', if(x.expected_action = a.now and not (x.new_action = 'BLOCK' and g2 and x.reason <> 'INDEPENDENT_EVIDENCE_OF_ABUSE'), x.new_action, a.now),
          'out', concat(a.out, array(named_struct('seq', x.seq,
            'outcome', case when x.expected_action <> a.now then 'CONFLICT' when x.new_action = 'BLOCK' and g2 and x.reason <> 'INDEPENDENT_EVIDENCE_OF_ABUSE' then 'REJECTED' else 'APPLIED' end,
            'warning', if(x.expected_action = a.now and x.new_action = 'BLOCK' and g2 and x.reason = 'INDEPENDENT_EVIDENCE_OF_ABUSE', 'G2', null), 'previous_action', a.now)))), a -> a.out)"""
    fields = F.struct(F.col("seq").cast("long").alias("seq"), "expected_action", "new_action", "reason")
    asked = requests.groupBy("k").agg(F.sort_array(F.collect_list(fields)).alias("r"))
    return asked.join(decisions.select("k", "action", "g2"), "k").select("k", F.explode(F.expr(step)).alias("x")).select("x.seq", "k", "x.outcome", "x.warning", "x.previous_action")


def appeals(requests: DataFrame, opened_before: int = 0, year: int = 2026) -> DataFrame:
    """seq, k, outcome, reference of appeal requests (seq, k): an order has one open appeal; references are numbered in order."""
    first = F.row_number().over(Window.partitionBy("k").orderBy("seq")) == 1
    asked = requests.select("seq", "k", F.when(first, "OPENED").otherwise("CONFLICT").alias("outcome"))
    number = ranked(asked.where("outcome = 'OPENED'"), "seq").select("seq", "k", "outcome", F.concat(F.lit(f"APL-{year}-"), F.lpad((F.col("rank") + opened_before + 1).cast("string"), 6, "0")).alias("reference"))
    return number.unionByName(asked.where("outcome = 'CONFLICT'").withColumn("reference", F.lit(None).cast("string")))


def seeded(df: DataFrame, n: int = 250, seed: int = 20260901) -> DataFrame:
    """The rows to start a review with: all that aren't allowed, the likeliest `n` if they are more, else filled up to `n` by a sample."""
    flagged = df.where("action <> 'ALLOW'").orderBy(F.desc("p_abuse"), "k").limit(n)
    draw = F.xxhash64(F.lit(seed), "k")
    rest = df.where("action = 'ALLOW'").withColumn("_draw", draw).orderBy("_draw", "k").limit(n).drop("_draw")
    both = flagged.withColumn("_first", F.lit(0)).unionByName(rest.withColumn("_first", F.lit(1)))
    return both.orderBy("_first", F.xxhash64(F.lit(seed), "k"), "k").limit(n).drop("_first")
