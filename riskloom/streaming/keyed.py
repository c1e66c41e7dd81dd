"""Streams with state of their own per key: exact trailing attempts of a device, and identifiers' accounts and recent orders.

Rows of a key are applied in the order of their time. A row that is older than what its key has applied already is late: it
is returned as such, changes nothing, and nothing is computed for it; none is dropped. Rows of one instant don't see each
other, in whatever batches they come.

State leaves a key's memory by the key's own event time: attempts after 24 hours, orders after 7 days. A key that has been
silent for 7 days of arrival time is forgotten as a whole. The watermark is on the time of arrival, so it never drops late events.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.world import DAY

#: Milliseconds of arrival time after which a silent key is forgotten, and the days that an order stays in memory.
SILENT = 7 * 86_400_000
ORDER_DAYS = 7


def _arriving(df: DataFrame) -> DataFrame:
    return df.withColumn("_arrived", F.current_timestamp()).withWatermark("_arrived", "0 seconds")


def _armed(state: GroupState) -> None:
    # the first batch has no watermark yet
    state.setTimeoutTimestamp(max(state.getCurrentWatermarkMs(), state.getCurrentProcessingTimeMs()) + SILENT)


def _rows(frames: Iterator[pd.DataFrame], *order: str) -> pd.DataFrame:
    return pd.concat(list(frames), ignore_index=True).sort_values(list(order), kind="stable")


def attempts(events: DataFrame) -> DataFrame:
    """event_id, user_id, t, attempts_24h (this one included), carts_24h (distinct ones, this one's included), late, of rows (event_id, user_id, cart, t).

    Late rows have no counts.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        times, carts, applied = (list(x) if isinstance(x, (list, tuple)) or hasattr(x, "__len__") else x for x in (state.get if state.exists else ([], [], None)))
        out = []
        for event, cart, t in _rows(frames, "t", "event_id")[["event_id", "cart", "t"]].itertuples(index=False):
            cart = None if pd.isna(cart) else int(cart)
            if applied is not None and t < applied:
                out.append((event, key[0], t, None, None, True))
                continue
            gone = next((i for i, x in enumerate(times) if x >= t - DAY), len(times))
            times, carts, applied = times[gone:], carts[gone:], int(t)
            before = next((i for i, x in enumerate(times) if x >= t), len(times))
            others = {c for c in carts[:before] if c is not None and c != cart} if cart is not None else set()
            out.append((event, key[0], t, before + 1, len(others) + 1, False))
            times.append(int(t))
            carts.append(cart)
        state.update((times, carts, applied))
        _armed(state)
        done = pd.DataFrame(out, columns=["event_id", "user_id", "t", "attempts_24h", "carts_24h", "late"])
        yield done.astype({"attempts_24h": "Int64", "carts_24h": "Int64"})

    kind = events.schema["user_id"].dataType.simpleString()
    return _arriving(events.select("event_id", "user_id", "cart", "t")).groupBy("user_id").applyInPandasWithState(
        step, f"event_id long, user_id {kind}, t long, attempts_24h long, carts_24h long, late boolean", "times array<long>, carts array<long>, applied long", "append", GroupStateTimeout.EventTimeTimeout)


def identifier_uses(uses: DataFrame) -> DataFrame:
    """Per use (k, c, kind, ident, t) of an identifier, as of its time: reuse_7d (accounts whose first use was in the 7 days
    before), others_30d (other accounts that used it in the 30 days before), new_for_account, orders_24h (orders of other
    accounts in the 24 hours before), and late.

    The state of an identifier is each account's first and last use, and the orders of the last 7 days.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        names, firsts, lasts, priors, owners, times, applied = state.get if state.exists else ([], [], [], [], [], [], None)
        known = {n: [f, x, None if pd.isna(p) else p] for n, f, x, p in zip(names, firsts, lasts, priors)}
        orders = list(zip(owners, times))
        out = []
        for k, c, t in _rows(frames, "t", "k")[["k", "c", "t"]].itertuples(index=False):
            t = int(t)
            if applied is not None and t < applied:
                out.append((k, c, *key, t, None, None, None, None, True))
                continue
            applied = t
            orders = [(o, x) for o, x in orders if x >= t - ORDER_DAYS * DAY]
            seen = {n: x if x < t else p for n, (_, x, p) in known.items()}  # the last use before this instant
            new = sum(t - 7 * DAY <= f < t for f, _, _ in known.values())
            others = sum(x is not None and x >= t - 30 * DAY for n, x in seen.items() if n != c)
            recent = sum(t - DAY <= x < t for o, x in orders if o != c)
            out.append((k, c, *key, t, new, others, c not in known or known[c][0] >= t, recent, False))
            mine = known.setdefault(c, [t, t, None])
            if mine[1] < t:
                mine[1:] = [t, mine[1]]
            orders.append((c, t))
        state.update(([*known], [v[0] for v in known.values()], [v[1] for v in known.values()], [v[2] for v in known.values()], [o for o, _ in orders], [x for _, x in orders], applied))
        _armed(state)
        done = pd.DataFrame(out, columns=["k", "c", "kind", "ident", "t", "reuse_7d", "others_30d", "new_for_account", "orders_24h", "late"])
        yield done.astype({"reuse_7d": "Int64", "others_30d": "Int64", "orders_24h": "Int64", "new_for_account": "boolean"})

    k, c = (uses.schema[x].dataType.simpleString() for x in ("k", "c"))
    return _arriving(uses.select("k", "c", "kind", "ident", "t")).groupBy("kind", "ident").applyInPandasWithState(
        step, f"k {k}, c {c}, kind string, ident string, t long, reuse_7d long, others_30d long, new_for_account boolean, orders_24h long, late boolean",
        f"names array<{c}>, firsts array<long>, lasts array<long>, priors array<long>, owners array<{c}>, times array<long>, applied long", "append", GroupStateTimeout.EventTimeTimeout)


def late_rows(out: DataFrame) -> DataFrame:
    """late, n: how many rows came in time and how many too late."""
    return out.groupBy("late").agg(F.count("*").alias("n"))
