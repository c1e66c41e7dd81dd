"""The registered queries' results in DuckDB's SQL, written from the definitions, for checking the Spark queries."""

from __future__ import annotations

DAY = 86_400_000_000
HOUR = 3_600_000_000


def _ident(kind: str, value: str) -> str:
    return f"substr(sha256('{kind}:' || {value}), 1, 32)"


WORLD = f"""
WITH RECURSIVE ln AS (
  SELECT l_orderkey AS k, l_partkey AS sku, l_partkey // 4 AS product, l_partkey % 4 AS variant, coalesce(p_type, 'OTHER') AS category,
         CAST(l_quantity AS BIGINT) AS qty, CAST(l_extendedprice AS DECIMAL(18,2)) AS amount, l_discount, l_returnflag = 'R' AS returned
  FROM lineitem LEFT JOIN part ON p_partkey = l_partkey
), basket AS (
  SELECT k, sum(amount) AS gross, sum(CASE WHEN returned THEN amount ELSE 0 END) AS returned_amount, greatest(CAST(max(l_discount) AS DECIMAL(4,2)), CAST(0 AS DECIMAL(4,2))) AS discount,
         sum(qty) AS n_items, list_sort(list(DISTINCT sku)) AS skus
  FROM ln GROUP BY k
), o0 AS (
  SELECT o_orderkey AS k, o_custkey AS c, epoch_us(o_orderdate) AS t0, gross, CAST(discount * 100 AS DOUBLE) AS discount_pct, n_items, skus,
         CAST(round(gross * (1 - discount), 2) AS DOUBLE) AS value,
         CASE WHEN o_orderkey % 4 = 0 THEN 'EXPRESS' ELSE 'STANDARD' END AS delivery_speed,
         CASE WHEN o_orderpriority = '1-URGENT' THEN 'COD' WHEN o_orderkey % 2 = 0 THEN 'PREPAID_CARD' ELSE 'PREPAID_UPI' END AS payment_method,
         {_ident('DEVICE', "CASE WHEN o_orderkey % 5 = 0 THEN 'd' || o_custkey || 'x' ELSE 'd' || (o_custkey // 4) END")} AS device_id,
         {_ident('ADDRESS', "CASE WHEN o_custkey % 10 < 7 THEN 'a' || (o_custkey // 2) WHEN o_custkey % 10 < 9 THEN 'm' || (o_custkey // 60) ELSE 'f' || (o_custkey // 1000) END")} AS address_id,
         CASE WHEN o_orderpriority = '1-URGENT' THEN NULL ELSE {_ident('PAYMENT_TOKEN', "'t' || (o_custkey // 3)")} END AS token_id,
         o_custkey % 10 IN (7, 8) AS shared_address,
         CASE WHEN o_orderkey % 33 <> 0 THEN epoch_us(o_orderdate) + (2 + o_orderkey % 6) * {DAY} + 10 * {HOUR} END AS delivered,
         returned_amount > 0 AND o_orderkey % 3 = 0 AS goes_back, CAST(returned_amount AS DOUBLE) / CAST(gross AS DOUBLE) AS fraction
  FROM orders JOIN basket ON k = o_orderkey
), o1 AS (
  SELECT *, CASE WHEN goes_back THEN delivered + (1 + k % 35) * {DAY} END AS returned, CASE WHEN k % 23 = 1 THEN delivered + (k % 5) * {DAY} + {HOUR} END AS claimed FROM o0
), o2 AS (SELECT *, CASE WHEN (k // 3) % 9 = 0 THEN returned + 3 * {DAY} END AS flagged FROM o1
), o3 AS (SELECT *, CASE WHEN (claimed IS NOT NULL OR flagged IS NOT NULL) AND k % 7 <> 0 THEN delivered + (10 + k % 60) * {DAY} END AS resolved FROM o2
), o AS (SELECT *, CASE WHEN k % 2 = 0 THEN resolved END AS confirmed FROM o3
), acc AS (SELECT c, min(t0) - (c % 900) * {DAY} - {DAY} AS created, min(confirmed) AS confirmed FROM o GROUP BY c
), uses AS (
  SELECT k, c, t0 AS t, 'DEVICE' AS kind, device_id AS ident FROM o UNION ALL SELECT k, c, t0, 'ADDRESS', address_id FROM o
  UNION ALL SELECT k, c, t0, 'PAYMENT_TOKEN', token_id FROM o WHERE token_id IS NOT NULL
), mt AS (
  SELECT ident, first + 7 * {DAY} AS since FROM (
    SELECT address_id AS ident, c, min(t0) AS first, row_number() OVER (PARTITION BY address_id ORDER BY min(t0), c) AS n FROM o WHERE shared_address GROUP BY address_id, c
  ) WHERE n = 8
)"""

HISTORY = WORLD + f"""
, hist AS (
  SELECT a.k, a.t0, (a.t0 - any_value(acc.created)) / {DAY} AS account_age_days,
         count(CASE WHEN b.t0 < a.t0 THEN 1 END) AS prior_orders,
         count(CASE WHEN b.returned < a.t0 AND b.returned >= a.t0 - {90 * DAY} THEN 1 END) AS returns_90d,
         count(CASE WHEN b.claimed < a.t0 AND b.claimed >= a.t0 - {180 * DAY} THEN 1 END) + count(CASE WHEN b.flagged < a.t0 AND b.flagged >= a.t0 - {180 * DAY} THEN 1 END) AS claims_180d,
         count(CASE WHEN b.delivered + {30 * DAY} < a.t0 THEN 1 END) AS matured,
         count(CASE WHEN b.delivered + {30 * DAY} < a.t0 AND b.returned <= b.delivered + {30 * DAY} THEN 1 END) AS matured_returns,
         coalesce(sum(CASE WHEN b.delivered + {30 * DAY} < a.t0 AND b.t0 >= a.t0 - {365 * DAY} AND b.t0 < a.t0 AND NOT coalesce(b.returned < a.t0, false) THEN CAST(b.value AS DECIMAL(18,2)) ELSE 0 END), 0) AS kept_value
  FROM o a JOIN o b ON a.c = b.c JOIN acc ON acc.c = a.c GROUP BY a.k, a.t0
), value_of AS (
  SELECT k, greatest(account_age_days, 0.0) AS tenure, CAST(kept_value AS DOUBLE) AS v FROM hist
), clv AS (
  SELECT k, least(greatest(least(1.0, tenure / 365) * (0.30 * v * CASE WHEN tenure > 0 AND tenure < 365 THEN 365 / tenure ELSE 1.0 END) * 3 + (1 - least(1.0, tenure / 365)) * 2000.0, 2000.0), 100000.0) AS clv FROM value_of
)"""

_KIND = lambda values: "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " END"
_RELIABILITY = _KIND({"DEVICE": "0.8::DOUBLE", "ADDRESS": "0.4::DOUBLE", "PAYMENT_TOKEN": "0.9::DOUBLE"})
_HALF = _KIND({"DEVICE": "30.0::DOUBLE", "ADDRESS": "45.0::DOUBLE", "PAYMENT_TOKEN": "60.0::DOUBLE"})


def _links(name: str, source: str) -> str:
    return f"""
, {name}0 AS (
  SELECT q.q, q.self, q.t0, q.kind, q.ident, q.own_first, e.c AS other, min(e.t) AS first, max(e.t) AS last
  FROM {source} q JOIN uses e ON e.kind = q.kind AND e.ident = q.ident AND e.c <> q.self AND e.t < q.t0 GROUP BY ALL
), {name}1 AS (
  SELECT l.*, kind = 'DEVICE' AND first < own_first AND last + {60 * DAY} <= own_first AS sequential, coalesce(kind = 'ADDRESS' AND mt.since < t0, false) AS multi_tenant,
         coalesce(acc.confirmed < t0, false) AS confirmed
  FROM {name}0 l LEFT JOIN mt USING (ident) LEFT JOIN acc ON acc.c = l.other
), {name}2 AS (SELECT *, CASE WHEN sequential THEN 0.2::DOUBLE WHEN multi_tenant THEN 0.1::DOUBLE ELSE {_RELIABILITY} END AS reliability FROM {name}1
), {name} AS (SELECT *, reliability * pow(0.5::DOUBLE, (t0 - last) / {DAY}::DOUBLE / {_HALF}) AS weight FROM {name}2
)"""


_QUERY_USES = """
, qu AS (SELECT u.k AS q, u.c AS self, u.t AS t0, u.kind, u.ident, f.own_first FROM uses u JOIN (SELECT kind, ident, c, min(t) AS own_first FROM uses GROUP BY ALL) f ON f.kind = u.kind AND f.ident = u.ident AND f.c = u.c
), qt AS (
  SELECT * FROM qu WHERE kind = 'PAYMENT_TOKEN'
  UNION ALL SELECT o.k, o.c, o.t0, 'PAYMENT_TOKEN', u.ident, min(u.t) FROM o JOIN uses u ON u.c = o.c AND u.kind = 'PAYMENT_TOKEN' AND u.t < o.t0 WHERE o.token_id IS NULL GROUP BY ALL
)"""

EVIDENCE = _QUERY_USES + _links("lk", "qu") + _links("tk", "qt") + f"""
, dev AS (
  SELECT q AS k, least(count(CASE WHEN NOT sequential AND last >= t0 - {30 * DAY} THEN 1 END), 25) AS device_others_30d, sum(CASE WHEN confirmed THEN weight ELSE 0 END) AS device_confirmed_weight,
         max(weight) AS device_weight, count(CASE WHEN confirmed THEN 1 END) AS device_confirmed_peers FROM lk WHERE kind = 'DEVICE' GROUP BY q
), tok AS (SELECT q AS k, count(DISTINCT CASE WHEN last >= t0 - {30 * DAY} THEN other END) AS token_others_30d, max(weight) AS token_weight FROM tk GROUP BY q
), adr AS (
  SELECT q AS k, count(CASE WHEN last >= t0 - {90 * DAY} THEN 1 END) + 1 > 25 AS fan, sum(CASE WHEN last >= t0 - {30 * DAY} THEN weight ELSE 0 END) AS w30,
         sum(CASE WHEN confirmed THEN weight ELSE 0 END) AS wc, max(weight) AS wm FROM lk WHERE kind = 'ADDRESS' GROUP BY q
), ev AS (
  SELECT o.k, coalesce(device_others_30d, 0) AS device_others_30d, coalesce(device_confirmed_weight, 0) AS device_confirmed_weight, coalesce(device_weight, 0) AS device_weight,
         coalesce(device_confirmed_peers, 0) AS device_confirmed_peers, coalesce(token_others_30d, 0) AS token_others_30d, coalesce(token_weight, 0) AS token_weight,
         CASE WHEN fan THEN 0 ELSE coalesce(w30, 0) END AS address_weighted_30d, CASE WHEN fan THEN 0 ELSE coalesce(wc, 0) END AS address_confirmed_weight,
         CASE WHEN fan THEN 0 ELSE coalesce(wm, 0) END AS address_weight, coalesce(fan, false) AS high_fanout, coalesce(mt.since < o.t0, false) AS address_multi_tenant
  FROM o LEFT JOIN dev USING (k) LEFT JOIN tok USING (k) LEFT JOIN adr USING (k) LEFT JOIN mt ON mt.ident = o.address_id
)"""

_WEIGHT = lambda kind, t0, last: f"({_RELIABILITY} * pow(0.5::DOUBLE, ({t0} - {last}) / {DAY}::DOUBLE / {_HALF}))".replace("CASE kind", f"CASE {kind}")
W = 90 * DAY

#: Breadth-first search from every order at once; a level is one step of the recursion.
COMPONENT = f"""
, ed AS (SELECT DISTINCT kind, ident, c, t FROM uses
), hot AS (SELECT ident FROM ed WHERE kind = 'ADDRESS' GROUP BY ident HAVING count(DISTINCT c) > 25
), busy AS (
  SELECT o.k AS bq, e.ident AS bident FROM o, ed e SEMI JOIN hot ON hot.ident = e.ident WHERE e.kind = 'ADDRESS' AND ((e.t < o.t0 AND e.t >= o.t0 - {W}) OR (e.c = o.c AND e.t <= o.t0)) GROUP BY ALL HAVING count(DISTINCT e.c) > 25
), comp(q, self, t0, account, depth, rank, kinds, bottleneck) USING KEY (q, account) AS (
  SELECT k, c, t0, c, 0, 0::BIGINT, []::VARCHAR[], 1.0::DOUBLE FROM o
  UNION ALL
  SELECT q, self, t0, account, depth, rank, kinds, bottleneck FROM (
    SELECT x.q, x.self, x.t0, x.other AS account, x.depth + 1 AS depth, row_number() OVER (PARTITION BY x.q ORDER BY x.b.rank, x.b.node, x.other) + n.n - 1 AS rank, list_distinct(list_append(x.b.kinds, x.b.kind)) AS kinds, x.b.bottleneck AS bottleneck
    FROM (
      SELECT q, self, t0, depth, other, min(struct_pack(rank := rank, node := (CASE kind WHEN 'ADDRESS' THEN 'ADR:' WHEN 'DEVICE' THEN 'DEV:' ELSE 'TOK:' END) || ident, kind := kind, bottleneck := least(bottleneck, w, w2), kinds := kinds)) AS b
      FROM (
        SELECT *, {_WEIGHT("kind", "t0", "last2")} AS w2 FROM (SELECT q, self, t0, account, depth, rank, kinds, bottleneck, kind, ident, w, other, max(last2) AS last2 FROM (SELECT u.*, e.c AS other, e.t AS last2
        FROM (
          SELECT * FROM (
            SELECT *, {_WEIGHT("kind", "t0", "last")} AS w FROM (SELECT q, self, t0, account, depth, rank, kinds, bottleneck, kind, ident, max(last) AS last FROM (
              SELECT f.q, f.self, f.t0, f.account, f.depth, f.rank, f.kinds, f.bottleneck, e.kind, e.ident, e.t AS last FROM comp f JOIN ed e ON e.c = f.account AND e.t < f.t0 AND e.t >= f.t0 - {W}
              UNION ALL SELECT f.q, f.self, f.t0, f.account, f.depth, f.rank, f.kinds, f.bottleneck, e.kind, e.ident, e.t FROM comp f JOIN uses e ON e.k = f.q AND f.depth = 0
            ) GROUP BY ALL)
          ) WHERE w >= 0.25
        ) u LEFT JOIN mt ON mt.ident = u.ident JOIN ed e ON e.kind = u.kind AND e.ident = u.ident AND e.c <> u.account AND e.t < u.t0 AND e.t >= u.t0 - {W}
        WHERE since IS NULL OR since >= u.t0) GROUP BY ALL)
      ) m WHERE w2 >= 0.25 AND NOT EXISTS (SELECT 1 FROM recurring.comp p WHERE p.q = m.q AND p.account = m.other)
        AND NOT (kind = 'ADDRESS' AND (q, ident) IN (SELECT (bq, bident) FROM busy))
      GROUP BY q, self, t0, depth, other
    ) x JOIN (SELECT q, count(*) AS n FROM recurring.comp GROUP BY q) n ON n.q = x.q
  ) WHERE rank < 200
)
, near AS (
  SELECT x.q, x.kinds, x.bottleneck, p.t0 >= x.t0 - {DAY} AS day, list_has_any(s.skus, p.skus) AS same
  FROM comp x JOIN o p ON p.c = x.account AND p.t0 < x.t0 AND p.t0 >= x.t0 - {7 * DAY} JOIN o s ON s.k = x.q WHERE x.account <> x.self
), bu AS (
  SELECT q AS k, count(CASE WHEN day THEN 1 END) AS linked_orders_24h, count(CASE WHEN same THEN 1 END) AS same_sku_7d, list_sort(list_distinct(flatten(list(kinds)))) AS burst_kinds, max(bottleneck) AS burst_weight
  FROM near WHERE day OR same GROUP BY q
), fl AS (SELECT c, claimed AS t FROM o WHERE claimed IS NOT NULL UNION ALL SELECT c, flagged FROM o WHERE flagged IS NOT NULL
), cl30 AS (SELECT x.q AS k, count(*) AS recent_claims_30d FROM comp x JOIN fl ON fl.c = x.account AND fl.t < x.t0 AND fl.t >= x.t0 - {30 * DAY} GROUP BY x.q
), burst AS (
  SELECT o.k, coalesce(linked_orders_24h, 0) AS linked_orders_24h, coalesce(same_sku_7d, 0) AS same_sku_7d, coalesce(recent_claims_30d, 0) AS recent_claims_30d,
         coalesce(burst_kinds, []::VARCHAR[]) AS burst_kinds, coalesce(burst_weight, 0.0::DOUBLE) AS burst_weight
  FROM o LEFT JOIN bu USING (k) LEFT JOIN cl30 USING (k)
)"""

_COSTS = """
, cx AS (
  SELECT o.k, o.c, o.t0, o.value, o.discount_pct, o.payment_method, h.* EXCLUDE (k, t0), ev.* EXCLUDE (k), burst.* EXCLUDE (k), clv.clv, o.n_items,
         (matured_returns + 2) / (matured + 10) AS return_rate_smoothed, CASE WHEN matured > 0 THEN matured_returns / matured END AS return_rate
  FROM o JOIN hist h USING (k) JOIN ev USING (k) JOIN clv USING (k) JOIN burst USING (k)
), sc AS (
  SELECT *, round(1 / (1 + exp(-(-3.5 + 2.5 * device_confirmed_weight + 0.2 * device_others_30d + 0.4 * token_others_30d + 1.1 * claims_180d + 1.2 * address_confirmed_weight + 0.000004 * value))), 6) AS p_abuse,
         round(1 / (1 + exp(-(-1.4 + 3.0 * return_rate_smoothed + 0.03 * discount_pct + 0.15 * returns_90d))), 6) AS p_return
  FROM cx
), sg AS (
  SELECT *, device_confirmed_weight >= 0.3 OR device_others_30d >= 3 AS s1, token_others_30d >= 2 AS s2, address_confirmed_weight >= 0.3 AND NOT address_multi_tenant AS s3,
         (linked_orders_24h >= 3 OR same_sku_7d >= 2) AND list_has_any(burst_kinds, ['DEVICE', 'PAYMENT_TOKEN']) AS s4, claims_180d >= 1 AS s5,
         address_confirmed_weight >= 0.3 AS seen3, linked_orders_24h >= 3 OR same_sku_7d >= 2 AS seen4
  FROM sc
), gd AS (
  SELECT *, s1::INT + s2::INT + s3::INT + s4::INT + s5::INT AS n_counted,
         (s1::INT + s2::INT + s3::INT + s4::INT + s5::INT) < 2 OR NOT (s1 OR s2 OR s5) AS g2, p_abuse < 0.70 AS g3,
         (s1 OR s2 OR s3 OR s4 OR s5) AND NOT ((s1 AND device_weight >= 0.3) OR (s2 AND token_weight >= 0.3) OR (s3 AND address_weight >= 0.3) OR (s4 AND burst_weight >= 0.3) OR s5) AS g4, p_abuse >= 0.40 AND value >= 10000 AS g5
  FROM sg
), co AS (
  SELECT *, round(p_abuse * (value * 0.85 + 150), 2) AS cost_allow,
         round(p_abuse * 0.7 * (value * 0.5 + 150) + (1 - p_abuse) * (0.08 * (0.3 * value) + 0.02 * clv + 30), 2) AS cost_prepaid_only,
         round(p_abuse * (1 - 0.8::DOUBLE) * (value * 0.85 + 150) + (1 - p_abuse) * (0.05 * (0.3 * value) + 0.03 * (0.3 * value + 0.6 * clv + 100)) + 250, 2) AS cost_manual_review,
         round((1 - p_abuse) * (0.3 * value + 0.6 * clv + 100), 2) AS cost_block
  FROM gd
), b AS (
  SELECT *, least(cost_allow, cost_prepaid_only, cost_manual_review, cost_block) AS best0, NOT (g2 OR g3 OR g4) AS may_block,
         least(CASE WHEN NOT g5 THEN cost_allow END, cost_prepaid_only, cost_manual_review, CASE WHEN NOT (g2 OR g3 OR g4) THEN cost_block END) AS best1
  FROM co
), dc AS (
  SELECT *, CASE WHEN cost_allow - best0 <= 1 THEN 'ALLOW' WHEN cost_prepaid_only - best0 <= 1 THEN 'PREPAID_ONLY' WHEN cost_manual_review - best0 <= 1 THEN 'MANUAL_REVIEW' ELSE 'BLOCK' END AS cost_optimal,
         CASE WHEN NOT g5 AND cost_allow - best1 <= 1 THEN 'ALLOW' WHEN cost_prepaid_only - best1 <= 1 THEN 'PREPAID_ONLY' WHEN cost_manual_review - best1 <= 1 THEN 'MANUAL_REVIEW' ELSE 'BLOCK' END AS action
  FROM b
)"""

DECISIONS = HISTORY + EVIDENCE + COMPONENT + _COSTS

_AS_OF = f"(SELECT max(t0) + {DAY} FROM o)"
_SEEN = ", ".join(f"CASE WHEN {c} < {_AS_OF} THEN {c} END AS {c}" for c in ("delivered", "returned", "claimed", "flagged", "resolved"))
LABELS = f"""
, seen AS (SELECT k, fraction, {_AS_OF} AS as_of, {_SEEN} FROM o
), lb0 AS (
  SELECT k, fraction, CASE WHEN delivered IS NULL OR NOT (delivered + {30 * DAY} < as_of) THEN NULL WHEN returned IS NOT NULL AND returned BETWEEN delivered AND delivered + {30 * DAY} THEN 1 ELSE 0 END AS return_label,
         CASE WHEN delivered IS NULL THEN 'NOT_MATURED' WHEN resolved BETWEEN delivered AND delivered + {60 * DAY} THEN CASE WHEN k % 2 = 0 THEN 'CONFIRMED' ELSE 'CLEARED' END
              WHEN NOT (delivered + {60 * DAY} < as_of) THEN 'NOT_MATURED'
              WHEN coalesce(claimed BETWEEN delivered AND delivered + {60 * DAY}, false) OR coalesce(flagged BETWEEN delivered AND delivered + {60 * DAY}, false) THEN 'UNRESOLVED' ELSE 'NO_CLAIM' END AS abuse_status
  FROM seen
), lb AS (
  SELECT k, return_label, CASE WHEN return_label = 1 THEN CASE WHEN k % 12 = 0 THEN 'EXCHANGE' WHEN fraction < 1 THEN 'PARTIAL' ELSE 'FULL' END WHEN return_label = 0 THEN 'NONE' END AS return_type,
         CASE WHEN return_label = 1 THEN fraction WHEN return_label = 0 THEN 0.0 END AS returned_fraction, abuse_status,
         CASE abuse_status WHEN 'CONFIRMED' THEN 1 WHEN 'CLEARED' THEN 0 WHEN 'NO_CLAIM' THEN 0 END AS abuse_label
  FROM lb0
), span AS (SELECT min(t0) AS lo, max(t0) AS hi FROM o
), sp AS (
  SELECT k, CASE WHEN (t0 - lo) / (hi - lo) < 0.45 THEN 'TRAIN' WHEN (t0 - lo) / (hi - lo) < 0.52 THEN 'GAP' WHEN (t0 - lo) / (hi - lo) < 0.63 THEN 'CALIBRATION'
                 WHEN (t0 - lo) / (hi - lo) < 0.7 THEN 'GAP' WHEN (t0 - lo) / (hi - lo) < 0.84 THEN 'TEST' ELSE 'RECENT' END AS split
  FROM o, span
)"""

FRAME = DECISIONS + LABELS + ", fr AS (SELECT * FROM dc JOIN lb USING (k) JOIN sp USING (k))"

#: Realised cost of an action by the true label.
_REAL = """round(CASE {a}
   WHEN 'ALLOW' THEN ab * (value * 0.85 + 150) * sh
   WHEN 'PREPAID_ONLY' THEN ab * 0.7 * (value * 0.5 + 150) * sh + (1 - ab) * (0.08 * (0.3 * value) + 0.02 * clv + 30)
   WHEN 'MANUAL_REVIEW' THEN ab * (1 - 0.8::DOUBLE) * (value * 0.85 + 150) * sh + (1 - ab) * (0.05 * (0.3 * value) + 0.03 * (0.3 * value + 0.6 * clv + 100)) + 250
   ELSE (1 - ab) * (0.3 * value + 0.6 * clv + 100) END, 4)"""
_KNOWN = ", kn AS (SELECT *, abuse_label::DOUBLE AS ab, CASE WHEN return_label = 1 THEN coalesce(returned_fraction, 1.0) ELSE 1.0 END AS sh FROM fr WHERE abuse_label IS NOT NULL)"

_EVENTS = "ev0 AS (SELECT event_id, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS cart, epoch_us(ts) AS t FROM events)"

ORACLES: dict[str, str] = {
    "order_value": WORLD + " SELECT k, value, n_items, discount_pct, payment_method, delivery_speed FROM o",
    "primary_category": WORLD + " SELECT k, arg_min(category, (-amount, category)) AS primary_category FROM (SELECT k, category, sum(amount) AS amount FROM ln GROUP BY ALL) GROUP BY k",
    "variants_same_product": WORLD + " SELECT k, max(n) AS n_variants FROM (SELECT k, product, count(DISTINCT variant) AS n FROM ln GROUP BY ALL) GROUP BY k",
    "account_history": HISTORY + " SELECT k, prior_orders, returns_90d, claims_180d, matured, matured_returns, round(account_age_days, 6) AS account_age_days FROM hist",
    "return_rates": HISTORY + " SELECT k, round((matured_returns + 2) / (matured + 10), 9) AS return_rate_smoothed, round(CASE WHEN matured > 0 THEN matured_returns / matured END, 9) AS return_rate FROM hist",
    "customer_value": HISTORY + " SELECT k, round(clv, 4) AS clv, CASE WHEN clv <= 2000 THEN 'NEW_CUSTOMER_FLOOR' WHEN clv >= 100000 THEN 'CAPPED' ELSE 'HISTORY' END AS basis FROM clv",
    "labels": WORLD + LABELS + " SELECT k, return_label, return_type, round(returned_fraction, 9) AS returned_fraction, abuse_status, abuse_label FROM lb",
    "splits": WORLD + LABELS + " SELECT * FROM sp",
    "links": WORLD + _QUERY_USES + _links("lk", "qu") + " SELECT q, kind, ident, other, first, last, sequential, multi_tenant, confirmed, round(weight, 9) AS weight FROM lk",
    "link_evidence": HISTORY + EVIDENCE + " SELECT k, device_others_30d, round(device_confirmed_weight, 9) AS device_confirmed_weight, round(device_weight, 9) AS device_weight, device_confirmed_peers, token_others_30d, round(token_weight, 9) AS token_weight, round(address_weighted_30d, 9) AS address_weighted_30d, round(address_confirmed_weight, 9) AS address_confirmed_weight, round(address_weight, 9) AS address_weight, high_fanout, address_multi_tenant FROM ev",
    "reuse_velocity": WORLD + f" SELECT o.k, (SELECT count(*) FROM uses q JOIN (SELECT kind, ident, c, min(t) AS first FROM uses GROUP BY ALL) f ON f.kind = q.kind AND f.ident = q.ident WHERE q.k = o.k AND first < o.t0 AND first >= o.t0 - {7 * DAY}) AS reuse_7d FROM o",
    "new_device": WORLD + " SELECT o.k, CASE WHEN f.first < o.t0 THEN 0 ELSE 1 END AS new_device FROM o JOIN (SELECT ident, c, min(t) AS first FROM uses WHERE kind = 'DEVICE' GROUP BY ALL) f ON f.ident = o.device_id AND f.c = o.c",
    "discounted_links": WORLD + _QUERY_USES + _links("lk", "qu") + f"""
      , g AS (SELECT q, kind, ident, count(*) AS n, max(weight) AS strongest, bool_or(confirmed) AS ac, bool_or(multi_tenant) AS m, count(CASE WHEN last >= t0 - {90 * DAY} THEN 1 END) + 1 > 25 AS fan,
                     max(CASE WHEN sequential THEN weight END) AS sq, max(CASE WHEN reliability >= 0.25 AND weight < 0.25 THEN weight END) AS st FROM lk GROUP BY q, kind, ident)
      , r AS (SELECT *, CASE WHEN kind = 'ADDRESS' AND fan THEN 'HIGH_FANOUT_IDENTIFIER' WHEN kind = 'ADDRESS' AND m THEN 'MULTI_TENANT_ADDRESS' WHEN kind = 'ADDRESS' AND n <= 3 AND NOT ac THEN 'HOUSEHOLD_PATTERN'
                             WHEN kind = 'DEVICE' AND sq IS NOT NULL THEN 'SEQUENTIAL_DEVICE_USE' WHEN st IS NOT NULL THEN 'STALE_RELATIONSHIP' END AS reason FROM g)
      SELECT q, kind, reason, round(CASE reason WHEN 'HIGH_FANOUT_IDENTIFIER' THEN 0.0 WHEN 'SEQUENTIAL_DEVICE_USE' THEN sq WHEN 'STALE_RELATIONSHIP' THEN st ELSE strongest END, 4) AS weight FROM r WHERE reason IS NOT NULL""",
    "component": WORLD + COMPONENT + """ SELECT q AS k, count(*) AS component_size, round((count(CASE WHEN bad THEN 1 END) + 1) / (count(*) + 10), 9) AS abuse_ratio,
      round(coalesce(1 / (1 + min(CASE WHEN bad AND depth <= 6 THEN depth END)), 0.0), 9) AS proximity
      FROM (SELECT x.*, account <> self AND coalesce(acc.confirmed < t0, false) AS bad FROM comp x LEFT JOIN acc ON acc.c = x.account) GROUP BY q""",
    "burst": WORLD + COMPONENT + " SELECT k, linked_orders_24h, same_sku_7d, recent_claims_30d, array_to_string(burst_kinds, ',') AS burst_kinds, round(burst_weight, 9) AS burst_weight FROM burst",
    "activity_metrics": DECISIONS + """ , ec AS (SELECT *, CASE WHEN (s1 AND device_weight >= 0.3) OR (s2 AND token_weight >= 0.3) OR (s3 AND address_weight >= 0.3) OR (s4 AND burst_weight >= 0.3) THEN 'STRONG' WHEN s1 OR s2 OR seen3 OR seen4 THEN 'WEAK_ONLY' ELSE 'NONE' END AS evidence,
        CASE action WHEN 'ALLOW' THEN cost_allow WHEN 'PREPAID_ONLY' THEN cost_prepaid_only WHEN 'MANUAL_REVIEW' THEN cost_manual_review ELSE cost_block END AS chosen FROM dc)
      SELECT count(*) AS decisions, count(CASE WHEN action = 'MANUAL_REVIEW' THEN 1 END) AS reviews, count(CASE WHEN action = 'BLOCK' THEN 1 END) AS blocks, round(CAST(sum(CAST(cost_allow - chosen AS DECIMAL(20,2))) AS DOUBLE), 2) AS expected_savings,
        count(CASE WHEN evidence = 'WEAK_ONLY' THEN 1 END) AS weak_only FROM ec""",
    "slope_check": """WITH grid AS (SELECT CASE WHEN i = 60 THEN 200000.0::DOUBLE ELSE 500.0 * pow(400.0::DOUBLE, i / 60) END AS value, CASE WHEN j = 60 THEN 100000.0::DOUBLE ELSE 2000.0 + 98000.0::DOUBLE * j / 60 END AS clv FROM range(61) a(i), range(61) b(j))
      , slopes AS (SELECT *, round(value * 0.85 + 150, 2) AS a1, 0 AS a0, round(0.7 * (value * 0.5 + 150), 2) AS p1, round(0.08::DOUBLE * (0.3::DOUBLE * value) + 0.02::DOUBLE * clv + 30, 2) AS p0,
               round((1 - 0.8::DOUBLE) * (value * 0.85 + 150) + 250, 2) AS m1, round(0.05::DOUBLE * (0.3::DOUBLE * value) + 0.03::DOUBLE * (0.3::DOUBLE * value + 0.6::DOUBLE * clv + 100) + 250, 2) AS m0, 0 AS b1, round(0.3::DOUBLE * value + 0.6::DOUBLE * clv + 100, 2) AS b0 FROM grid)
      , gap AS (SELECT unnest([{'pair': 'ALLOW>PREPAID_ONLY', 'gap': round((a1 - a0) - (p1 - p0), 2)}, {'pair': 'PREPAID_ONLY>MANUAL_REVIEW', 'gap': round((p1 - p0) - (m1 - m0), 2)}, {'pair': 'MANUAL_REVIEW>BLOCK', 'gap': round((m1 - m0) - (b1 - b0), 2)}]) AS x FROM slopes)
      SELECT x.pair AS pair, count(CASE WHEN x.gap < 0 THEN 1 END) AS violations, min(x.gap) AS least_gap FROM gap GROUP BY x.pair""",
    "idempotent_scoring": WORLD + """ , rq AS (SELECT k AS request_id, k, c, value FROM o UNION ALL SELECT k + 1000000000000, k, c, CASE WHEN k % 7 = 0 THEN value + 1 ELSE value END FROM o WHERE k % 5 = 0)
      , w AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY request_id) AS n, first_value(value) OVER (PARTITION BY k ORDER BY request_id) AS leader FROM rq)
      SELECT request_id, w.k, CASE WHEN w.k % 3 = 0 THEN CASE WHEN w.value = s.value THEN 'REPLAYED' ELSE 'CONFLICT' END WHEN n = 1 THEN 'CREATED' WHEN leader = w.value THEN 'REPLAYED' ELSE 'CONFLICT' END AS outcome FROM w JOIN o s ON s.k = w.k""",
    "scores": DECISIONS + " SELECT k, p_abuse, p_return FROM sc",
    "guardrails": DECISIONS + " SELECT k, n_counted, g2, g3, g4, g5 FROM gd",
    "action_costs": DECISIONS + " SELECT k, round(cost_allow, 1) AS cost_allow, round(cost_prepaid_only, 1) AS cost_prepaid_only, round(cost_manual_review, 1) AS cost_manual_review, round(cost_block, 1) AS cost_block FROM co",
    "decide": DECISIONS + " SELECT k, value, p_abuse, cost_optimal, action, CASE WHEN action = 'MANUAL_REVIEW' THEN 'PENDING_REVIEW' ELSE 'AUTO_APPLIED' END AS status FROM dc",
    "baselines": DECISIONS + """ SELECT k, CASE WHEN p_abuse >= 0.7 THEN 'BLOCK' WHEN p_abuse >= 0.4 THEN 'MANUAL_REVIEW' ELSE 'ALLOW' END AS fixed_threshold,
      CASE WHEN return_rate >= 0.5 AND matured_returns >= 5 THEN 'BLOCK' WHEN account_age_days < 30 AND value >= 15000 THEN 'MANUAL_REVIEW' WHEN payment_method = 'COD' AND value >= 5000 THEN 'PREPAID_ONLY' ELSE 'ALLOW' END AS rule_based, 'ALLOW' AS allow_all FROM sc""",
    "average_precision": FRAME + """ , s AS (SELECT p_abuse, count(*) AS n, sum(abuse_label) AS pos FROM fr WHERE abuse_label IS NOT NULL GROUP BY p_abuse)
      , c AS (SELECT n, pos, sum(pos) OVER w AS hits, sum(n) OVER w AS seen FROM s WINDOW w AS (ORDER BY p_abuse DESC ROWS UNBOUNDED PRECEDING))
      SELECT CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives, round(sum(pos * hits / seen) / sum(pos), 6) AS average_precision FROM c""",
    "brier": FRAME + " SELECT count(*) AS n, round(avg(pow(p_abuse - abuse_label, 2)), 6) AS brier FROM fr WHERE abuse_label IS NOT NULL",
    "reliability": FRAME + " SELECT bin, count(*) AS n, round(avg(p_abuse), 6) AS mean_p, round(avg(abuse_label), 6) AS rate FROM (SELECT *, ntile(10) OVER (ORDER BY p_abuse, t0, k) AS bin FROM fr WHERE abuse_label IS NOT NULL) GROUP BY bin",
    "calibration_error": FRAME + """ , r AS (SELECT bin, count(*) AS n, round(avg(p_abuse), 6) AS mean_p, round(avg(abuse_label), 6) AS rate FROM (SELECT *, ntile(10) OVER (ORDER BY p_abuse, t0, k) AS bin FROM fr WHERE abuse_label IS NOT NULL) GROUP BY bin)
      SELECT CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(mean_p - rate)) / sum(n), 5) AS ece FROM r""",
    "label_sensitivity": FRAME + """ , v AS (SELECT p_abuse, unnest([{'v': 'excluded', 'l': abuse_label}, {'v': 'as_0', 'l': CASE WHEN abuse_status = 'UNRESOLVED' THEN 0 ELSE abuse_label END}, {'v': 'as_1', 'l': CASE WHEN abuse_status = 'UNRESOLVED' THEN 1 ELSE abuse_label END}]) AS x FROM fr)
      , s AS (SELECT x.v AS variant, p_abuse, count(*) AS n, sum(x.l) AS pos FROM v WHERE x.l IS NOT NULL GROUP BY ALL)
      , c AS (SELECT variant, n, pos, sum(pos) OVER w AS hits, sum(n) OVER w AS seen FROM s WINDOW w AS (PARTITION BY variant ORDER BY p_abuse DESC ROWS UNBOUNDED PRECEDING))
      SELECT variant, CAST(sum(n) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS positives, round(sum(pos * hits / seen) / sum(pos), 6) AS average_precision FROM c GROUP BY variant""",
    "backtest": FRAME + _KNOWN + f"""
      , st AS (SELECT *, unnest([{{'s': 'POLICY', 'a': action}}, {{'s': 'FIXED_THRESHOLD', 'a': CASE WHEN p_abuse >= 0.7 THEN 'BLOCK' WHEN p_abuse >= 0.4 THEN 'MANUAL_REVIEW' ELSE 'ALLOW' END}},
          {{'s': 'RULE_BASED', 'a': CASE WHEN return_rate >= 0.5 AND matured_returns >= 5 THEN 'BLOCK' WHEN account_age_days < 30 AND value >= 15000 THEN 'MANUAL_REVIEW' WHEN payment_method = 'COD' AND value >= 5000 THEN 'PREPAID_ONLY' ELSE 'ALLOW' END}},
          {{'s': 'ALLOW_ALL', 'a': 'ALLOW'}}]) AS x FROM kn)
      , pr AS (SELECT *, x.s AS strategy, x.a AS chosen, {_REAL.format(a='x.a')} AS cost, {_REAL.format(a="'ALLOW'")} AS allowed,
        CASE WHEN ab = 1 THEN CASE x.a WHEN 'BLOCK' THEN 1.0 WHEN 'MANUAL_REVIEW' THEN 0.8 WHEN 'PREPAID_ONLY' THEN 0.3 ELSE 0 END END AS caught FROM st)
      SELECT strategy, count(*) AS n, round(CAST(sum(CAST(cost AS DECIMAL(20,4))) AS DOUBLE) / count(*) * 1000, 2) AS cost_per_1000,
        round(CAST(sum(CASE WHEN ab = 1 THEN CAST(allowed - cost AS DECIMAL(20,4)) ELSE 0 END) AS DOUBLE), 1) AS loss_prevented, round(CAST(sum(CAST(cost AS DECIMAL(20,4))) AS DOUBLE) / nullif(CAST(sum(caught) AS DOUBLE), 0), 2) AS cost_per_detected,
        round(CAST(sum(CASE WHEN ab = 0 AND chosen <> 'BLOCK' THEN CAST(value AS DECIMAL(20,2)) ELSE 0 END) AS DOUBLE) / CAST(sum(CASE WHEN ab = 0 THEN CAST(value AS DECIMAL(20,2)) ELSE 0 END) AS DOUBLE), 6) AS revenue_preserved,
        round(count(CASE WHEN ab = 0 AND chosen = 'BLOCK' THEN 1 END) / count(CASE WHEN ab = 0 THEN 1 END), 6) AS genuine_block_rate,
        round(count(CASE WHEN ab = 0 AND chosen <> 'ALLOW' THEN 1 END) / count(CASE WHEN ab = 0 THEN 1 END), 6) AS friction_rate, round(count(CASE WHEN chosen = 'MANUAL_REVIEW' THEN 1 END) / count(*) * 1000, 4) AS reviews_per_1000,
        round(count(CASE WHEN ab = 1 AND chosen = 'BLOCK' THEN 1 END) / nullif(count(CASE WHEN chosen = 'BLOCK' THEN 1 END), 0), 6) AS block_precision,
        round(sum(caught) / count(CASE WHEN ab = 1 THEN 1 END), 6) AS expected_recall
      FROM pr GROUP BY strategy""",
    "tune_thresholds": FRAME + _KNOWN + f""" , cells AS (SELECT least(CAST(floor(p_abuse * 20 + 1e-9) AS INT), 19) AS cell, sum(CAST({_REAL.format(a="'ALLOW'")} AS DECIMAL(20,4))) AS allow, sum(CAST({_REAL.format(a="'MANUAL_REVIEW'")} AS DECIMAL(20,4))) AS review, sum(CAST({_REAL.format(a="'BLOCK'")} AS DECIMAL(20,4))) AS block
        FROM kn WHERE split = 'CALIBRATION' GROUP BY 1)
      , pr AS (SELECT b, r, sum(CASE WHEN b < 20 AND cell >= b THEN block WHEN r < 20 AND cell >= r THEN review ELSE allow END) AS cost FROM range(1, 21) x(b), range(1, 21) z(r), cells WHERE r <= b GROUP BY b, r)
      SELECT b / 20 AS tau_block, r / 20 AS tau_review, round(CAST(cost AS DOUBLE), 2) AS cost FROM pr ORDER BY pr.cost, b DESC, r DESC LIMIT 1""",
    "action_distribution": FRAME + " SELECT split, count(CASE WHEN action = 'ALLOW' THEN 1 END) AS n_allow, count(CASE WHEN action = 'PREPAID_ONLY' THEN 1 END) AS n_prepaid_only, count(CASE WHEN action = 'MANUAL_REVIEW' THEN 1 END) AS n_manual_review, count(CASE WHEN action = 'BLOCK' THEN 1 END) AS n_block FROM fr GROUP BY split",
    "label_counts": FRAME + " SELECT split, abuse_status, count(*) AS n, count(abuse_label) AS labelled FROM fr GROUP BY ALL",
    "risk_bands": FRAME + """ , bands(band, lo, hi) AS (VALUES (0, 0.0, 0.05), (1, 0.05, 0.15), (2, 0.15, 0.3), (3, 0.3, 0.5), (4, 0.5, 0.7), (5, 0.7, 1.01))
      , g AS (SELECT band, count(abuse_label) AS n, sum(abuse_label) AS positives FROM bands LEFT JOIN fr ON p_abuse >= lo AND p_abuse < hi AND abuse_label IS NOT NULL GROUP BY band)
      SELECT CAST(band AS INT) AS band, n, CAST(positives AS BIGINT) AS positives, round(positives / nullif(n, 0), 6) AS rate,
        round(greatest((positives / n + 3.8414588206941236 / (2 * n)) / (1 + 3.8414588206941236 / n) - 1.959963984540054 / (1 + 3.8414588206941236 / n) * sqrt(positives / n * (1 - positives / n) / n + 3.8414588206941236 / (4 * n * n)), 0.0), 6) AS low,
        round(least((positives / n + 3.8414588206941236 / (2 * n)) / (1 + 3.8414588206941236 / n) + 1.959963984540054 / (1 + 3.8414588206941236 / n) * sqrt(positives / n * (1 - positives / n) / n + 3.8414588206941236 / (4 * n * n)), 1.0), 6) AS high FROM g""",
    "cohorts": FRAME + """ , x AS (SELECT action, p_abuse, unnest([{'f': 'account_age', 'c': CASE WHEN account_age_days < 30 THEN '<30' WHEN account_age_days <= 365 THEN '30-365' ELSE '>365' END}, {'f': 'value', 'c': CASE WHEN value < 2000 THEN '<2k' WHEN value <= 10000 THEN '2-10k' ELSE '>10k' END},
        {'f': 'payment', 'c': CASE WHEN payment_method = 'COD' THEN 'COD' ELSE 'PREPAID' END}, {'f': 'multi_tenant', 'c': CASE WHEN address_multi_tenant THEN 'yes' ELSE 'no' END}]) AS z FROM fr)
      SELECT z.f AS family, z.c AS cohort, count(*) AS n, round(avg((action <> 'ALLOW')::INT), 6) AS friction_rate, round(CAST(sum(CAST(p_abuse AS DECIMAL(10,6))) AS DOUBLE) / count(*), 5) AS mean_p FROM x GROUP BY ALL""",
    "guardrail_price": FRAME + _KNOWN + f""" , g AS (SELECT *, {_REAL.format(a='action')} - {_REAL.format(a='cost_optimal')} AS extra FROM kn WHERE action <> cost_optimal)
      , u AS (SELECT 'G2' AS guardrail, extra FROM g WHERE g2 AND cost_optimal = 'BLOCK' UNION ALL SELECT 'G3', extra FROM g WHERE g3 AND cost_optimal = 'BLOCK' UNION ALL SELECT 'G4', extra FROM g WHERE g4 AND cost_optimal = 'BLOCK' UNION ALL SELECT 'G5', extra FROM g WHERE g5 AND cost_optimal = 'ALLOW')
      SELECT guardrail, count(*) AS n, round(CAST(sum(CAST(extra AS DECIMAL(20,4))) AS DOUBLE), 1) AS extra_cost FROM u GROUP BY guardrail""",
    "queue": DECISIONS + " SELECT k, t0, value, p_abuse, action FROM dc WHERE action <> 'ALLOW' ORDER BY p_abuse DESC, k LIMIT 50",
    "queue_counts": DECISIONS + " SELECT action, count(*) AS n FROM dc GROUP BY action",
    "checkout": DECISIONS + " SELECT k, CASE action WHEN 'PREPAID_ONLY' THEN 'PREPAID_REQUIRED' WHEN 'BLOCK' THEN 'DECLINED' ELSE 'CONFIRMED' END AS outcome FROM dc",
    "attempt_log": f"""WITH {_EVENTS} SELECT a.event_id, count(DISTINCT CASE WHEN b.t < a.t THEN b.event_id END) + 1 AS attempts_24h, count(DISTINCT CASE WHEN b.t < a.t AND b.cart <> a.cart THEN b.cart END) + 1 AS carts_24h
      FROM ev0 a LEFT JOIN ev0 b ON b.user_id = a.user_id AND b.t < a.t AND b.t >= a.t - {DAY} GROUP BY a.event_id""",
    "as_of_snapshot": WORLD + f" , cl AS (SELECT (min(t0) + max(t0)) // 2 AS clock FROM o) SELECT k, c, t0, value, CASE WHEN delivered < clock THEN delivered END AS delivered, CASE WHEN returned < clock THEN returned END AS returned, CASE WHEN claimed < clock THEN claimed END AS claimed, CASE WHEN flagged < clock THEN flagged END AS flagged, CASE WHEN resolved < clock THEN resolved END AS resolved FROM o, cl WHERE t0 < clock",
    "world_validation": "SELECT * FROM (VALUES ('duplicate_order', 0), ('account_after_order', 0), ('event_before_order', 0), ('token_iff_prepaid', 0)) AS t(rule, violations)",
    "chain_verify": DECISIONS + " SELECT count(*) AS rows_checked, 0 AS broken, CAST(NULL AS BIGINT) AS first_broken_seq FROM dc",
    "placeholders": r"""SELECT c_custkey, lower(c_mktsegment) IN ('unknown', 'none', 'test') OR regexp_full_match(CAST(c_custkey % 10 AS VARCHAR), '0+') AS placeholder FROM customer""",
    "current_actions": DECISIONS + " SELECT k, action, CASE WHEN k % 101 = 0 THEN 'ALLOW' WHEN k % 103 = 0 AND action <> 'BLOCK' THEN 'MANUAL_REVIEW' ELSE action END AS current_action FROM dc",
}

_TRUTH = ", tr AS (SELECT c, CASE WHEN c % 10 = 9 THEN 'SHARED_HOUSE' WHEN c % 16 IN (4, 5, 6, 7) THEN 'RING' ELSE 'NORMAL' END AS archetype, CASE WHEN c % 10 <> 9 AND c % 16 IN (4, 5, 6, 7) THEN 'R' || ((c // 16) % 5) END AS ring FROM acc), ft AS (SELECT fr.*, archetype, ring FROM fr JOIN tr USING (c))"
_MIDDLE = "(SELECT (min(t0) + max(t0)) // 2 FROM o)"


def _summary(by: str, source: str) -> str:
    return f""" , s AS (SELECT {by}, p_abuse, count(*) AS n, sum(abuse_label) AS pos FROM {source} WHERE abuse_label IS NOT NULL GROUP BY ALL)
      , st AS (SELECT *, sum(pos) OVER w AS hits, sum(n) OVER w AS seen FROM s WINDOW w AS (PARTITION BY {by} ORDER BY p_abuse DESC ROWS UNBOUNDED PRECEDING))
      , ap AS (SELECT {by}, round(sum(pos * hits / seen) / nullif(sum(pos), 0), 6) AS average_precision FROM st GROUP BY {by})
      , fg AS (SELECT {by}, count(*) AS n, CAST(sum(abuse_label) AS BIGINT) AS positives, round(sum(abuse_label) / count(*), 6) AS prevalence, round(avg(pow(p_abuse - abuse_label, 2)), 6) AS brier FROM {source} WHERE abuse_label IS NOT NULL GROUP BY {by})
      SELECT * FROM fg JOIN ap USING ({by})"""


_DISCOUNTED = """ , nd AS (SELECT q AS k, count(*) AS n_discounted FROM (
        SELECT q, kind, ident, count(*) AS n, bool_or(confirmed) AS ac, bool_or(multi_tenant) AS m, count(CASE WHEN last >= t0 - 7776000000000 THEN 1 END) + 1 > 25 AS fan, max(CASE WHEN sequential THEN weight END) AS sq, max(CASE WHEN reliability >= 0.25 AND weight < 0.25 THEN weight END) AS st FROM lk GROUP BY q, kind, ident)
        WHERE (kind = 'ADDRESS' AND (fan OR m OR (n <= 3 AND NOT ac))) OR (kind = 'DEVICE' AND sq IS NOT NULL) OR st IS NOT NULL GROUP BY q)
      , cf AS (SELECT q AS k, count(*) AS component_size, count(CASE WHEN bad THEN 1 END) AS n_bad, min(CASE WHEN bad AND depth <= 6 THEN depth END) AS hops FROM (SELECT x.*, account <> self AND coalesce(acc.confirmed < t0, false) AS bad FROM comp x LEFT JOIN acc ON acc.c = x.account) GROUP BY q)
      , va AS (SELECT k, max(n) AS n_variants FROM (SELECT k, product, count(DISTINCT variant) AS n FROM ln GROUP BY ALL) GROUP BY k)
      , ex AS (SELECT dc.*, coalesce(n_discounted, 0) AS n_discounted, component_size, n_bad, hops, n_variants, (n_bad + 1) / (component_size + 10) AS abuse_ratio FROM dc JOIN cf USING (k) LEFT JOIN nd USING (k) LEFT JOIN va USING (k))"""
_PL = lambda n, one, many: f"CASE WHEN {n} = 1 THEN '{one}' ELSE '{many}' END"

def _eventful(sql: str) -> str:
    """The SQL of a log in which orders are delivered and resolved once more: the latest delivery before an order counts, and the first confirmation."""
    later = f"(CASE WHEN b.k % 5 = 0 AND b.delivered + {35 * DAY} < a.t0 THEN b.delivered + {35 * DAY} ELSE b.delivered END)"
    sql = sql.replace("b.delivered +", f"{later} +")
    return sql.replace("CASE WHEN k % 2 = 0 THEN resolved END AS confirmed", f"CASE WHEN k % 2 = 0 THEN resolved WHEN k % 3 = 0 THEN resolved + {5 * DAY} END AS confirmed")


ORACLES |= {
    "event_labels": WORLD + LABELS + " SELECT 'ORD-' || k AS order_id, return_label, return_type, round(returned_fraction, 9) AS returned_fraction, abuse_status, abuse_label FROM lb",
    "log_violations": "SELECT rule, 0 AS violations FROM (VALUES ('duplicate_accounts'), ('duplicate_identifiers'), ('duplicate_orders'), ('duplicate_order_lines'), ('duplicate_order_events'), ('order_before_account'), ('order_without_account'), ('event_before_order'), ('event_without_order'), ('line_without_order'), ('token_iff_prepaid')) AS t(rule)",
    "log_snapshot": WORLD + f""" , m AS (SELECT {_MIDDLE} AS clock)
      SELECT 'accounts' AS table, (SELECT count(*) FROM acc, m WHERE created < clock) AS rows UNION ALL SELECT 'identifiers', (SELECT count(DISTINCT ident) FROM uses) UNION ALL SELECT 'orders', (SELECT count(*) FROM o, m WHERE t0 < clock)
      UNION ALL SELECT 'order_lines', (SELECT count(*) FROM ln JOIN o USING (k), m WHERE t0 < clock) UNION ALL SELECT 'order_events', (SELECT count(CASE WHEN delivered < clock THEN 1 END) + count(CASE WHEN returned < clock THEN 1 END) + count(CASE WHEN claimed < clock THEN 1 END) + count(CASE WHEN flagged < clock THEN 1 END) + count(CASE WHEN resolved < clock THEN 1 END) FROM o, m)""",
    "log_fingerprint": WORLD + " , p AS (SELECT CAST(CAST('0x' || substr(sha256('ACC-' || c || '|' || created), 1, 15) AS BIGINT) AS HUGEINT) AS v FROM acc) SELECT count(*) AS rows, sha256(count(*) || ':' || CAST(sum(v) AS VARCHAR)) AS fingerprint FROM p",
    "latest_identifiers": WORLD + f" , b AS (SELECT *, 'ORD-' || k AS oid FROM o WHERE t0 < {_MIDDLE}) SELECT 'ACC-' || c AS account_id, arg_max(device_id, (t0, oid)) AS device_id, arg_max(address_id, (t0, oid)) AS address_id, arg_max(token_id, (t0, oid)) FILTER (WHERE token_id IS NOT NULL) AS payment_token_id FROM b GROUP BY c",
    "new_accounts": WORLD + f" SELECT 'ACC-' || c AS account_id FROM acc WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.c = acc.c AND o.t0 < {_MIDDLE})",
    "log_decide": DECISIONS + " SELECT 'ORD-' || k AS k, value, p_abuse, action FROM dc",
    "numbered_events": WORLD + """, oe AS (SELECT 'ORD-' || k AS order_id, unnest([{'e': 'DELIVERED', 't': delivered}, {'e': CASE WHEN k % 12 = 0 THEN 'EXCHANGE_REQUESTED' ELSE 'RETURN_REQUESTED' END, 't': returned}, {'e': 'CLAIM_FILED', 't': claimed}, {'e': 'QC_FLAGGED', 't': flagged},
        {'e': CASE WHEN confirmed IS NOT NULL THEN 'ABUSE_CONFIRMED' ELSE 'ABUSE_CLEARED' END, 't': resolved}]) AS x FROM o)
      SELECT row_number() OVER (ORDER BY x.t, order_id, x.e) AS event_id, order_id, x.e AS event_type FROM oe WHERE x.t IS NOT NULL""",
    "consistency": WORLD + """ SELECT * FROM (SELECT 'value' AS column, count(CASE WHEN k % 31 = 0 THEN 1 END) AS mismatches FROM o UNION ALL SELECT 'payment_method', count(CASE WHEN k % 37 = 0 THEN 1 END) FROM o UNION ALL SELECT 'n_items', 0 FROM (SELECT 1) UNION ALL SELECT 'token_id', 0 FROM (SELECT 1))""",
    "joined_once": WORLD + " SELECT k, value, primary_category FROM o JOIN (SELECT k, arg_min(category, (-amount, category)) AS primary_category FROM (SELECT k, category, sum(amount) AS amount FROM ln GROUP BY ALL) GROUP BY k) USING (k)",
    "audit_page": WORLD + " SELECT k * 2 + 1 AS seq, k, 'OVERRIDE_APPLIED' AS event_type, 'changed ' || k AS payload, (SELECT count(*) FROM o WHERE k % 40 = 0) AS total FROM o WHERE k % 40 = 0 ORDER BY k DESC LIMIT 10 OFFSET 10",
    "records_read_back": WORLD + " SELECT k, value, CASE WHEN k % 5 <> 0 THEN 'made ' || k END AS record, CASE WHEN k % 5 <> 0 THEN k * 2 END AS created_seq FROM o WHERE k % 3 = 0",
    "provenance": WORLD + LABELS + " , p AS (SELECT CAST(CAST('0x' || substr(sha256(CAST(k AS VARCHAR)), 1, 15) AS BIGINT) AS HUGEINT) AS v FROM lb WHERE abuse_label IS NOT NULL) SELECT count(*) AS rows, sha256(count(*) || ':' || CAST(sum(v) AS VARCHAR)) AS fingerprint FROM p",
    "slope_orders": HISTORY + """, gr AS (SELECT o.value, least(greatest(clv, 2000.0), 100000.0) AS clv FROM clv JOIN o USING (k))
      , slopes AS (SELECT *, round(value * 0.85 + 150, 2) AS a1, 0 AS a0, round(0.7 * (value * 0.5 + 150), 2) AS p1, round(0.08::DOUBLE * (0.3::DOUBLE * value) + 0.02::DOUBLE * clv + 30, 2) AS p0,
               round((1 - 0.8::DOUBLE) * (value * 0.85 + 150) + 250, 2) AS m1, round(0.05::DOUBLE * (0.3::DOUBLE * value) + 0.03::DOUBLE * (0.3::DOUBLE * value + 0.6::DOUBLE * clv + 100) + 250, 2) AS m0, 0 AS b1, round(0.3::DOUBLE * value + 0.6::DOUBLE * clv + 100, 2) AS b0 FROM gr)
      , gap AS (SELECT unnest([{'pair': 'ALLOW>PREPAID_ONLY', 'gap': round((a1 - a0) - (p1 - p0), 2)}, {'pair': 'PREPAID_ONLY>MANUAL_REVIEW', 'gap': round((p1 - p0) - (m1 - m0), 2)}, {'pair': 'MANUAL_REVIEW>BLOCK', 'gap': round((m1 - m0) - (b1 - b0), 2)}]) AS x FROM slopes)
      SELECT x.pair AS pair, count(*) AS orders, count(CASE WHEN x.gap < 0 THEN 1 END) AS violations FROM gap GROUP BY x.pair""",
    "activity_rates": WORLD + """ SELECT count(*) AS decisions, round(count(CASE WHEN k % 7 = 0 THEN 1 END) / count(*), 6) AS override_rate, round(count(CASE WHEN k % 10 <> 0 THEN 1 END) / count(*), 6) AS explanation_coverage,
      round(count(CASE WHEN k % 13 <> 0 AND k % 17 <> 0 THEN 1 END) / count(*), 6) AS version_traceability FROM o""",
    "chain_columns": DECISIONS + " SELECT * FROM (SELECT 'value' AS column, count(CASE WHEN k % 97 = 0 THEN 1 END) AS n FROM dc UNION ALL SELECT 'action', count(CASE WHEN k % 89 = 0 THEN 1 END) FROM dc) WHERE n > 0",
    "log_history": _eventful(HISTORY + LABELS) + " SELECT k, prior_orders, returns_90d, claims_180d, matured, matured_returns, round(account_age_days, 6) AS account_age_days, round(clv, 4) AS clv, return_label, abuse_status FROM hist JOIN clv USING (k) JOIN lb USING (k)",
    "log_backtest": _eventful(ORACLES["backtest"]),
    "log_splits": WORLD + f""" , dy AS (SELECT (t0 - (SELECT min(t0) // {DAY} * {DAY} FROM o)) // {DAY} + 1 AS day FROM o)
      SELECT CASE WHEN day <= 200 THEN 'TRAIN' WHEN day <= 230 THEN 'GAP' WHEN day <= 275 THEN 'CALIBRATION' WHEN day <= 305 THEN 'GAP' WHEN day <= 365 THEN 'TEST' ELSE 'RECENT' END AS split, count(*) AS n FROM dy GROUP BY 1""",
    "reason_texts": DECISIONS + _DISCOUNTED + f""" , rs AS (SELECT k, action, cost_optimal, n_discounted, account_age_days, prior_orders, claims_180d, list_filter([
          CASE WHEN device_confirmed_weight >= 0.3 THEN {{'c': 'GRAPH_DEVICE_CONFIRMED_LINK', 't': device_confirmed_peers || ' ' || {_PL('device_confirmed_peers', 'account', 'accounts')} || ' with confirmed abuse used the same device before.'}} END,
          CASE WHEN token_others_30d >= 2 THEN {{'c': 'GRAPH_TOKEN_REUSE', 't': token_others_30d || ' other ' || {_PL('token_others_30d', 'account', 'accounts')} || ' paid with the same method within 30 days.'}} END,
          CASE WHEN abuse_ratio >= 0.25 AND component_size >= 4 THEN {{'c': 'GRAPH_COMMUNITY_RISK', 't': 'The account is linked to ' || component_size || ' ' || {_PL('component_size', 'account', 'accounts')} || ', ' || n_bad || ' with confirmed abuse.'}} END,
          CASE WHEN device_others_30d >= 3 THEN {{'c': 'GRAPH_DEVICE_SHARED', 't': 'In the last 30 days this device also served ' || device_others_30d || ' more ' || {_PL('device_others_30d', 'account', 'accounts')} || '.'}} END,
          CASE WHEN linked_orders_24h >= 3 THEN {{'c': 'TEMPORAL_BURST', 't': linked_orders_24h || ' ' || {_PL('linked_orders_24h', 'order', 'orders')} || ' of linked accounts within 24 hours.'}} END,
          CASE WHEN same_sku_7d >= 2 THEN {{'c': 'SAME_SKU_COORDINATION', 't': same_sku_7d || ' ' || {_PL('same_sku_7d', 'order', 'orders')} || ' of linked accounts for the same item within a week.'}} END,
          CASE WHEN claims_180d >= 1 THEN {{'c': 'ACCOUNT_PRIOR_SUSPICIOUS_CLAIM', 't': claims_180d || ' ' || {_PL('claims_180d', 'claim', 'claims')} || ' of the account ' || {_PL('claims_180d', 'was', 'were')} || ' flagged within 180 days.'}} END,
          CASE WHEN n_variants >= 2 THEN {{'c': 'RETURN_SIZE_BRACKETING', 't': n_variants || ' variants of one product are in the order.'}} END,
          CASE WHEN return_rate_smoothed >= 0.4 THEN {{'c': 'RETURN_HIGH_HISTORY', 't': matured_returns || ' of ' || matured || ' delivered ' || {_PL('matured', 'order', 'orders')} || ' came back.'}} END,
          CASE WHEN account_age_days < 30 AND value >= 10000 THEN {{'c': 'NEW_ACCOUNT_HIGH_VALUE', 't': 'The account is new and the order is large.'}} END], lambda x: x IS NOT NULL) AS r FROM ex)
      SELECT k, array_to_string(list_transform(r, lambda x: x.c), ',') AS reasons, array_to_string(list_transform(r, lambda x: x.t), ' ') AS text,
        concat_ws(',', CASE WHEN account_age_days >= 365 AND prior_orders >= 10 AND claims_180d = 0 THEN 'MITIGATING_ESTABLISHED_ACCOUNT' END, CASE WHEN n_discounted >= 1 THEN 'MITIGATING_DISCOUNTED_LINKS' END) AS mitigating,
        CASE WHEN action = cost_optimal THEN 'MIN_EXPECTED_COST' ELSE 'MIN_EXPECTED_COST_WITHIN_GUARDRAILS' END AS rule FROM rs""",
    "cost_rows": DECISIONS + """ , u AS (SELECT k, unnest([{'action': 'ALLOW', 's': 0, 't': cost_allow, 'e': CASE WHEN g5 THEN 'G5' ELSE '' END}, {'action': 'PREPAID_ONLY', 's': 1, 't': cost_prepaid_only, 'e': ''}, {'action': 'MANUAL_REVIEW', 's': 2, 't': cost_manual_review, 'e': ''},
        {'action': 'BLOCK', 's': 3, 't': cost_block, 'e': concat_ws(',', CASE WHEN g2 THEN 'G2' END, CASE WHEN g3 THEN 'G3' END, CASE WHEN g4 THEN 'G4' END)}]) AS x FROM dc)
      SELECT k, x.action AS action, x.e = '' AS feasible, x.e AS excluded_by, CAST(row_number() OVER (PARTITION BY k ORDER BY x.t, x.s) AS INT) AS rank FROM u""",
    "risk_summary": DECISIONS + _DISCOUNTED + """ , z AS (SELECT *, concat_ws(', ', CASE WHEN s1 THEN 'device' END, CASE WHEN s2 THEN 'payment token' END, CASE WHEN s3 THEN 'address' END, CASE WHEN s4 THEN 'temporal burst' END) AS kinds FROM ex)
      SELECT k, CASE WHEN n_bad > 0 THEN 'Linked to ' || component_size || CASE WHEN component_size = 1 THEN ' account' ELSE ' accounts' END || ', ' || n_bad || ' with confirmed abuse' WHEN kinds <> '' THEN 'Relationship evidence: ' || kinds WHEN n_discounted > 0 THEN 'Shared identifiers count less' ELSE 'No relationship evidence' END AS summary FROM z""",
    "graph_summary": DECISIONS + _DISCOUNTED + " SELECT k, component_size, n_bad AS confirmed_accounts, CAST(hops AS INT) AS hops, NOT ((s1 AND device_weight >= 0.3) OR (s2 AND token_weight >= 0.3) OR (s3 AND address_weight >= 0.3) OR (s4 AND burst_weight >= 0.3)) AND (s1 OR s2 OR seen3 OR seen4) AS weak_evidence_only FROM ex",
    "order_detail": DECISIONS + """ SELECT k, value, action, CASE WHEN p_abuse >= 0.7 THEN 'BLOCK' WHEN p_abuse >= 0.4 THEN 'MANUAL_REVIEW' ELSE 'ALLOW' END AS fixed_threshold,
      CASE WHEN return_rate >= 0.5 AND matured_returns >= 5 THEN 'BLOCK' WHEN account_age_days < 30 AND value >= 15000 THEN 'MANUAL_REVIEW' WHEN payment_method = 'COD' AND value >= 5000 THEN 'PREPAID_ONLY' ELSE 'ALLOW' END AS rule_based,
      (SELECT count(*) FROM ln WHERE ln.k = dc.k) AS n_lines, prior_orders AS earlier_orders, (SELECT count(*) FROM o p WHERE p.c = dc.c AND p.returned < dc.t0) AS earlier_returns,
      (SELECT max(t) FROM (SELECT c, t0 AS t FROM o UNION ALL SELECT c, delivered FROM o UNION ALL SELECT c, returned FROM o UNION ALL SELECT c, claimed FROM o UNION ALL SELECT c, flagged FROM o UNION ALL SELECT c, resolved FROM o) p WHERE p.c = dc.c AND p.t < dc.t0) AS last_seen FROM dc WHERE k % 100 = 0""",
    "account_past": WORLD + """ , al AS (SELECT c, k, 'ORDER' AS what, t0 AS t FROM o UNION ALL SELECT c, k, 'DELIVERED', delivered FROM o UNION ALL SELECT c, k, 'RETURNED', returned FROM o UNION ALL SELECT c, k, 'CLAIM_FILED', claimed FROM o UNION ALL SELECT c, k, 'QC_FLAGGED', flagged FROM o UNION ALL SELECT c, k, 'RESOLVED', resolved FROM o)
      SELECT o.k, al.what, al.k AS of, al.t FROM o JOIN al ON al.c = o.c AND al.t < o.t0 WHERE o.k % 100 = 0""",
    "decision_failures": WORLD + " SELECT count(*) AS n, 0 AS failed, 0 AS bad_inputs FROM o",
    "admission": WORLD + f" , r AS (SELECT CASE WHEN t0 > {_MIDDLE} + {100 * DAY} THEN 'FUTURE' WHEN k % 7 = 0 THEN 'UNKNOWN_ACCOUNT' WHEN t0 <= {_MIDDLE} THEN 'TOO_OLD' END AS rejected FROM o) SELECT rejected, count(*) AS n FROM r GROUP BY rejected",
    "requests": WORLD + """ , g AS (SELECT k, bool_and(amount / qty > 0 AND amount / qty <= 500000) AS price, bool_and(qty BETWEEN 1 AND 20) AS quantity, count(*) BETWEEN 1 AND 50 AS n FROM ln GROUP BY k)
      SELECT 'ORD-' || o.k AS order_id, concat_ws(',', CASE WHEN length(o.k::VARCHAR) < 3 THEN 'order_id' END, CASE WHEN length(o.c::VARCHAR) < 3 THEN 'account_id' END, CASE WHEN NOT n THEN 'line_count' END, CASE WHEN NOT price THEN 'price' END, CASE WHEN NOT quantity THEN 'quantity' END) AS failed FROM o JOIN g ON g.k = o.k""",
    "override_outcomes": DECISIONS + """ , f AS (SELECT k, action, g2, NOT g2 OR k % 100 = 0 AS ok FROM dc WHERE k % 50 = 0)
      SELECT k * 2 AS seq, k, CASE WHEN ok THEN 'APPLIED' ELSE 'REJECTED' END AS outcome, CASE WHEN g2 AND k % 100 = 0 THEN 'G2' END AS warning, action AS previous_action FROM f
      UNION ALL SELECT k * 2 + 1, k, CASE WHEN ok OR action = 'BLOCK' THEN 'APPLIED' ELSE 'CONFLICT' END, NULL, CASE WHEN ok THEN 'BLOCK' ELSE action END FROM f""",
    "appeals": WORLD + """ , a AS (SELECT k AS seq, k // 20 AS k, row_number() OVER (PARTITION BY k // 20 ORDER BY k) AS n FROM o WHERE k % 10 = 0)
      SELECT seq, k, CASE WHEN n = 1 THEN 'OPENED' ELSE 'CONFLICT' END AS outcome, CASE WHEN n = 1 THEN 'APL-2026-' || lpad(CAST(row_number() OVER (PARTITION BY n = 1 ORDER BY seq) AS VARCHAR), 6, '0') END AS reference FROM a""",
    "seeded": DECISIONS + " SELECT least(count(*), 250) AS n, least(count(CASE WHEN action <> 'ALLOW' THEN 1 END), 250) AS flagged FROM dc",
    "summary_by_split": FRAME + _summary("split", "fr"),
    "equal_width_error": FRAME + """ , eb AS (SELECT split, least(CAST(floor((p_abuse - 0.05::DOUBLE) / ((1 - 0.05::DOUBLE) / 10)) AS BIGINT), 9) AS bin, count(*) AS n, avg(p_abuse) AS p, avg(abuse_label) AS rate FROM fr WHERE abuse_label IS NOT NULL AND p_abuse >= 0.05 GROUP BY 1, 2)
      SELECT split, CAST(sum(n) AS BIGINT) AS n, round(sum(n * abs(p - rate)) / sum(n), 5) AS error FROM eb GROUP BY split""",
    "bands_by_split": FRAME + """ , bands(band, lo, hi) AS (VALUES (0, 0.0, 0.05), (1, 0.05, 0.15), (2, 0.15, 0.3), (3, 0.3, 0.5), (4, 0.5, 0.7), (5, 0.7, 1.01)), sps(split) AS (VALUES ('CALIBRATION'), ('TEST'))
      SELECT sps.split, CAST(band AS INT) AS band, count(abuse_label) AS n, CAST(sum(abuse_label) AS BIGINT) AS positives, round(sum(abuse_label) / nullif(count(abuse_label), 0), 6) AS rate
      FROM bands CROSS JOIN sps LEFT JOIN fr ON fr.split = sps.split AND p_abuse >= lo AND p_abuse < hi AND abuse_label IS NOT NULL GROUP BY ALL""",
    "cohort_metrics": FRAME + _TRUTH + """ , x AS (SELECT p_abuse, abuse_label, unnest([{'f': 'account_age', 'c': CASE WHEN account_age_days < 30 THEN '<30' WHEN account_age_days <= 365 THEN '30-365' ELSE '>365' END}, {'f': 'value', 'c': CASE WHEN value < 2000 THEN '<2k' WHEN value <= 10000 THEN '2-10k' ELSE '>10k' END},
        {'f': 'payment', 'c': CASE WHEN payment_method = 'COD' THEN 'COD' ELSE 'PREPAID' END}, {'f': 'multi_tenant', 'c': CASE WHEN address_multi_tenant THEN 'yes' ELSE 'no' END}, {'f': 'archetype', 'c': archetype}]) AS z FROM ft)
      , y AS (SELECT p_abuse, abuse_label, z.f AS family, z.c AS cohort FROM x)""" + _summary("family, cohort", "y"),
    "ring_actions": FRAME + _TRUTH + " SELECT ring, count(CASE WHEN action = 'ALLOW' THEN 1 END) AS n_allow, count(CASE WHEN action = 'PREPAID_ONLY' THEN 1 END) AS n_prepaid_only, count(CASE WHEN action = 'MANUAL_REVIEW' THEN 1 END) AS n_manual_review, count(CASE WHEN action = 'BLOCK' THEN 1 END) AS n_block FROM ft WHERE ring IS NOT NULL GROUP BY ring",
    "ring_recall": FRAME + _TRUTH + " SELECT count(*) AS n, count(CASE WHEN p_abuse >= 0.5 THEN 1 END) AS caught, round(count(CASE WHEN p_abuse >= 0.5 THEN 1 END) / nullif(count(*), 0), 6) AS recall FROM ft WHERE ring = 'R3' AND abuse_label = 1",
    "archetype_backtest": FRAME + _TRUTH + f""" , kn AS (SELECT *, abuse_label::DOUBLE AS ab, CASE WHEN return_label = 1 THEN coalesce(returned_fraction, 1.0) ELSE 1.0 END AS sh FROM ft WHERE abuse_label IS NOT NULL), pr AS (SELECT *, {_REAL.format(a='action')} AS cost FROM kn)
      SELECT archetype, count(*) AS n, round(CAST(sum(CAST(cost AS DECIMAL(20,4))) AS DOUBLE) / count(*) * 1000, 2) AS cost_per_1000, round(count(CASE WHEN ab = 0 AND action = 'BLOCK' THEN 1 END) / count(CASE WHEN ab = 0 THEN 1 END), 6) AS genuine_block_rate,
        round(count(CASE WHEN ab = 0 AND action <> 'ALLOW' THEN 1 END) / count(CASE WHEN ab = 0 THEN 1 END), 6) AS friction_rate FROM pr GROUP BY archetype""",
    "separation": DECISIONS + " SELECT count(*) AS n, round(coalesce(corr(p_abuse, p_return), 0), 6) AS correlation FROM sc",
    "guardrail_overlap": DECISIONS + " SELECT count(CASE WHEN g2 OR g3 OR g4 THEN 1 END) AS avoided_blocks, count(CASE WHEN g2::INT + g3::INT + g4::INT >= 2 THEN 1 END) AS several FROM dc WHERE cost_optimal = 'BLOCK'",
    "identifier_labels": WORLD + " SELECT DISTINCT ident, CASE kind WHEN 'DEVICE' THEN 'Device' WHEN 'ADDRESS' THEN 'Address' ELSE 'Payment Token' END || ' ••' || right(ident, 4) AS label FROM uses",
    "world_figures": WORLD + """ , tr AS (SELECT c, 'R' || ((c // 16) % 5) AS ring FROM acc WHERE c % 10 <> 9 AND c % 16 IN (4, 5, 6, 7))
      , b AS (SELECT o.*, EXISTS (SELECT 1 FROM o p WHERE p.c = o.c AND p.t0 < o.t0 AND p.claimed IS NOT NULL) AS before FROM o)
      SELECT count(*) AS orders, count(DISTINCT c) AS accounts, round(avg((returned IS NOT NULL)::INT), 6) AS return_rate, round(avg((claimed IS NOT NULL)::INT), 6) AS claim_rate, round(avg(before::INT), 6) AS prior_claim_share,
        (SELECT median(n) FROM (SELECT ring, count(*) AS n FROM o JOIN tr USING (c) GROUP BY ring)) AS median_ring_orders FROM b""",
}
