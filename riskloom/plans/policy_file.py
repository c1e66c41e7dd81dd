"""A policy from a TOML file: every key must be there and none other, values must make sense together, and the file has a version."""

from __future__ import annotations

import hashlib
import tomllib
from dataclasses import dataclass
from pathlib import Path

from .policy import ACTIONS, Policy, totals_at

#: Section and key of each policy value in a file, and the keys that are text (fixed values).
KEYS = {
    "tie_tolerance": ("policy", "tie_tolerance_inr"), "gross_margin_rate": ("economics", "gross_margin_rate"), "reverse_logistics_cost": ("economics", "reverse_logistics_cost_inr"),
    "clv_floor": ("clv", "new_customer_floor_inr"), "clv_cap": ("clv", "cap_inr"), "allow_recovery_rate": ("allow", "abuse_recovery_rate"),
    "prepaid_deterrence_rate": ("prepaid_only", "abuser_deterrence_rate"), "prepaid_recovery_rate": ("prepaid_only", "abuse_recovery_rate"), "prepaid_abandonment_rate": ("prepaid_only", "genuine_abandonment_rate"),
    "prepaid_churn_rate": ("prepaid_only", "genuine_clv_churn_rate"), "prepaid_friction_cost": ("prepaid_only", "genuine_friction_cost_inr"),
    "review_cost": ("manual_review", "review_cost_inr"), "review_detection_rate": ("manual_review", "reviewer_detection_rate"), "review_abandonment_rate": ("manual_review", "genuine_delay_abandonment_rate"),
    "review_false_cancel_rate": ("manual_review", "genuine_false_cancel_rate"), "block_churn_rate": ("block", "genuine_clv_churn_rate"), "block_support_cost": ("block", "genuine_support_cost_inr"),
    "block_min_p": ("guardrails", "block_min_p_abuse"), "block_min_signals": ("guardrails", "block_min_corroborating_signals"), "exposure_value": ("guardrails", "high_exposure_value_inr"),
    "exposure_min_p": ("guardrails", "high_exposure_min_p_abuse"), "degraded_review_value": ("guardrails", "degraded_review_min_value_inr"),
}
TEXTS = (("policy", "version"), ("policy", "currency"), ("policy", "notice"))
#: The pair of actions whose costs may rise in either order, and the range of order values that is checked (fixed values).
EITHER, LEAST, MOST = ("PREPAID_ONLY", "MANUAL_REVIEW"), 500.0, 200_000.0


class PolicyError(ValueError):
    """All that is wrong with a policy file."""


@dataclass(frozen=True)
class PolicyFile:
    policy: Policy
    version: str
    currency: str
    notice: str
    digest: str


def _key_faults(data: dict) -> list[str]:
    wanted = {*KEYS.values(), *TEXTS}
    given = {(s, k) for s, values in data.items() if isinstance(values, dict) for k in values}
    sections = {s for s, _ in wanted}
    out = [f"unknown section {s}" for s in sorted(set(data) - sections)] + [f"missing section {s}" for s in sorted(sections - set(data))]
    out += [f"unknown key {s}.{k}" for s, k in sorted(given - wanted) if s in sections]
    return out + [f"missing key {s}.{k}" for s, k in sorted(wanted - given) if s in data]


def faults(y: Policy) -> list[str]:
    """What doesn't hold between a policy's values."""
    out = []
    if y.review_detection_rate <= 0:
        out.append("reviews must detect something")
    if not 0.5 < y.block_min_p < 1:
        out.append(f"block_min_p is not between 0.5 and 1: {y.block_min_p}")
    if y.block_min_signals < 2:
        out.append("a block needs two signals or more")
    if not 0 < y.exposure_min_p < y.block_min_p:
        out.append("exposure_min_p is not between 0 and block_min_p")
    return out or slope_faults(y)


def slope_faults(y: Policy) -> list[str]:
    """Pairs of actions whose costs rise faster with p for the more severe one somewhere.

    The difference of two slopes is linear in the order's value and in the customer's value, so its least value is at a corner of
    their ranges.
    """
    out = []
    for a, b in zip(ACTIONS, ACTIONS[1:]):
        if (a, b) == EITHER:
            continue
        gaps = []
        for value in (LEAST, MOST):
            for clv in (y.clv_floor, y.clv_cap):
                zero, one = totals_at(0.0, value, clv, y), totals_at(1.0, value, clv, y)
                gaps.append((one[a] - zero[a]) - (one[b] - zero[b]))
        if min(gaps) < 0:
            out.append(f"costs of {b} rise faster than those of {a}, by {-min(gaps):.2f}")
    return out


def read(path: str) -> PolicyFile:
    """The policy in a TOML file; the digest doesn't depend on how its lines end."""
    raw = Path(path).read_bytes().replace(b"\r\n", b"\n")
    try:
        data = tomllib.loads(raw.decode())
    except tomllib.TOMLDecodeError as e:
        raise PolicyError(f"{path} isn't TOML: {e}") from e
    wrong = _key_faults(data)
    if wrong:
        raise PolicyError("; ".join(wrong))
    values = {name: data[s][k] for name, (s, k) in KEYS.items()}
    kinds = [f"{'.'.join(KEYS[n])} isn't a number" for n, v in values.items() if isinstance(v, bool) or not isinstance(v, (int, float))]
    if kinds:
        raise PolicyError("; ".join(kinds))
    try:
        y = Policy(**{n: int(v) if n == "block_min_signals" else float(v) for n, v in values.items()})
    except ValueError as e:
        raise PolicyError(str(e)) from e
    wrong = faults(y)
    if wrong:
        raise PolicyError("; ".join(wrong))
    return PolicyFile(y, *(str(data[s][k]) for s, k in TEXTS), hashlib.sha256(raw).hexdigest())
