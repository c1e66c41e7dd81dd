"""A policy from TOML: whole, checked, and the same as the values in code."""

import pytest
from pyspark.sql import functions as F

from riskloom.plans import policy, policy_file
from riskloom.plans.policy import Policy


def text(change=None, drop=None, more=""):
    values = {pair: getattr(Policy(), name) for name, pair in policy_file.KEYS.items()} | {pair: f'"{pair[1]}"' for pair in policy_file.TEXTS} | (change or {})
    sections = {}
    for (section, key), value in values.items():
        if (section, key) != drop:
            sections.setdefault(section, []).append(f"{key} = {value}")
    return "\n".join(f"[{s}]\n" + "\n".join(lines) for s, lines in sections.items()) + "\n" + more


def read(tmp_path, content):
    path = tmp_path / "policy.toml"
    path.write_bytes(content.encode() if isinstance(content, str) else content)
    return policy_file.read(str(path))


def test_file_gives_the_values_of_the_code(tmp_path):
    one = read(tmp_path, text())
    assert one.policy == Policy() and one.version == "version"
    assert read(tmp_path, text().replace("\n", "\r\n")).digest == one.digest != read(tmp_path, text() + "# more").digest


@pytest.mark.parametrize(("given", "words"), [
    (text(drop=("clv", "cap_inr")), "missing key clv.cap_inr"), (text(more="[extra]\na = 1\n"), "unknown section extra"), (text({("block", "other"): 1}), "unknown key block.other"),
    (text({("clv", "cap_inr"): 10}), "clv_floor"), (text({("economics", "gross_margin_rate"): 1.5}), "out of range"), (text({("guardrails", "block_min_p_abuse"): 0.4}), "block_min_p"),
    (text({("guardrails", "high_exposure_min_p_abuse"): 0.9}), "exposure_min_p"), (text({("guardrails", "block_min_corroborating_signals"): 1}), "two signals"), (text({("manual_review", "reviewer_detection_rate"): 0.0}), "detect"),
    (text({("manual_review", "review_cost_inr"): '"x"'}), "isn't a number"), ("not [ toml", "isn't TOML"), (text({("allow", "abuse_recovery_rate"): 0.99, ("prepaid_only", "abuser_deterrence_rate"): 0.0, ("prepaid_only", "abuse_recovery_rate"): 0.0}), "rise faster"),
])
def test_faults_are_named(tmp_path, given, words):
    with pytest.raises(policy_file.PolicyError, match=words):
        read(tmp_path, given)


def test_plain_costs_equal_the_columns(spark):
    df = spark.createDataFrame([(p, v, c) for p in (0.0, 0.3, 1.0) for v in (500.0, 12345.0) for c in (10.0, 5000.0, 1e6)], "p double, value double, clv double")
    for r in df.select("*", *(x.alias(a) for a, x in policy.totals(F.col("p"), F.col("value"), F.col("clv")).items())).collect():
        assert [r[a] for a in policy.ACTIONS] == pytest.approx([policy.totals_at(r["p"], r["value"], r["clv"])[a] for a in policy.ACTIONS], abs=0.006)
