"""Bootstrap intervals from score cells against resampling of rows."""

import numpy as np
from pyspark.sql import functions as F

from riskloom.plans import evaluation


def precision(score, label, times):
    order = np.argsort(-score, kind="stable")
    s, hits, seen = score[order], np.cumsum((label * times)[order]), np.cumsum(times[order])
    last = np.append(s[1:] != s[:-1], True)
    pos = np.diff(np.concatenate([[0], hits[last]]))
    with np.errstate(invalid="ignore"):
        return np.nansum(pos * hits[last] / seen[last]) / hits[-1]


def test_interval_equals_resampled_rows(spark):
    rng = np.random.default_rng(4)
    score = np.round(rng.random(1200), 2)
    label = (rng.random(1200) < score**3).astype(int)
    half = rng.integers(0, 2, 1200)
    df = spark.createDataFrame([(i, float(s), int(y), "ab"[h], None if h else 1) for i, (s, y, h) in enumerate(zip(score, label, half))], "k long, p_abuse double, abuse_label int, half string, other int").repartition(5)
    row = evaluation.bootstrap_interval(df).first()
    ap = [precision(score, label, rng.poisson(1, 1200)) for _ in range(1000)]
    assert abs(row["low"] - np.quantile(ap, 0.025)) < 0.02 and abs(row["high"] - np.quantile(ap, 0.975)) < 0.02
    found = {r["half"]: r for r in evaluation.bootstrap_interval(df, by=("half",)).collect()}
    for h, name in enumerate("ab"):
        ap = [precision(score[half == h], label[half == h], rng.poisson(1, int((half == h).sum()))) for _ in range(1000)]
        assert abs(found[name]["low"] - np.quantile(ap, 0.025)) < 0.03 and abs(found[name]["high"] - np.quantile(ap, 0.975)) < 0.03
    again = evaluation.bootstrap_interval(df.repartition(2)).first()
    assert np.allclose([again["low"], again["high"]], [row["low"], row["high"]])


def test_interval_of_nothing(spark):
    df = spark.createDataFrame([], "k long, p_abuse double, abuse_label int")
    assert tuple(evaluation.bootstrap_interval(df).first()) == (None, None)
    assert evaluation.bootstrap_interval(df.withColumn("g", F.lit(1)), by=("g",)).count() == 0
