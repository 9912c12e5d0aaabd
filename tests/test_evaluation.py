import json
import math
import random
from fractions import Fraction

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wishloom.functions.mathx import log_gamma, order_statistic_rank
from wishloom.operators import evaluation as ev
from wishloom.operators.usage import flatten_usage


def test_job_of_1200(spark):
    rows = [("success", 50.0)] * 1000 + [("failed", 180.0)] * 100 + [("error", 1400.0)] * 100
    df = spark.createDataFrame(rows, "status string, total_ms double").withColumn("ts", F.current_timestamp())
    job = ev.job_totals(df).first()
    assert (job["success_count"], job["failed_count"], job["error_count"], job["status"]) == (1000, 100, 100, "error")
    assert job["processing_ms"] == 208000.0
    histogram = {r["bucket"]: r["n"] for r in ev.latency_histogram(df).collect()}
    assert histogram["0-99ms"] == 1000 and histogram["100-249ms"] == 100 and histogram["1000-1999ms"] == 100
    assert sum(histogram.values()) == 1200 and len(histogram) == 7
    p = ev.latency_percentiles(df).first()
    assert p["p50"] <= p["p90"] <= p["p95"] <= p["p99"] == 1400.0


def test_log_gamma(spark):
    xs = [0.5, 1.0, 2.0, 3.7, 10.0, 1234.5, 1e7]
    got = spark.createDataFrame([(x,) for x in xs], "x double").select(log_gamma(F.col("x"))).collect()
    for x, r in zip(xs, got):
        assert r[0] == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-12)


@pytest.mark.parametrize("k,n", [(0, 10), (10, 10), (-1, 10), (830, 1000), (150, 1000), (2550, 3000)])
def test_binomial_is_exact(spark, k, n):
    p = Fraction(17, 20)
    want = float(sum(math.comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k + 1)))
    got = ev.binomial_test(spark.createDataFrame([(k, n)], "k long, n long"), "k", "n", 0.85, minimum=1).first()["p_value"]
    assert got == pytest.approx(want, rel=1e-9, abs=1e-300)


def test_small_sample_report(spark):
    df = spark.createDataFrame([("success", 420.0), ("success", 515.0), ("success", 610.0)], "status string, total_ms double")
    r = ev.replay_report(df, threshold=750.0, alpha=0.1, minimum=3).first()
    assert (r["p95_inference"], r["accuracy_inference"], r["accuracy"]) == ("meet-target", "meet-target", 1.0)
    assert ev.replay_report(df, minimum=4).first()["p95_inference"] == "insufficient-data"


def test_analytic_p95(spark):
    df = spark.createDataFrame([(120.0,)] * 800 + [(220.0,)] * 200, "v double")
    assert ev.assess_p95(df, "v", 180.0, minimum=1).first()["inference"] == "violates-target"
    assert ev.assess_p95(df, "v", 250.0, minimum=1).first()["inference"] == "meets-target"
    assert ev.assess_p95(df, "v", 250.0, minimum=2000).count() == 0


@pytest.mark.parametrize("n", [1, 2, 40, 9_999, 10_000, 10_001])
def test_interval_agrees_with_draws(spark, n):
    rng = np.random.default_rng(2)
    values = rng.exponential(200, n)
    got = ev.bootstrap_interval(spark.createDataFrame(pd.DataFrame({"v": values})), "v", 0.0).first()
    drawn = np.sort([np.percentile(values[rng.integers(0, n, n)], 95) for _ in range(2000)])
    low, high = drawn[int(0.025 * 1999)], drawn[int(0.975 * 1999)]
    width = max(high - low, 1e-9)
    assert got["n"] == n and abs(got["delta_low"] - low) < 0.15 * width and abs(got["delta_high"] - high) < 0.15 * width


def test_order_statistic_rank_is_exact():
    for n in (1, 2, 7, 40, 200):
        for q in (0.025, 0.5, 0.975):
            for k in {1, n, max(1, int(0.95 * n))}:
                def reached(c, n=n, k=k):
                    p = Fraction(c, n)
                    return sum(math.comb(n, i) * p**i * (1 - p)**(n - i) for i in range(k, n + 1))
                want = next(c for c in range(1, n + 1) if reached(c) >= Fraction(q))
                assert order_statistic_rank(np.array([n]), np.array([k]), q)[0] == want


def test_usage_totals(spark):
    shapes = [
        {"usage": {"components": [{"usage": {"tokensIn": 10, "tokensOut": 5, "apiCalls": 1}}]}},
        {"usage": {"components": [{"usage": {"tokensIn": 20, "tokensOut": 10, "apiCalls": 2, "cpuMs": 7.5}}, {"metrics": {"ramMbSeconds": 3.6}}]}},
        {"usage": {"ok": True}, "other": {"tokensIn": 99}},
        {"components": [{"usage": {"name": "x"}, "requests": 2}, {"usage": {}, "requests": 3}, {"usage": {"apiCalls": 1}, "requests": 50}]},
    ]
    df = spark.createDataFrame([(i, json.dumps(s)) for i, s in enumerate(shapes)], "op long, meta string")
    totals = {r["metric"]: r["total"] for r in ev.usage_totals(flatten_usage(df, "op", "meta")).collect()}
    assert totals == {"tokensIn": 30, "tokensOut": 15, "apiCalls": 9, "cpuMs": 7.5, "ramMbSeconds": 3.6}


def test_peak_concurrency_equals_sweep(spark):
    rng = random.Random(4)
    spans = [(i, rng.randint(0, 5000), rng.randint(1, 900)) for i in range(300)]
    df = spark.createDataFrame(spans, "i long, a long, n long").select(
        F.timestamp_seconds(F.col("a") * 86400).alias("s"), F.timestamp_seconds((F.col("a") + F.col("n")) * 86400).alias("e"))
    want = max(sum(a <= d < a + n for _i, a, n in spans) for d in {a for _i, a, _n in spans})
    assert ev.peak_concurrency(df, "s", "e").first()["peak_concurrency"] == want
