"""Replay statistics.

Every function takes optional group keys, so the same code reports on one run,
on each run, or on each method.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.mathx import binomial_at_most, order_statistic_rank
from ..plans.scale import exact_percentiles, running, settle


def is_success(status: Column) -> Column:
    """A missing status counts as success."""
    return F.coalesce(F.lower(status), F.lit("success")) == "success"


def bucket_label(ms: Column) -> Column:
    """Latency bucket; anything below the first bound lands in the first bucket."""
    label = None
    for low, high in fv.LATENCY_BUCKETS:
        name = f"{low}ms+" if high is None else f"{low}-{high - 1}ms"
        if high is None:
            return label.otherwise(name)
        label = F.when(ms < high, name) if label is None else label.when(ms < high, name)


def bucket_labels() -> list[str]:
    return [f"{lo}ms+" if hi is None else f"{lo}-{hi - 1}ms" for lo, hi in fv.LATENCY_BUCKETS]


def outcome_counts(status: Column) -> dict[str, Column]:
    return {
        "total_requests": F.count(F.lit(1)),
        "success_count": F.count_if(status == "success"),
        "failed_count": F.count_if(status == "failed"),
        "error_count": F.count_if(~status.isin("success", "failed") | status.isNull()),
    }


def latency_histogram(df: DataFrame, ms: str = "total_ms", by: Sequence[str] = ()) -> DataFrame:
    """All seven buckets per group, empty ones with 0; one pass, no join."""
    label = bucket_label(F.col(ms))
    names = bucket_labels()
    counts = df.groupBy(*by).agg(*[F.count_if(label == n).alias(f"_b{i}") for i, n in enumerate(names)])
    rows = F.array(*[
        F.struct(F.lit(i).alias("bucket_ord"), F.lit(n).alias("bucket"), F.col(f"_b{i}").alias("n"))
        for i, n in enumerate(names)])
    return counts.select(*by, F.inline(rows))


def latency_percentiles(df: DataFrame, ms: str = "total_ms", by: Sequence[str] = ()) -> DataFrame:
    return exact_percentiles(df, ms, dict(fv.PERCENTILES), by)


def job_totals(df: DataFrame, by: Sequence[str] = (), status="status", ms="total_ms", ts="ts") -> DataFrame:
    counts = outcome_counts(F.col(status))
    out = df.groupBy(*by).agg(
        *[c.alias(n) for n, c in counts.items()],
        F.sum(ms).alias("processing_ms"), F.min(ts).alias("started_at"), F.max(ts).alias("finished_at"))
    overall = (F.when(F.col("error_count") > 0, "error").when(F.col("failed_count") > 0, "partial").otherwise("success"))
    micros = F.unix_micros(F.col("finished_at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))
    return out.withColumns({"duration_ms": micros / 1000.0, "status": overall})


def retry_accounting(attempts: DataFrame, key: str, attempt: str, status: str, max_attempts: int,
                     tie: str | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Final status, retries and permanent failure per request.

    An attempt after the first non-error one never ran; neither did one past
    max_attempts.
    """
    at = F.struct(attempt, tie) if tie else F.col(attempt)
    error = F.col(status) == "error"
    settled = attempts.where(F.col(attempt) <= max_attempts).groupBy(*by, key).agg(
        F.min(F.when(~error, at)).alias("_ok_at"), F.max(at).alias("_last_at"),
        F.min_by(status, F.when(~error, at)).alias("_ok_status"),
        F.max(attempt).alias("_n"),
    )
    ok_attempt = F.col("_ok_at")[attempt] if tie else F.col("_ok_at")
    return settled.select(
        *by, key, F.coalesce("_ok_status", F.lit("error")).alias("final_status"),
        F.when(F.col("_ok_at").isNotNull(), ok_attempt - 1)
        .otherwise(F.least(F.col("_n"), F.lit(max_attempts)) - 1).cast("long").alias("retries"),
        F.col("_ok_at").isNull().alias("permanent_failure"))


def peak_concurrency(spans: DataFrame, start: str, end: str, by: Sequence[str] = ()) -> DataFrame:
    """Most spans open at once; a span is open on [start, end).

    Changes are summed per instant before anything is ordered, then a running
    sum walks ranges of instants.
    """
    by = list(by)
    change = F.explode(F.array(
        F.struct(F.col(start).cast("timestamp").alias("at"), F.lit(1).alias("d")),
        F.struct(F.col(end).cast("timestamp").alias("at"), F.lit(-1).alias("d"))))
    steps = spans.select(*by, change.alias("e")).groupBy(*by, F.col("e.at").alias("at")).agg(F.sum("e.d").alias("d"))
    walked = running(steps, by, ["at"], sums={"open": F.col("d")})
    return walked.groupBy(*by).agg(F.max("open").alias("peak_concurrency"))


def resource_rollup(samples: DataFrame, cpu_limit: float, memory_limit: float, by: Sequence[str] = (),
                    cpu="cpu", memory="memory_mb") -> DataFrame:
    c, m = F.nanvl(F.col(cpu), F.lit(None)), F.nanvl(F.col(memory), F.lit(None))
    hot_c, hot_m = F.coalesce(c >= cpu_limit, F.lit(False)), F.coalesce(m >= memory_limit, F.lit(False))
    return samples.groupBy(*by).agg(
        F.max(c).alias("peak_cpu"), F.avg(c).alias("mean_cpu"), F.max(m).alias("peak_memory_mb"),
        F.avg(m).alias("mean_memory_mb"), F.count_if(hot_c).alias("cpu_breaches"),
        F.count_if(hot_m).alias("memory_breaches"), F.count_if(hot_c | hot_m).alias("throttle_count"))


def job_summary(ops: DataFrame, attempts: DataFrame, samples: DataFrame, by: Sequence[str], max_attempts: int,
                cpu_limit: float, memory_limit: float) -> DataFrame:
    """Everything a job reports (X3): outcomes, durations, percentiles, retries, concurrency and resources.

    ops: by, status, total_ms, ts (start) and ended (end); attempts: by,
    request, attempt, status; samples: by, cpu, memory_mb. One row per job; a
    job without attempts or samples has zero retries and no peaks.
    """
    by = list(by)
    retries = retry_accounting(attempts, "request", "attempt", "status", max_attempts, by=by).groupBy(*by).agg(
        F.sum("retries").alias("retry_count"), F.count_if("permanent_failure").alias("permanent_failures"))
    peaks = resource_rollup(samples, cpu_limit, memory_limit, by).select(*by, "peak_cpu", "peak_memory_mb", "throttle_count")
    slow = ops.groupBy(*by).agg(*[F.count_if(bucket_label(F.col("total_ms")) == label).alias(f"latency_{i}") for i, (label, _) in enumerate(zip(bucket_labels(), fv.LATENCY_BUCKETS))])
    summary = job_totals(ops, by)
    for part in (latency_percentiles(ops, by=by).drop("n"), slow, peak_concurrency(ops, "ts", "ended", by)):
        summary = summary.join(part, by, "left")
    return summary.join(retries, by, "left").join(peaks, by, "left").na.fill(0, ["retry_count", "permanent_failures", "throttle_count"])


def mismatch(mismatches: Column, status: Column) -> Column:
    """A stored expected-value mismatch decides; else the status does."""
    return (F.coalesce(F.size(mismatches), F.lit(0)) > 0) | ~is_success(status)


def accuracy_counts(df: DataFrame, failed: Column, by: Sequence[str] = ()) -> DataFrame:
    out = df.groupBy(*by).agg(F.count(F.lit(1)).alias("request_count"), F.count_if(failed).alias("mismatch_count"))
    success = F.col("request_count") - F.col("mismatch_count")
    return out.withColumns({"success_count": success, "accuracy": F.try_divide(success, F.col("request_count"))})


def considered(ms: Column, limit: float = fv.OUTLIER_MS) -> Column:
    return F.when((ms >= 0) & (ms <= limit), ms)


def bootstrap_interval(
    df: DataFrame, value: str, threshold: float, by: Sequence[str] = (), alpha: float = fv.ALPHA, weight: str | None = None,
) -> DataFrame:
    """Bootstrap interval of P95 - threshold per group, without drawing.

    The k-th smallest of n draws has rank c or less with the chance
    P(Binomial(n, c / n) >= k), so the quantiles that ever more resamples tend to
    are order statistics of the values, whose ranks depend on n alone. The 95th
    percentile lies between two order statistics; its interval ends are
    interpolated between theirs. The cost is that of an exact percentile
    for every n. `weight` names a column of counts for values already counted.
    """
    by = list(by)

    def at(side: float, step: int):
        @F.pandas_udf("long")
        def rank(n: pd.Series) -> pd.Series:
            k = np.minimum(np.floor(0.95 * (n.to_numpy() - 1)).astype(np.int64) + 1 + step, n.to_numpy())
            return pd.Series(order_statistic_rank(n.to_numpy(), k, side) - 1)
        return rank

    ends = {"_l0": at(alpha / 2, 0), "_l1": at(alpha / 2, 1), "_h0": at(1 - alpha / 2, 0), "_h1": at(1 - alpha / 2, 1)}
    found = exact_percentiles(df, value, {}, by, weight, positions=ends)
    share = 0.95 * (F.col("n") - 1) - F.floor(0.95 * (F.col("n") - 1))
    end = lambda s: F.col(f"_{s}0") + (F.col(f"_{s}1") - F.col(f"_{s}0")) * share - threshold
    return found.select(*by, "n", end("l").alias("delta_low"), end("h").alias("delta_high")).withColumn(
        "inference", F.when(F.col("delta_high") <= 0, "meet-target")
        .when(F.col("delta_low") > 0, "above-target").otherwise("insufficient-data"))


def binomial_test(counts: DataFrame, k: str, n: str, p: float, by: Sequence[str] = (), alpha: float = fv.ALPHA,
                  minimum: int = fv.MIN_SAMPLE) -> DataFrame:
    """P(X <= k) for X ~ Binomial(n, p), by the incomplete beta function."""
    by = list(by)
    base = counts.select(*by, F.col(k).cast("long").alias("_k"), F.col(n).cast("long").alias("_n"))
    tested = base.withColumn("p_value", F.lit(0.0 if p <= 0 else 1.0) if p <= 0 or p >= 1 else binomial_at_most("_n", "_k", F.lit(float(p))))
    enough = F.col("_n") >= minimum
    return tested.select(
        *by, F.col("_k").alias("success_count"), F.col("_n").alias("request_count"),
        F.when(enough, F.col("p_value")).alias("p_value"),
        F.when(~enough, "insufficient-data").when(F.col("p_value") < alpha, "below-target")
        .otherwise("meet-target").alias("inference"))


def assess_p95(df: DataFrame, value: str, threshold: float, by: Sequence[str] = (), alpha: float = fv.ALPHA,
               minimum: int = fv.MIN_SAMPLE, q: float = 0.95) -> DataFrame:
    """Analytic test of a percentile: density by finite difference, one-sided z.

    Groups smaller than `minimum` are left out.
    """
    def delta(n):
        return F.least(F.lit(0.5), F.greatest(1 / n, 0.5 / F.sqrt(n)))

    def low(n):
        return F.greatest(F.lit(0.0), q - delta(n))

    def high(n):
        return F.least(F.lit(1.0), q + delta(n))

    n = F.col("n")
    base = exact_percentiles(df, value, {"sample_p95": q, "_lo": low, "_hi": high}, by).where(n >= max(minimum, 1))
    slope = F.when(n >= 2, (F.col("_hi") - F.col("_lo")) / (high(n) - low(n)))
    error = F.sqrt(F.lit(q * (1 - q)) / n * slope * slope)
    critical = NormalDist().inv_cdf(1 - min(max(alpha, 1e-6), 0.5))
    gap = F.col("sample_p95") - threshold
    breached = gap > 0
    z = F.when(F.col("standard_error_ms") > 0, gap / F.col("standard_error_ms")).when(
        F.col("standard_error_ms") == 0, F.when(gap == 0, 0.0).when(gap > 0, float("inf")).otherwise(float("-inf")))
    out = base.withColumn("standard_error_ms", error).withColumn("z_score", z)
    significant = F.when(F.col("z_score").isNotNull(), breached & (F.col("z_score") >= critical))
    return out.withColumns({
        "threshold_breached": breached, "significant_breach": significant,
        "inference": F.when(~breached, "meets-target").when(significant, "violates-target").otherwise("inconclusive"),
    }).drop("_lo", "_hi")


def resolve_run_method(df: DataFrame, method: Column, order: str, by: Sequence[str] = ()) -> DataFrame:
    """Most frequent non-blank method label; the first seen wins a tie."""
    label = F.trim(method)
    counted = df.withColumn("_m", label).where(F.coalesce(F.col("_m"), F.lit("")) != "").groupBy(*by, "_m").agg(
        F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    return counted.groupBy(*by).agg(F.max_by("_m", F.struct("_n", -F.col("_first"))).alias("method"))


def usage_totals(flat: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sum per usage metric, only metrics seen, rounded half-even to six digits."""
    return flat.where(F.col("metric").isNotNull() & F.col("value").isNotNull()).groupBy(*by, "metric").agg(
        F.bround(F.sum("value"), 6).alias("total"))


def word_span(words: DataFrame, key: str, start="start", end="end", measured: Column | None = None) -> DataFrame:
    """Spoken milliseconds from first start to last end; at least the measured time."""
    span = (F.max(end) - F.min(start)) * 1000.0
    longest = F.greatest(span, F.max(measured)) if measured is not None else span
    return words.groupBy(key).agg(span.alias("span_ms"), longest.alias("duration_ms"))


def progress(df: DataFrame, order: str, status: str = "status", by: Sequence[str] = ()) -> DataFrame:
    """Running counts after each finished request, in `order`."""
    one = {"processed": F.lit(1)} | {
        f"{s}_so_far": (F.col(status) == s).cast("int") for s in ("success", "failed")} | {
        "error_so_far": (~F.col(status).isin("success", "failed")).cast("int")}
    return running(df, by, [order], sums=one)


def replay_report(ops: DataFrame, by: Sequence[str] = (), failed: Column | None = None, ms: str = "total_ms",
                  threshold: float = fv.P95_TARGET_MS, target: float = fv.ACCURACY_TARGET, alpha: float = fv.ALPHA,
                  minimum: int = fv.MIN_SAMPLE,
                  outlier_ms: float = fv.OUTLIER_MS) -> DataFrame:
    """Accuracy, mean, P95 with its interval and both inferences per group."""
    keys = list(by) or ["_all"]
    rows = ops if by else ops.withColumn("_all", F.lit(0))
    failed = failed if failed is not None else ~is_success(F.col("status"))
    kept = rows.withColumns({"_ms": considered(F.col(ms), outlier_ms), "_failed": failed})
    base = settle(kept.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("request_count"), F.count_if("_failed").alias("mismatch_count"),
        F.count("_ms").alias("considered_count"), F.avg("_ms").alias("mean_response_ms"))
        .withColumn("success_count", F.col("request_count") - F.col("mismatch_count")))
    # percentiles and resamples share one count of the values
    counted = settle(kept.where("_ms is not null").groupBy(*keys, "_ms").agg(F.count(F.lit(1)).alias("_w")))
    p95 = exact_percentiles(counted, "_ms", {"p95_ms": 0.95}, keys, "_w").drop("n")
    test = binomial_test(base, "success_count", "request_count", target, keys, alpha, minimum).select(
        *keys, "p_value", F.col("inference").alias("accuracy_inference"))
    interval = bootstrap_interval(counted, "_ms", threshold, keys, alpha, weight="_w").select(
        *keys, "delta_low", "delta_high", F.col("inference").alias("_p95_inference"))
    out = base.join(p95, keys, "left").join(test, keys).join(interval, keys, "left")
    enough = F.col("request_count") >= minimum
    out = out.withColumns({
        "accuracy": F.try_divide(F.col("success_count"), F.col("request_count")),
        "ci_low_ms": F.when(enough, F.col("delta_low")), "ci_high_ms": F.when(enough, F.col("delta_high")),
        "p95_inference": F.when(enough, F.coalesce("_p95_inference", F.lit("insufficient-data"))).otherwise("insufficient-data"),
    }).drop("delta_low", "delta_high", "_p95_inference")
    return out if by else out.drop("_all")


def import_summary(ops: DataFrame, key: str, metadata: str, order: str, by: Sequence[str] = (), **targets) -> DataFrame:
    """The whole report of a run: replay_report with stored mismatches, the resolved method and usage totals.

    `metadata` is a JSON text column; `order` breaks ties of methods.
    """
    from .usage import flatten_usage

    keys = list(by) or ["_all"]
    rows = (ops if by else ops.withColumn("_all", F.lit(0))).withColumn("_parsed", F.try_parse_json(F.col(metadata)))
    stored = F.try_variant_get("_parsed", "$.expectedValueMismatches", "array<variant>")
    rows = rows.withColumn("_stored", F.coalesce(F.size(stored), F.lit(0)))
    report = replay_report(rows, keys, (F.col("_stored") > 0) | ~is_success(F.col("status")), **targets)
    found = rows.groupBy(*keys).agg(F.count_if(F.col("_stored") > 0).alias("stored_mismatch_rows"), F.sum("_stored").alias("stored_mismatches"))
    label = F.coalesce(*[F.nullif(F.trim(F.try_variant_get("_parsed", f"$.{k}", "string")), F.lit("")) for k in fv.METHOD_KEYS])
    method = resolve_run_method(rows, label, order, keys)
    usage = usage_totals(flatten_usage(rows, key, metadata, keys), keys).groupBy(*keys).pivot("metric", fv.USAGE_METRICS).agg(F.first("total"))
    out = report.join(found, keys).join(method, keys, "left").join(usage, keys, "left")
    return out if by else out.drop("_all")


