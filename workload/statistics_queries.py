"""A7-A20, A25, A26, U1, X2-X4 over events, orders and lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from wishloom.functions import fixed_values as fv
from wishloom.operators import evaluation as ev
from wishloom.operators.usage import flatten_usage

from .frames import SQL_OPS, operations
from .registry import query, r6

BUCKETS = ", ".join(
    f"({i}, '{n}', {lo if i else '-1e308'}, {hi if hi is not None else '1e308'})"
    for i, (n, (lo, hi)) in enumerate(zip(ev.bucket_labels(), fv.LATENCY_BUCKETS)))
COUNTS = """count(*) AS total_requests, count(*) FILTER (status = 'success') AS success_count,
 count(*) FILTER (status = 'failed') AS failed_count, count(*) FILTER (status NOT IN ('success', 'failed')) AS error_count"""


@query("a7_outcome_counts", f"WITH {SQL_OPS} SELECT run_id, {COUNTS} FROM ops GROUP BY 1")
def _(t):
    return operations(t).groupBy("run_id").agg(*[c.alias(n) for n, c in ev.outcome_counts(F.col("status")).items()])


@query("a8_latency_histogram", f"""WITH {SQL_OPS}, b AS (SELECT * FROM (VALUES {BUCKETS}) v(bucket_ord, bucket, lo, hi))
SELECT bucket_ord, bucket, count(op_id) AS n FROM b LEFT JOIN ops ON total_ms - 300 >= lo AND total_ms - 300 < hi GROUP BY ALL""")
def _(t):
    return ev.latency_histogram(operations(t).withColumn("total_ms", F.col("total_ms") - 300))


PCT = ", ".join(f"round(quantile_cont({{0}}, {q}), 6) AS {n}" for n, q in fv.PERCENTILES)


@query("a9_percentiles", f"WITH {SQL_OPS} SELECT method, count(*) AS n, {PCT.format('total_ms')} FROM ops GROUP BY 1")
def _(t):
    p = ev.latency_percentiles(operations(t), by=["method"])
    return p.select("method", "n", *[r6(n).alias(n) for n, _q in fv.PERCENTILES])


@query("a9_lineitem_percentiles", f"SELECT count(*) AS n, {PCT.format('l_extendedprice')} FROM lineitem")
def _(t):
    p = ev.latency_percentiles(t.lineitem, "l_extendedprice")
    return p.select("n", *[r6(n).alias(n) for n, _q in fv.PERCENTILES])


@query("a10_job_totals", f"""WITH {SQL_OPS}, g AS (SELECT run_id, {COUNTS}, round(sum(total_ms), 4) AS processing_ms, min(ts) AS started_at, max(ts) AS finished_at FROM ops GROUP BY 1)
SELECT * EXCLUDE (started_at, finished_at), epoch_us(started_at) AS started_us, epoch_us(finished_at) AS finished_us, (epoch_us(finished_at) - epoch_us(started_at)) / 1000 AS duration_ms, CASE WHEN error_count > 0 THEN 'error' WHEN failed_count > 0 THEN 'partial' ELSE 'success' END AS status FROM g""")
def _(t):
    j = ev.job_totals(operations(t), ["run_id"])
    micros = {f"{c}_us": F.unix_micros(F.col(f"{c}_at").cast("timestamp")) for c in ("started", "finished")}
    return j.withColumn("processing_ms", F.round("processing_ms", 4)).withColumns(micros).drop("started_at", "finished_at")


@query("a11_retry_accounting", """
WITH a AS (SELECT l_orderkey AS request, l_linenumber AS attempt, l_partkey AS tie, CASE WHEN l_returnflag = 'R' THEN 'success' WHEN l_returnflag = 'A' THEN 'failed' ELSE 'error' END AS status FROM lineitem WHERE l_linenumber <= 3),
o AS (SELECT request, max(attempt) AS n, min(attempt) FILTER (status <> 'error') AS ok,
   arg_min(status, attempt::BIGINT * 1000000000 + tie) FILTER (status <> 'error') AS okst FROM a GROUP BY 1)
SELECT request, coalesce(okst, 'error') AS final_status, CAST(coalesce(ok, n) - 1 AS BIGINT) AS retries, ok IS NULL AS permanent_failure FROM o""")
def _(t):
    flag = F.col("l_returnflag")
    a = t.lineitem.select(
        F.col("l_orderkey").alias("request"), F.col("l_linenumber").alias("attempt"), F.col("l_partkey").alias("tie"),
        F.when(flag == "R", "success").when(flag == "A", "failed").otherwise("error").alias("status"))
    return ev.retry_accounting(a, "request", "attempt", "status", 3, tie="tie")


@query("a12_peak_concurrency", """
WITH s AS (SELECT l_returnflag AS lane, o_orderdate AS a, greatest(l_shipdate, o_orderdate + INTERVAL 1 DAY) AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
e AS (SELECT lane, a AS tm, 1 AS d FROM s UNION ALL SELECT lane, b, -1 FROM s),
g AS (SELECT lane, tm, sum(d) AS d FROM e GROUP BY 1, 2), w AS (SELECT lane, sum(d) OVER (PARTITION BY lane ORDER BY tm) AS o FROM g)
SELECT lane, CAST(max(o) AS BIGINT) AS peak_concurrency FROM w GROUP BY 1""")
def _(t):
    s = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_returnflag").alias("lane"), F.col("o_orderdate").alias("a"),
        F.greatest("l_shipdate", F.col("o_orderdate") + F.expr("INTERVAL 1 DAY")).alias("b"))
    return ev.peak_concurrency(s, "a", "b", ["lane"])


@query("a13_resource_rollup", """
WITH s AS (SELECT user_id % 7 AS job, CASE WHEN event_id % 13 = 0 THEN NULL ELSE value / 5 END AS c, CASE WHEN event_id % 17 = 0 THEN NULL ELSE value * 10 END AS m FROM events)
SELECT job, max(c) AS peak_cpu, round(avg(c), 6) AS mean_cpu, max(m) AS peak_memory_mb, round(avg(m), 6) AS mean_memory_mb,
 count(*) FILTER (c >= 70) AS cpu_breaches, count(*) FILTER (m >= 3500) AS memory_breaches, count(*) FILTER (c >= 70 OR m >= 3500) AS throttle_count FROM s GROUP BY 1""")
def _(t):
    nan = F.lit(float("nan"))
    s = t.events.select((F.col("user_id") % 7).alias("job"),
                        F.when(F.col("event_id") % 13 == 0, nan).otherwise(F.col("value") / 5).alias("cpu"),
                        F.when(F.col("event_id") % 17 == 0, nan).otherwise(F.col("value") * 10).alias("memory_mb"))
    r = ev.resource_rollup(s, 70, 3500, ["job"])
    return r.withColumns({"mean_cpu": r6("mean_cpu"), "mean_memory_mb": r6("mean_memory_mb")})


def with_metadata(t):
    """Operations with JSON metadata; every seventh carries a stored mismatch."""
    ops = operations(t)
    mism = F.when(F.col("op_id") % 7 == 0, '[{"label":"To","expected":"Spain","actual":"Italy"}]').when(
        F.col("op_id") % 7 == 1, "[]").otherwise("null")
    meta = F.concat(F.lit('{"method":"'), "method", F.lit('","expectedValueMismatches":'), mism,
                    F.lit(',"timings":{"totalMs":'), F.col("total_ms").cast("string"), F.lit("}}"))
    return ops.withColumn("metadata", F.parse_json(meta))


@query("a14_replay_accuracy", f"""WITH {SQL_OPS} SELECT method, count(*) AS request_count, count(*) FILTER (op_id % 7 = 0 OR status <> 'success') AS mismatch_count,
 count(*) FILTER (NOT (op_id % 7 = 0 OR status <> 'success')) AS success_count, round(count(*) FILTER (NOT (op_id % 7 = 0 OR status <> 'success')) / count(*), 6) AS accuracy FROM ops GROUP BY 1""")
def _(t):
    ops = with_metadata(t)
    stored = F.try_variant_get("metadata", "$.expectedValueMismatches", "array<variant>")
    a = ev.accuracy_counts(ops, ev.mismatch(stored, F.col("status")), ["method"])
    return a.withColumn("accuracy", r6("accuracy"))


@query("a15_filtered_latency", f"""WITH {SQL_OPS}, f AS (SELECT method, CASE WHEN total_ms - 200 BETWEEN 0 AND 5000 THEN total_ms - 200 END AS v FROM ops)
SELECT method, count(*) AS request_count, count(v) AS considered_count, round(avg(v), 6) AS mean_ms, round(quantile_cont(v, 0.95), 6) AS p95_ms FROM f GROUP BY 1""")
def _(t):
    v = operations(t).select("method", ev.considered(F.col("total_ms") - 200, 5000.0).alias("v"))
    base = v.groupBy("method").agg(F.count("*").alias("request_count"), F.count("v").alias("considered_count"),
                                   r6(F.avg("v")).alias("mean_ms"))
    p = ev.exact_percentiles(v, "v", {"p95_ms": 0.95}, ["method"])
    return base.join(p.select("method", r6("p95_ms").alias("p95_ms")), "method")


def boot_sql(keys: str, on: str) -> str:
    k = f"{keys}, " if keys else ""
    part = f"PARTITION BY {keys} " if keys else ""
    return f"""
rkd AS (SELECT {k}v, row_number() OVER ({part}ORDER BY v) AS r, count(*) OVER ({part.strip()}) AS n FROM vals WHERE v IS NOT NULL),
ns AS (SELECT DISTINCT {k}n FROM rkd),
ks AS (SELECT {k}n, step, least(CAST(floor(0.95 * (n - 1)) AS BIGINT) + 1 + step, n) AS kth FROM ns, (VALUES (0), (1)) s(step)),
cand AS (SELECT n, kth, unnest(range(greatest(1, CAST(0.95 * n - 8 * sqrt(0.0475 * n) AS BIGINT) - 5),
  least(n, CAST(0.95 * n + 8 * sqrt(0.0475 * n) AS BIGINT) + 5) + 1)) AS c FROM (SELECT DISTINCT n, kth FROM ks)),
tails AS (SELECT n, kth, c, CASE WHEN c = n THEN 1.0 ELSE sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(c / n)
  + (n - i) * ln(greatest(1 - c / n, 1e-300)))) END AS tail FROM cand, LATERAL (SELECT unnest(range(kth, n + 1)) AS i) x GROUP BY n, kth, c),
rk AS (SELECT n, kth, min(c) FILTER (tail >= 0.025) AS lo, min(c) FILTER (tail >= 0.975) AS hi FROM tails GROUP BY n, kth),
pick AS (SELECT {k}n, step, l.v AS lo, h.v AS hi FROM ks JOIN rk USING (n, kth)
  JOIN (SELECT {k}r AS lo, v FROM rkd) l USING ({on}lo) JOIN (SELECT {k}r AS hi, v FROM rkd) h USING ({on}hi)),
ci AS (SELECT {k}min(lo) FILTER (step = 0) + (min(lo) FILTER (step = 1) - min(lo) FILTER (step = 0)) * any_value(0.95 * (n - 1) - floor(0.95 * (n - 1))) - 750 AS lo,
  min(hi) FILTER (step = 0) + (min(hi) FILTER (step = 1) - min(hi) FILTER (step = 0)) * any_value(0.95 * (n - 1) - floor(0.95 * (n - 1))) - 750 AS hi
  FROM pick {'GROUP BY ' + keys if keys else ''})"""


@query("a16_bootstrap_interval", f"""WITH {SQL_OPS}, vals AS (SELECT run_id, total_ms AS v FROM ops), {boot_sql('run_id', 'run_id, ')}
SELECT run_id, n, round(lo, 6) AS delta_low, round(hi, 6) AS delta_high, CASE WHEN hi <= 0 THEN 'meet-target' WHEN lo > 0 THEN 'above-target' ELSE 'insufficient-data' END AS inference
FROM ci JOIN ns USING (run_id)""")
def _(t):
    i = ev.bootstrap_interval(operations(t), "total_ms", 750.0, ["run_id"])
    return i.select("run_id", "n", r6("delta_low").alias("delta_low"), r6("delta_high").alias("delta_high"), "inference")


def binom(keys: str, minimum: int) -> str:
    return f"""
bt AS (SELECT *, lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.85) + (n - i) * ln(0.15) AS lp FROM kn, LATERAL (SELECT unnest(range(k + 1)) AS i) x),
bm AS (SELECT *, max(lp) OVER (PARTITION BY {keys}) AS mx FROM bt),
bp AS (SELECT {keys}, k, n, exp(any_value(mx)) * sum(exp(lp - mx)) AS p FROM bm GROUP BY ALL)"""


@query("a17_binomial_test", f"""WITH {SQL_OPS}, kn AS (SELECT method, count(*) AS n, count(*) FILTER (k >= 15) AS k FROM ops GROUP BY 1), {binom('method', 1)}
SELECT method, k AS success_count, n AS request_count, round(p, 6) AS p_value, CASE WHEN p < 0.05 THEN 'below-target' ELSE 'meet-target' END AS inference FROM bp""")
def _(t):
    c = operations(t).groupBy("method").agg(F.count("*").alias("n"), F.count_if(F.col("k") >= 15).alias("s"))
    b = ev.binomial_test(c, "s", "n", 0.85, ["method"], minimum=1)
    return b.withColumn("p_value", r6("p_value"))


@query("a18_p95_assessment", f"""WITH {SQL_OPS}, n AS (SELECT method, count(*) AS n FROM ops GROUP BY 1),
d AS (SELECT method, n, least(0.5, greatest(1 / n, 0.5 / sqrt(n))) AS d FROM n),
q AS (SELECT method, n, d, list(total_ms ORDER BY total_ms) AS v FROM ops JOIN d USING (method) GROUP BY ALL),
f AS (SELECT *, 0.95 * (n - 1) AS p0, greatest(0, 0.95 - d) AS q1, least(1, 0.95 + d) AS q2 FROM q),
x AS (SELECT *, v[1 + CAST(floor(p0) AS BIGINT)] * (1 - (p0 - floor(p0))) + v[1 + CAST(ceil(p0) AS BIGINT)] * (p0 - floor(p0)) AS s, q1 * (n - 1) AS p1, q2 * (n - 1) AS p2 FROM f),
y AS (SELECT *, v[1 + CAST(floor(p1) AS BIGINT)] * (1 - (p1 - floor(p1))) + v[1 + CAST(ceil(p1) AS BIGINT)] * (p1 - floor(p1)) AS lo,
  v[1 + CAST(floor(p2) AS BIGINT)] * (1 - (p2 - floor(p2))) + v[1 + CAST(ceil(p2) AS BIGINT)] * (p2 - floor(p2)) AS hi FROM x),
z AS (SELECT *, sqrt(0.95 * 0.05 / n * pow((hi - lo) / (q2 - q1), 2)) AS se FROM y)
SELECT method, n, round(s, 6) AS sample_p95, round(se, 6) AS standard_error_ms, round((s - 9300) / se, 6) AS z_score, s > 9300 AS threshold_breached,
 CASE WHEN s <= 9300 THEN 'meets-target' WHEN (s - 9300) / se >= 1.6448536269514722 THEN 'violates-target' ELSE 'inconclusive' END AS inference FROM z""")
def _(t):
    a = ev.assess_p95(operations(t), "total_ms", 9300.0, ["method"], minimum=1)
    return a.select("method", "n", *[r6(c).alias(c) for c in ("sample_p95", "standard_error_ms", "z_score")],
                    "threshold_breached", "inference")


@query("a19_resolved_method", f"""WITH {SQL_OPS}, c AS (SELECT run_id, method, count(*) AS n, min(op_id) AS f FROM ops WHERE op_id % 5 <> 0 GROUP BY 1, 2)
SELECT run_id, method FROM c QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY n DESC, f) = 1""")
def _(t):
    key = F.element_at(F.array(*[F.lit(k) for k in fv.METHOD_KEYS]), (F.col("op_id") % 4 + 1).cast("int"))
    meta = F.when(F.col("op_id") % 5 == 0, '{"method":"  "}').otherwise(
        F.concat(F.lit('{"'), key, F.lit('":" '), "method", F.lit(' "}')))
    ops = operations(t).withColumn("meta", F.parse_json(meta))
    chain = F.coalesce(*[F.nullif(F.trim(F.try_variant_get("meta", f"$.{k}", "string")), F.lit("")) for k in fv.METHOD_KEYS])
    return ev.resolve_run_method(ops, chain, "op_id", ["run_id"])


def usage_json(t):
    k, v = F.col("k").cast("string"), F.col("total_ms").cast("string")
    shape = F.col("op_id") % 3
    nested = F.concat(
        F.lit('{"usage":{"components":[{"name":"a","usage":{"tokensIn":'), k, F.lit(',"tokensOut":"'), k,
        F.lit('","apiCalls":1}},{"metrics":{"cpuMs":'), v, F.lit('}}],"ramMbSeconds":0.5}}'))
    flat = F.concat(F.lit('{"llm":{"usageMetadata":{"promptTokenCount":'), k, F.lit(',"candidatesTokenCount":'), k,
                    F.lit(',"flag":true}},"resources":{"totals":{"cpu_time":'), v, F.lit('},"ignored":{"cpuMs":5}}}'))
    return operations(t).withColumn("meta", F.when(shape == 0, nested).when(shape == 1, flat).otherwise(
        '{"components":[{"requests":2,"usage":{}}],"note":"cpuMs"}'))


USAGE = """u AS (
 SELECT op_id, method, 'tokensIn' AS metric, k AS value FROM ops WHERE op_id % 3 IN (0, 1)
 UNION ALL SELECT op_id, method, 'tokensOut', k FROM ops WHERE op_id % 3 IN (0, 1)
 UNION ALL SELECT op_id, method, 'apiCalls', 1 FROM ops WHERE op_id % 3 = 0
 UNION ALL SELECT op_id, method, 'cpuMs', total_ms FROM ops WHERE op_id % 3 IN (0, 1)
 UNION ALL SELECT op_id, method, 'ramMbSeconds', 0.5 FROM ops WHERE op_id % 3 = 0
 UNION ALL SELECT op_id, method, 'apiCalls', 2 FROM ops WHERE op_id % 3 = 2)"""


@query("a20_usage_totals", f"WITH {SQL_OPS}, {USAGE} SELECT method, metric, round(sum(value), 4) AS total FROM u GROUP BY 1, 2")
def _(t):
    src = usage_json(t)
    flat = flatten_usage(src, "op_id", "meta", ["method"])
    return ev.usage_totals(flat, ["method"]).withColumn("total", F.round("total", 4))


@query("u1_flatten_usage", f"WITH {SQL_OPS}, {USAGE} SELECT op_id, metric, round(CAST(value AS DOUBLE), 6) AS value FROM u")
def _(t):
    flat = flatten_usage(usage_json(t), "op_id", "meta")
    return flat.where("metric is not null").select("op_id", "metric", r6("value").alias("value"))


@query("u1_nested_usage", f"""WITH {SQL_OPS}, n AS (SELECT op_id, op_id % 4 AS s, k, total_ms FROM ops), u AS (
 SELECT op_id, '$.usage.summary.total.aggregate[0].metricSet.resources.tokensIn' AS path, 'tokensIn' AS metric, CAST(k AS DOUBLE) AS value FROM n WHERE s IN (0, 1)
 UNION ALL SELECT op_id, '$.usage.summary.total.aggregate[1].items[0].tokens_out', 'tokensOut', k FROM n WHERE s IN (0, 1)
 UNION ALL SELECT op_id, '$.details.components[0].usage.summary.cpuTime', 'cpuMs', total_ms FROM n WHERE s = 1
 UNION ALL SELECT op_id, '$.details.components[1].requests', 'apiCalls', 3 FROM n WHERE s = 1
 UNION ALL SELECT op_id, '$.usageMetadata.components[0].usage.total.promptTokens', 'tokensIn', k FROM n WHERE s = 2)
SELECT op_id, path, metric, round(value, 6) AS value FROM u""")
def _(t):
    k, v = F.col("k").cast("string"), F.col("total_ms").cast("string")
    deep = F.concat(
        F.lit('"usage":{"summary":{"total":{"aggregate":[{"metricSet":{"resources":{"tokensIn":"'), k, F.lit('","plain":{"tokensIn":5},"flag":true}}},'),
        F.lit('{"items":[{"tokens_out":'), k, F.lit('},7,null]}]}}}'))
    listed = F.concat(F.lit('"details":{"components":[{"usage":{"summary":{"cpuTime":'), v, F.lit('}},"requests":9},{"usage":{"tokensIn":"many"},"requests":3}]}'))
    other = F.concat(F.lit('{"usageMetadata":{"components":[{"usage":{"total":{"promptTokens":'), k, F.lit('}}}]},"llm":{"usageMetadata":{"promptTokens":1}}}'))
    shape = F.col("op_id") % 4
    meta = F.when(shape == 0, F.concat(F.lit("{"), deep, F.lit("}"))).when(shape == 1, F.concat(F.lit("{"), deep, F.lit(","), listed, F.lit("}"))).when(
        shape == 2, other).otherwise('[{"usage":{"tokensIn":1}}]')
    flat = flatten_usage(operations(t).withColumn("meta", meta), "op_id", "meta")
    return flat.where("metric is not null and value is not null").select("op_id", "path", "metric", r6("value").alias("value"))


@query("a25_word_spans", """
WITH w AS (SELECT user_id, value AS s, value + event_id % 5 AS e, event_id % 900000 AS m FROM events)
SELECT user_id, round((max(e) - min(s)) * 1000, 4) AS span_ms, round(greatest((max(e) - min(s)) * 1000, max(m)), 4) AS duration_ms FROM w GROUP BY 1""")
def _(t):
    w = t.events.select("user_id", F.col("value").alias("start"), (F.col("value") + F.col("event_id") % 5).alias("end"),
                        (F.col("event_id") % 900000).alias("m"))
    s = ev.word_span(w, "user_id", measured=F.col("m"))
    return s.select("user_id", F.round("span_ms", 4).alias("span_ms"), F.round("duration_ms", 4).alias("duration_ms"))


@query("a26_progress", f"""WITH {SQL_OPS} SELECT op_id, count(*) OVER w AS processed, count(*) FILTER (status = 'success') OVER w AS success_so_far,
 count(*) FILTER (status = 'failed') OVER w AS failed_so_far, count(*) FILTER (status = 'error') OVER w AS error_so_far FROM ops WINDOW w AS (ORDER BY op_id ROWS UNBOUNDED PRECEDING)""")
def _(t):
    p = ev.progress(operations(t), "op_id")
    return p.select("op_id", *[F.col(c).cast("long").alias(c) for c in
                               ("processed", "success_so_far", "failed_so_far", "error_so_far")])


def report_sql(key: str, bad: str = "status <> 'success'") -> str:
    return f"""
o AS (SELECT {key} AS grp, {bad} AS bad, CASE WHEN total_ms <= 10000 THEN total_ms END AS v FROM ops),
base AS (SELECT grp, count(*) AS request_count, count(*) FILTER (bad) AS mismatch_count, count(v) AS considered_count,
  round(avg(v), 6) AS mean_response_ms, round(quantile_cont(v, 0.95), 6) AS p95_ms FROM o GROUP BY 1),
kn AS (SELECT grp, request_count AS n, request_count - mismatch_count AS k FROM base), {binom('grp', 1000)},
vals AS (SELECT grp, v FROM o), {boot_sql('grp', 'grp, ')},
rep AS (SELECT grp, request_count, considered_count, mean_response_ms, p95_ms, round((request_count - mismatch_count) / request_count, 6) AS accuracy,
  CASE WHEN request_count >= 1000 THEN round(p, 6) END AS p_value,
  CASE WHEN request_count < 1000 THEN 'insufficient-data' WHEN p < 0.05 THEN 'below-target' ELSE 'meet-target' END AS accuracy_inference,
  CASE WHEN request_count >= 1000 THEN round(lo, 6) END AS ci_low_ms, CASE WHEN request_count >= 1000 THEN round(hi, 6) END AS ci_high_ms,
  CASE WHEN request_count < 1000 THEN 'insufficient-data' WHEN hi <= 0 THEN 'meet-target' WHEN lo > 0 THEN 'above-target' ELSE 'insufficient-data' END AS p95_inference
FROM base JOIN bp USING (grp) JOIN ci USING (grp))"""


REPORT = ["request_count", "considered_count", "accuracy_inference", "p95_inference"]
REPORT_FLOATS = ["mean_response_ms", "p95_ms", "accuracy", "p_value", "ci_low_ms", "ci_high_ms"]


@query("x2_import_summary", f"""WITH {SQL_OPS}, {report_sql('0', "(op_id % 7 = 0 OR status <> 'success')")},
ex AS (SELECT count(*) FILTER (op_id % 7 = 0) AS stored_mismatch_rows, count(*) FILTER (op_id % 7 = 0) AS stored_mismatches,
  CAST(sum(k) AS DOUBLE) AS tokens_in, CAST(count(*) AS DOUBLE) AS api_calls FROM ops),
me AS (SELECT method FROM (SELECT method, count(*) AS n, min(op_id) AS f FROM ops GROUP BY 1) ORDER BY n DESC, f LIMIT 1)
SELECT rep.* EXCLUDE (grp), ex.*, me.method FROM rep, ex, me""")
def _(t):
    found = F.when(F.col("op_id") % 7 == 0, '[{"label":"To","expected":"Spain","actual":"Italy"}]').when(F.col("op_id") % 7 == 1, "[]").otherwise("null")
    meta = F.concat(F.lit('{"method":"'), "method", F.lit('","expectedValueMismatches":'), found,
                    F.lit(',"usage":{"tokensIn":'), F.col("k").cast("string"), F.lit(',"apiCalls":1}}'))
    r = ev.import_summary(operations(t).withColumn("metadata", meta), "op_id", "metadata", "op_id")
    return r.select(*REPORT, *[r6(c).alias(c) for c in REPORT_FLOATS], "stored_mismatch_rows", "stored_mismatches", "method",
                    F.col("tokensIn").alias("tokens_in"), F.col("apiCalls").alias("api_calls"))


@query("x4_method_comparison", f"WITH {SQL_OPS}, {report_sql('method')} SELECT * FROM rep")
def _(t):
    r = ev.replay_report(operations(t).withColumn("grp", F.col("method")), ["grp"])
    return r.select("grp", *REPORT, *[r6(c).alias(c) for c in REPORT_FLOATS])


@query("x3_full_job_summary", f"""WITH {SQL_OPS}, o AS (SELECT *, run_id % 10 AS job, op_id % 4 + 1 AS tries FROM ops),
g AS (SELECT job, {COUNTS}, round(sum(total_ms), 4) AS processing_ms, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000 AS duration_ms, {PCT.format('total_ms')}, count(*) FILTER (total_ms >= 5000) AS slow,
  CAST(sum(CASE WHEN tries <= 3 THEN tries - 1 ELSE 2 END) AS BIGINT) AS retry_count, count(*) FILTER (tries > 3 OR status = 'error') AS permanent_failures,
  max(CASE WHEN op_id % 13 <> 0 THEN total_ms / 100 END) AS peak_cpu, max(k * 50.0) AS peak_memory_mb, count(*) FILTER ((op_id % 13 <> 0 AND total_ms / 100 >= 70) OR k * 50.0 >= 4096) AS throttle_count FROM o GROUP BY 1),
ch AS (SELECT job, moment, sum(d) AS d FROM (SELECT job, epoch_us(ts) AS moment, 1 AS d FROM o UNION ALL SELECT job, epoch_us(ts) + CAST(floor(total_ms) AS BIGINT) * 1000000, -1 FROM o) GROUP BY 1, 2),
pk AS (SELECT job, CAST(max(n) AS BIGINT) AS peak_concurrency FROM (SELECT job, sum(d) OVER (PARTITION BY job ORDER BY moment ROWS UNBOUNDED PRECEDING) AS n FROM ch) GROUP BY 1)
SELECT g.*, peak_concurrency, CASE WHEN error_count > 0 THEN 'error' WHEN failed_count > 0 THEN 'partial' ELSE 'success' END AS status FROM g JOIN pk USING (job)""")
def _(t):
    # spans in seconds, so that the requests of a job overlap
    ops = operations(t).withColumns({"job": F.col("run_id") % 10, "ended": F.timestamp_micros(F.unix_micros(F.col("ts").cast("timestamp")) + F.floor("total_ms") * 1000000)})
    tries = F.col("op_id") % 4 + 1
    attempts = ops.select("job", F.col("op_id").alias("request"), "status", tries.alias("_n"), F.explode(F.sequence(F.lit(1), tries.cast("int"))).alias("attempt")).withColumn(
        "status", F.when(F.col("attempt") < F.col("_n"), "error").otherwise(F.col("status")))
    samples = ops.select("job", F.when(F.col("op_id") % 13 != 0, F.col("total_ms") / 100).alias("cpu"), (F.col("k") * 50.0).alias("memory_mb"))
    s = ev.job_summary(ops, attempts, samples, ["job"], 3, 70, 4096)
    counts = ["job", "total_requests", "success_count", "failed_count", "error_count", "duration_ms", "retry_count", "permanent_failures", "peak_cpu", "peak_memory_mb", "throttle_count", "peak_concurrency", "status"]
    return s.select(*counts, F.round("processing_ms", 4).alias("processing_ms"), F.col("latency_6").alias("slow"), *[r6(n).alias(n) for n, _q in fv.PERCENTILES])


@query("x3_job_summary", f"""WITH {SQL_OPS}, g AS (SELECT run_id % 10 AS job, {COUNTS}, round(sum(total_ms), 4) AS processing_ms, {PCT.format('total_ms')},
  count(*) FILTER (total_ms >= 5000) AS slow, max(total_ms) AS peak_cpu FROM ops GROUP BY 1)
SELECT *, CASE WHEN error_count > 0 THEN 'error' WHEN failed_count > 0 THEN 'partial' ELSE 'success' END AS status FROM g""")
def _(t):
    ops = operations(t).withColumn("job", F.col("run_id") % 10)
    jobs = ev.job_totals(ops, ["job"]).withColumn("processing_ms", F.round("processing_ms", 4)).drop(
        "started_at", "finished_at", "duration_ms")
    pct = ev.latency_percentiles(ops, by=["job"]).select("job", *[r6(n).alias(n) for n, _q in fv.PERCENTILES])
    slow = ev.latency_histogram(ops, by=["job"]).where("bucket_ord = 6").select("job", F.col("n").alias("slow"))
    res = ev.resource_rollup(ops, 90, 4096, ["job"], "total_ms", "k").select("job", "peak_cpu")
    return jobs.join(pct, "job").join(slow, "job").join(res, "job")
