"""S5, S9, S10, S14, S15 over orders, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from wishloom.functions import fixed_values as fv
from wishloom.operators import evaluation as ev
from wishloom.sources import logs
from wishloom.sources import readers as rd
from wishloom.sources import sinks as sk

from .embedding_queries import CENTROIDS
from .frames import SQL_OPS, operations
from .registry import query


@query("s5_booking_types", """SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_custkey % 13 ELSE -1 END AS duration, CAST(NULL AS INT) AS rooms, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_custkey % 4 END AS adults, 1 AS children, 0 AS infants, CAST(NULL AS VARCHAR) AS end_date,
 CASE WHEN o_orderkey % 4 <> 3 THEN strftime(o_orderdate, '%Y-%m-%d') END AS start_date, o_orderpriority || ' #' || o_orderkey AS airport, 'A,B c,' || o_custkey % 5 AS destinations FROM orders""")
def _(t):
    k, d = F.col("o_orderkey"), F.col("o_orderdate")
    date = (F.when(k % 4 == 0, F.date_format(d, " M/d/yyyy ")).when(k % 4 == 1, F.date_format(d, "yyyy-M-d"))
            .when(k % 4 == 2, F.date_format(d, "MM/dd/yyyy")).otherwise("soon"))
    raw = t.orders.select(
        F.when(k % 5 == 0, "many").otherwise(F.concat(F.lit(" "), F.col("o_custkey") % 13)).alias("duration"), F.lit("").alias("rooms"),
        F.when(k % 3 == 0, "x").otherwise((F.col("o_custkey") % 4).cast("string")).alias("adults"), F.lit("1").alias("children"), F.lit("").alias("infants"),
        date.alias("startDepartureDate"), F.lit("").alias("endDepartureDate"), F.concat("o_orderpriority", F.lit(" #"), k, F.lit(" ")).alias("from"),
        F.concat(F.lit("A, B\nc,, "), F.col("o_custkey") % 5).alias("to"))
    return rd.read_bookings(t.spark, _written(t, "booking-export", raw)).select(F.coalesce("duration", F.lit(-1)).alias("duration"), "rooms", "adults", "children", "infants", "start_date", "end_date", "airport", F.array_join("destinations", ",").alias("destinations"))


@query("s9_request_batch", """SELECT conv_id, turn, 0 AS pos, md5(trim(text)) AS text, 'holiday' AS mode, CASE WHEN trim(text) = '' THEN 'Batch entries provided as strings must be non-empty' END AS request_error FROM conversations
UNION ALL SELECT conv_id, turn, 1, md5(role), role, NULL FROM conversations UNION ALL SELECT conv_id, turn, 2, NULL, 'holiday', 'Batch entries must include a ''text'' field' FROM conversations""")
def _(t):
    text = F.regexp_extract(F.to_json(F.struct(F.col("text").alias("c"))), r'(?s)^\{"c":(.*)\}$', 1)
    js = F.concat(F.lit("["), text, F.lit(',{"text":" '), "role", F.lit('","mode":"'), "role", F.lit('"},{"mode":""}]'))
    r = rd.parse_request_batch(t.conversations.select("conv_id", "turn", js.alias("js")), "js", default_mode="holiday")
    return r.select("conv_id", "turn", "pos", F.md5("text").alias("text"), "mode", "request_error")


@query("s10_batch_mode", "SELECT conv_id, CASE WHEN count(DISTINCT role) = 1 THEN max(role) END AS mode FROM conversations GROUP BY 1")
def _(t):
    return t.conversations.groupBy("conv_id").agg(rd.batch_mode(None, F.col("role")).alias("mode"))


DEC = "CAST(CAST(round(CAST({0} AS DECIMAL(28, 9)), 2) AS DECIMAL(28, 2)) AS VARCHAR)"


AUDIT_NAMES = ["stamp", "user_input", "request_type", "method", "mode", "status", "language_ms", "total", "language", "extraction", "mapping", "validation",
               "transcription", "network", "output"]
AUDIT_SQL = f"""WITH {SQL_OPS} SELECT strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z' AS stamp, 'op ' || op_id || ', "quoted"' || chr(10) || 'line' AS user_input, 'Text' AS request_type, method, 'holiday' AS mode,
 upper(left(status, 1)) || substr(status, 2) AS status, {DEC.format('k')} AS language_ms, {DEC.format('total_ms')} AS total, 'en (' || {DEC.format('k / 100')} || ')' AS language, '' AS extraction,
 '' AS mapping, '' AS validation, '' AS transcription, CASE WHEN op_id % 2 = 0 THEN {DEC.format('k * 2')} ELSE '' END AS network, '{{"k":' || k || '}}' AS output FROM ops"""


def audit_frame(ops):
    network = F.when(F.col("op_id") % 2 == 0, F.create_map(F.lit(fv.AUDIT_TIMINGS["network"][0]), F.col("k").cast("double") * 2)).otherwise(F.create_map().cast("map<string,double>"))
    return sk.audit_rows(ops.select(
        "ts", F.concat(F.lit("op "), "op_id", F.lit(', "quoted"\nline')).alias("text"), F.lit("Text").alias("request_type"), "method", F.lit("holiday").alias("mode"), "status",
        F.map_concat(F.create_map(F.lit("languageMs"), F.col("k").cast("double"), F.lit("total"), F.col("total_ms")), network).alias("timings"),
        F.lit("en").alias("language"), (F.col("k") / 100).alias("confidence"), F.struct("k").alias("output")))


@query("s14_audit_log", AUDIT_SQL)
def _(t):
    from wishloom.plans.scale import scratch_folder

    path, ops = scratch_folder(t.spark, "audit"), operations(t)
    for part in (ops.where("op_id % 2 = 0"), ops.where("op_id % 2 <> 0")):  # a log grows by appends
        sk.write_audit_log(audit_frame(part), path)
    return logs.read_log(t.spark, path, AUDIT_NAMES)


@query("d3_streamed_audit_log", AUDIT_SQL)
def _(t):
    from wishloom.plans.scale import scratch_folder

    class Live:
        events = t.feed("events")

    path = scratch_folder(t.spark, "audit-stream")
    logs.stream_log(audit_frame(operations(Live)), path, fv.AUDIT_LOG_HEADER, scratch_folder(t.spark, "audit-stream-state")).awaitTermination()
    return logs.read_log(t.spark, path, AUDIT_NAMES)


SUMMARY_NAMES = ["stamp", "mode", "status", "requests", "succeeded", "failed", "errored", "duration", "processing", "p50", "p95", "peak_cpu", "peak_memory", "throttled", "breaches", "started", "finished"]


@query("s15_summary_log", f"""WITH {SQL_OPS}, g AS (SELECT run_id, count(*) AS n, count(*) FILTER (status = 'success') AS s, count(*) FILTER (status = 'error') AS e, count(*) FILTER (status = 'failed') AS f, max(total_ms) AS pk,
 sum(CAST(total_ms AS DECIMAL(28, 9))) AS pr, quantile_cont(total_ms, 0.5) AS p50, quantile_cont(total_ms, 0.95) AS p95, max(k) AS mem, count(*) FILTER (total_ms >= 9000) AS b, min(ts) AS a, max(ts) AS z FROM ops GROUP BY 1)
SELECT strftime(z, '%Y-%m-%dT%H:%M:%S.%g') AS stamp, 'run ' || run_id AS mode, CASE WHEN e > 0 THEN 'error' WHEN f > 0 THEN 'partial' ELSE 'success' END AS status, CAST(n AS VARCHAR) AS requests, CAST(s AS VARCHAR) AS succeeded,
 CAST(f AS VARCHAR) AS failed, CAST(e AS VARCHAR) AS errored, ((epoch_us(z) - epoch_us(a) + 5) // 1000) || '.' || lpad(CAST((epoch_us(z) - epoch_us(a) + 5) // 10 % 100 AS VARCHAR), 2, '0') AS duration, CAST(CAST(round(pr, 2) AS DECIMAL(28, 2)) AS VARCHAR) AS processing,
 {DEC.format('p50')} AS p50, {DEC.format('p95')} AS p95, {DEC.format('pk')} AS peak_cpu, {DEC.format('mem')} AS peak_memory, CAST(b AS VARCHAR) AS throttled, CASE WHEN b > 0 THEN '["cpu"]' ELSE '' END AS breaches,
 strftime(a, '%Y-%m-%dT%H:%M:%S.%g') AS started, strftime(z, '%Y-%m-%dT%H:%M:%S.%g') AS finished FROM g""")
def _(t):
    from wishloom.plans.scale import scratch_folder

    ops = operations(t)
    exact = ops.groupBy("run_id").agg(F.sum(F.col("total_ms").cast("decimal(28,9)")).alias("processing_ms"))
    jobs = ev.job_totals(ops, ["run_id"]).drop("processing_ms").join(exact, "run_id").join(ev.latency_percentiles(ops, by=["run_id"]).drop("n"), "run_id").join(
        ev.resource_rollup(ops, 9000, 1e12, ["run_id"], "total_ms", "k"), "run_id")
    rows = jobs.withColumns({"mode": F.concat(F.lit("run "), "run_id"),
                             "breaches": F.array_compact(F.array(F.when(F.col("cpu_breaches") > 0, "cpu")))})
    path = scratch_folder(t.spark, "summary")
    sk.write_summary_log(sk.summary_rows(rows), path)
    return logs.read_log(t.spark, path, SUMMARY_NAMES)


@query("s16_source_digest", """SELECT o_orderpriority AS source, sha256(string_agg(o_orderkey || ',' || o_custkey || chr(10), '' ORDER BY o_orderkey)) AS source_sha256,
 CAST(sum(length(o_orderkey || ',' || o_custkey) + 1) AS BIGINT) AS length, count(*) AS row_count, 1 AS schema_version FROM orders GROUP BY 1""")
def _(t):
    from wishloom.plans.scale import scratch_folder

    # one booking file per priority, as an export would leave them
    path = scratch_folder(t.spark, "bookings")
    lines = t.orders.select("o_orderpriority", "o_orderkey", F.concat_ws(",", "o_orderkey", "o_custkey").alias("value"))
    lines.repartition("o_orderpriority").sortWithinPartitions("o_orderpriority", "o_orderkey").drop("o_orderkey").write.partitionBy("o_orderpriority").text(path)
    digests = logs.file_digest(t.spark, path).withColumn("source", F.url_decode(F.regexp_extract("path", "o_orderpriority=([^/]*)/", 1)))
    meta = sk.statistics_metadata(t.orders.withColumn("source", F.col("o_orderpriority")), digests)
    return meta.select("source", "source_sha256", "length", "row_count", "schema_version")


# -- sources and sinks as round trips: written from a table, read back ---------


def _written(t, name, df):
    from wishloom.plans.scale import scratch_folder

    path = scratch_folder(t.spark, name)
    sk.write_csv(df, path, "overwrite")
    return path


@query("s1_catalogue_source", "SELECT p_brand AS filter_id, 'Brand \"' || p_brand || '\", all' AS filter_label, CAST(p_partkey AS VARCHAR) AS option_id, p_name AS option_label, p_name || ';' || lower(p_type) AS synonyms FROM part")
def _(t):
    raw = t.part.select(F.concat(F.lit(" "), "p_brand").alias("filterId"), F.concat(F.lit('Brand "'), "p_brand", F.lit('", all')).alias("filterName"),
                        F.col("p_partkey").alias("optionId"), F.concat("p_name", F.lit(" ")).alias("optionName"),
                        F.concat("p_name", F.lit("|\n |"), F.lower("p_type")).alias("synonyms"))
    c = rd.read_catalogue(t.spark, _written(t, "catalogue", raw))
    return c.select("filter_id", "filter_label", "option_id", "option_label", F.array_join("synonyms", ";").alias("synonyms"))


@query("s3_utterance_source", "SELECT md5(trim(text, E' \\n\\t\\r')) AS utterance, 'f' || conv_id AS filter_id, CAST(turn AS VARCHAR) AS option_id FROM conversations")
def _(t):
    clean = F.regexp_replace("text", r"^\s+|\s+$", "")
    raw = t.conversations.select(clean.alias("Utterance"), F.concat(F.lit(" f"), "conv_id").alias("filterId"), F.lit("").alias("filterName"),
                                 F.concat("turn", F.lit(" ")).alias("optionId"), F.lit("x").alias("optionName"))
    u = rd.read_utterances(t.spark, _written(t, "utterances", raw))
    return u.select(F.md5("Utterance").alias("utterance"), F.col("filterId").alias("filter_id"), F.col("optionId").alias("option_id"))


@query("s4_synonym_input", "SELECT CAST(p_partkey AS VARCHAR) AS id, p_brand AS filter_id, p_name AS option_name FROM part")
def _(t):
    raw = t.part.select(F.col("p_partkey").alias("ID"), F.lit("Brand").alias("filterName"), F.concat("p_brand", F.lit(" ")).alias("filterId"),
                        F.col("p_partkey").alias("optionId"), "p_name").withColumnRenamed("p_name", "optionName")
    r = rd.read_synonym_input(t.spark, _written(t, "synonym-input", raw))
    return r.select(F.col("ID").alias("id"), F.col("filterId").alias("filter_id"), F.col("optionName").alias("option_name"))


@query("s13_replay_source", "SELECT o_orderpriority || '#' || o_orderkey AS user_input, 'To: \"' || o_custkey || '\"' AS expected_values FROM orders WHERE o_orderkey % 5 <> 0")
def _(t):
    k = F.col("o_orderkey")
    raw = t.orders.select(F.when(k % 5 == 0, "  ").otherwise(F.concat("o_orderpriority", F.lit("#"), k)).alias("User input"),
                          F.concat(F.lit('To: "'), "o_custkey", F.lit('"')).alias("Expected values"))
    return rd.read_replay(t.spark, _written(t, "replay", raw))


@query("s17_scored_dataset", f"""WITH {CENTROIDS} SELECT CAST(vec_id AS VARCHAR) AS "Utterance", 'f' || target % 3 AS "filterId", 'Filter, ' || target % 3 AS "filterName", 'o' || target AS "optionId", 'Option "' || target || '"' AS "optionName",
 round(target_score, 6) AS target_similarity, 'o' || top_opt AS top_option_id, 'Option "' || top_opt || '"' AS top_option_name, round(top_score, 6) AS top_similarity, round(best_non_target, 6) AS best_non_target_similarity,
 round(target_score - best_non_target, 6) AS similarity_gap, target_rank, top_opt = target AS is_target_top_match FROM best""")
def _(t):
    from wishloom.plans.scale import scratch_folder

    from .embedding_queries import scored

    number = lambda c: F.substring(c, 2, 9).cast("int")
    named = lambda c: F.concat(F.lit('Option "'), number(c).cast("string"), F.lit('"'))
    third = (number(F.col("target")) % 3).cast("string")
    rows = scored(t).select(
        F.col("vec_id").alias("Utterance"), F.concat(F.lit("f"), third).alias("filterId"), F.concat(F.lit("Filter, "), third).alias("filterName"),
        F.col("target").alias("optionId"), named(F.col("target")).alias("optionName"), F.col("target_score").alias("target_similarity"),
        F.col("top_option").alias("top_option_id"), named(F.col("top_option")).alias("top_option_name"), F.col("top_score").alias("top_similarity"),
        F.col("best_non_target").alias("best_non_target_similarity"), (F.col("target_score") - F.col("best_non_target")).alias("similarity_gap"),
        "target_rank", (F.col("top_option") == F.col("target")).alias("is_target_top_match"))
    path = scratch_folder(t.spark, "scored")
    sk.write_dataset(rows, path, fv.SCORED_COLUMNS)
    back = rd.read_scored(t.spark, path)
    return back.withColumns({c: F.round(c, 6) for c in ("target_similarity", "top_similarity", "best_non_target_similarity", "similarity_gap")})


@query("s19_raw_operations", f"WITH {SQL_OPS} SELECT op_id, run_id, status FROM ops")
def _(t):
    from wishloom.plans.scale import scratch_folder

    path = scratch_folder(t.spark, "operations")
    sk.persist_operations(operations(t), path)
    return t.spark.read.parquet(path).select("op_id", F.col("run_id").cast("long").alias("run_id"), "status")
