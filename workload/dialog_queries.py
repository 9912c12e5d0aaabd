"""D1-D5, W7 over conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from wishloom.operators import dialog as dg
from wishloom.plans.scale import scratch_folder
from wishloom.streaming import feeds, sessions

from .frames import SQL_OPS, operations
from .registry import Tables, query
from .statistics_queries import BUCKETS

SQL_TURNS = """turns AS (SELECT conv_id, turn, role, text,
  CASE WHEN turn % 4 = 1 THEN ['A' || conv_id % 3] ELSE [] END AS frm, CASE turn % 3 WHEN 0 THEN ['D' || conv_id % 5, 'D' || turn % 4] WHEN 1 THEN ['D' || turn] ELSE [] END AS dst,
  CASE WHEN turn % 5 = 2 AND conv_id % 2 = 0 THEN ['2026-01-0' || 1 + turn % 9] ELSE [] END AS dep, CASE WHEN turn % 4 = 2 THEN '20' || (10 + turn) WHEN turn % 4 = 3 THEN '' END AS dur,
  CASE WHEN turn % 3 = 1 THEN conv_id % 12 END AS ad, CASE WHEN turn % 3 = 1 THEN 1 END AS na, CASE WHEN turn % 6 = 5 THEN 2 END AS rm, CASE WHEN turn % 2 = 0 THEN 'l' || conv_id % 3 END AS lang FROM conversations)"""


def turns(t, source=None):
    c, n = F.col("conv_id"), F.col("turn")
    s = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    none = F.array().cast("array<string>")
    return (source if source is not None else t.conversations).select(
        c.cast("string").alias("session"), "turn", "role", "text",
        F.when(n % 4 == 1, F.array(s("A", c % 3))).otherwise(none).alias("from_codes"),
        F.when(n % 3 == 0, F.array(s("D", c % 5), s("D", n % 4))).when(n % 3 == 1, F.array(s("D", n))).otherwise(none).alias("to_ids"),
        F.when((n % 5 == 2) & (c % 2 == 0), F.array(s("2026-01-0", 1 + n % 9))).otherwise(none).alias("departure_dates"),
        F.when(n % 4 == 2, s("20", 10 + n)).when(n % 4 == 3, "").alias("duration_id"),
        F.when(n % 3 == 1, c % 12).cast("int").alias("adults"), F.when(n % 3 == 1, 1).alias("non_adults"),
        F.when(n % 6 == 5, 2).alias("rooms"), F.when(n % 2 == 0, s("l", c % 3)).alias("language"))


def _firsts(col, name):
    return f"""{name}0 AS (SELECT conv_id, turn, unnest({col}) AS v, unnest(range(len({col}))) AS p FROM turns),
{name} AS (SELECT conv_id, string_agg(v, ',' ORDER BY f) AS l FROM (SELECT conv_id, v, min(turn * 1000 + p) AS f FROM {name}0 GROUP BY 1, 2) GROUP BY 1)"""


FOLD = f"""WITH {SQL_TURNS}, {_firsts('frm', 'ff')}, {_firsts('dst', 'dd')},
sc AS (SELECT conv_id, count(*) AS turns, arg_max(lang, turn) FILTER (lang IS NOT NULL) AS language, coalesce(array_to_string(arg_max(dep, turn) FILTER (len(dep) > 0), ','), '') AS departure,
  coalesce(arg_max(dur, turn) FILTER (dur <> ''), '2007') AS duration_id, arg_max(ad, turn) FILTER (ad IS NOT NULL) AS a0, arg_max(na, turn) FILTER (na IS NOT NULL) AS n0, coalesce(arg_max(rm, turn) FILTER (rm IS NOT NULL), 1) AS rooms FROM turns GROUP BY 1),
fo AS (SELECT sc.*, coalesce(a0, 2) AS adults, coalesce(n0, 0) AS non_adults, coalesce(ff.l, '') AS from_codes, coalesce(dd.l, '') AS to_ids FROM sc LEFT JOIN ff USING (conv_id) LEFT JOIN dd USING (conv_id)),
er AS (SELECT *, CASE WHEN departure = '' THEN 'Departure date is required' WHEN to_ids = '' THEN 'Destination is required'
   WHEN NOT (duration_id BETWEEN '2002' AND '2014' OR duration_id = '2099') THEN 'Duration is not supported' WHEN adults < 1 THEN 'At least one adult is required' WHEN adults > 9 THEN 'Too many adults requested' END AS error FROM fo)
"""


@query("d1_session_fold", f"""{FOLD} SELECT CAST(conv_id AS VARCHAR) AS session, turns, language, from_codes, to_ids, departure, duration_id, adults, non_adults, rooms, error,
 CASE WHEN error IS NULL THEN 'success' ELSE 'clarification' END AS status, CASE WHEN error LIKE '%date%' THEN 'departureDate' WHEN error LIKE 'Duration%' THEN 'durationId' WHEN error LIKE '%adult%' THEN 'party' WHEN error IS NOT NULL THEN 'general' END AS asks FROM er""")
def _(t):
    o = dg.outcome(dg.fold(turns(t)))
    j = lambda c: F.array_join(c, ",")
    return o.select("session", "turns", "language", j("from_codes").alias("from_codes"), j("to_ids").alias("to_ids"), j("departure_dates").alias("departure"),
                    "duration_id", F.col("party.adults").alias("adults"), F.col("party.nonAdults").alias("non_adults"), "rooms", "error", "status",
                    F.col("prompt.parameter").alias("asks"))


@query("d1_fold_with_defaults", f"""WITH {SQL_TURNS} SELECT CAST(conv_id AS VARCHAR) AS session, coalesce(nullif(arg_max(coalesce(dur, ''), turn), ''), '2007') AS duration_id, arg_max(coalesce(ad, 2), turn) AS adults, arg_max(coalesce(na, 0), turn) AS non_adults, arg_max(coalesce(rm, 1), turn) AS rooms FROM turns GROUP BY 1""")
def _(t):
    f = dg.fold(turns(t), defaults_override=True)
    return f.select("session", "duration_id", F.col("party.adults").alias("adults"), F.col("party.nonAdults").alias("non_adults"), "rooms")


@query("d2_turn_metadata", f"""WITH {SQL_TURNS}, w AS (SELECT conv_id, turn, count(*) FILTER (role = 'user') OVER x AS user_turn, count(*) OVER x AS transcript_length, last_value(CASE WHEN role = 'system' THEN md5(text) END IGNORE NULLS) OVER x AS last_prompt,
  last_value(lang IGNORE NULLS) OVER x AS session_language, sum(len(dep)) OVER x AS d, sum(len(frm)) OVER x AS f, sum(len(dst)) OVER x AS s FROM turns WINDOW x AS (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING))
SELECT CAST(conv_id AS VARCHAR) AS session, turn, user_turn, transcript_length, last_prompt, session_language, array_to_string(list_filter([CASE WHEN d = 0 THEN 'departureDate' END, CASE WHEN f = 0 THEN 'from' END, CASE WHEN s = 0 THEN 'to' END], lambda x: x IS NOT NULL), ',') AS missing FROM w""")
def _(t):
    m = dg.turn_metadata(turns(t))
    return m.select("session", "turn", F.col("user_turn").cast("long").alias("user_turn"), F.col("transcript_length").cast("long").alias("transcript_length"),
                    F.md5("last_prompt").alias("last_prompt"), "session_language", F.array_join("missing_parameters", ",").alias("missing"))


TRANSCRIPT_SQL = "tr AS (SELECT CAST(conv_id AS VARCHAR) AS session, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos FROM conversations)"


@query("d2_transcript_chunks", f"""WITH {TRANSCRIPT_SQL} SELECT session, pos // 3 AS chunk, count(*) AS entries, md5(string_agg(turn || ' ' || role || ' ' || text, chr(10) ORDER BY pos)) AS said FROM tr GROUP BY 1, 2""")
def _(t):
    chunks, _pointers = dg.transcripts(turns(t), chunk_turns=3)
    lines = F.transform("entries", lambda e: F.concat_ws(" ", e["turn"], e["role"], e["text"]))
    return chunks.select("session", "chunk", F.size("entries").cast("long").alias("entries"), F.md5(F.array_join(lines, "\n")).alias("said"))


@query("d2_turn_transcripts", f"""WITH {TRANSCRIPT_SQL} SELECT a.session, a.turn, b.turn AS said, b.role, md5(b.text) AS text FROM tr a JOIN tr b ON a.session = b.session AND b.pos <= a.pos""")
def _(t):
    chunks, pointers = dg.transcripts(turns(t), chunk_turns=3)
    return dg.transcript_entries(chunks, pointers).select("session", "turn", "said", "role", F.md5("text").alias("text"))


@query("w7_turn_counter", """SELECT conv_id, turn, count(*) FILTER (role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS user_turn FROM conversations""")
def _(t):
    from wishloom.plans.scale import running

    r = running(t.conversations.select("conv_id", "turn", "role"), ["conv_id"], ["turn"],
                sums={"user_turn": (F.col("role") == "user").cast("int")})
    return r.select("conv_id", "turn", F.col("user_turn").cast("long").alias("user_turn"))


@query("d1_session_stream", f"""WITH {SQL_TURNS}, g AS (SELECT *, min(turn) OVER (PARTITION BY conv_id) = 0 AS s, turn = row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ok FROM turns)
, fr AS (SELECT conv_id, v, min(turn * 1000 + p) AS f FROM (SELECT conv_id, turn, unnest(frm) AS v, unnest(range(len(frm))) AS p FROM g WHERE ok) GROUP BY 1, 2),
de AS (SELECT conv_id, v, min(turn * 1000 + p) AS f FROM (SELECT conv_id, turn, unnest(dst) AS v, unnest(range(len(dst))) AS p FROM g WHERE ok) GROUP BY 1, 2),
fl AS (SELECT g.conv_id, g.turn, string_agg(v, ',' ORDER BY f) AS l FROM g JOIN fr ON fr.conv_id = g.conv_id AND f < (g.turn + 1) * 1000 GROUP BY 1, 2),
dl AS (SELECT g.conv_id, g.turn, string_agg(v, ',' ORDER BY f) AS l FROM g JOIN de ON de.conv_id = g.conv_id AND f < (g.turn + 1) * 1000 GROUP BY 1, 2)
SELECT CAST(g.conv_id AS VARCHAR) AS session, g.turn, ok AS accepted, CASE WHEN ok THEN coalesce(fl.l, '') END AS from_codes, CASE WHEN ok THEN coalesce(dl.l, '') END AS to_ids,
 CASE WHEN ok THEN coalesce(last_value(CASE WHEN len(dep) > 0 THEN array_to_string(dep, ',') END IGNORE NULLS) OVER w, '') END AS departure_dates,
 CASE WHEN ok THEN last_value(nullif(dur, '') IGNORE NULLS) OVER w END AS duration_id, CASE WHEN ok THEN last_value(rm IGNORE NULLS) OVER w END AS rooms,
 CASE WHEN NOT ok THEN 'expected turn ' || count(*) FILTER (ok) OVER (PARTITION BY g.conv_id) END AS reason
FROM g LEFT JOIN fl ON fl.conv_id = g.conv_id AND fl.turn = g.turn LEFT JOIN dl ON dl.conv_id = g.conv_id AND dl.turn = g.turn WINDOW w AS (PARTITION BY g.conv_id ORDER BY g.turn ROWS UNBOUNDED PRECEDING)""")
def _(t: Tables):
    # a finite feed without timers is folded in one batch, so a turn of any file can close a gap
    feed = t.feed("conversations", files_per_trigger=None)
    out, state = scratch_folder(t.spark, "sessions"), scratch_folder(t.spark, "sessions-state")
    feeds.append_log(sessions.fold_stream(turns(t, feed), ttl=None), out, state).awaitTermination()
    return t.spark.read.parquet(out)


def op_stream(t: Tables):
    class Live:
        events = t.feed("events")
    return operations(Live)


@query("d3_request_log", f"WITH {SQL_OPS} SELECT op_id, method, status, round(total_ms, 6) AS total_ms FROM ops")
def _(t):
    out, state = scratch_folder(t.spark, "log"), scratch_folder(t.spark, "log-state")
    feeds.append_log(op_stream(t).select("op_id", "method", "status", "total_ms"), out, state).awaitTermination()
    return t.spark.read.parquet(out).withColumn("total_ms", F.round("total_ms", 6))


@query("d4_live_counters", f"""WITH {SQL_OPS}, b AS (SELECT * FROM (VALUES {BUCKETS}) v(bucket_ord, bucket, lo, hi))
SELECT status AS outcome, bucket, count(*) AS n FROM ops JOIN b ON total_ms >= lo AND total_ms < hi GROUP BY 1, 2""")
def _(t):
    out, state = scratch_folder(t.spark, "counters"), scratch_folder(t.spark, "counters-state")
    feeds.publish_counters(feeds.live_counters(op_stream(t)), out, state).awaitTermination()
    return feeds.latest_counters(t.spark, out)


@query("d5_request_feed", """SELECT conv_id, turn, length(trim(text)) AS letters, role = 'user' AS from_user FROM conversations""")
def _(t):
    feed = t.feed("conversations")
    shaped = feeds.process_feed(feed, lambda df: df.select(
        "conv_id", "turn", F.length(F.trim("text")).cast("long").alias("letters"), (F.col("role") == "user").alias("from_user")))
    out, state = scratch_folder(t.spark, "feed"), scratch_folder(t.spark, "feed-state")
    feeds.append_log(shaped, out, state).awaitTermination()
    return t.spark.read.parquet(out)
