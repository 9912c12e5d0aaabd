"""T19-T21, J7, J8, X1, S18 over expectations composed from orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from wishloom.functions import expected as xp
from wishloom.operators import replay as rp
from wishloom.plans.scale import unnest

from .frames import SQL_DURATIONS
from .registry import query


def expected_text(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    text = F.concat(F.lit(" From : AMS|To:Spain: south | "), F.when(k % 3 == 0, "Duration: 7 nights").when(k % 3 == 1, "Rooms").otherwise(" : lost"),
                    F.lit(" || To: "), F.concat(F.lit("Land "), c % 4))
    return t.orders.select(k.alias("request_id"), c.alias("o_custkey"), text.alias("raw"), "o_orderpriority")


@query("t19_expected_values", """WITH e AS (SELECT o_orderkey AS request_id, unnest(['From=AMS', 'To=Spain: south', CASE o_orderkey % 3 WHEN 0 THEN 'Duration=7 nights' WHEN 1 THEN 'Rooms=' END, 'To=Land ' || o_custkey % 4]) AS x, unnest([1, 2, 3, 4]) AS p FROM orders)
SELECT request_id, string_agg(x, ';' ORDER BY p) AS parsed FROM e WHERE x IS NOT NULL GROUP BY 1""")
def _(t):
    pair = F.transform(xp.parse_values(F.col("raw")), lambda e: F.concat(e["label"], F.lit("="), e["value"]))
    return expected_text(t).select("request_id", F.array_join(pair, ";").alias("parsed"))


def preference_text(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    quoted = F.concat(F.lit('FILTER: "Board"; Options: "Half, board", "B'), c % 3, F.lit('"'))
    listed = F.concat(F.lit("filter:Pool;options: deep , 'P"), c % 3, F.lit("',,  "))
    both = F.concat(quoted, F.lit(" | "), listed)
    text = F.when(k % 4 == 0, quoted).when(k % 4 == 1, listed).when(k % 4 == 2, both).otherwise("nothing here | Filter: Sea")
    return t.orders.select(k.alias("request_id"), c.alias("o_custkey"), text.alias("raw"))


@query("t20_expected_preferences", """SELECT o_orderkey AS request_id, CASE o_orderkey % 4 WHEN 0 THEN 'Board[Half, board/B' || o_custkey % 3 || ']' WHEN 1 THEN 'Pool[deep/P' || o_custkey % 3 || ']'
 WHEN 2 THEN 'Board[Half, board/B' || o_custkey % 3 || ']Pool[deep/P' || o_custkey % 3 || ']' ELSE 'Sea[]' END AS parsed FROM orders""")
def _(t):
    one = F.transform(xp.parse_preferences(F.col("raw")), lambda e: F.concat(
        e["filter_label"], F.lit("["), F.array_join(e["options"], "/"), F.lit("]")))
    return preference_text(t).select("request_id", F.array_join(one, "").alias("parsed"))


def rendered(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    names = F.create_map(F.lit("AMS"), F.lit("Amsterdam"), F.lit("d1"), F.lit("Spain"))
    return t.orders.select(k.alias("request_id"), xp.payload_rows({
        "language": F.lit("en"),
        "from": xp.named_list(F.array(F.lit("AMS"), F.concat(F.lit("Q"), c % 2)), names),
        "to": xp.named_list(F.when(k % 2 == 0, F.array(F.lit("d1"))).otherwise(F.array().cast("array<string>")), names),
        "departureDate": F.array_join(F.array(F.date_format("o_orderdate", "yyyy-MM-dd")), ", "),
        "durationId": xp.duration_text((2001 + c % 20).cast("string")),
        "party": xp.party_text(c % 3, k % 2),
        "rooms": xp.rooms_text(F.when(k % 3 == 0, F.lit(None)).when(k % 3 == 1, "auto_allocation").otherwise((k % 5).cast("string")))}).alias("rows"))


RENDER = f"""WITH {SQL_DURATIONS}, dn AS (SELECT id, CASE id WHEN '2099' THEN 'More than 14 nights' ELSE name END AS name FROM durations)
SELECT o_orderkey AS request_id, 'Language: en | From: Amsterdam, Q' || o_custkey % 2 || ' | To: ' || CASE WHEN o_orderkey % 2 = 0 THEN 'Spain' ELSE '' END || ' | Departure date range: ' || strftime(o_orderdate, '%Y-%m-%d')
 || ' | Duration: ' || coalesce(name, CAST(2001 + o_custkey % 20 AS VARCHAR)) || ' | Participants: ' || CASE WHEN o_custkey % 3 > 0 AND o_orderkey % 2 > 0 THEN 'Adults: ' || o_custkey % 3 || ', Non adults: 1'
   WHEN o_custkey % 3 > 0 THEN 'Adults: ' || o_custkey % 3 WHEN o_orderkey % 2 > 0 THEN 'Non adults: 1' ELSE '{{"adults":0,"nonAdults":0}}' END
 || ' | Rooms: ' || CASE o_orderkey % 3 WHEN 2 THEN CAST(o_orderkey % 5 AS VARCHAR) ELSE 'Auto allocation' END AS shown FROM orders LEFT JOIN dn ON id = CAST(2001 + o_custkey % 20 AS VARCHAR)"""


@query("t21_payload_text", RENDER)
def _(t):
    return rendered(t).select("request_id", xp.extracted_text(F.col("rows")).alias("shown"))


@query("t21_preference_rows", """SELECT p_partkey, '"Brand"#' AS x, p_brand || '; Options: ' || CASE WHEN p_name = lower(p_type) THEN p_name ELSE least(p_name, lower(p_type)) || ', ' || greatest(p_name, lower(p_type)) END AS shown FROM part""")
def _(t):
    options = F.array(F.concat(F.lit('"'), "p_name", F.lit('"')), F.lower("p_type"), F.lit(""), F.col("p_name"))
    rows = xp.preference_rows(F.array(F.struct(F.col("p_brand").alias("label"), options.alias("options"))))
    return t.part.select("p_partkey", F.lit('"Brand"#').alias("x"), rows[0]["value"].alias("shown"))


@query("s18_session_export", RENDER.replace("SELECT o_orderkey AS request_id,", "SELECT 'trip ' || o_orderpriority AS user_input, o_orderkey AS request_id,"))
def _(t):
    from wishloom.sources.sinks import session_export

    rows = rendered(t).join(t.orders.select(F.col("o_orderkey").alias("request_id"), F.concat(F.lit("trip "), "o_orderpriority").alias("input")), "request_id")
    out = session_export(rows.withColumn("input", F.concat("input", F.lit("#"), "request_id")), "input", "rows")
    parts = F.split("User input", "#")
    return out.select(parts[0].alias("user_input"), parts[1].cast("long").alias("request_id"), F.col("Extracted values").alias("shown"))


def value_runs(t):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    e = lambda label, value: F.struct(F.lit(label).alias("label"), value.alias("value"))
    actual = F.array(e("From", F.lit("AMS")), e(" To ", F.concat(F.lit("Land "), c % 4)), e("Duration", F.when(k % 2 == 0, "7 nights").otherwise("3 nights")),
                     e("Note", F.when(k % 5 == 0, "extra").otherwise("")), e("From", F.when(c % 7 == 0, "BRU").otherwise("AMS")))
    expected = F.concat(F.lit("From: AMS | To: Land "), k % 4, F.lit(" | Duration: 7 nights | To: Land "), (k + 1) % 4, F.when(k % 6 == 0, " | Rooms: 2").otherwise(""))
    status = F.when(k % 11 == 0, F.lit(None)).when(k % 13 == 0, "failed").otherwise("success")
    return t.orders.select(k.alias("request_id"), actual.alias("actual"), F.when(k % 9 == 0, "").otherwise(expected).alias("raw"), status.alias("status"))


MISMATCH = """
v AS (SELECT o_orderkey AS request_id, CASE WHEN o_custkey % 7 = 0 THEN 'BRU' ELSE 'AMS' END AS f, 'Land ' || o_custkey % 4 AS a_to, 'Land ' || (o_orderkey + 1) % 4 AS e_to,
  CASE WHEN o_orderkey % 2 = 0 THEN '7 nights' ELSE '3 nights' END AS d, o_orderkey FROM orders WHERE o_orderkey % 9 <> 0),
mm AS (SELECT request_id, 'From' AS label, 'AMS' AS expected, f AS actual FROM v WHERE f <> 'AMS' UNION ALL SELECT request_id, 'To', e_to, a_to FROM v WHERE e_to <> a_to
  UNION ALL SELECT request_id, 'Duration', '7 nights', d FROM v WHERE d <> '7 nights' UNION ALL SELECT request_id, 'Note', '', 'extra' FROM v WHERE o_orderkey % 5 = 0
  UNION ALL SELECT request_id, 'Rooms', '2', '' FROM v WHERE o_orderkey % 6 = 0)"""


@query("j7_value_mismatches", f"WITH {MISMATCH} SELECT * FROM mm")
def _(t):
    rows = value_runs(t).withColumn("expected", xp.parse_values(F.col("raw")))
    return unnest(rp.value_mismatches(rows, "actual", "expected"), "mismatches", "request_id")


@query("x1_replay", f"""WITH {MISMATCH}, c AS (SELECT request_id, count(*) AS n FROM mm GROUP BY 1)
SELECT o_orderkey AS request_id, coalesce(n, 0) AS mismatch_count, CASE WHEN o_orderkey % 11 = 0 THEN 'error' WHEN n > 0 THEN 'failed' WHEN o_orderkey % 13 = 0 THEN 'failed' ELSE 'success' END AS replay_status FROM orders LEFT JOIN c ON request_id = o_orderkey""")
def _(t):
    return rp.replay(value_runs(t), "actual", "raw").select("request_id", "mismatch_count", "replay_status")


@query("j8_preference_mismatches", """WITH b AS (SELECT o_orderkey AS request_id, o_orderkey AS k, o_custkey AS c FROM orders),
e AS (SELECT request_id, k, c, 'board' AS key, 'Board' AS label, list_sort(['half, board', 'b' || c % 3]) AS s, list_sort(['Half, board', 'B' || c % 3]) AS o FROM b WHERE k % 4 IN (0, 2)
  UNION ALL SELECT request_id, k, c, 'pool', 'Pool', list_sort(['deep', 'p' || c % 3]), list_sort(['deep', 'P' || c % 3]) FROM b WHERE k % 4 IN (1, 2)
  UNION ALL SELECT request_id, k, c, 'sea', 'Sea', [], [] FROM b WHERE k % 4 = 3),
a AS (SELECT request_id, 'board' AS key, 'board' AS label, ['b0', 'half, board'] AS s, ['B0', 'Half, Board'] AS o FROM b UNION ALL SELECT request_id, 'spa', 'Spa', ['x'], ['x'] FROM b WHERE c % 2 = 0),
j AS (SELECT coalesce(e.request_id, a.request_id) AS request_id, e.label AS el, a.label AS al, e.s AS es, a.s AS ass, e.o AS eo, a.o AS ao FROM e FULL JOIN a ON e.request_id = a.request_id AND e.key = a.key)
SELECT request_id, 'Filter: "' || coalesce(el, al) || '"' AS label, CASE WHEN len(coalesce(eo, [])) = 0 THEN '' ELSE 'Options: "' || array_to_string(eo, '", "') || '"' END AS expected,
 CASE WHEN len(coalesce(ao, [])) = 0 THEN '' ELSE 'Options: "' || array_to_string(ao, '", "') || '"' END AS actual FROM j WHERE (el IS NOT NULL AND coalesce(ass, []) <> es) OR (el IS NULL AND len(ass) > 0)""")
def _(t):
    f = lambda label, *o: F.struct(F.lit(label).alias("filter_label"), F.array(*[F.lit(x) for x in o]).alias("options"))
    mine = F.array(f("board", "Half, Board", "B0"), f("Board ", "b0", ""))
    actual = F.when(F.col("o_custkey") % 2 == 0, F.concat(mine, F.array(f("Spa", "x")))).otherwise(mine)
    rows = preference_text(t).withColumns({"actual": actual, "expected": xp.parse_preferences(F.col("raw"))})
    return unnest(rp.preference_mismatches(rows, "actual", "expected"), "mismatches", "request_id")
