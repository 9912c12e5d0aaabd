"""T9-T12, T16, T17, T26, J3, J4, J6, J10, N1-N4, V1-V7, W4, W5, H1-H4, S6-S8 over requests and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from wishloom.functions import fixed_values as fv
from wishloom.functions import messages as ms
from wishloom.operators import cascade as cs
from wishloom.operators import catalogue as ct
from wishloom.operators import extraction as ex
from wishloom.operators import normalisation as nm
from wishloom.plans.scale import settle, stored

from .frames import (SQL_ALIAS, SQL_DURATIONS, SQL_FLEX, SQL_REQUESTS, airports, alias_entries, destinations, norm,
                     requests)
from .popularity_queries import DUR, IMPUTE, bookings, im, pop, requests_frame
from .registry import query

LANGS = ["en", "nl", "fr"]
DUTCH = {"nl": [("7 nachten", "7 nights")]}

SQL_EXTRACT = f"""
{SQL_REQUESTS}, {SQL_DURATIONS}, {SQL_FLEX},
dl AS (SELECT unnest(['en', 'nl', 'fr']) AS lang, lower(r_name) AS name, 'R' || r_regionkey AS id, r_regionkey AS ord FROM region
  UNION ALL SELECT 'nl', 'land_' || r_regionkey, 'R' || r_regionkey, 100 + r_regionkey FROM region
  UNION ALL SELECT 'fr', 'pays_' || r_regionkey, 'R' || r_regionkey, 100 + r_regionkey FROM region),
rq AS (SELECT *, CASE WHEN lang IN ('nl', 'fr') THEN lang ELSE 'en' END AS ul, ' ' || {norm('text')} || ' ' AS nt, lower(text) AS lt,
  coalesce(TRY_CAST(regexp_extract(text, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AS TIMESTAMP), try_strptime(regexp_extract(text, '\\d{{2}}-\\d{{2}}-\\d{{4}}'), '%d-%m-%Y'),
    try_strptime(regexp_extract(text, '\\d{{1,2}} [A-Z][a-z]+ \\d{{4}}'), '%d %B %Y'), try_strptime(regexp_extract(text, '[A-Z][a-z]+ \\d{{1,2}}, \\d{{4}}'), '%B %d, %Y')) AS dt FROM requests),
apm AS (SELECT request_id, 'N' || n_nationkey AS id, n_nationkey AS ord, n_name AS name, n_nationkey % 9 <> 8 AS av FROM rq JOIN nation ON contains(nt, ' ' || lower(n_name) || ' ')),
dsm AS (SELECT request_id, id, min(ord) AS ord FROM rq JOIN dl ON dl.lang = ul AND contains(nt, ' ' || name || ' ') GROUP BY 1, 2),
dsd AS (SELECT request_id, id, ord, r_name AS name, r_regionkey <> 3 AS av, CASE WHEN r_regionkey % 2 = 0 THEN id || ':COUNTRY' ELSE id END AS code FROM dsm JOIN region ON id = 'R' || r_regionkey),
dm AS (SELECT request_id, arg_min(d.id, d.ord) AS duration_id FROM rq JOIN (SELECT ord, id, name, '' AS ex FROM durations UNION ALL SELECT 100, '2007', 'a week', 'nl' UNION ALL SELECT 101, '2007', 'one week', 'nl') d ON contains(lt, d.name) AND lang <> ex GROUP BY 1),
fx AS (SELECT request_id, arg_min(f.id, f.ord) AS flex_id FROM rq JOIN flexes f ON contains(lt, f.name) GROUP BY 1),
apg AS (SELECT request_id, string_agg(id, ',' ORDER BY ord) AS from_codes, arg_min(name, ord) FILTER (NOT av) AS closed_airport FROM apm GROUP BY 1),
dsg AS (SELECT request_id, string_agg(code, ',' ORDER BY ord) AS to_ids, string_agg(id, ',' ORDER BY ord) AS dest_ids, arg_min(name, ord) FILTER (NOT av) AS closed_dest FROM dsd GROUP BY 1),
ext AS (SELECT rq.request_id, lang, text, dt, coalesce(from_codes, '') AS from_codes, coalesce(to_ids, '') AS to_ids, coalesce(dest_ids, '') AS dest_ids, closed_airport, closed_dest, duration_id, flex_id
  FROM rq LEFT JOIN apg USING (request_id) LEFT JOIN dsg USING (request_id) LEFT JOIN dm USING (request_id) LEFT JOIN fx USING (request_id))
"""
SQL_CALENDAR = "cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE dayofweek(l_shipdate) BETWEEN 1 AND 5)"


def calendar(t):
    """Weekdays on which something shipped."""
    return t.lineitem.where(F.dayofweek("l_shipdate").between(2, 6)).select(F.to_date("l_shipdate").alias("d")).distinct()


def lookups(t):
    flat, _unknown, conflicts = ct.locale_aliases(alias_entries(t), destinations(t))
    clean = flat.join(conflicts, ["category", "lang", "alias"], "left_anti")
    ordered = clean.withColumn("ord", 100 + F.regexp_extract("target_id", r"(\d+)", 1).cast("long"))
    none = ordered.where(F.lit(False))
    return ct.lookup_table(airports(t), none, LANGS), ct.lookup_table(destinations(t), ordered, LANGS)


def extracted(t):
    a, d = lookups(t)
    both = ex.detailed_lookup(a, airports(t), "airport").unionByName(ex.detailed_lookup(d, destinations(t), "destination"))
    return ex.extract(requests(t), both, LANGS, DUTCH)


def ids(c):
    return F.array_join(F.transform(c, lambda e: e["id"]), ",")


@query("t9_entity_match", f"WITH {SQL_EXTRACT} SELECT request_id, 'airport' AS kind, id, CAST(ord AS BIGINT) AS ord FROM apm UNION ALL SELECT request_id, 'destination', id, CAST(ord AS BIGINT) FROM dsm")
def _(t):
    a, d = lookups(t)
    both = a.withColumn("kind", F.lit("airport")).unionByName(d.withColumn("kind", F.lit("destination")))
    return ex.match_entities(requests(t), both, languages=LANGS).select("request_id", "kind", "id", "ord")


@query("t10_locale_lookup", f"WITH {SQL_EXTRACT} SELECT lang, name, id, CAST(ord AS BIGINT) AS ord FROM dl")
def _(t):
    return lookups(t)[1]


@query("t11_duration_flexibility", f"WITH {SQL_EXTRACT} SELECT request_id, duration_id, flex_id FROM ext")
def _(t):
    text, lang = F.col("text"), F.col("lang")
    return requests(t).select("request_id", ex.duration_id(text, lang, DUTCH).alias("duration_id"),
                              ex.flexibility_id(text, lang).alias("flex_id"))


@query("t12_date_phrases", f"WITH {SQL_EXTRACT} SELECT request_id, strftime(dt, '%Y-%m-%d') AS first_date, CASE WHEN dt IS NULL THEN 0 ELSE 1 END AS n_dates FROM ext")
def _(t):
    d = requests(t).select("request_id", ex.dates(F.col("text")).alias("d"))
    return d.select("request_id", F.date_format(F.get("d", F.lit(0))["at"], "yyyy-MM-dd").alias("first_date"),
                    F.size("d").alias("n_dates"))


@query("w5_first_in_order", f"WITH {SQL_EXTRACT} SELECT request_id, arg_min(id, ord) AS first_destination FROM dsm GROUP BY 1")
def _(t):
    found = ex.match_entities(requests(t), lookups(t)[1], languages=LANGS)
    return found.groupBy("request_id").agg(F.min_by("id", "ord").alias("first_destination"))


@query("h4_recognised", f"WITH {SQL_EXTRACT} SELECT request_id, from_codes AS airports, dest_ids AS destinations, coalesce(strftime(dt, '%Y-%m-%dT%H:%M:%S'), '') AS dates, duration_id, flex_id FROM ext")
def _(t):
    r = ex.recognised(extracted(t))
    j = lambda c: F.array_join(c, ",")
    return r.select("request_id", j("recognised_airports").alias("airports"), j("recognised_destinations").alias("destinations"),
                    j("recognised_dates").alias("dates"), "duration_id", "flex_id")


# -- normalisation -------------------------------------------------------------

SQL_NORMAL = f"""
WITH {SQL_EXTRACT}, {SQL_CALENDAR},
w AS (SELECT *, CAST(coalesce(flex_id, '3') AS INT) AS n, CAST(dt AS DATE) AS b FROM ext),
pr AS (SELECT DISTINCT b, n FROM w WHERE b IS NOT NULL),
win AS (SELECT b, n, min(d) AS lo, max(d) AS hi FROM pr JOIN cal ON d BETWEEN b - n AND b + n GROUP BY 1, 2),
nz AS (SELECT w.*, lo, hi, CASE WHEN lo IS NULL THEN '' WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || ',' || hi END AS departure, coalesce(w.duration_id, '2007') AS dur FROM w LEFT JOIN win ON win.b = w.b AND win.n = w.n),
va AS (SELECT *, CASE WHEN closed_airport IS NOT NULL THEN 'Departure airport ''' || closed_airport || ''' is unavailable'
   WHEN closed_dest IS NOT NULL THEN 'Destination ''' || closed_dest || ''' is unavailable' WHEN departure = '' THEN 'Departure date is required'
   WHEN to_ids = '' THEN 'Destination is required' END AS error FROM nz)
"""


@query("n4_payload", f"{SQL_NORMAL} SELECT request_id, lang, from_codes AS from_, to_ids AS to_, departure, dur AS duration_id, 2 AS adults, 0 AS non_adults, 1 AS rooms FROM va")
def _(t):
    n = nm.normalise(extracted(t), settle(calendar(t)))
    schema = ('language string, `from` array<string>, `to` array<string>, departureDate array<string>, durationId string, '
              'party struct<adults:int,nonAdults:int>, rooms int')
    p = n.select("request_id", F.from_json(nm.payload_json(), schema).alias("p"))
    j = lambda c: F.array_join(c, ",")
    return p.select("request_id", F.col("p.language").alias("lang"), j("p.from").alias("from_"), j("p.to").alias("to_"),
                    j("p.departureDate").alias("departure"), F.col("p.durationId").alias("duration_id"),
                    F.col("p.party.adults").alias("adults"), F.col("p.party.nonAdults").alias("non_adults"), F.col("p.rooms").alias("rooms"))


@query("w4_first_error", f"{SQL_NORMAL} SELECT request_id, CASE WHEN error IS NULL THEN 'success' ELSE 'failed' END AS status, error FROM va")
def _(t):
    cal = settle(calendar(t))
    v = nm.validate(nm.normalise(extracted(t), cal), cal)
    return v.select("request_id", "status", F.col("validation_error").alias("error"))


FLEX = "CASE o_orderpriority WHEN '1-URGENT' THEN '0' WHEN '2-HIGH' THEN '3' WHEN '3-MEDIUM' THEN '14' WHEN '4-NOT SPECIFIED' THEN 'any' END"


def flexed(t):
    p = F.col("o_orderpriority")
    flex = F.when(p == "1-URGENT", "0").when(p == "2-HIGH", "3").when(p == "3-MEDIUM", "14").when(p == "4-NOT SPECIFIED", "any")
    return t.orders.select(F.col("o_orderkey").alias("request_id"), F.to_date("o_orderdate").alias("base_date"), flex.alias("flex_id"))


WINDOW = f"""WITH {SQL_CALENDAR}, o AS (SELECT o_orderkey AS request_id, CAST(o_orderdate AS DATE) AS b, CASE {FLEX} WHEN '0' THEN 0 WHEN '14' THEN 14 WHEN 'any' THEN 0 ELSE 3 END AS n FROM orders),
win AS (SELECT b, n, min(d) AS lo, max(d) AS hi FROM (SELECT DISTINCT b, n FROM o) JOIN cal ON d BETWEEN b - n AND b + n GROUP BY 1, 2)"""


@query("n1_departure_window", f"{WINDOW} SELECT request_id, CASE WHEN lo IS NULL THEN '' WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || ',' || hi END AS dates FROM o LEFT JOIN win USING (b, n)")
def _(t):
    w = nm.departure_window(flexed(t), settle(calendar(t)))
    return w.select("request_id", F.array_join("departure_dates", ",").alias("dates"))


@query("n1_window_without_calendar", f"""{WINDOW} SELECT request_id, CASE WHEN n = 0 THEN CAST(b AS VARCHAR) ELSE CAST(b - n AS DATE) || ',' || CAST(b + n AS DATE) END AS dates FROM o""")
def _(t):
    return nm.departure_window(flexed(t), None).select("request_id", F.array_join("departure_dates", ",").alias("dates"))


@query("j3_calendar_range", f"{WINDOW} SELECT CAST(b AS VARCHAR) AS base_date, n AS days, CAST(lo AS VARCHAR) AS first_day, CAST(hi AS VARCHAR) AS last_day FROM win")
def _(t):
    w = nm.departure_window(flexed(t), settle(calendar(t))).where(F.size("departure_dates") > 0)
    days = F.when(F.col("flex_id") == "14", 14).when(F.col("flex_id").isin("0", "any"), 0).otherwise(3)
    return w.select(F.date_format("base_date", "yyyy-MM-dd").alias("base_date"), days.alias("days"),
                    F.element_at("departure_dates", 1).alias("first_day"), F.element_at("departure_dates", -1).alias("last_day")).distinct()


@query("j4_calendar_semi_anti", f"""WITH {SQL_CALENDAR} SELECT o_orderkey AS request_id, CASE WHEN CAST(o_orderdate AS DATE) NOT IN (SELECT d FROM cal) THEN strftime(o_orderdate, '%Y-%m-%d') END AS off_calendar FROM orders""")
def _(t):
    o = t.orders.select(F.col("o_orderkey").alias("request_id"), F.array(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("departure_dates"))
    return nm.first_off_calendar(o, settle(calendar(t))).select("request_id", "off_calendar")


@query("n2_codes", """SELECT o_orderkey AS request_id, 'AB,C' || o_custkey % 3 AS airports,
 'd' || o_custkey % 5 || CASE WHEN o_orderkey % 2 = 0 THEN ':COUNTRY' ELSE '' END || CASE WHEN o_custkey % 5 <> 1 OR o_orderkey % 2 = 0 THEN ',d1' ELSE '' END AS destinations FROM orders""")
def _(t):
    c, k = F.col("o_custkey"), F.col("o_orderkey")
    ent = lambda i, ty: F.struct(i.alias("id"), ty.alias("type"))
    a = F.array(ent(F.lit("ab"), F.lit("")), ent(F.concat(F.lit("c"), c % 3), F.lit("")), ent(F.lit("Ab"), F.lit("")), ent(F.lit(""), F.lit("")))
    d = F.array(ent(F.concat(F.lit(" d"), c % 5), F.when(k % 2 == 0, " country").otherwise("")), ent(F.lit("d1"), F.lit(" ")), ent(F.lit("d1"), F.lit("")))
    return t.orders.select(k.alias("request_id"), F.array_join(nm.airport_codes(a), ",").alias("airports"),
                           F.array_join(nm.destination_codes(d), ",").alias("destinations"))


@query("g7_distinct_codes", "SELECT o_orderkey AS request_id, CASE o_custkey % 3 WHEN 0 THEN 'A,B' WHEN 1 THEN 'B,A' ELSE 'C,A,B' END AS codes FROM orders")
def _(t):
    c = F.col("o_custkey")
    first = F.when(c % 3 == 0, "a").when(c % 3 == 1, "b").otherwise("c")
    e = F.transform(F.array(first, F.lit("A"), F.lit("b"), F.lit("B")), lambda x: F.struct(x.alias("id")))
    return t.orders.select(F.col("o_orderkey").alias("request_id"), F.array_join(nm.airport_codes(e), ",").alias("codes"))


@query("n3_defaults", """SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 3 = 0 THEN '2010' ELSE '2007' END AS duration_id,
 CASE WHEN o_orderkey % 4 = 0 THEN o_custkey % 5 ELSE 2 END AS adults, CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END AS non_adults, CASE WHEN o_orderkey % 5 = 0 THEN 3 ELSE 1 END AS rooms FROM orders""")
def _(t):
    k = F.col("o_orderkey")
    party = nm.default_party(F.when(k % 2 == 0, F.col("o_custkey") % 5), F.when(k % 4 == 0, 1))
    return t.orders.select(k.alias("request_id"), nm.default_duration(F.when(k % 3 == 0, " 2010").when(k % 3 == 1, " ")).alias("duration_id"),
                           party["adults"].alias("adults"), party["nonAdults"].alias("non_adults"),
                           nm.default_rooms(F.when(k % 5 == 0, 3)).alias("rooms"))


# -- validation rules on order-shaped requests ---------------------------------


@query("v1_availability", """SELECT o_orderkey AS request_id, CASE WHEN o_custkey % 5 = 0 THEN 'Departure airport ''' || o_orderpriority || ''' is unavailable'
 WHEN o_orderkey % 3 <> 1 THEN 'Destination ''second'' is unavailable' END AS error FROM orders""")
def _(t):
    e = lambda n, a: F.struct(n.alias("name"), a.cast("boolean").alias("available"))
    a = F.array(e(F.lit("ok"), F.lit(True)), e(F.col("o_orderpriority"), F.col("o_custkey") % 5 != 0))
    d = F.array(e(F.lit("first"), F.lit(True)), e(F.lit("second"), F.when(F.col("o_orderkey") % 3 == 1, True).when(F.col("o_orderkey") % 3 == 2, False)))
    return t.orders.select(F.col("o_orderkey").alias("request_id"), nm.availability_error(a, d).alias("error"))


@query("v2_multi_select", """SELECT o_orderkey AS request_id, CASE WHEN o_custkey % 13 > 10 THEN 'Too many departure airports selected' WHEN o_custkey % 120 > 100 THEN 'Too many destinations selected' END AS lenient,
 CASE WHEN o_custkey % 13 > 1 THEN 'Multiple departure airports are not allowed' WHEN o_custkey % 120 > 1 THEN 'Multiple destinations are not allowed' END AS strict FROM orders""")
def _(t):
    a, d = (F.array_repeat(F.lit("x"), (F.col("o_custkey") % n).cast("int")) for n in (13, 120))
    one = {"multi": False, "max": 10}
    return t.orders.select(F.col("o_orderkey").alias("request_id"), nm.multi_select_error(a, d).alias("lenient"),
                           nm.multi_select_error(a, d, one, one).alias("strict"))


@query("v3_dates", f"""WITH {SQL_CALENDAR} SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 6 = 0 THEN 'Departure date is required' WHEN CAST(o_orderdate AS DATE) NOT IN (SELECT d FROM cal)
 THEN 'Departure date ''' || strftime(o_orderdate, '%Y-%m-%d') || ''' is not available' END AS error FROM orders""")
def _(t):
    none = F.array().cast("array<string>")
    o = t.orders.select(F.col("o_orderkey").alias("request_id"),
                        F.when(F.col("o_orderkey") % 6 == 0, none).otherwise(F.array(F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("departure_dates"))
    m = nm.first_off_calendar(o, settle(calendar(t)))
    return m.select("request_id", nm.date_error(F.col("departure_dates"), F.col("off_calendar")).alias("error"))


@query("v4_destination_duration", f"""WITH {SQL_DURATIONS} SELECT o_orderkey AS request_id, CASE WHEN o_custkey % 4 = 0 THEN 'Destination is required' END AS destination_error,
 CASE WHEN CAST(1998 + o_custkey % 20 AS VARCHAR) NOT IN (SELECT id FROM durations) THEN 'Duration is not supported' END AS duration_error FROM orders""")
def _(t):
    to = F.array_repeat(F.lit("x"), (F.col("o_custkey") % 4).cast("int"))
    return t.orders.select(F.col("o_orderkey").alias("request_id"), nm.destination_error(to).alias("destination_error"),
                           nm.duration_error((1998 + F.col("o_custkey") % 20).cast("string")).alias("duration_error"))


@query("v5_party", """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 12 < 1 THEN 'At least one adult is required' WHEN l_partkey % 12 > 9 THEN 'Too many adults requested'
 WHEN l_quantity > 45 THEN 'Too many children/infants requested' END AS error FROM lineitem""")
def _(t):
    kids = F.when(F.col("l_quantity") > 45, 9).otherwise(F.col("l_linenumber"))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey",
                             nm.party_error(F.col("l_partkey") % 12, kids).alias("error"))


@query("v6_rooms", """SELECT o_orderkey AS request_id, CASE WHEN o_custkey % 4 = 0 THEN 'Number of rooms must be provided' WHEN o_orderkey % 12 < 1 THEN 'At least one room must be requested'
 WHEN o_orderkey % 12 > 9 THEN 'Requested number of rooms exceeds the limit' END AS manual, CASE WHEN o_custkey % 4 = 0 THEN NULL WHEN o_orderkey % 12 < 1 THEN 'At least one room must be requested'
 WHEN o_orderkey % 12 > 9 THEN 'Requested number of rooms exceeds the limit' END AS automatic FROM orders""")
def _(t):
    rooms = F.when(F.col("o_custkey") % 4 != 0, F.col("o_orderkey") % 12)
    return t.orders.select(F.col("o_orderkey").alias("request_id"), nm.rooms_error(rooms, auto=False).alias("manual"),
                           nm.rooms_error(rooms).alias("automatic"))


@query("v7_required_combinations", """SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 5 = 0 THEN 'Departure date is required' WHEN o_custkey % 2 = 0 AND o_custkey % 3 = 0
 THEN 'Utterance must include departure date with departure or destination' END AS error FROM orders""")
def _(t):
    some = lambda c: F.array_repeat(F.lit("x"), c.cast("int"))
    c = F.col("o_custkey")
    return t.orders.select(F.col("o_orderkey").alias("request_id"), nm.combination_error(
        some(c % 2), some(c % 3), some(F.col("o_orderkey") % 5)).alias("error"))


# -- messages -------------------------------------------------------------------

MESSAGES = [*fv.VALIDATION_MESSAGES.values(), "Departure airport 'X' is unavailable", "Destination 'Y' is unavailable",
            "Departure date '2026-01-01' is not available", "We need your arrival and flex days", "Nothing to see", ""]
SQL_MESSAGES = "m AS (SELECT o_orderkey AS request_id, o_custkey, ([" + ", ".join("'" + x.replace("'", "''") + "'" for x in MESSAGES) + f"])[1 + o_orderkey % {len(MESSAGES)}] AS msg FROM orders)"


def message_rows(t):
    names = F.array(*[F.lit(x) for x in MESSAGES])
    return t.orders.select(F.col("o_orderkey").alias("request_id"), "o_custkey",
                           F.get(names, (F.col("o_orderkey") % len(MESSAGES)).cast("int")).alias("msg"))


SQL_FIELDS = """list_filter([CASE WHEN regexp_matches(lower(msg), 'departure\\s+date') THEN 'departureDate' END,
 CASE WHEN regexp_matches(regexp_replace(lower(msg), 'departure\\s+date', '', 'g'), 'departure') OR contains(lower(msg), 'airport') THEN 'from' END,
 CASE WHEN regexp_matches(lower(msg), 'destination|arrival') THEN 'to' END, CASE WHEN regexp_matches(lower(msg), 'duration|night') THEN 'durationId' END,
 CASE WHEN contains(lower(msg), 'room') THEN 'rooms' END, CASE WHEN regexp_matches(lower(msg), 'adult|child|infant') THEN 'party' END,
 CASE WHEN contains(lower(msg), 'flex') THEN 'flexibility' END], lambda f: f IS NOT NULL)"""


@query("t16_fields_from_messages", f"""WITH {SQL_MESSAGES}, f AS (SELECT *, {SQL_FIELDS} AS fields FROM m),
core AS (SELECT *, list_filter([CASE WHEN o_custkey % 2 = 0 THEN 'from' END, CASE WHEN o_custkey % 3 = 0 THEN 'to' END, CASE WHEN o_custkey % 5 = 0 THEN 'departureDate' END], lambda x: x IS NOT NULL) AS absent FROM f),
mi AS (SELECT *, list_distinct(absent || CASE WHEN regexp_matches(lower(msg), 'require|missing|must include|need') THEN list_filter(fields, lambda x: list_contains(absent, x) OR x IN ('durationId', 'flexibility')) ELSE [] END) AS missing FROM core)
SELECT request_id, array_to_string(list_sort(missing), ',') AS missing, CASE WHEN regexp_matches(lower(msg), 'unavailable|not allowed|not supported|too many|exceed|cannot|not available') THEN array_to_string(list_sort(fields), ',') ELSE '' END AS invalid FROM mi""")
def _(t):
    c = F.col("o_custkey")
    present = {"from": c % 2 != 0, "to": c % 3 != 0, "departureDate": c % 5 != 0, "rooms": F.lit(True), "party": F.lit(True)}
    said = F.array("msg")
    return message_rows(t).select("request_id", F.array_join(ms.missing_fields(said, present), ",").alias("missing"),
                                  F.array_join(ms.invalid_fields(said), ",").alias("invalid"))


def _rule_sql():
    arms = ""
    for parameter, prompt, words in fv.CLARIFICATION_RULES:
        cond = " OR ".join(f"contains(lower(msg), '{w}')" for w in words)
        arms += f" WHEN {cond} THEN '{parameter}|" + prompt.replace("'", "''") + "'"
    general = "|".join(fv.GENERAL_PROMPT)
    return f"CASE{arms} ELSE '{general}' END"


@query("t17_clarification", f"WITH {SQL_MESSAGES} SELECT request_id, {_rule_sql()} AS prompt, msg AS reason FROM m WHERE msg <> ''")
def _(t):
    p = message_rows(t).select("request_id", ms.choose_prompt(F.array("msg")).alias("p")).where("p is not null")
    return p.select("request_id", F.concat_ws("|", "p.parameter", "p.message").alias("prompt"), F.col("p.reason").alias("reason"))


@query("t26_clarification_list", f"""WITH {SQL_MESSAGES} SELECT request_id, CASE WHEN msg = '' THEN 'to=Please provide a value for to. (missing);from=Please provide a value for from. (missing)'
 ELSE CASE WHEN o_custkey % 2 = 0 THEN 'unknown' ELSE 'field' END || '=' || msg || ' (validation)' END AS prompts FROM m""")
def _(t):
    err = F.array(F.struct(F.concat(F.lit(" "), "msg").alias("message"), F.when(F.col("o_custkey") % 2 == 1, "field").alias("parameter"), F.lit("").alias("code")))
    c = ms.clarifications(err, F.array(F.lit("to"), F.lit("from")))
    shown = F.transform(c, lambda p: F.concat(p["parameter"], F.lit("="), p["message"], F.lit(" ("), p["reason"], F.lit(")")))
    return message_rows(t).select("request_id", F.array_join(shown, ";").alias("prompts"))


# -- lookups and sources over dimension tables ---------------------------------


@query("j6_name_lookup", """WITH q AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN 'Atlantis' ELSE ' nation_' || c_nationkey END AS asked FROM customer)
SELECT c_custkey, 'N' || n_nationkey AS resolved_id, CASE WHEN n_name IS NULL THEN 'Unknown airport ''' || asked || '''' END AS lookup_error FROM q LEFT JOIN nation ON upper(trim(asked)) = n_name""")
def _(t):
    q = t.customer.select("c_custkey", F.when(F.col("c_custkey") % 7 == 0, "Atlantis").otherwise(
        F.concat(F.lit(" nation_"), "c_nationkey")).alias("asked"))
    return ct.resolve_ids(q, airports(t), "asked", "airport").select("c_custkey", "resolved_id", "lookup_error")


@query("s6_entity_duplicates", """SELECT 'identifier' AS kind, p_brand AS value, count(*) AS copies FROM part GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'name', lower(p_name), count(*) FROM part GROUP BY 2 HAVING count(*) > 1
UNION ALL SELECT 'name', lower(p_type), count(*) FROM part GROUP BY 2 HAVING count(*) > 1""")
def _(t):
    # names of one and many owners, in other case and with blanks around
    named = t.part.select("p_brand", F.concat(F.lit(" "), F.upper("p_name")).alias("name"))
    typed = t.part.select(F.concat(F.lit("t"), "p_partkey").alias("id"), F.col("p_type").alias("name"))
    return ct.duplicate_entities(named.withColumnRenamed("p_brand", "id").unionByName(typed))


@query("s6_missing_required", """SELECT c_custkey, array_to_string(list_filter([CASE WHEN c_custkey % 4 = 0 THEN 'id' END, CASE WHEN c_custkey % 6 < 2 THEN 'name' END, CASE WHEN c_custkey % 5 = 0 THEN 'available' END], lambda x: x IS NOT NULL), ',') AS missing FROM customer""")
def _(t):
    k = F.col("c_custkey")
    rows = t.customer.select(k, F.when(k % 4 != 0, k).alias("id"), F.when(k % 6 == 0, "  ").when(k % 6 != 1, "some").alias("name"), F.when(k % 5 != 0, k % 2 == 0).alias("available"))
    return ct.missing_required(rows, ["id", "name", "available"]).select("c_custkey", F.array_join("missing_fields", ",").alias("missing"))


@query("s6_entity_source", "SELECT 'N' || n_nationkey AS id, n_name AS name, n_nationkey % 9 <> 8 AS available FROM nation")
def _(t):
    from wishloom.plans.scale import scratch_folder
    from wishloom.sources.readers import read_entities

    # a gazetteer is one JSON document
    entity = F.struct(F.concat(F.lit(" N"), "n_nationkey").alias("id"), F.concat("n_name", F.lit(" ")).alias("name"), (F.col("n_nationkey") % 9 != 8).alias("available"))
    path = scratch_folder(t.spark, "gazetteer")
    t.nation.agg(F.collect_list(entity).alias("airports")).select(F.to_json(F.struct(F.struct("airports").alias("data"))).alias("value")).write.text(path)
    return read_entities(t.spark, path, "airports").select("id", "name", "available")


@query("s7_calendar", "SELECT DISTINCT strftime(o_orderdate, '%d-%m-%Y') AS shown, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders")
def _(t):
    from wishloom.sources.readers import parse_calendar

    return parse_calendar(t.orders.select(F.date_format("o_orderdate", "dd-MM-yyyy").alias("date")).distinct()).where("d is not null").select(F.col("date").alias("shown"), F.date_format("d", "yyyy-MM-dd").alias("d"))


@query("s8_alias_check", f"""WITH {SQL_ALIAS}, ok AS (SELECT * FROM entries WHERE target_id LIKE 'R%'), cf AS (SELECT lang, alias FROM ok GROUP BY 1, 2 HAVING count(DISTINCT target_id) > 1)
SELECT 'alias' AS kind, lang, alias, target_id FROM ok UNION ALL SELECT 'unknown', lang, alias, target_id FROM entries WHERE target_id LIKE 'X%' UNION ALL SELECT 'conflict', lang, alias, '' FROM cf""")
def _(t):
    aliases, unknown, conflicts = ct.locale_aliases(alias_entries(t), destinations(t))
    cols = ["kind", "lang", "alias", "target_id"]
    return (aliases.withColumn("kind", F.lit("alias")).select(cols)
            .unionByName(unknown.withColumn("kind", F.lit("unknown")).select(cols))
            .unionByName(conflicts.withColumns({"kind": F.lit("conflict"), "target_id": F.lit("")}).select(cols)))


@query("j10_method_resolution", """SELECT event_id, CASE event_type WHEN 'view' THEN 'rules-basic' WHEN 'click' THEN 'semantic-basic' WHEN 'purchase' THEN 'llm-basic' WHEN 'signup' THEN 'hybrid' ELSE 'rules-basic' END AS method_id FROM events""")
def _(t):
    methods = t.spark.createDataFrame(
        [(0, "rules-basic", "rules"), (1, "llm-basic", "llm"), (2, "llm-strict", "llm"), (3, "hybrid", "hybrid"), (4, "semantic-basic", "semantic")],
        "ord int, id string, kind string")
    e = F.col("event_type")
    alias = F.when(e == "view", " Rules-BASIC").when(e == "click", "semantic").when(e == "purchase", "LLM").when(e == "signup", "hybrid").otherwise("magic")
    return cs.resolve_methods(t.events.withColumn("alias", alias), methods, "alias", "rules-basic").select("event_id", "method_id")


# -- cascades --------------------------------------------------------------------


def _stage(condition, reason):
    def evaluate(df):
        return df.withColumns({"status": F.when(condition, "success").otherwise("failed"),
                               "detail": F.when(~condition, F.lit(reason))})
    return evaluate


@query("h1_cascade", f"""WITH {SQL_REQUESTS}, s AS (SELECT request_id, contains(text, ' on ') AS a, contains(text, ' to ') AS b, lang = 'xx' AS c FROM requests)
SELECT request_id, CASE WHEN a OR b OR c THEN 'success' ELSE 'failed' END AS status, CASE WHEN a THEN 'rules' WHEN b THEN 'model' WHEN c THEN 'last' END AS selected_stage,
 NOT a AND NOT b AS fallback_triggered, CASE WHEN a THEN 'rules:success' WHEN b THEN 'rules:failed,model:success' WHEN c THEN 'rules:failed,model:failed,last:success' ELSE 'rules:failed,model:failed,last:failed' END AS attempts,
 CASE WHEN NOT (a OR b OR c) THEN 'no luck' END AS detail FROM s""")
def _(t):
    text = F.col("text")
    out = cs.run_cascade(
        requests(t).select("request_id", "lang", "text"),
        [("rules", "rules", _stage(F.contains(text, F.lit(" on ")), "no date")), ("model", "llm", _stage(F.contains(text, F.lit(" to ")), "no place"))],
        ("last", "rules", _stage(F.col("lang") == "xx", "no luck")))
    tries = F.transform("attempts", lambda a: F.concat(a["method"], F.lit(":"), a["status"]))
    return out.select("request_id", "status", "selected_stage", "fallback_triggered", F.array_join(tries, ",").alias("attempts"), "detail")


def stored_answers(t):
    """A model response per request: unreadable, with a bad date, complete, without dates, with a flexibility."""
    k, d = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    base = F.concat(F.lit('{"airports":["n'), (F.col("o_custkey") % 30).cast("string"), F.lit('"],"destinations":["R'), (F.col("o_custkey") % 7).cast("string"), F.lit('"]'))
    inner = (F.when(k % 5 == 0, "not json").when(k % 5 == 1, F.concat(base, F.lit(',"dates":["soon"]}')))
             .when(k % 5 == 2, F.concat(base, F.lit(',"dates":["'), d, F.lit('"]}'))).when(k % 5 == 3, F.concat(base, F.lit("}")))
             .otherwise(F.concat(base, F.lit(',"dates":[{"iso":"'), d, F.lit('"}],"flexibility":"0","duration":{"id":"2010"}}'))))
    quoted = F.regexp_extract(F.to_json(F.struct(inner.alias("c"))), r'^\{"c":(.*)\}$', 1)
    return t.orders.select(k.alias("request_id"), F.concat(F.lit('{"choices":[{"message":{"content":'), quoted, F.lit("}}]}")).alias("body"))


STAGES_SQL = f"""{SQL_NORMAL},
ans AS (SELECT o_orderkey AS request_id, o_orderkey % 5 AS v, CAST(o_orderdate AS DATE) AS b, CASE WHEN o_orderkey % 5 = 4 THEN 0 ELSE 3 END AS n, o_custkey % 30 AS ap, o_custkey % 7 AS de FROM orders),
anw AS (SELECT b, n, min(d) AS lo FROM (SELECT DISTINCT b, n FROM ans) JOIN cal ON d BETWEEN b - n AND b + n GROUP BY 1, 2),
mo AS (SELECT request_id, CASE WHEN v < 2 OR ap >= 25 OR de >= 5 THEN 'error' END AS err,
  CASE WHEN v = 0 THEN 'Model response must be an object' WHEN v = 1 THEN 'Model returned invalid ISO date ''soon'''
   WHEN ap >= 25 THEN 'Unknown departure airport ''n' || ap || ''' returned by model' WHEN de >= 5 THEN 'Unknown destination ''R' || de || ''' returned by model'
   WHEN ap % 9 = 8 THEN 'Departure airport ''' || n_name || ''' is unavailable' WHEN de = 3 THEN 'Destination ''' || r_name || ''' is unavailable'
   WHEN v = 3 OR lo IS NULL THEN 'Departure date is required' END AS detail
  FROM ans LEFT JOIN anw USING (b, n) LEFT JOIN nation ON n_nationkey = ap LEFT JOIN region ON r_regionkey = de),
st AS (SELECT request_id, error AS d0, mo.detail AS d1, coalesce(mo.err, CASE WHEN mo.detail IS NULL THEN 'success' ELSE 'failed' END) AS s1,
  CASE WHEN closed_airport IS NOT NULL OR closed_dest IS NOT NULL THEN error WHEN to_ids = '' THEN 'Destination is required' END AS d2 FROM va JOIN mo USING (request_id)),
att AS (SELECT request_id, 0 AS position, 'rules-basic' AS method, 'rules' AS type, CASE WHEN d0 IS NULL THEN 'success' ELSE 'failed' END AS status, d0 AS detail, false AS fallback FROM st
  UNION ALL SELECT request_id, 1, 'llm-basic', 'llm', s1, d1, false FROM st WHERE d0 IS NOT NULL
  UNION ALL SELECT request_id, 2, 'rules-places', 'rules', CASE WHEN d2 IS NULL THEN 'success' ELSE 'failed' END, d2, true FROM st WHERE d0 IS NOT NULL AND d1 IS NOT NULL)"""


def staged(t):
    """Rules first, stored model answers next, places alone as the last resort."""
    cal = settle(calendar(t))
    extractions = {"rules": cs.prepare(extracted(t).drop("text", "lang", "o_custkey", "o_orderpriority"), cal),
                   "llm": cs.prepare(ex.model_extraction(ex.read_model_responses(stored_answers(t)), airports(t), destinations(t)), cal)}
    return cs.staged_cascade(requests(t).select("request_id"), extractions, [cs.Stage("rules-basic", "rules"), cs.Stage("llm-basic", "llm")],
                             cs.Stage("rules-places", "rules", ["availability", "selection", "destination"]))


@query("h1_stage_attempts", f"{STAGES_SQL} SELECT * FROM att")
def _(t):
    return staged(t)[0]


@query("h1_staged_outcome", f"""{STAGES_SQL} SELECT request_id, CASE WHEN d0 IS NULL OR d1 IS NULL OR d2 IS NULL THEN 'success' ELSE 'failed' END AS status,
 CASE WHEN d0 IS NOT NULL AND d1 IS NOT NULL THEN d2 END AS detail, CASE WHEN d0 IS NULL THEN 'rules-basic' WHEN d1 IS NULL THEN 'llm-basic' WHEN d2 IS NULL THEN 'rules-places' END AS selected_stage,
 d0 IS NOT NULL AND d1 IS NOT NULL AS fallback_triggered FROM st""")
def _(t):
    return staged(t)[1]


REVALIDATED = f"""{IMPUTE}, {SQL_CALENDAR},
bg AS (SELECT DISTINCT lower(p_brand) AS key, p_brand AS name, 'B' || substr(p_brand, 7) AS id, CAST(substr(p_brand, 7) AS INT) % 2 = 0 AS country, CAST(substr(p_brand, 7) AS INT) % 10 <> 3 AS av FROM part),
x AS (SELECT im.*, len("to") = 0 AS ft, len("from") = 0 AS ff, len(departure) = 0 AS fd0, trim(coalesce(duration_id, '')) = '' AS fu, a IS NULL AND na IS NULL AS fp0, rooms0 IS NULL AS fr0,
  string_split(coalesce(fpm, party), '/') AS p, coalesce(fam, airport) AS fl,
  CASE WHEN len(dests) = 1 AND fim IS NOT NULL THEN fim WHEN len(dests) >= 2 AND cim IS NOT NULL THEN cim ELSE iv END AS iv2,
  CASE WHEN CAST(frm AS INT) > 0 THEN CAST(frm AS INT) WHEN CAST(rooms AS INT) > 0 THEN CAST(rooms AS INT) ELSE 1 END AS rm,
  coalesce({DUR.format('fdm')}, {DUR.format('duration')}, '2007') AS dur FROM im),
y AS (SELECT x.*, bg.id AS bid, bg.country, bg.name AS bname, bg.av, CAST(CASE WHEN fd0 THEN split_part(iv2, '..', 1) ELSE departure[1] END AS DATE) AS b FROM x LEFT JOIN bg ON ft AND bg.key = lower(dests[1])),
win AS (SELECT b, min(d) AS lo, max(d) AS hi FROM (SELECT DISTINCT b FROM y) JOIN cal ON d BETWEEN b - 3 AND b + 3 GROUP BY 1),
z AS (SELECT *, CASE WHEN fp0 THEN CAST(p[1] AS INT) ELSE a END AS ad, CASE WHEN fp0 THEN CAST(p[2] AS INT) + CAST(p[3] AS INT) ELSE na END AS no, CASE WHEN fr0 THEN rm ELSE rooms0 END AS rms,
  CASE WHEN ff AND left(fl, 1) = '5' THEN 'Departure airport ''' || fl || ''' is unavailable' WHEN ft AND NOT av THEN 'Destination ''' || bname || ''' is unavailable' END AS closed FROM y LEFT JOIN win USING (b))"""


@query("h2_revalidated_fields", f"""{REVALIDATED}
SELECT request_id, CASE WHEN ft THEN coalesce(bid, dests[1]) || CASE WHEN country THEN ':COUNTRY' ELSE '' END ELSE array_to_string(list_sort(list_distinct(list_transform("to", lambda v: trim(v)))), ',') END AS to_ids,
 CASE WHEN ff THEN 'P' || left(fl, 1) ELSE 'AMS' END AS from_codes, CASE WHEN lo IS NULL THEN '' WHEN lo = hi THEN CAST(lo AS VARCHAR) ELSE lo || ',' || hi END AS departure_dates,
 CASE WHEN fu THEN dur ELSE trim(duration_id) END AS duration_id, ad AS adults, no AS non_adults, rms AS rooms,
 array_to_string(list_filter([CASE WHEN ft THEN 'to=popularity' END, CASE WHEN ff THEN 'from=' || CASE WHEN fam IS NOT NULL THEN 'destination:' || fad ELSE 'global' END END,
  CASE WHEN fd0 THEN 'departure=' || CASE WHEN len(dests) = 1 AND fim IS NOT NULL THEN 'destination:' || dests[1] WHEN len(dests) >= 2 AND cim IS NOT NULL THEN 'intersection:' || cl ELSE 'global' END END,
  CASE WHEN fu THEN 'duration=' || CASE WHEN {DUR.format('fdm')} IS NOT NULL THEN 'destination:' || fdd WHEN {DUR.format('duration')} IS NOT NULL THEN 'global' ELSE 'configuration' END END,
  CASE WHEN fp0 THEN 'party=' || CASE WHEN fpm IS NOT NULL THEN 'destination:' || fpd ELSE 'global' END END,
  CASE WHEN fr0 THEN 'rooms=' || CASE WHEN CAST(frm AS INT) > 0 THEN 'destination:' || frd WHEN CAST(rooms AS INT) > 0 THEN 'global' ELSE 'configuration' END END], lambda v: v IS NOT NULL), ';') AS origins,
 coalesce(closed, CASE WHEN lo IS NULL THEN 'Departure date is required' WHEN ad < 1 THEN 'At least one adult is required' WHEN rms < 1 THEN 'At least one room must be requested' END) AS detail,
 CASE WHEN closed IS NULL AND lo IS NOT NULL AND ad >= 1 AND rms >= 1 THEN 'success' ELSE 'failed' END AS status FROM z""")
def _(t):
    books = stored(bookings(t), "bookings")
    req = stored(requests_frame(t, books), "requests")
    filled = im.impute(req, pop.statistics_table(books), auto_rooms=False)
    cal = settle(calendar(t))
    place = lambda c: F.transform(c, lambda v: F.struct(v.alias("id"), v.alias("name"), F.lit("").alias("type"), F.lit(True).alias("available")))
    dates = F.transform("departure", lambda d: F.struct(d.alias("phrase"), d.try_cast("timestamp").alias("at")))
    extraction = req.select("request_id", place("from").alias("airports"), place("to").alias("destinations"), dates.alias("dates"), "duration_id",
                            F.lit(None).cast("string").alias("flex_id"), "adults", "non_adults", "rooms")
    number, first = F.substring("p_brand", 7, 9).cast("int"), F.substring("o_orderpriority", 1, 1)
    brands = t.part.select("p_brand").distinct().select(
        F.concat(F.lit("B"), number.cast("string")).alias("id"), F.col("p_brand").alias("name"), F.when(number % 2 == 0, "country").otherwise("").alias("type"), (number % 10 != 3).alias("available"))
    ports = t.orders.select("o_orderpriority").distinct().select(
        F.concat(F.lit("p"), first).alias("id"), F.col("o_orderpriority").alias("name"), F.lit("AIRPORT").alias("type"), (first != "5").alias("available"))
    out = cs.revalidate_imputed(cs.prepare(extraction, cal), filled, ports, brands, cal)
    pl = F.col("payload")
    shown = F.transform(F.map_entries("origins"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return out.select("request_id", F.array_join(F.array_sort(pl["to_ids"]), ",").alias("to_ids"), F.array_join(pl["from_codes"], ",").alias("from_codes"),
                      F.array_join(pl["departure_dates"], ",").alias("departure_dates"), pl["duration_id"].alias("duration_id"), pl["party"]["adults"].alias("adults"),
                      pl["party"]["nonAdults"].alias("non_adults"), pl["rooms"].alias("rooms"), F.array_join(shown, ";").alias("origins"), "detail", "status")


@query("h2_impute_revalidate", f"""{IMPUTE}, {SQL_CALENDAR},
f AS (SELECT request_id, CASE WHEN filled THEN dests ELSE "to" END AS t2, CASE WHEN len(departure) > 0 THEN departure[1] ELSE split_part(CASE WHEN len(dests) = 1 AND fim IS NOT NULL THEN fim WHEN len(dests) >= 2 AND cim IS NOT NULL THEN cim ELSE iv END, '..', 1) END AS dep,
  filled OR len("from") = 0 OR len(departure) = 0 AS touched FROM im)
SELECT request_id, CASE WHEN NOT touched THEN 'failed' WHEN CAST(dep AS DATE) NOT IN (SELECT d FROM cal) THEN 'failed' ELSE 'success' END AS status,
 CASE WHEN NOT touched THEN 'model failed' WHEN CAST(dep AS DATE) NOT IN (SELECT d FROM cal) THEN 'Departure date ''' || dep || ''' is not available' END AS detail FROM f""")
def _(t):
    books = settle(bookings(t))
    req = requests_frame(t, books)
    filled = im.impute(req, pop.statistics_table(books), auto_rooms=False)
    cal = settle(calendar(t))
    outcome = req.select("request_id", F.col("from").alias("from_codes"), F.col("to").alias("to_ids"),
                         F.col("departure").alias("departure_dates"), F.lit("failed").alias("status"), F.lit("model failed").alias("detail"))

    def validate(df):
        m = nm.first_off_calendar(df, cal)
        error = F.coalesce(nm.date_error(F.col("departure_dates"), F.col("off_calendar")), nm.destination_error(F.col("to_ids")))
        return m.withColumn("detail", error).withColumn("status", F.when(F.col("detail").isNull(), "success").otherwise("failed"))

    return cs.impute_and_revalidate(outcome, filled, validate).select("request_id", "status", "detail")


@query("h3_model_responses", """WITH s AS (SELECT o_orderkey AS request_id, o_orderkey % 6 AS v, strftime(o_orderdate, '%Y-%m-%d') AS d, o_custkey % 30 AS n, o_custkey FROM orders)
SELECT request_id, CASE v WHEN 4 THEN '' WHEN 5 THEN 'n' || n || ',ZZ' ELSE 'n' || n END AS airports, CASE WHEN v = 4 THEN '' ELSE 'R' || (n % 7) || CASE WHEN v = 0 THEN ',own' ELSE '' END END AS destinations, CASE WHEN v IN (0, 1) THEN d WHEN v = 2 THEN d || ',' || d WHEN v IN (3) THEN 'soon' ELSE '' END AS dates,
 CASE v WHEN 0 THEN '2010' WHEN 1 THEN '2003' END AS duration_id, CASE v WHEN 0 THEN 'm1' WHEN 1 THEN 'm2' END AS model,
 CASE WHEN v = 4 THEN 'Model response must be an object' WHEN v = 3 THEN 'Model returned invalid ISO date ''soon''' WHEN n >= 25 THEN 'Unknown departure airport ''n' || n || ''' returned by model' WHEN n % 7 >= 5 THEN 'Unknown destination ''R' || (n % 7) || ''' returned by model' END AS error FROM s""")
def _(t):
    k, d = F.col("o_orderkey"), F.date_format("o_orderdate", "yyyy-MM-dd")
    code = F.concat(F.lit("n"), F.col("o_custkey") % 30)
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    v = k % 6
    own = F.when(v == 5, ',{"id":"ZZ","name":"Own"}').otherwise("")
    place = q(F.concat(F.lit("R"), F.col("o_custkey") % 30 % 7))
    base = F.concat(F.lit('{"airports":['), q(code), own, F.lit('],"destinations":['), place,
                    F.when(v == 0, ',{"id":"own","name":"Given by the model"}').otherwise(""), F.lit("]"))
    inner = (F.when(v == 0, F.concat(base, F.lit(',"dates":['), q(d), F.lit('],"duration":"2010","model":"m0","llm":{"model":"m1"}}')))
             .when(v == 1, F.concat(base, F.lit(',"dates":[{"phrase":"then","iso":'), q(d), F.lit('}],"duration":{"id":"2003"},"model":"m2"}')))
             .when(v == 2, F.concat(base, F.lit(',"dates":[{"value":'), q(d), F.lit('},{"date":'), q(d), F.lit("}]}")))
             .when(v == 3, F.concat(base, F.lit(',"dates":["soon"]}'))).when(v == 4, F.lit("not json")).otherwise(F.concat(base, F.lit("}"))))
    text = F.to_json(F.struct(inner.alias("c")))
    content = F.regexp_extract(text, r'^\{"c":(.*)\}$', 1)
    body = F.when(k % 2 == 0, F.concat(F.lit('{"choices":[{"message":{"content":'), content, F.lit("}}]}"))).otherwise(
        F.concat(F.lit('{"candidates":[{"content":{"parts":[{"text":'), content, F.lit("}]}}]}")))
    rows = t.orders.select(k.alias("request_id"), body.alias("body"))
    read = ex.check_known_ids(ex.read_model_responses(rows), "airport_listed", airports(t), "departure airport", upper=True)
    read = ex.check_known_ids(read, "destination_listed", destinations(t), "destination")
    return read.select("request_id", F.array_join("airport_ids", ",").alias("airports"), F.array_join("destination_ids", ",").alias("destinations"), F.array_join("iso_dates", ",").alias("dates"),
                       "duration_id", F.get_json_object("response_meta", "$.model").alias("model"), F.col("response_error").alias("error"))
