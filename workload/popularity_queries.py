"""A1-A6, W8, S16, J11, J12, I1-I10 over orders, lineitem and part."""

from __future__ import annotations

from pyspark.sql import functions as F

from wishloom.operators import imputation as im
from wishloom.operators import popularity as pop
from wishloom.plans.scale import settle

from .frames import SQL_BOOKINGS, bookings
from .registry import query

UNPIVOT = """
unp AS (
  SELECT ord, destinations, 'duration' AS metric, CAST(duration AS VARCHAR) AS value FROM bookings WHERE duration IS NOT NULL
  UNION ALL SELECT ord, destinations, 'rooms', CAST(rooms AS VARCHAR) FROM bookings
  UNION ALL SELECT ord, destinations, 'party', adults || '/' || children || '/' || infants FROM bookings
  UNION ALL SELECT ord, destinations, 'interval', start_date || '..' || end_date FROM bookings WHERE end_date IS NOT NULL
  UNION ALL SELECT ord, destinations, 'departure_airport', airport FROM bookings WHERE airport IS NOT NULL),
gl AS (SELECT metric, value, count(*) AS n, min(ord) AS f FROM (SELECT metric, value, ord FROM unp
   UNION ALL SELECT 'destination', unnest(destinations), ord FROM bookings) GROUP BY 1, 2),
ds AS (SELECT destination, metric, value, count(*) AS n, min(ord) AS f FROM (SELECT unnest(destinations) AS destination, metric, value, ord FROM unp) GROUP BY 1, 2, 3),
ix AS (SELECT combination, value, count(*) AS n, min(ord) AS f FROM (SELECT array_to_string(list_sort(destinations), '||') AS combination, value, ord FROM unp WHERE metric = 'interval' AND len(destinations) >= 2) GROUP BY 1, 2)
"""
POP = f"WITH {SQL_BOOKINGS}, {UNPIVOT}"


def summary_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, f, value NULLS FIRST) AS rank, value, n AS "count",
  max(n) OVER (PARTITION BY {keys}) AS mode_count, count(*) OVER (PARTITION BY {keys}) AS unique_values,
  CAST(sum(n) OVER (PARTITION BY {keys}) AS BIGINT) AS total FROM {source} QUALIFY rank <= 5"""


@query("a1_value_counts", f"""
WITH c AS (SELECT o_custkey, o_orderpriority AS value, count(*) AS n, min(o_orderkey) AS f FROM orders GROUP BY 1, 2) {summary_sql('c', 'o_custkey')}""")
def _(t):
    return pop.summarize(pop.value_counts(t.orders, ["o_custkey"], "o_orderpriority", F.col("o_orderkey")), ["o_custkey"])


@query("a2_global_statistics", f"{POP} {summary_sql('gl', 'metric')}")
def _(t):
    return pop.global_statistics(bookings(t))


@query("a3_destination_statistics", f"{POP} {summary_sql('ds', 'destination, metric')}")
def _(t):
    return pop.destination_statistics(bookings(t))


@query("a4_intersection_statistics", f"{POP} {summary_sql('ix', 'combination')}")
def _(t):
    return pop.intersection_statistics(bookings(t))


@query("a5_destination_mentions", f"""WITH {SQL_BOOKINGS} SELECT count(*) AS "rows", CAST(sum(len(destinations)) AS BIGINT) AS destination_mentions FROM bookings""")
def _(t):
    return pop.totals(bookings(t))


LONG = f"""{POP},
glt AS ({summary_sql('gl', 'metric')}), dst AS ({summary_sql('ds', 'destination, metric')}), ixt AS ({summary_sql('ix', 'combination')}),
st AS (SELECT 'global' AS scope, '' AS scope_key, metric, rank, value, "count", mode_count, unique_values, total FROM glt
  UNION ALL SELECT 'destination', destination, metric, rank, value, "count", mode_count, unique_values, total FROM dst
  UNION ALL SELECT 'intersection', combination, 'interval', rank, value, "count", mode_count, unique_values, total FROM ixt)
"""


@query("a6_popular_destination", f"""{LONG}, g AS (SELECT value FROM st WHERE scope = 'global' AND metric = 'destination' ORDER BY rank LIMIT 1),
d AS (SELECT scope_key FROM st WHERE scope = 'destination' AND metric = 'duration' ORDER BY total DESC, mode_count DESC, scope_key LIMIT 1)
SELECT (SELECT value FROM g) AS with_global, (SELECT scope_key FROM d) AS without_global""")
def _(t):
    st = settle(pop.statistics_table(bookings(t)))
    with_global = pop.most_popular_destination(st).select(F.lit(1).alias("k"), F.col("destination").alias("with_global"))
    without = pop.most_popular_destination(st.where("metric <> 'destination'")).select(
        F.lit(1).alias("k"), F.col("destination").alias("without_global"))
    return with_global.join(without, "k").drop("k")


@query("w8_document_order", f"""{LONG}, k AS (SELECT DISTINCT scope, scope_key FROM st)
SELECT scope, scope_key, row_number() OVER (PARTITION BY scope ORDER BY len(string_split(scope_key, '||')), string_split(scope_key, '||')) AS position FROM k""")
def _(t):
    keys = pop.key_positions(pop.statistics_table(bookings(t)))
    return keys.select("scope", "scope_key", (F.col("position") + 1).alias("position"))


@query("s16_statistics_document", f"""{LONG}
SELECT scope, scope_key, metric, arg_min(coalesce(value, 'null'), rank) AS mode, max(mode_count) AS mode_count,
 string_agg(coalesce(value, 'null') || '=' || "count", ',' ORDER BY rank) AS top_values, max(unique_values) AS unique_values, max(total) AS total FROM st GROUP BY 1, 2, 3""")
def _(t):
    doc = pop.statistics_document(pop.statistics_table(bookings(t)))
    schema = ("mode string, mode_count long, top_values array<struct<value:string,count:long>>, unique_values long, total long")
    s = doc.withColumn("s", F.from_json("summary", schema))
    pair = F.transform("s.top_values", lambda e: F.concat(F.coalesce(e["value"], F.lit("null")), F.lit("="), e["count"]))
    return s.select("scope", "scope_key", "metric", F.coalesce("s.mode", F.lit("null")).alias("mode"), "s.mode_count",
                    F.array_join(pair, ",").alias("top_values"), "s.unique_values", "s.total")


# -- imputation ---------------------------------------------------------------

REQ = """
req AS (SELECT o_orderkey AS request_id,
  CASE o_orderkey % 6 WHEN 0 THEN [] WHEN 1 THEN ['Brand#' || (1 + o_custkey % 25) || ':COUNTRY'] WHEN 2 THEN ['brand#' || (1 + o_custkey % 25), 'Brand#' || (1 + o_custkey % 7), 'BRAND#' || (1 + o_custkey % 25)]
    WHEN 3 THEN [' Nowhere ', 'Brand#' || (1 + o_custkey % 25)] WHEN 4 THEN b.destinations ELSE ['Nowhere'] END AS "to",
  CASE WHEN o_orderkey % 4 = 1 THEN ['AMS'] ELSE [] END AS "from", CASE WHEN o_orderkey % 5 = 1 THEN ['2026-01-02'] ELSE [] END AS departure,
  CASE WHEN o_orderkey % 9 = 1 THEN '2010' WHEN o_orderkey % 9 = 2 THEN ' ' END AS duration_id,
  CASE WHEN o_orderkey % 7 = 1 THEN 3 END AS a, CASE WHEN o_orderkey % 7 = 1 THEN 1 END AS na, CASE o_orderkey % 8 WHEN 1 THEN 2 WHEN 2 THEN 0 END AS rooms
  FROM orders JOIN bookings b ON ord = o_orderkey)
"""


def requests_frame(t, books):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    none = F.array().cast("array<string>")

    def brand(prefix, n):
        return F.concat(F.lit(prefix), (1 + c % n).cast("string"))

    to = (F.when(k % 6 == 0, none).when(k % 6 == 1, F.array(F.concat(brand("Brand#", 25), F.lit(":COUNTRY"))))
          .when(k % 6 == 2, F.array(brand("brand#", 25), brand("Brand#", 7), brand("BRAND#", 25)))
          .when(k % 6 == 3, F.array(F.lit(" Nowhere "), brand("Brand#", 25)))
          .when(k % 6 == 4, F.col("destinations")).otherwise(F.array(F.lit("Nowhere"))))
    joined = t.orders.join(books.select("ord", "destinations"), k == F.col("ord"))
    return joined.select(
        k.alias("request_id"), to.alias("to"),
        F.when(k % 4 == 1, F.array(F.lit("AMS"))).otherwise(none).alias("from"),
        F.when(k % 5 == 1, F.array(F.lit("2026-01-02"))).otherwise(none).alias("departure"),
        F.when(k % 9 == 1, "2010").when(k % 9 == 2, " ").alias("duration_id"),
        F.when(k % 7 == 1, 3).alias("adults"), F.when(k % 7 == 1, 1).alias("non_adults"),
        F.when(k % 8 == 1, 2).when(k % 8 == 2, 0).alias("rooms"))


DUR = "CASE CAST({0} AS INT) " + " ".join(f"WHEN {n} THEN '{i}'" for n, i in im.duration_ids().items()) + " END"
IMPUTE = f"""{LONG}, {REQ},
md AS (SELECT scope, scope_key, metric, arg_min(value, rank) AS mode FROM st WHERE value IS NOT NULL AND trim(value) <> '' GROUP BY 1, 2, 3),
gm AS (SELECT max(mode) FILTER (metric = 'duration') AS duration, max(mode) FILTER (metric = 'party') AS party, max(mode) FILTER (metric = 'rooms') AS rooms,
  max(mode) FILTER (metric = 'departure_airport') AS airport, max(mode) FILTER (metric = 'interval') AS iv, max(mode) FILTER (metric = 'destination') AS dest FROM md WHERE scope = 'global'),
bn AS (SELECT DISTINCT scope_key AS label, lower(scope_key) AS key FROM md WHERE scope = 'destination'),
ex AS (SELECT request_id, unnest("to") AS raw, unnest(range(len("to"))) AS pos FROM req),
nm AS (SELECT request_id, pos, trim(split_part(trim(raw), ':', 1)) AS name, lower(trim(split_part(trim(raw), ':', 1))) AS key FROM ex),
dd AS (SELECT request_id, nm.key, min(pos) AS pos, coalesce(any_value(label), arg_min(name, pos)) AS name, any_value(label) IS NULL AS unknown FROM nm LEFT JOIN bn ON bn.key = nm.key WHERE name <> '' GROUP BY 1, 2),
can AS (SELECT request_id, list(name ORDER BY pos) AS dests, list(name ORDER BY pos) FILTER (unknown) AS missing FROM dd GROUP BY 1),
r1 AS (SELECT req.*, coalesce(dests, []) AS d0, coalesce(missing, []) AS missing, len("to") = 0 AND len("from") = 0 AND len(departure) = 0 AND trim(coalesce(duration_id, '')) = '' AND a IS NULL AND na IS NULL AND rooms IS NULL AS unpopulated FROM req LEFT JOIN can USING (request_id)),
r2 AS (SELECT r1.*, unpopulated OR len(d0) = 0 AS filled, CASE WHEN unpopulated OR len(d0) = 0 THEN [gm.dest] ELSE d0 END AS dests FROM r1, gm),
e2 AS (SELECT request_id, unnest(dests) AS dest, unnest(range(len(dests))) AS pos FROM r2),
lk AS (SELECT request_id, pos, dest, metric, mode FROM e2 JOIN md ON scope = 'destination' AND lower(scope_key) = lower(dest)),
fm AS (SELECT request_id, metric, arg_min(mode, pos) AS mode, arg_min(dest, pos) AS dest FROM lk GROUP BY 1, 2),
kk AS (SELECT request_id, array_to_string(list_sort(list(DISTINCT lower(dest))), '||') AS combo FROM lk GROUP BY 1),
im AS (SELECT r2.request_id, unpopulated, array_to_string(missing, ',') AS missing, filled, "to", dests, "from", departure, r2.duration_id, a, na, r2.rooms AS rooms0,
  fd.mode AS fdm, fd.dest AS fdd, fp.mode AS fpm, fp.dest AS fpd, fr.mode AS frm, fr.dest AS frd, fa.mode AS fam, fa.dest AS fad, fi.mode AS fim, c.mode AS cim, c.scope_key AS cl, gm.*
  FROM r2 CROSS JOIN gm LEFT JOIN fm fd ON fd.request_id = r2.request_id AND fd.metric = 'duration' LEFT JOIN fm fp ON fp.request_id = r2.request_id AND fp.metric = 'party'
  LEFT JOIN fm fr ON fr.request_id = r2.request_id AND fr.metric = 'rooms' LEFT JOIN fm fa ON fa.request_id = r2.request_id AND fa.metric = 'departure_airport'
  LEFT JOIN fm fi ON fi.request_id = r2.request_id AND fi.metric = 'interval' LEFT JOIN kk ON kk.request_id = r2.request_id
  LEFT JOIN md c ON c.scope = 'intersection' AND lower(c.scope_key) = kk.combo)
"""


def imputed(t, auto_rooms=False):
    books = settle(bookings(t))
    return im.impute(requests_frame(t, books), pop.statistics_table(books), auto_rooms=auto_rooms)


@query("i1_unpopulated", f"{IMPUTE} SELECT request_id, unpopulated FROM im")
def _(t):
    return imputed(t).select("request_id", "unpopulated")


@query("i2_destination", f"""{IMPUTE} SELECT request_id, array_to_string(CASE WHEN filled THEN dests ELSE "to" END, ',') AS "to", CASE WHEN filled THEN 'popularity' END AS to_source FROM im""")
def _(t):
    return imputed(t).select("request_id", F.array_join("to", ",").alias("to"), "to_source")


@query("i3_duration", f"""{IMPUTE} SELECT request_id, CASE WHEN trim(coalesce(duration_id, '')) <> '' THEN duration_id ELSE coalesce({DUR.format('fdm')}, {DUR.format('duration')}, '2007') END AS duration_id,
 CASE WHEN trim(coalesce(duration_id, '')) <> '' THEN NULL WHEN {DUR.format('fdm')} IS NOT NULL THEN 'destination:' || fdd WHEN {DUR.format('duration')} IS NOT NULL THEN 'global' ELSE 'configuration' END AS duration_source FROM im""")
def _(t):
    return imputed(t).select("request_id", "duration_id", "duration_source")


@query("i4_party", f"""{IMPUTE}, p AS (SELECT *, string_split(coalesce(fpm, party), '/') AS x FROM im)
SELECT request_id, coalesce(a, CAST(x[1] AS INT)) AS adults, coalesce(na, CAST(x[2] AS INT) + CAST(x[3] AS INT)) AS non_adults,
 CASE WHEN a IS NOT NULL THEN NULL WHEN fpm IS NOT NULL THEN 'destination:' || fpd ELSE 'global' END AS party_source FROM p""")
def _(t):
    return imputed(t).select("request_id", "adults", "non_adults", "party_source")


@query("i5_rooms", f"""{IMPUTE} SELECT request_id, CASE WHEN rooms0 > 0 THEN rooms0 WHEN CAST(frm AS INT) > 0 THEN CAST(frm AS INT) WHEN CAST(rooms AS INT) > 0 THEN CAST(rooms AS INT) ELSE 1 END AS rooms,
 CASE WHEN rooms0 > 0 THEN NULL WHEN CAST(frm AS INT) > 0 THEN 'destination:' || frd WHEN CAST(rooms AS INT) > 0 THEN 'global' ELSE 'configuration' END AS rooms_source FROM im""")
def _(t):
    return imputed(t).select("request_id", "rooms", "rooms_source")


@query("i6_airport", f"""{IMPUTE} SELECT request_id, CASE WHEN len("from") > 0 THEN "from"[1] ELSE coalesce(fam, airport) END AS airport, CASE WHEN len("from") > 0 THEN NULL WHEN fam IS NOT NULL THEN 'destination:' || fad ELSE 'global' END AS from_source FROM im""")
def _(t):
    return imputed(t).select("request_id", F.element_at("from", 1).alias("airport"), "from_source")


@query("i7_interval", f"""{IMPUTE}, v AS (SELECT *, CASE WHEN len(dests) = 1 AND fim IS NOT NULL THEN 'destination:' || dests[1] WHEN len(dests) >= 2 AND cim IS NOT NULL THEN 'intersection:' || cl ELSE 'global' END AS src FROM im)
SELECT request_id, CASE WHEN len(departure) > 0 THEN departure[1] ELSE split_part(CASE WHEN src LIKE 'dest%' THEN fim WHEN src LIKE 'inter%' THEN cim ELSE iv END, '..', 1) END AS departure, CASE WHEN len(departure) = 0 THEN src END AS departure_source FROM v""")
def _(t):
    return imputed(t).select("request_id", F.element_at("departure", 1).alias("departure"), "departure_source")


@query("i8_canonical_destinations", f"{IMPUTE} SELECT request_id, array_to_string(d0, ',') AS destinations, array_to_string(missing, ',') AS missing FROM r1")
def _(t):
    books = settle(bookings(t))
    names = settle(im.destination_modes(pop.statistics_table(books)))
    req = requests_frame(t, books)
    c = req.select("request_id").join(im.requested_destinations(req, names), "request_id", "left")
    none = F.array().cast("array<string>")
    return c.select("request_id", F.array_join(F.coalesce("destinations", none), ",").alias("destinations"),
                    F.array_join(F.coalesce("missing", none), ",").alias("missing"))


@query("i9_usable_modes", f"{IMPUTE} SELECT scope, scope_key, metric, mode FROM md")
def _(t):
    return pop.modes(pop.statistics_table(bookings(t)))


@query("j11_first_destination_mode", f"""{POP}, {REQ}, dm AS (SELECT destination, metric, value AS mode FROM ds WHERE value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY destination, metric ORDER BY n DESC, f, value) = 1),
e AS (SELECT request_id, lower(trim(split_part(trim(x), ':', 1))) AS key, pos FROM (SELECT request_id, unnest("to") AS x, unnest(range(len("to"))) AS pos FROM req))
SELECT request_id, metric, arg_min(mode, pos) AS mode, arg_min(destination, pos) AS dest FROM e JOIN dm ON lower(destination) = key GROUP BY 1, 2""")
def _(t):
    books = settle(bookings(t))
    table = settle(im.destination_modes(pop.statistics_table(books)))
    fm = im.requested_destinations(requests_frame(t, books), table)
    rows = F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"d_{m}.value").alias("mode"), F.col(f"d_{m}.at").alias("dest")) for m in im.METRICS]))
    return fm.select("request_id", rows).where("mode is not null")


@query("j12_combination_lookup", f"""{POP}, m AS (SELECT combination, arg_min(value, f) AS value, max(n) AS n FROM (SELECT * FROM ix QUALIFY n = max(n) OVER (PARTITION BY combination)) GROUP BY 1)
SELECT ord, value AS interval FROM bookings JOIN m ON combination = array_to_string(list_sort(destinations), '||')""")
def _(t):
    from wishloom.plans.scale import lookup_join

    books = settle(bookings(t))
    table = settle(pop.intersection_statistics(books).where("rank = 1").select("combination", F.col("value").alias("interval")))
    keyed = books.select("ord", F.array_join(pop.destination_set(F.col("destinations")), "||").alias("combination"))
    return lookup_join(keyed, table, "combination").select("ord", "interval")


@query("i10_merge_imputed", f"""{IMPUTE}, dg AS (SELECT lower(r_name) AS key, 'R' || r_regionkey AS id, CASE WHEN r_regionkey % 2 = 0 THEN 'country' ELSE '' END AS kind FROM region),
ag AS (SELECT lower(n_name) AS key, 'N' || n_nationkey AS id FROM nation),
x AS (SELECT *, string_split(coalesce(fpm, party), '/') AS p, CASE WHEN filled THEN dests ELSE "to" END AS t2, CASE WHEN len("from") > 0 THEN "from" ELSE [coalesce(fam, airport)] END AS f2,
  CASE WHEN len(departure) > 0 THEN departure ELSE [split_part(CASE WHEN len(dests) = 1 AND fim IS NOT NULL THEN fim WHEN len(dests) >= 2 AND cim IS NOT NULL THEN cim ELSE iv END, '..', 1)] END AS dep,
  CASE WHEN rooms0 > 0 THEN rooms0 WHEN CAST(frm AS INT) > 0 THEN CAST(frm AS INT) WHEN CAST(rooms AS INT) > 0 THEN CAST(rooms AS INT) ELSE 1 END AS rm,
  CASE WHEN trim(coalesce(duration_id, '')) <> '' THEN duration_id ELSE coalesce({DUR.format('fdm')}, {DUR.format('duration')}, '2007') END AS dur FROM im),
tl AS (SELECT request_id, code, kind, min(pos) AS pos FROM (SELECT request_id, pos, coalesce(id, label) AS code, coalesce(kind, '') AS kind FROM
  (SELECT request_id, trim(unnest(t2)) AS label, unnest(range(len(t2))) AS pos FROM x) e LEFT JOIN dg ON dg.key = lower(label) WHERE label <> '') GROUP BY 1, 2, 3),
fl AS (SELECT request_id, code, min(pos) AS pos FROM (SELECT request_id, pos, upper(coalesce(id, label)) AS code FROM
  (SELECT request_id, trim(unnest(f2)) AS label, unnest(range(len(f2))) AS pos FROM x) e LEFT JOIN ag ON ag.key = lower(label) WHERE label <> '') GROUP BY 1, 2)
SELECT x.request_id, CASE WHEN x.request_id % 3 = 0 THEN 'own' ELSE coalesce((SELECT string_agg(code, ',' ORDER BY pos, code) FROM tl WHERE tl.request_id = x.request_id), '') END AS to_ids,
 coalesce((SELECT string_agg(code, ',' ORDER BY pos, code) FROM fl WHERE fl.request_id = x.request_id), '') AS from_codes,
 CASE WHEN x.request_id % 5 = 0 THEN '2030-01-01' ELSE array_to_string(list_filter(dep, lambda d: TRY_CAST(d AS TIMESTAMP) IS NOT NULL), ',') END AS departure_dates,
 CASE WHEN x.request_id % 2 = 0 THEN '2003' ELSE dur END AS duration_id,
 CASE WHEN x.request_id % 7 = 0 THEN 9 ELSE coalesce(a, CAST(p[1] AS INT)) END AS adults,
 CASE WHEN x.request_id % 7 = 0 THEN NULL ELSE coalesce(na, CAST(p[2] AS INT) + CAST(p[3] AS INT)) END AS non_adults,
 CASE WHEN x.request_id % 4 = 0 THEN 8 ELSE rm END AS rooms FROM x""")
def _(t):
    i = settle(imputed(t))
    none = F.array().cast("array<string>")
    r = F.col("request_id")
    own = i.select(
        "request_id", F.when(r % 3 == 0, F.array(F.lit("own"))).otherwise(none).alias("to_ids"), none.alias("from_codes"),
        F.when(r % 5 == 0, F.array(F.lit("2030-01-01"))).otherwise(none).alias("departure_dates"),
        F.when(r % 2 == 0, "2003").otherwise(" ").alias("duration_id"), F.when(r % 7 == 0, 9).alias("adults"),
        F.lit(None).cast("int").alias("non_adults"), F.when(r % 4 == 0, 8).alias("rooms"))
    from .frames import airports, destinations

    merged = im.merge_imputed(own, i, airports(t), destinations(t))
    return merged.withColumns({c: F.array_join(F.coalesce(c, none), ",") for c in ("to_ids", "from_codes", "departure_dates")})
