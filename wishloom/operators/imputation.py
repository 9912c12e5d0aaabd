"""Filling missing search parameters from popularity statistics.

Requests carry: request_id, to, from (arrays of text), departure (array of ISO
dates), duration_id, adults, non_adults, rooms. Global statistics are one
value per metric and are read as constants. Per-destination statistics are
joined, never looped over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..plans.scale import lookup_join, settle, stored, unnest
from .popularity import modes, most_popular_destination

METRICS = ["duration", "party", "rooms", "departure_airport", "interval"]


def duration_ids() -> dict[int, str]:
    """Nights to duration id, from the digits of each name; a later entry wins."""
    import re

    found = {}
    for identifier, name in fv.DURATIONS:
        digits = re.search(r"\d+", name)
        if digits:
            found[int(digits.group())] = identifier
    return found


def map_duration(value: Column) -> Column:
    """A known id stays; a number of nights becomes its id; anything else is null."""
    table = duration_ids()
    nights = F.trim(value).try_cast("int")
    by_nights = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), nights)
    return F.when(F.trim(value).isin(list(table.values())), F.trim(value)).otherwise(by_nights)


def is_unpopulated() -> Column:
    def empty(name):
        return F.coalesce(F.size(name), F.lit(0)) <= 0

    return (empty("to") & empty("from") & empty("departure")
            & (F.coalesce(F.trim("duration_id"), F.lit("")) == "")
            & F.col("adults").isNull() & F.col("non_adults").isNull() & F.col("rooms").isNull())


def requested_destinations(requests: DataFrame, per_destination: DataFrame) -> DataFrame:
    """One pass over the requested names: spelling, gaps and first modes.

    `id:TYPE` becomes the known spelling, repeats are dropped without case.
    Returns request_id, destinations and missing (in request order), a struct
    d_<metric>(value, at) from the first destination that has a mode, and
    known_keys, the sorted folded names that have statistics.
    """
    # dealt by request once, short as they are; both groupings and the join of the requests keep that
    listed = requests.select("request_id", "to").repartition("request_id").select("request_id", F.posexplode("to").alias("pos", "raw"))
    base = F.trim(F.split_part(F.trim("raw"), F.lit(":"), F.lit(1)))
    named = listed.select("request_id", "pos", base.alias("name"), F.lower(base).alias("key")).where("name <> ''")
    table = per_destination.select(F.lower("destination").alias("key"), F.col("destination").alias("label"), *METRICS)
    each = lookup_join(named, table, "key", "left")
    first = each.groupBy("request_id", "key").agg(
        F.min("pos").alias("pos"), F.min_by(F.coalesce("label", "name"), "pos").alias("name"),
        F.max("label").isNull().alias("unknown"), *[F.max(m).alias(m) for m in METRICS])
    known = F.coalesce(*METRICS).isNotNull()
    # one entry per destination named in the request
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda s: s["name"])
    return first.groupBy("request_id").agg(
        ordered(F.struct("pos", "name")).alias("destinations"),
        ordered(F.when(F.col("unknown"), F.struct("pos", "name"))).alias("missing"),
        *[F.min_by(F.struct(F.col(m).alias("value"), F.col("name").alias("at")),
                   F.when(F.col(m).isNotNull(), F.col("pos"))).alias(f"d_{m}") for m in METRICS],
        F.array_sort(F.collect_set(F.when(known, F.lower("name")))).alias("known_keys"))


def destination_modes(statistics: DataFrame) -> DataFrame:
    """One row per destination: key, label and the usable mode of each metric."""
    return modes(statistics.where("scope = 'destination'")).groupBy("scope_key").pivot("metric", METRICS).agg(
        F.first("mode")).withColumnRenamed("scope_key", "destination")


def impute(requests: DataFrame, statistics: DataFrame, auto_rooms: bool = fv.ROOMS["auto"],
           allow_intersection: bool = True) -> DataFrame:
    """Adds every parameter with its value and source; given values are kept."""
    statistics = settle(statistics)
    usable = modes(statistics)
    popular = most_popular_destination(statistics).first()["destination"]
    # one value per metric, for everybody and for the most popular destination
    everywhere_or_popular = (F.col("scope") == "global") | ((F.col("scope") == "destination") & (F.lower("scope_key") == F.lower(F.lit(popular))))
    known = usable.where(everywhere_or_popular).orderBy(F.desc("scope_key")).collect()
    constants = {r["metric"]: r["mode"] for r in known if r["scope"] == "global"}
    own = {r["metric"]: r["mode"] for r in known if r["scope"] == "destination"}
    # a row per destination, stored so that names meet it without a shuffle where it is small
    per_destination = stored(destination_modes(statistics), "modes")
    combos = usable.where("scope = 'intersection'").select(
        F.lower("scope_key").alias("combination"), F.col("scope_key").alias("combination_label"),
        F.col("mode").alias("combination_interval"))

    def glob(metric):
        return F.lit(constants.get(metric)).cast("string")

    none = F.array().cast("array<string>")
    full = requests.join(requested_destinations(requests, per_destination), "request_id", "left").withColumns({
        "destinations": F.coalesce("destinations", none), "missing": F.coalesce("missing", none),
        "unpopulated": is_unpopulated(), "to_source": F.lit(None).cast("string")})
    if popular is not None:
        fill = F.col("unpopulated") | (F.size("destinations") == 0)
        constant = {m: F.lit(own.get(m)).cast("string") for m in METRICS}
        full = full.withColumn("_fill", fill).withColumns({
            **{f"d_{m}": F.when(F.col("_fill"), F.when(constant[m].isNotNull(), F.struct(
                constant[m].alias("value"), F.lit(popular).alias("at")))).otherwise(F.col(f"d_{m}")) for m in METRICS},
            "destinations": F.when(F.col("_fill"), F.array(F.lit(popular))).otherwise(F.col("destinations")),
            "known_keys": F.when(F.col("_fill"), F.array(F.lit(popular.lower()))).otherwise(F.col("known_keys")),
            "to_source": F.when(F.col("_fill"), F.lit("popularity"))})
    full = full.withColumn("combination", F.array_join(F.coalesce("known_keys", none), "||"))
    full = lookup_join(full, combos, "combination", "left")

    def at(metric):
        return F.col(f"d_{metric}.value"), F.concat(F.lit("destination:"), F.col(f"d_{metric}.at"))

    def choose(*options: tuple[Column, Column]) -> Column:
        return F.coalesce(*[F.when(v.isNotNull(), F.struct(v.cast("string").alias("value"), s.alias("source"))) for v, s in options])

    everywhere, config = F.lit("global"), F.lit("configuration")
    d_value, d_at = at("duration")
    duration = choose((map_duration(d_value), d_at), (map_duration(glob("duration")), everywhere),
                      (F.lit(fv.DEFAULT_DURATION_ID), config))
    p_value, p_at = at("party")
    party = choose((p_value, p_at), (glob("party"), everywhere),
                   (F.lit(f"{fv.DEFAULT_PARTY['adults']}/{fv.DEFAULT_PARTY['nonAdults']}/0"), config))
    r_value, r_at = at("rooms")

    def valid(c):
        return F.when(c.try_cast("int") > 0, c)

    rooms = F.struct(F.lit(None).cast("string").alias("value"), config.alias("source")) if auto_rooms else choose(
        (valid(r_value), r_at), (valid(glob("rooms")), everywhere), (F.lit(str(max(fv.ROOMS["default"], 1))), config))
    a_value, a_at = at("departure_airport")
    airport = choose((F.nullif(F.trim(a_value), F.lit("")), a_at), (glob("departure_airport"), everywhere))
    single = F.size("destinations") == 1
    first_label = F.element_at("destinations", 1)
    own_interval = F.when(single, F.col("d_interval.value"))
    shared = F.when((F.size("destinations") >= 2) & F.lit(allow_intersection), F.col("combination_interval"))
    interval = choose((own_interval, F.concat(F.lit("destination:"), first_label)),
                      (shared, F.concat(F.lit("intersection:"), F.col("combination_label"))),
                      (glob("interval"), everywhere))

    staged = full.withColumns({"_duration": duration, "_party": party, "_rooms": rooms, "_airport": airport, "_interval": interval})
    need_duration = F.coalesce(F.trim("duration_id"), F.lit("")) == ""
    need_party = F.col("adults").isNull() | F.col("non_adults").isNull()
    need_rooms = F.coalesce("rooms", F.lit(0)) == 0
    need_from = F.coalesce(F.size("from"), F.lit(0)) <= 0
    need_date = F.coalesce(F.size("departure"), F.lit(0)) <= 0
    people = F.split("_party.value", "/")
    return staged.select(
        "request_id", "unpopulated", "missing",
        F.when(F.col("to_source").isNotNull(), F.col("destinations")).otherwise(F.col("to")).alias("to"), "to_source",
        F.when(need_duration, F.col("_duration.value")).otherwise(F.col("duration_id")).alias("duration_id"),
        F.when(need_duration, F.col("_duration.source")).alias("duration_source"),
        F.when(need_party, people[0].cast("int")).otherwise(F.col("adults")).alias("adults"),
        F.when(need_party, people[1].cast("int") + people[2].cast("int")).otherwise(F.col("non_adults")).alias("non_adults"),
        F.when(need_party, F.col("_party.source")).alias("party_source"),
        F.when(need_rooms, F.col("_rooms.value").cast("int")).otherwise(F.col("rooms")).alias("rooms"),
        F.when(need_rooms, F.col("_rooms.source")).alias("rooms_source"),
        F.when(need_from & F.col("_airport").isNotNull(), F.array("_airport.value")).otherwise(F.col("from")).alias("from"),
        F.when(need_from & F.col("_airport").isNotNull(), F.col("_airport.source")).alias("from_source"),
        F.when(need_date & F.col("_interval").isNotNull(), F.array(F.split("_interval.value", r"\.\.")[0]))
        .otherwise(F.col("departure")).alias("departure"),
        F.when(need_date, F.col("_interval.source")).alias("departure_source"),
        F.when(need_date, F.col("_interval.value")).alias("interval"))


def merge_imputed(extracted: DataFrame, imputed: DataFrame, airports: DataFrame, destinations: DataFrame) -> DataFrame:
    """Imputed values go only into empty fields; names become ids, unknown names stay.

    extracted: request_id, to_ids, from_codes, departure_dates (arrays),
    duration_id, adults, non_adults, rooms. Destinations are told apart by
    id and type, airports by code. A party is taken whole or not at all, a
    date only if it is an ISO date, a duration only if it is configured.
    """
    # one pass names the labels of both lists; a label meets the gazetteer of its kind
    none = F.array().cast("array<string>")

    def labels(kind, column):
        return F.transform(F.coalesce(column, none), lambda v, i: F.struct(F.lit(kind).alias("kind"), i.alias("pos"), F.trim(v).alias("label")))

    listed = unnest(imputed.select("request_id", F.concat(labels("to", F.col("to")), labels("from", F.col("from"))).alias("_l")), "_l", "request_id").where(
        "label <> ''").withColumn("_k", F.lower("label"))
    table = destinations.withColumn("kind", F.lit("to")).select("kind", "name", "id", "type").unionByName(
        airports.withColumn("kind", F.lit("from")).select("kind", "name", "id", "type")).select(
        "kind", F.lower(F.trim("name")).alias("_k"), F.col("id").alias("_id"), F.coalesce(F.trim("type"), F.lit("")).alias("_type"))
    each = lookup_join(listed, table, ["kind", "_k"], "left")
    airport = F.col("kind") == "from"
    code = F.when(airport, F.upper(F.coalesce("_id", "label"))).otherwise(F.trim(F.coalesce("_id", "label")))
    kind = F.when(airport, F.lit("")).otherwise(F.coalesce("_type", F.lit("")))
    first = each.groupBy("request_id", "kind", code.alias("code"), kind.alias("type")).agg(F.min("pos").alias("pos")).where("code <> ''")
    in_order = lambda kind: F.transform(F.array_sort(F.collect_list(
        F.when(F.col("kind") == kind, F.struct("pos", "code")))), lambda s: s["code"])
    some = lambda codes: F.when(F.size(codes) > 0, codes)
    named = first.groupBy("request_id").agg(some(in_order("to")).alias("_to"), some(in_order("from")).alias("_from"))

    given = imputed.select("request_id", F.col("duration_id").alias("_duration"), F.col("departure").alias("_departure"),
                           F.col("adults").alias("_adults"), F.col("non_adults").alias("_non_adults"), F.col("rooms").cast("int").alias("_rooms"))
    joined = extracted.join(named, "request_id", "left").join(given, "request_id", "left")

    def kept(own, new):
        return F.when(F.coalesce(F.size(own), F.lit(0)) > 0, F.col(own)).otherwise(new)

    known = [d for d, _n in fv.DURATIONS]
    dates = F.filter(F.transform("_departure", F.trim), lambda d: d.try_cast("timestamp").isNotNull())
    no_party = F.col("adults").isNull() & F.col("non_adults").isNull()
    whole = no_party & F.col("_adults").isNotNull() & F.col("_non_adults").isNotNull()
    return joined.select(
        "request_id", kept("to_ids", F.col("_to")).alias("to_ids"), kept("from_codes", F.col("_from")).alias("from_codes"),
        kept("departure_dates", dates).alias("departure_dates"),
        F.coalesce(F.nullif(F.trim("duration_id"), F.lit("")), F.when(F.trim("_duration").isin(known), F.trim("_duration")))
        .alias("duration_id"),
        F.when(whole, F.col("_adults")).otherwise(F.col("adults")).alias("adults"),
        F.when(whole, F.col("_non_adults")).otherwise(F.col("non_adults")).alias("non_adults"),
        F.coalesce("rooms", "_rooms").alias("rooms"))


GIVEN = ["to", "from", "departure", "duration_id", "adults", "non_adults", "rooms"]
SOURCES = ["to", "from", "departure", "duration", "party", "rooms"]
PLACE = "struct<id:string,name:string,type:string,available:boolean>"


def fill_extraction(extracted: DataFrame, imputed: DataFrame, airports: DataFrame, destinations: DataFrame,
                    key: str = "request_id") -> DataFrame:
    """Empty fields of an extraction from imputed ones; adds `origins`, field to source, of what was filled.

    extracted: key, airports, destinations (arrays of places), dates
    (array of phrase and time), duration_id and, where it has them, adults,
    non_adults, rooms. imputed: from `impute`. Names become places of the gazetteers (id, name, type,
    available), unknown names places of their own that count as available; a
    code, or an id with its type, is taken once. A party is filled whole, a date
    if it is an ISO date, a duration if it is configured.
    """
    absent = [c for c in ("adults", "non_adults", "rooms") if c not in extracted.columns]
    asked = extracted.withColumns({c: F.lit(None).cast("int") for c in absent}) if absent else extracted
    columns = asked.columns
    given = imputed.select(key, *[F.col(c).alias(f"_{c}") for c in GIVEN],
                           *[F.col(f"{c}_source").alias(f"_{c}_source") for c in SOURCES])
    joined = asked.join(given, key, "left")
    none = F.coalesce(F.size("airports"), F.lit(0)) <= 0, F.coalesce(F.size("destinations"), F.lit(0)) <= 0

    def labels(kind, empty, column):
        listed = F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda v, i: F.struct(
            F.lit(kind).alias("kind"), F.trim(v).alias("label"), i.alias("pos")))
        return F.when(empty, listed).otherwise(F.array().cast("array<struct<kind:string,label:string,pos:int>>"))

    # one pass names the places of both gazetteers
    wanted = joined.select(key, F.concat(labels("airport", none[0], F.col("_from")), labels("destination", none[1], F.col("_to"))).alias("_l"))
    named = unnest(wanted, "_l", key).where("label <> ''").withColumn("_k", F.lower("label"))
    known = airports.withColumn("kind", F.lit("airport")).select("kind", "id", "name", "type", "available").unionByName(
        destinations.withColumn("kind", F.lit("destination")).select("kind", "id", "name", "type", "available"))
    table = known.groupBy("kind", F.lower(F.trim("name")).alias("_k")).agg(
        F.min(F.struct("id", "name", F.coalesce("type", F.lit("")).alias("type"), F.coalesce("available", F.lit(True)).alias("available"))).alias("_p"))
    airport = F.col("kind") == "airport"
    own = F.struct(F.when(airport, F.upper("label")).otherwise(F.col("label")).alias("id"), F.col("label").alias("name"),
                   F.lit("").alias("type"), F.lit(True).alias("available"))
    place = lookup_join(named, table, ["kind", "_k"], "left").withColumn("_p", F.coalesce("_p", own).cast(PLACE))
    code = F.when(airport, F.upper(F.trim("_p.id"))).otherwise(F.concat_ws(":", F.trim("_p.id"), F.nullif(F.trim("_p.type"), F.lit(""))))
    once = place.where(F.trim("_p.id") != "").groupBy(key, "kind", code.alias("_c")).agg(F.min(F.struct("pos", "_p")).alias("_e"))
    # as many entries as a request has labels
    in_order = lambda kind: F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.col("_e")))), lambda e: e["_p"])
    places = once.groupBy(key).agg(in_order("airport").alias("_airports"), in_order("destination").alias("_destinations"))
    dates = F.filter(F.transform("_departure", lambda d: F.struct(F.trim(d).alias("phrase"), F.trim(d).try_cast("timestamp").alias("at"))),
                     lambda d: d["at"].isNotNull())
    fill = {
        "from": none[0] & (F.size("_airports") > 0), "to": none[1] & (F.size("_destinations") > 0),
        "departure": (F.coalesce(F.size("dates"), F.lit(0)) <= 0) & (F.size("_dates") > 0),
        "duration": (F.coalesce(F.trim("duration_id"), F.lit("")) == "") & F.trim("_duration_id").isin([d for d, _n in fv.DURATIONS]),
        "party": F.col("adults").isNull() & F.col("non_adults").isNull() & F.col("_adults").isNotNull() & F.col("_non_adults").isNotNull(),
        "rooms": F.col("rooms").isNull() & F.col("_rooms").isNotNull()}
    marked = joined.join(places, key, "left").withColumn("_dates", dates).withColumn("_fill", F.struct(*[
        F.coalesce(c, F.lit(False)).alias(name) for name, c in fill.items()]))
    f = F.col("_fill")
    filled = {
        "airports": F.when(f["from"], F.col("_airports")).otherwise(F.col("airports")),
        "destinations": F.when(f["to"], F.col("_destinations")).otherwise(F.col("destinations")),
        "dates": F.when(f["departure"], F.col("_dates")).otherwise(F.col("dates")),
        "duration_id": F.when(f["duration"], F.trim("_duration_id")).otherwise(F.col("duration_id")),
        "adults": F.when(f["party"], F.col("_adults")).otherwise(F.col("adults")),
        "non_adults": F.when(f["party"], F.col("_non_adults")).otherwise(F.col("non_adults")),
        "rooms": F.when(f["rooms"], F.col("_rooms")).otherwise(F.col("rooms"))}
    origins = F.map_from_entries(F.filter(F.array(*[F.struct(
        F.lit(c).alias("key"), F.when(f[c], F.coalesce(F.col(f"_{c}_source"), F.lit("given"))).alias("value")) for c in SOURCES]),
        lambda e: e["value"].isNotNull()))
    return marked.select(*[filled.get(c, F.col(f"`{c}`")).alias(c) for c in columns], origins.alias("origins"))
