"""Canonical search payloads and their validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..plans.scale import lookup_join

MSG = fv.VALIDATION_MESSAGES


def departure_window(df: DataFrame, calendar: DataFrame | None, base: str = "base_date", flex: str = "flex_id",
                     key: str = "request_id", flexible: bool = fv.FLEXIBILITY_ALLOWED, table: DataFrame | None = None) -> DataFrame:
    """Adds departure_dates: 0-2 ISO dates around the base date.

    calendar: (d date), or None for no calendar. The first open day from
    base - n and the last one up to base + n are looked up in a table of
    days, so any reach works, nothing is joined by range, and the requests
    are read once. Nothing runs before the caller's action: the span of the
    calendar is a scalar subquery. `table`: `open_days` of the calendar, if the caller has it ready.
    """
    days = F.coalesce(F.coalesce(F.col(flex), F.lit(fv.DEFAULT_FLEX_ID)).try_cast("int"), F.lit(0))
    reach = F.greatest(days, F.lit(0)) if flexible else F.lit(0)
    first, last = F.date_sub(F.col(base), reach), F.date_add(F.col(base), reach)
    none = F.array().cast("array<string>")
    if calendar is None:
        ends = F.array_distinct(F.array(first, last))
        shown = F.when(F.col(base).isNotNull(), F.transform(ends, lambda d: F.date_format(d, "yyyy-MM-dd")))
        return df.withColumn("departure_dates", F.coalesce(shown, none))
    table = open_days(calendar) if table is None else table
    opens, closes = calendar.agg(F.min("d")).scalar(), calendar.agg(F.max("d")).scalar()
    rows = df.withColumns({"_first": F.greatest(first, opens), "_last": F.least(last, closes)})
    joined = lookup_join(rows, table.select(F.col("day").alias("_first"), F.col("next_open").alias("_lo")), "_first", "left")
    joined = lookup_join(joined, table.select(F.col("day").alias("_last"), F.col("last_open").alias("_hi")), "_last", "left")
    found = F.when(F.col(base).isNotNull() & (F.col("_lo") <= F.col("_hi")) & (F.col("_lo") <= last) & (F.col("_hi") >= first),
                   F.array_distinct(F.array("_lo", "_hi")))
    shown = F.transform(found, lambda d: F.date_format(d, "yyyy-MM-dd"))
    return joined.withColumn("departure_dates", F.coalesce(shown, none)).drop("_first", "_last", "_lo", "_hi")


def open_days(calendar: DataFrame) -> DataFrame:
    """(day, next_open, last_open) for every day of the calendar's span.

    One row per day, so its size is bounded by the years covered.
    """
    opened = calendar.select("d").distinct()
    span = opened.agg(F.min("d").alias("a"), F.max("d").alias("b"))
    every = span.select(F.explode(F.sequence("a", "b")).alias("day"))
    marked = every.join(opened, F.col("day") == F.col("d"), "left")
    up = Window.orderBy("day").rowsBetween(0, Window.unboundedFollowing)
    down = Window.orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return marked.select("day", F.first("d", ignorenulls=True).over(up).alias("next_open"),
                         F.last("d", ignorenulls=True).over(down).alias("last_open"))


def airport_codes(airports: Column) -> Column:
    return F.filter(F.array_distinct(F.transform(airports, lambda a: F.upper(a["id"]))), lambda c: c != "")


def destination_codes(destinations: Column) -> Column:
    code = lambda d: F.concat_ws(":", F.trim(d["id"]), F.nullif(F.upper(F.trim(d["type"])), F.lit("")))
    named = F.filter(destinations, lambda d: F.coalesce(F.trim(d["id"]), F.lit("")) != "")
    return F.array_distinct(F.transform(named, code))


def default_duration(duration: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(duration), F.lit("")), F.lit(fv.DEFAULT_DURATION_ID))


def default_party(adults: Column, non_adults: Column) -> Column:
    """Both parts must be given, else both defaults apply."""
    given = adults.isNotNull() & non_adults.isNotNull()
    return F.struct(
        F.when(given, adults).otherwise(fv.DEFAULT_PARTY["adults"]).cast("int").alias("adults"),
        F.when(given, non_adults).otherwise(fv.DEFAULT_PARTY["nonAdults"]).cast("int").alias("nonAdults"))


def default_rooms(rooms: Column) -> Column:
    return F.coalesce(rooms, F.lit(fv.ROOMS["default"])).cast("int")


def normalise(extracted: DataFrame, calendar: DataFrame | None, table: DataFrame | None = None) -> DataFrame:
    """Extraction columns to payload columns; lists of entities stay for validation."""
    based = extracted.withColumn("base_date", F.to_date(F.get("dates", F.lit(0))["at"]))
    dated = departure_window(based, calendar, table=table)
    adults = F.col("adults") if "adults" in extracted.columns else F.lit(None).cast("int")
    non_adults = F.col("non_adults") if "non_adults" in extracted.columns else F.lit(None).cast("int")
    rooms = F.col("rooms") if "rooms" in extracted.columns else F.lit(None).cast("int")
    return dated.withColumns({
        "from_codes": airport_codes(F.col("airports")), "to_ids": destination_codes(F.col("destinations")),
        "duration_id": default_duration(F.col("duration_id")), "party": default_party(adults, non_adults),
        "rooms": default_rooms(rooms)})


def payload_json(language: str = "lang") -> Column:
    return F.to_json(F.struct(
        F.col(language).alias("language"), F.col("from_codes").alias("from"), F.col("to_ids").alias("to"),
        F.col("departure_dates").alias("departureDate"), F.col("duration_id").alias("durationId"),
        "party", "rooms"), {"ignoreNullFields": "false"})


# -- validation rules: each gives a message, or null when it passes -----------


def availability_error(airports: Column, destinations: Column) -> Column:
    closed = lambda xs: F.get(F.filter(xs, lambda e: ~F.coalesce(e["available"], F.lit(False))), F.lit(0))
    say = lambda prefix, xs: F.when(
        closed(xs).isNotNull(), F.concat(F.lit(f"{prefix} '"), closed(xs)["name"], F.lit("' is unavailable")))
    return F.coalesce(say("Departure airport", airports), say("Destination", destinations))


def multi_select_error(from_codes: Column, to_ids: Column, airports=None, destinations=None) -> Column:
    a, d = airports or fv.AIRPORT_SELECTION, destinations or fv.DESTINATION_SELECTION
    return (F.when(F.lit(not a["multi"]) & (F.size(from_codes) > 1), MSG["many_airports"])
            .when(F.size(from_codes) > a["max"], MSG["max_airports"])
            .when(F.lit(not d["multi"]) & (F.size(to_ids) > 1), MSG["many_destinations"])
            .when(F.size(to_ids) > d["max"], MSG["max_destinations"]))


def date_error(departure_dates: Column, off_calendar: Column) -> Column:
    """off_calendar: the first date that is not in the calendar, or null."""
    return F.when(F.size(departure_dates) <= 0, MSG["date_required"]).when(
        off_calendar.isNotNull(), F.concat(F.lit("Departure date '"), off_calendar, F.lit("' is not available")))


def first_off_calendar(df: DataFrame, calendar: DataFrame, key: str = "request_id",
                       hold: Callable[[DataFrame], DataFrame] = lambda unknown: unknown) -> DataFrame:
    """Adds off_calendar: the first departure date missing from the calendar.

    One row per requested day meets the day table; requests stay where they are.
    `hold` may store the days that are missing, mostly few, before requests meet them.
    """
    allowed = calendar.select(F.date_format("d", "yyyy-MM-dd").alias("iso")).distinct()
    each = df.select(key, F.posexplode("departure_dates").alias("pos", "iso"))
    unknown = lookup_join(each, allowed, "iso", "left_anti").groupBy(key).agg(F.min_by("iso", "pos").alias("off_calendar"))
    return df.join(hold(unknown), key, "left")


def destination_error(to_ids: Column) -> Column:
    return F.when(F.size(to_ids) <= 0, MSG["destination_required"])


def duration_error(duration: Column) -> Column:
    return F.when(~F.coalesce(duration, F.lit("")).isin([d for d, _n in fv.DURATIONS]), MSG["duration"])


def party_error(adults: Column, non_adults: Column) -> Column:
    limit = fv.PARTY_LIMITS
    return (F.when(adults < limit["minAdults"], MSG["min_adults"]).when(adults > limit["maxAdults"], MSG["max_adults"])
            .when(non_adults > limit["maxNonAdults"], MSG["max_non_adults"])
            .when((adults == 0) & (non_adults > 0), MSG["unaccompanied"]))


def rooms_error(rooms: Column, auto: bool = fv.ROOMS["auto"]) -> Column:
    return (F.when(rooms.isNull() & F.lit(not auto), MSG["rooms_required"]).when(rooms < 1, MSG["rooms_min"])
            .when(rooms > fv.ROOMS["max"], MSG["rooms_max"]))


def combination_error(from_codes: Column, to_ids: Column, departure_dates: Column, combos=None) -> Column:
    present = {"from": F.size(from_codes) > 0, "to": F.size(to_ids) > 0, "departureDate": F.size(departure_dates) > 0}
    met = F.lit(False)
    for combo in combos or fv.REQUIRED_COMBINATIONS:
        whole = F.lit(True)
        for field in combo:
            whole = whole & present.get(field, F.lit(False))
        met = met | whole
    return F.when(~present["departureDate"], MSG["date_required"]).when(~met, MSG["combination"])


#: Rules in the order in which they are asked, with the fields each one reads.
RULE_FIELDS = {
    "availability": ("from", "to"), "selection": ("from", "to"), "date": ("departure",), "destination": ("to",),
    "duration": ("duration",), "party": ("party",), "rooms": ("rooms",), "combination": ("from", "to", "departure")}


def rule_errors() -> dict[str, Column]:
    """Message of every rule over payload columns and off_calendar, null where it passes."""
    c = F.col
    return {
        "availability": availability_error(c("airports"), c("destinations")), "selection": multi_select_error(c("from_codes"), c("to_ids")),
        "date": date_error(c("departure_dates"), c("off_calendar")), "destination": destination_error(c("to_ids")),
        "duration": duration_error(c("duration_id")), "party": party_error(c("party.adults"), c("party.nonAdults")), "rooms": rooms_error(c("rooms")),
        "combination": combination_error(c("from_codes"), c("to_ids"), c("departure_dates"))}


def first_error(errors: Column) -> Column:
    """The first message in the order of the rules."""
    return F.coalesce(*[errors[rule] for rule in RULE_FIELDS])


def validate(df: DataFrame, calendar: DataFrame, key: str = "request_id", rules: list[str] | None = None,
             hold: Callable[[DataFrame], DataFrame] = lambda unknown: unknown) -> DataFrame:
    """Adds rule_errors (a struct, one field per rule), validation_error (the first that fails) and status.

    `rules` names the rules that are asked; all of them by default. `hold`: as for `first_off_calendar`.
    """
    asked = list(RULE_FIELDS) if rules is None else rules
    marked = first_off_calendar(df, calendar, key, hold)
    errors = F.struct(*[(e if rule in asked else F.lit(None)).cast("string").alias(rule) for rule, e in rule_errors().items()])
    return marked.withColumn("rule_errors", errors).withColumn("validation_error", first_error(F.col("rule_errors"))).withColumn(
        "status", F.when(F.col("validation_error").isNull(), "success").otherwise("failed")).drop("off_calendar")
