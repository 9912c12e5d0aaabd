"""Popularity statistics from booking history.

Bookings carry: ord, duration, rooms, adults, children, infants, start_date,
end_date, airport, destinations. Statistics come out as one long table
(scope, scope_key, metric, rank, value, count, mode_count, unique_values,
total); rank 1 is the mode. Values are text, null where null is a value.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.scale import global_position, settle, unnest

TOP_N = 5
STATED = "array<struct<scope:string,scope_key:string,metric:string,value:string>>"


def value_counts(df: DataFrame, keys: Sequence[str], value: str, order: Column) -> DataFrame:
    """Occurrences of each value per key and where it was first seen."""
    return df.groupBy(*keys, F.col(value).alias("value")).agg(
        F.count(F.lit(1)).alias("count"), F.min(order).alias("first_seen"))


def summarize(counts: DataFrame, keys: Sequence[str], top_n: int = TOP_N) -> DataFrame:
    """Top values per key with mode_count, unique_values and total; ties by first occurrence.

    The rank filter is pushed below the shuffle as a per-task limit, so a key
    with very many distinct values sends at most top_n rows per task.
    """
    keys = list(keys)
    # both uses below would otherwise scan the bookings again
    counts = settle(counts)
    ranked = counts.withColumn("rank", F.row_number().over(
        Window.partitionBy(*keys).orderBy(F.desc("count"), "first_seen", "value"))).where(F.col("rank") <= top_n)
    totals = counts.groupBy(*keys).agg(
        F.max("count").alias("mode_count"), F.count(F.lit(1)).alias("unique_values"), F.sum("count").alias("total"))
    return ranked.drop("first_seen").join(totals, keys)


def destination_set(destinations: Column) -> Column:
    return F.array_sort(F.array_distinct(destinations))


def _metric_values() -> Column:
    """Array of (metric, value) of a booking; null is kept as a value for rooms only."""
    text = lambda c: F.col(c).cast("string")
    dated = F.col("start_date").isNotNull() & F.col("end_date").isNotNull()
    pairs = {
        "duration": text("duration"), "rooms": text("rooms"),
        "party": F.concat_ws("/", text("adults"), text("children"), text("infants")),
        "interval": F.when(dated, F.concat_ws("..", "start_date", "end_date")), "departure_airport": F.nullif(F.trim(F.col("airport")), F.lit("")),
    }
    every = F.array(*[F.struct(F.lit(n).alias("metric"), v.alias("value")) for n, v in pairs.items()])
    return F.filter(every, lambda m: m["value"].isNotNull() | (m["metric"] == "rooms"))


def _metrics(df: DataFrame, *keep: Column) -> DataFrame:
    """One row per (booking, metric)."""
    return unnest(df.select(*keep, "ord", _metric_values().alias("_m")), "_m", *[c for c in df.select(*keep).columns], "ord")


def global_statistics(bookings: DataFrame, top_n: int = TOP_N) -> DataFrame:
    named = bookings.select(F.lit("destination").alias("metric"), "ord",
                            F.explode(F.array_distinct("destinations")).alias("value"))
    both = _metrics(bookings).select("metric", "ord", "value").unionByName(named)
    return summarize(value_counts(both, ["metric"], "value", F.col("ord")), ["metric"], top_n)


def destination_statistics(bookings: DataFrame, top_n: int = TOP_N) -> DataFrame:
    each = bookings.withColumn("destination", F.explode(F.array_distinct("destinations")))
    keys = ["destination", "metric"]
    return summarize(value_counts(_metrics(each, F.col("destination")), keys, "value", F.col("ord")), keys, top_n)


def intersection_statistics(bookings: DataFrame, top_n: int = TOP_N) -> DataFrame:
    combos = bookings.withColumn("combination", destination_set(F.col("destinations"))).where(
        (F.size("combination") >= 2) & F.col("start_date").isNotNull() & F.col("end_date").isNotNull())
    keyed = combos.select(F.array_join("combination", "||").alias("combination"), "ord",
                          F.concat_ws("..", "start_date", "end_date").alias("value"))
    return summarize(value_counts(keyed, ["combination"], "value", F.col("ord")), ["combination"], top_n)


def totals(bookings: DataFrame) -> DataFrame:
    return bookings.agg(F.count(F.lit(1)).alias("rows"),
                        F.coalesce(F.sum(F.size(F.array_distinct("destinations"))), F.lit(0)).alias("destination_mentions"))


def statistics_table(bookings: DataFrame, top_n: int = TOP_N) -> DataFrame:
    """All three scopes in one long table, from one reading of the bookings.

    A booking counts for everybody, for each of its destinations, and, if it is dated, for the
    set of them; all of that is one exploded array, counted and ranked once.
    """
    def entry(scope: str, key: Column, metric: Column, value: Column) -> Column:
        return F.struct(F.lit(scope).alias("scope"), key.alias("scope_key"), metric.alias("metric"), value.alias("value"))

    named = F.coalesce(F.array_distinct("destinations"), F.array().cast("array<string>"))
    several, dated = destination_set(named), F.col("start_date").isNotNull() & F.col("end_date").isNotNull()
    together = entry("intersection", F.array_join(several, "||"), F.lit("interval"), F.concat_ws("..", "start_date", "end_date"))
    listed = bookings.select("ord", named.alias("_named"), _metric_values().alias("_own"), F.when(
        dated & (F.size(several) >= 2), F.array(together)).otherwise(F.array().cast(STATED)).alias("_together"))
    every = F.concat(
        F.transform("_own", lambda m: entry("global", F.lit(""), m["metric"], m["value"])),
        F.transform("_named", lambda d: entry("global", F.lit(""), F.lit("destination"), d)),
        F.flatten(F.transform("_named", lambda d: F.transform("_own", lambda m: entry("destination", d, m["metric"], m["value"])))),
        F.col("_together"))
    keys = ["scope", "scope_key", "metric"]
    counts = value_counts(unnest(listed.select("ord", every.alias("_s")), "_s", "ord"), keys, "value", F.col("ord"))
    return summarize(counts, keys, top_n).select(*keys, "rank", "value", "count", "mode_count", "unique_values", "total")


def modes(statistics: DataFrame) -> DataFrame:
    """Usable mode per (scope, scope_key, metric): the best-ranked value that is not null or blank."""
    usable = statistics.where(F.coalesce(F.trim("value"), F.lit("")) != "")
    return usable.groupBy("scope", "scope_key", "metric").agg(F.min_by("value", "rank").alias("mode"))


def most_popular_destination(statistics: DataFrame) -> DataFrame:
    """One row: the global mode, else most bookings, then mode count, then label."""
    by_mode = statistics.where("scope = 'global' and metric = 'destination' and trim(value) <> ''").agg(
        F.min_by("value", "rank").alias("a"))
    by_total = statistics.where("scope = 'destination' and metric = 'duration'").agg(
        F.min_by("scope_key", F.struct(-F.col("total"), -F.col("mode_count"), "scope_key")).alias("b"))
    both = by_mode.select(F.lit(0).alias("pick"), F.col("a").alias("destination")).unionByName(
        by_total.select(F.lit(1).alias("pick"), F.col("b").alias("destination")))
    return both.where("destination is not null").agg(F.min_by("destination", "pick").alias("destination"))


def ordered_keys(statistics: DataFrame) -> DataFrame:
    """Scope keys in document order: by number of parts, then by the parts."""
    parts = F.split("scope_key", r"\|\|")
    return statistics.select("scope", "scope_key").distinct().orderBy("scope", F.size(parts), parts)


def key_positions(statistics: DataFrame) -> DataFrame:
    """Distinct scope keys with their position, from 0, in the document order of their scope."""
    parts = F.split("scope_key", r"\|\|")
    keys = statistics.select("scope", "scope_key").distinct().withColumns({"_parts": parts, "_size": F.size(parts)})
    return global_position(keys, ["_size", "_parts"], ["scope"]).drop("_parts", "_size")


def statistics_document(statistics: DataFrame) -> DataFrame:
    """One JSON summary per (scope, key, metric); at most top_n entries are collected per row."""
    entries = F.array_sort(F.collect_list(F.struct("rank", "value", "count")))
    return statistics.groupBy("scope", "scope_key", "metric").agg(
        F.to_json(F.struct(
            F.min_by("value", "rank").alias("mode"), F.max("mode_count").alias("mode_count"),
            F.transform(entries, lambda e: F.struct(e["value"].alias("value"), e["count"].alias("count"))).alias("top_values"),
            F.max("unique_values").alias("unique_values"), F.max("total").alias("total"),
        ), {"ignoreNullFields": "false"}).alias("summary"))
