"""Expected against actual.

Both sides are short lists inside one row, so they are compared there: a
replay of any size needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expected import parse_preferences, parse_values, unquote
from ..functions.text import bind


def _one(values: Column) -> Column:
    return F.get(values, F.lit(0))


def _last_values(rows: Column) -> Column:
    """array<struct<label, value>> with trimmed text, the last duplicate of a label kept."""
    clean = F.transform(rows, lambda r: F.struct(F.trim(r["label"]).alias("label"), F.trim(r["value"]).alias("value")))

    def last_only(entries):
        backwards = F.reverse(F.transform(entries, lambda e: e["label"]))
        return bind(backwards, lambda labels: F.filter(
            entries, lambda e, i: F.array_position(labels, e["label"]) == F.size(labels) - i))

    return bind(clean, last_only)


def value_mismatches(rows: DataFrame, actual: str, expected: str) -> DataFrame:
    """Adds `mismatches`: array<struct<label, expected, actual>>; plans.scale.unnest gives rows.

    actual and expected are array<struct<label, value>>. An unexpected empty
    actual is ignored; a row without expectations has no mismatches.
    """
    staged = rows.withColumns({"_a": _last_values(F.col(actual)), "_e": _last_values(F.col(expected))})

    def given(entries: str, label: Column) -> Column:
        return F.coalesce(_one(F.filter(entries, lambda x: x["label"] == label))["value"], F.lit(""))

    asked = F.transform("_e", lambda e: F.struct(
        e["label"].alias("label"), e["value"].alias("expected"), given("_a", e["label"]).alias("actual")))
    known = F.transform("_e", lambda e: e["label"])
    extra = F.transform(
        F.filter("_a", lambda a: (a["value"] != "") & ~F.array_contains(known, a["label"])),
        lambda a: F.struct(a["label"].alias("label"), F.lit("").alias("expected"), a["value"].alias("actual")))
    found = F.concat(F.filter(asked, lambda m: m["expected"] != m["actual"]), extra)
    return _only_when_asked(staged, expected, found)


def _only_when_asked(staged: DataFrame, expected: str, found: Column) -> DataFrame:
    none = F.array().cast("array<struct<label:string,expected:string,actual:string>>")
    listed = F.when(F.coalesce(F.size(expected), F.lit(0)) > 0, found).otherwise(none)
    return staged.withColumn("mismatches", listed).drop("_a", "_e")


def _option_sets(filters: Column) -> Column:
    """array<struct<key, label, folded, shown>>: one entry per folded filter label."""
    clean = F.filter(F.transform(filters, lambda f: F.struct(
        unquote(f["filter_label"]).alias("label"),
        F.filter(F.transform(f["options"], unquote), lambda o: o != "").alias("options"))), lambda f: f["label"] != "")

    def first_spelling(options):
        return bind(options, lambda given: bind(F.transform(given, lambda o: F.lower(o)), lambda folded: F.filter(
            given, lambda o, i: F.array_position(folded, F.lower(o)) == i + 1)))

    def per_key(entries):
        keys = F.array_distinct(F.transform(entries, lambda e: F.lower(e["label"])))

        def build(key):
            mine = F.filter(entries, lambda e: F.lower(e["label"]) == key)
            return bind(mine, lambda own: bind(
                F.array_sort(first_spelling(F.flatten(F.transform(own, lambda e: e["options"])))),
                lambda shown: F.struct(key.alias("key"), _one(own)["label"].alias("label"),
                                       F.array_sort(F.transform(shown, lambda o: F.lower(o))).alias("folded"),
                                       shown.alias("shown"))))

        return F.transform(keys, build)

    return bind(clean, per_key)


def preference_mismatches(rows: DataFrame, actual: str, expected: str) -> DataFrame:
    """Adds `mismatches` for filters whose option sets differ, without case, both directions.

    actual and expected are array<struct<filter_label, options>>.
    """
    staged = rows.withColumns({"_a": _option_sets(F.col(actual)), "_e": _option_sets(F.col(expected))})

    def shown(options):
        quoted = F.transform(options, lambda o: F.concat(F.lit('"'), o, F.lit('"')))
        return F.when(F.size(quoted) > 0, F.concat(F.lit("Options: "), F.array_join(quoted, ", "))).otherwise("")

    def named(label):
        return F.concat(F.lit('Filter: "'), label, F.lit('"'))

    none = F.array().cast("array<string>")

    def compare(e):
        def against(other):
            wrong = F.coalesce(other["folded"], none) != e["folded"]
            return F.when(wrong, F.struct(named(e["label"]).alias("label"), shown(e["shown"]).alias("expected"),
                                          shown(F.coalesce(other["shown"], none)).alias("actual")))

        return bind(_one(F.filter("_a", lambda a: a["key"] == e["key"])), against)

    known = F.transform("_e", lambda e: e["key"])
    extra = F.transform(
        F.filter("_a", lambda a: (F.size(a["folded"]) > 0) & ~F.array_contains(known, a["key"])),
        lambda a: F.struct(named(a["label"]).alias("label"), F.lit("").alias("expected"), shown(a["shown"]).alias("actual")))
    return _only_when_asked(staged, expected, F.concat(F.array_compact(F.transform("_e", compare)), extra))


def replay(runs: DataFrame, actual: str, expected_text: str, status: str = "status",
           preferences: bool = False) -> DataFrame:
    """Adds mismatches, mismatch_count and replay_status; any mismatch fails a row, no status is an error."""
    parse, compare = ((parse_preferences, preference_mismatches) if preferences else (parse_values, value_mismatches))
    compared = compare(runs.withColumn("_expected", parse(F.col(expected_text))), actual, "_expected").drop("_expected")
    counted = compared.withColumn("mismatch_count", F.size("mismatches").cast("long"))
    return counted.withColumn("replay_status", F.when(F.col(status).isNull(), "error")
                              .when(F.col("mismatch_count") > 0, "failed").otherwise(F.col(status)))
