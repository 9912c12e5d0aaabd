"""Expected-value text and human-readable payload rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv
from .text import bind, strip


def unquote(c: Column) -> Column:
    """Trim, then drop one pair of wrapping quotes."""
    def inner(t):
        wrapped = t.rlike(r"""(?s)^"(.*)"$|^'(.*)'$""")
        return F.when(wrapped & (F.length(t) > 1), strip(F.substr(t, F.lit(2), F.length(t) - 2))).otherwise(t)

    return bind(strip(c), inner)


def parse_values(raw: Column) -> Column:
    """`label: value | label: value` to array<struct<label, value>>."""
    def one(piece):
        at = F.locate(":", piece)
        return F.struct(
            strip(F.when(at > 0, F.substr(piece, F.lit(1), at - 1)).otherwise(piece)).alias("label"),
            strip(F.when(at > 0, F.substr(piece, at + 1)).otherwise(F.lit(""))).alias("value"))

    pieces = F.filter(F.transform(F.split(raw, r"\|"), strip), lambda p: p != "")
    return F.filter(F.transform(pieces, one), lambda e: e["label"] != "")


def parse_options(raw: Column) -> Column:
    """A quoted list wins over a comma list."""
    def listed(text):
        quoted = F.regexp_extract_all(text, F.lit('"([^"]*)"'), F.lit(1))
        return F.when(text.rlike('"[^"]*"'), quoted).otherwise(F.split(text, ","))

    return F.filter(F.transform(bind(raw, listed), unquote), lambda v: v != "")


def parse_preferences(raw: Column) -> Column:
    """`Filter: "X"; Options: "A", "B" | ...` to array<struct<filter_label, options>>."""
    def one(piece):
        return F.struct(
            unquote(F.regexp_extract(piece, r"(?i)filter\s*:\s*([^;]+)(?:;|$)", 1)).alias("filter_label"),
            parse_options(strip(F.regexp_extract(piece, r"(?i)options\s*:\s*(.*)$", 1))).alias("options"))

    pieces = F.filter(F.transform(F.split(raw, r"\|"), strip), lambda p: p != "")
    return F.filter(F.transform(pieces, one), lambda e: e["filter_label"] != "")


def number_text(value: Column) -> Column:
    """At most two decimals, no trailing zeros."""
    fixed = F.format_string("%.2f", value.cast("double"))
    return F.regexp_replace(F.regexp_replace(fixed, r"0+$", ""), r"\.$", "")


def named_list(ids: Column, names: Column) -> Column:
    """Ids to names by a map<id, name>, unknown ids shown as they are."""
    return F.array_join(F.transform(ids, lambda i: F.coalesce(F.try_element_at(names, i), i)), ", ")


def duration_text(duration: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in fv.DURATIONS for x in pair])
    return F.coalesce(F.try_element_at(table, duration), duration)


def party_text(adults: Column, non_adults: Column) -> Column:
    parts = F.array_compact(F.array(
        F.when(adults > 0, F.concat(F.lit("Adults: "), number_text(adults))),
        F.when(non_adults > 0, F.concat(F.lit("Non adults: "), number_text(non_adults)))))
    plain = F.to_json(F.struct(adults.alias("adults"), non_adults.alias("nonAdults")))
    return F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise(plain)


def rooms_text(rooms: Column) -> Column:
    folded = F.lower(F.trim(rooms.cast("string")))
    return F.when(rooms.isNull() | folded.isin("autoallocation", "auto_allocation"), "Auto allocation").otherwise(
        rooms.cast("string"))


def payload_rows(values: dict[str, Column]) -> Column:
    """Display rows in fixed order, from already rendered values."""
    labels = [(key, label) for key, label in fv.PAYLOAD_LABELS if key in values]
    return F.array(*[F.struct(F.lit(label).alias("label"), values[key].alias("value")) for key, label in labels])


def preference_rows(filters: Column) -> Column:
    """array<struct<label, options:array<string>>> to display rows; options distinct and sorted."""
    def strip(c):
        return F.regexp_replace(F.trim(c), r"""^["']|["']$""", "")

    def one(f):
        options = F.array_sort(F.array_distinct(F.filter(F.transform(f["options"], strip), lambda v: v != "")))
        shown = F.array_join(options, ", ")
        tail = F.when(shown == "", " Options:").otherwise(F.concat(F.lit(" Options: "), shown))
        return F.struct(F.lit("Filter").alias("label"), F.concat(strip(f["label"]), F.lit(";"), tail).alias("value"))

    return F.transform(filters, one)


def extracted_text(rows: Column) -> Column:
    return F.array_join(F.transform(rows, lambda r: F.concat(r["label"], F.lit(": "), r["value"])), " | ")
