"""Numbers, timings, usage keys and status display."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .fixed_values import PROCESSING_BUDGET_MS, SUCCESS_STATUSES, TOTAL_MS_KEYS


def finite(number: Column) -> Column:
    d = number.cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) != float("inf")), d)


def to_number(raw: Column) -> Column:
    """Trimmed numeric text to a finite double; words and booleans become null."""
    return finite(F.trim(raw).try_cast("double"))


def variant_number(value: Column) -> Column:
    """Number held by a variant; booleans are not numbers, numeric strings are."""
    kind = F.schema_of_variant(value)
    return F.when(kind != "BOOLEAN", to_number(F.try_variant_get(value, "$", "string")))


def pick_total(timings: Column, keys: Sequence[str] = TOTAL_MS_KEYS) -> Column:
    """First numeric alias, else the first numeric entry whose key mentions total."""
    named = F.coalesce(*[finite(F.try_element_at(timings, F.lit(k))) for k in keys])
    loose = F.map_values(
        F.map_filter(timings, lambda k, v: F.contains(F.lower(k), F.lit("total")) & finite(v).isNotNull()))
    return F.coalesce(named, F.get(loose, F.lit(0)))


def usage_metric(key: Column) -> Column:
    """Usage metric that a free-form key names, null when it names none."""
    k = F.regexp_replace(F.lower(key), r"[^\p{L}\p{N}]", "")

    def has(*words: str) -> Column:
        return k.rlike("|".join(words))

    memory = has("ram", "mem")
    return (
        F.when(has("token") & has("out", "completion", "response", "candidate"), "tokensOut")
        .when(has("token") & has("in", "prompt"), "tokensIn")
        .when((has("api") & has("call", "request")) | (k == "requests"), "apiCalls")
        .when(has("cpu") & has("ms", "millisecond", "time", "duration"), "cpuMs")
        .when(memory & has("mb", "byte", "footprint") & has("sec", "time", "duration", "footprint"), "ramMbSeconds")
    )


def threshold_breached(total_ms: Column, budget: float = PROCESSING_BUDGET_MS) -> Column:
    return total_ms > budget


def is_failure(status: Column) -> Column:
    return ~F.coalesce(F.lower(F.trim(status)), F.lit("")).isin(SUCCESS_STATUSES)


def visible(df: DataFrame, mode: str, status: str = "status") -> DataFrame:
    """SHOW_ALL, SHOW_FAILED_ONLY or SUPPRESS."""
    if mode == "SUPPRESS":
        return df.where(F.lit(False))
    return df.where(is_failure(F.col(status))) if mode == "SHOW_FAILED_ONLY" else df


def two_decimals(value: Column) -> Column:
    """`%.2f`; null and NaN become an empty string."""
    shown = F.when(value.isNotNull() & ~F.isnan(value.cast("double")), F.format_string("%.2f", value.cast("double")))
    return F.coalesce(shown, F.lit(""))
