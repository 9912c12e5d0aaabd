"""What a validation message is about."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv


def fields_of(message: Column) -> Column:
    lowered = F.lower(message)
    named = [F.when(lowered.rlike(pattern), F.lit(field)) for pattern, field in fv.FIELD_PATTERNS]
    return F.array_distinct(F.array_compact(F.array(*named)))


def mentions(message: Column, keywords: list[str]) -> Column:
    return F.lower(message).rlike("|".join(keywords))


def fields_where(messages: Column, keywords: list[str]) -> Column:
    relevant = F.filter(messages, lambda m: mentions(m, keywords))
    return F.array_distinct(F.flatten(F.transform(relevant, fields_of)))


def missing_fields(messages: Column, present: dict[str, Column]) -> Column:
    """Absent core fields plus those that a message asks for and the payload lacks."""
    core = F.array_compact(F.array(*[
        F.when(~F.coalesce(present[f], F.lit(False)), F.lit(f)) for f in ("from", "to", "departureDate")]))
    held = F.array_compact(F.array(*[F.when(c, F.lit(f)) for f, c in present.items()]))
    asked = F.array_except(fields_where(messages, fv.MISSING_KEYWORDS), held)
    return F.array_sort(F.array_union(core, asked))


def invalid_fields(messages: Column) -> Column:
    return F.array_sort(fields_where(messages, fv.INVALID_KEYWORDS))


def choose_prompt(messages: Column) -> Column:
    """struct<parameter, message, reason> for the first message a rule matches, else general."""
    def classify(m):
        choice = None
        for parameter, prompt, keywords in fv.CLARIFICATION_RULES:
            hit = F.lit(False)
            for word in keywords:
                hit = hit | F.contains(F.lower(m), F.lit(word))
            made = F.struct(F.lit(parameter).alias("parameter"), F.lit(prompt).alias("message"), m.alias("reason"))
            choice = F.when(hit, made) if choice is None else choice.when(hit, made)
        return choice

    useful = F.filter(messages, lambda m: F.coalesce(m, F.lit("")) != "")
    matched = F.get(F.filter(F.transform(useful, classify), lambda p: p.isNotNull()), F.lit(0))
    parameter, text = fv.GENERAL_PROMPT
    general = F.struct(F.lit(parameter).alias("parameter"), F.lit(text).alias("message"),
                       F.get(useful, F.lit(0)).alias("reason"))
    return F.when(F.size(useful) > 0, F.coalesce(matched, general))


def clarifications(errors: Column, missing: Column) -> Column:
    """One prompt per error with a message, else one per missing field.

    errors: array<struct<message, parameter, code>>.
    """
    def clean(c, default):
        return F.coalesce(F.nullif(F.trim(c), F.lit("")), F.lit(default))

    said = F.filter(errors, lambda e: F.coalesce(F.trim(e["message"]), F.lit("")) != "")
    from_errors = F.transform(said, lambda e: F.struct(
        clean(e["parameter"], "unknown").alias("parameter"), F.trim(e["message"]).alias("message"),
        clean(e["code"], "validation").alias("reason")))
    from_missing = F.transform(missing, lambda f: F.struct(
        f.alias("parameter"), F.concat(F.lit("Please provide a value for "), f, F.lit(".")).alias("message"),
        F.lit("missing").alias("reason")))
    return F.when(F.size(from_errors) > 0, from_errors).otherwise(from_missing)
