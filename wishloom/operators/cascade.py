"""Method resolution and staged evaluation."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scale import lookup_join, settle, stored
from . import imputation as im
from . import normalisation as nm

ATTEMPT = "array<struct<method:string,type:string,status:string,detail:string>>"


def resolve_methods(df: DataFrame, methods: DataFrame, alias: str, default: str) -> DataFrame:
    """Alias to method id: by id, else the first method of that kind, else the default.

    methods: (ord, id, kind).
    """
    wanted = df.withColumn("_alias", F.lower(F.trim(alias)))
    by_id = methods.select(F.lower("id").alias("_alias"), F.col("id").alias("_by_id"))
    by_kind = methods.groupBy(F.lower("kind").alias("_alias")).agg(F.min_by("id", "ord").alias("_by_kind"))
    joined = lookup_join(lookup_join(wanted, by_id, "_alias", "left"), by_kind, "_alias", "left")
    return joined.withColumn("method_id", F.coalesce("_by_id", "_by_kind", F.lit(default))).drop("_alias", "_by_id", "_by_kind")


def run_cascade(requests: DataFrame, stages: list[tuple[str, str, Callable[[DataFrame], DataFrame]]],
                fallback: tuple[str, str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Run stages in order on the rows that have not succeeded yet.

    A stage is (id, kind, evaluate); evaluate returns its input columns plus
    status and detail. Each stage's outcome is settled, so no row runs a
    method twice; a fallback that already ran as a stage is skipped. Adds
    status, detail, selected_stage, fallback_triggered and attempts.
    """
    columns = requests.columns
    pending = requests.withColumn("attempts", F.array().cast(ATTEMPT))
    steps = [(*s, False) for s in stages]
    if fallback is not None and fallback[0] not in {s[0] for s in stages}:
        steps.append((*fallback, True))
    done = []
    for position, (identifier, kind, evaluate, is_fallback) in enumerate(steps):
        ran = evaluate(pending)
        entry = F.struct(F.lit(identifier).alias("method"), F.lit(kind).alias("type"), F.col("status").alias("status"),
                         F.col("detail").cast("string").alias("detail"))
        outcome = settle(ran.select(*columns, F.concat("attempts", F.array(entry)).cast(ATTEMPT).alias("attempts"),
                                    "status", F.col("detail").cast("string").alias("detail")))
        success = F.col("status") == "success"
        last = position == len(steps) - 1
        final = outcome if last else outcome.where(success)
        done.append(final.withColumns({
            "selected_stage": F.when(success, F.lit(identifier)), "fallback_triggered": F.lit(is_fallback)}))
        pending = outcome.where(~success).drop("status", "detail")
    result = done[0]
    for part in done[1:]:
        result = result.unionByName(part)
    return result


class Stage(NamedTuple):
    """A method of a staged cascade: the extraction it reads and the rules it asks (all by default)."""

    id: str
    kind: str
    rules: list[str] | None = None


PAYLOAD = ["from_codes", "to_ids", "departure_dates", "duration_id", "party", "rooms"]
JUDGEMENT = ["base_date", "off_calendar", "rule_errors", "validation_error", "status"]


def _judged(extracted: DataFrame, calendar: DataFrame, key: str) -> DataFrame:
    """Extraction columns as they were, their payload and the message of every rule."""
    replaced = [c for c in extracted.columns if c in PAYLOAD or c in JUDGEMENT]
    raw = extracted.withColumn("_raw", F.struct(F.lit(True).alias("_row"), *replaced))
    # stored, because the days of the payload meet the calendar on a branch of their own; as Parquet, like the
    # days and what is missing from them, so small tables are broadcast and no wide row is shuffled to meet them
    days = stored(nm.open_days(calendar), "days")
    normal = nm.validate(stored(nm.normalise(raw, calendar, days), "normal"), calendar, key, hold=lambda unknown: stored(unknown, "unknown"))
    own = [F.col(f"_raw.{c}" if c in replaced else f"`{c}`").alias(c) for c in extracted.columns]
    return normal.select(*own, F.struct(*PAYLOAD).alias("payload"), F.col("rule_errors").alias("_errors"))


def prepare(extracted: DataFrame, calendar: DataFrame, key: str = "request_id") -> DataFrame:
    """An extraction normalised and judged by every rule, computed once for all stages that read it.

    Adds payload, rule_errors, extraction_error (the `response_error` of a row
    that could not be read), status and detail.
    """
    error = F.col("response_error") if "response_error" in extracted.columns else F.lit(None).cast("string")
    judged = _judged(extracted.withColumn("extraction_error", error), calendar, key).withColumnRenamed("_errors", "rule_errors")
    detail = F.coalesce("extraction_error", nm.first_error(F.col("rule_errors")))
    return stored(judged.withColumn("detail", detail).withColumn("status", F.when(
        F.col("extraction_error").isNotNull(), "error").when(F.col("detail").isNotNull(), "failed").otherwise("success")), "prepared")


def staged_cascade(requests: DataFrame, extractions: dict[str, DataFrame], stages: list[Stage],
                   fallback: Stage | None = None, key: str = "request_id") -> tuple[DataFrame, DataFrame]:
    """Extract, normalise and validate in stages; the first success of a request ends its cascade (H1).

    `extractions` holds one prepared frame per kind, shared by the stages of
    that kind. Returns the attempts, one row per (request, position) with
    method, type, status, detail and whether it is the fallback, and the outcome of
    every request: status, detail, selected_stage and fallback_triggered. A
    stage meets only requests that no earlier stage has settled, by an anti
    join with the successes so far. A request without a row in an extraction fails that stage.
    """
    steps = [(stage, False) for stage in stages]
    if fallback is not None and fallback.id not in {s.id for s in stages}:
        steps.append((fallback, True))
    attempts, settled = None, None
    requests = settle(requests.select(key))
    for position, (stage, last_resort) in enumerate(steps):
        pending = requests if settled is None else requests.join(settled, key, "left_anti")
        rows = extractions[stage.kind].select(key, "rule_errors", "extraction_error", F.lit(True).alias("_there"))
        errors = F.col("rule_errors")
        asked = [errors[rule] for rule in nm.RULE_FIELDS if stage.rules is None or rule in stage.rules]
        detail = F.coalesce("extraction_error", F.when(F.col("_there").isNull(), F.lit("Nothing was extracted")), *asked)
        status = (F.when(F.col("extraction_error").isNotNull(), "error").when(F.col("_there").isNull(), "error")
                  .when(F.coalesce(*asked).isNotNull(), "failed").otherwise("success"))
        tried = settle(pending.join(rows, key, "left").select(
            key, F.lit(position).alias("position"), F.lit(stage.id).alias("method"), F.lit(stage.kind).alias("type"),
            status.alias("status"), detail.alias("detail"), F.lit(last_resort).alias("fallback")))
        attempts = tried if attempts is None else attempts.unionByName(tried)
        won = tried.where("status = 'success'").select(key)
        settled = won if settled is None else settled.union(won)
    if attempts is None:
        raise ValueError("a cascade needs a stage")
    # a request has one attempt per stage at most
    last = attempts.groupBy(key).agg(F.max_by(F.struct("method", "status", "detail", "fallback"), "position").alias("_l"))
    outcome = last.select(key, "_l.status", "_l.detail", F.when(F.col("_l.status") == "success", F.col("_l.method")).alias("selected_stage"),
                          F.col("_l.fallback").alias("fallback_triggered"))
    return attempts, outcome


def revalidate_imputed(prepared: DataFrame, imputed: DataFrame, airports: DataFrame, destinations: DataFrame,
                       calendar: DataFrame, key: str = "request_id") -> DataFrame:
    """Fill failed extractions from popularity and ask the rules again that read a filled field (H2).

    prepared: from `prepare`; imputed: from the imputer. Adds `origins`, the
    source of every field that was filled, and renews extraction, payload, rule_errors, status and
    detail of rows with such a field. The messages of rules that read no filled field are taken over.
    """
    extraction = [c for c in prepared.columns if c not in ("payload", "rule_errors", "status", "detail")]
    retry = F.col("status") == "failed"
    # imputed rows are asked for twice, for their places and for the rest
    imputed = stored(imputed.select(key, *im.GIVEN, *[f"{c}_source" for c in im.SOURCES]), "imputed")
    filled = im.fill_extraction(prepared.where(retry).select(*extraction, F.col("rule_errors").alias("_before")), imputed, airports, destinations, key)
    judged = _judged(filled, calendar, key)

    def touched(rule):
        return F.arrays_overlap(F.map_keys("origins"), F.array(*[F.lit(f) for f in nm.RULE_FIELDS[rule]]))

    errors = F.struct(*[F.when(touched(rule), F.col("_errors")[rule]).otherwise(F.col("_before")[rule]).alias(rule) for rule in nm.RULE_FIELDS])
    redone = judged.withColumn("rule_errors", errors).withColumn("detail", nm.first_error(F.col("rule_errors"))).withColumn(
        "status", F.when(F.col("detail").isNull(), "success").otherwise("failed"))
    columns = [*prepared.columns, "origins"]
    kept = prepared.where(~retry).withColumn("origins", F.create_map().cast("map<string,string>"))
    return redone.select(*columns).unionByName(kept.select(*columns), allowMissingColumns=False)


def impute_and_revalidate(outcome: DataFrame, imputed: DataFrame, validate: Callable[[DataFrame], DataFrame],
                          key: str = "request_id") -> DataFrame:
    """Fill a model stage's failed rows from popularity and validate those again (H2).

    outcome: key, from_codes, to_ids, departure_dates, status, detail.
    imputed: key, to, from, departure with their *_source columns. `validate`
    adds status and detail to such rows. Rows with nothing imputed keep their
    outcome.
    """
    given = imputed.select(
        key, F.col("to").alias("_to"), F.col("from").alias("_from"), F.col("departure").alias("_dep"),
        F.coalesce("to_source", "from_source", "departure_source").isNotNull().alias("_any"))
    joined = outcome.join(given, key, "left").withColumn("_any", F.coalesce("_any", F.lit(False)))

    def filled(own, new):
        return F.when(F.coalesce(F.size(own), F.lit(0)) > 0, F.col(own)).otherwise(
            F.coalesce(new, F.array().cast("array<string>")))

    redo = joined.where("_any").withColumns({
        "from_codes": filled("from_codes", "_from"), "to_ids": filled("to_ids", "_to"),
        "departure_dates": filled("departure_dates", "_dep")}).drop("status", "detail", "_to", "_from", "_dep", "_any")
    kept = joined.where("not _any").select(*outcome.columns)
    return validate(redo).select(*outcome.columns).unionByName(kept)
