"""Reading catalogues, gazetteers, bookings, requests and replays."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.text import normalize_label, strip
from ..operators.catalogue import clean_list, duplicate_entities, duplicate_options, missing_required
from .sinks import OPERATION_BUCKETS, operation_bucket


def csv_table(spark: SparkSession, path: str, delimiter: str = ",", multi_line: bool = True, order: str | None = None) -> DataFrame:
    """Header CSV with quoted newlines; a byte-order mark is dropped by the reader.

    Quoted newlines need a whole file per task (multi_line), so large inputs
    come as many files, or without such fields. `order` names a column for the
    place of a row: file, block and row in it, whatever files are packed together.
    """
    if len(delimiter) != 1:
        raise ValueError("CSV delimiter must be a single character")
    df = spark.read.csv(path, header=True, multiLine=multi_line, sep=delimiter, quote='"', escape='"',
                        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    named = [F.col(f"`{c}`").alias(c.replace("﻿", "").strip()) for c in df.columns]
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                     F.monotonically_increasing_id().alias("row"))
    return df.select(*named, *[place.alias(order)] if order else [])


def require_columns(df: DataFrame, required: Iterable[str], what: str) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"{what} is missing required columns: {', '.join(missing)}")
    return df


def text_or_empty(name: str) -> Column:
    return F.coalesce(strip(F.col(name).cast("string")), F.lit(""))


def must_hold(name: str, what: str) -> Column:
    """The trimmed value; a blank one raises when it is read."""
    return F.when(text_or_empty(name) != "", text_or_empty(name)).otherwise(
        F.raise_error(F.lit(f"Field '{name}' must not be empty in {what}")))


def read_catalogue(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """Filter catalogue: filter_id, filter_label, option_id, option_label, synonyms and ordinals.

    The file's own line order decides the ordinals. Empty files, blank fields
    and duplicate options in a filter are rejected.
    """
    raw = csv_table(spark, path, delimiter, order="_ord")
    for alias, name in fv.CATALOGUE_ALIASES.items():
        if name not in raw.columns and alias in raw.columns:
            raw = raw.withColumnRenamed(alias, name)
    require_columns(raw, fv.CATALOGUE_COLUMNS, "Filters catalogue")
    if raw.isEmpty():
        raise ValueError("Filters catalogue is empty")
    synonyms = F.col("synonyms") if "synonyms" in raw.columns else F.lit("")
    # ordinals are places in the files, so they do not change with the packing of files
    rows = raw.select(
        *[must_hold(c, "filters catalogue").alias(n) for c, n in zip(
            fv.CATALOGUE_COLUMNS, ("filter_id", "filter_label", "option_id", "option_label"))],
        clean_list(F.split(F.coalesce(synonyms, F.lit("")), r"\|")).alias("synonyms"),
        F.col("_ord").alias("option_ord"))
    repeated = duplicate_options(rows).limit(1).collect()
    if repeated:
        r = repeated[0]
        raise ValueError(f"Duplicate option identifier '{r['option_key']}' detected for filter '{r['filter_id']}'")
    first = rows.groupBy("filter_id").agg(F.min("option_ord").alias("filter_ord"),
                                          F.min_by("filter_label", "option_ord").alias("filter_label"))
    return rows.drop("filter_label").join(first, "filter_id").withColumn(
        "normalized_label", normalize_label(F.col("option_label")))


def lexicon_records(df: DataFrame, lower_id: str = "id") -> DataFrame:
    """Lexicon rows: record_id is the first non-blank of ID, id, optionId."""
    def given(name):
        return F.nullif(text_or_empty(name), F.lit("")) if name in df.columns else F.lit(None).cast("string")

    listed = F.split("synonyms", r"\|") if dict(df.dtypes)["synonyms"] == "string" else F.col("synonyms")
    return df.select(
        F.coalesce(given("ID"), given(lower_id), given("optionId")).alias("record_id"),
        *[text_or_empty(c).alias(c) for c in fv.LEXICON_COLUMNS[:-1]], clean_list(listed).alias("synonyms"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    if path.lower().endswith(".json"):
        raw = spark.read.option("multiLine", True).json(path)
        if "results" in raw.columns:
            raw = raw.select(F.explode("results").alias("r")).select("r.*")
    else:
        raw = csv_table(spark, path)
    # ID and id may both occur, and Spark resolves names without case
    with_case = [c for c in raw.columns if c == "id"]
    if with_case and "ID" in raw.columns:
        raw = raw.toDF(*["id_" if c == "id" else c for c in raw.columns])
        return lexicon_records(require_columns(raw, fv.LEXICON_COLUMNS, "Lexicon"), "id_")
    return lexicon_records(require_columns(raw, fv.LEXICON_COLUMNS, "Lexicon"))


def read_trimmed(spark: SparkSession, path: str, columns: list[str], what: str) -> DataFrame:
    df = require_columns(csv_table(spark, path), columns, what)
    return df.select(*[text_or_empty(c).alias(c) for c in columns])


def read_utterances(spark: SparkSession, path: str) -> DataFrame:
    return read_trimmed(spark, path, fv.UTTERANCE_COLUMNS, "CSV utterance file")


def read_scored(spark: SparkSession, path: str) -> DataFrame:
    """A scored dataset with its 13 columns; scores are doubles, the rank a number, the match a boolean."""
    kinds = dict.fromkeys([c for c in fv.SCORED_COLUMNS if "similarity" in c], "double") | {"target_rank": "bigint", "is_target_top_match": "boolean"}
    df = require_columns(csv_table(spark, path), fv.SCORED_COLUMNS, "Scored dataset")
    return df.select(*[F.trim(F.col(c)).try_cast(kinds[c]).alias(c) if c in kinds else text_or_empty(c).alias(c) for c in fv.SCORED_COLUMNS])


def read_synonym_input(spark: SparkSession, path: str) -> DataFrame:
    return read_trimmed(spark, path, fv.SYNONYM_INPUT_COLUMNS, "Synonym input")


def parse_booking_date(raw: Column) -> Column:
    """M/d/yyyy, M/d/yy or yyyy-M-d to an ISO date; anything else is null."""
    t = F.trim(raw)
    parsed = F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in ("M/d/yyyy", "M/d/yy", "yyyy-M-d")])
    return F.date_format(parsed, "yyyy-MM-dd")


def type_bookings(raw: DataFrame) -> DataFrame:
    """Text booking columns to typed ones; bad numbers become null, or 0 for people."""
    number = lambda c: F.trim(F.col(c)).try_cast("int")
    names = F.split(F.regexp_replace(F.coalesce("to", F.lit("")), "\n", " "), ",")
    return raw.select(
        *[c for c in ("ord",) if c in raw.columns], number("duration").alias("duration"), number("rooms").alias("rooms"),
        *[F.coalesce(number(c), F.lit(0)).alias(c) for c in ("adults", "children", "infants")],
        parse_booking_date(F.col("startDepartureDate")).alias("start_date"),
        parse_booking_date(F.col("endDepartureDate")).alias("end_date"),
        F.nullif(F.trim("from"), F.lit("")).alias("airport"), clean_list(names).alias("destinations"))


def read_bookings(spark: SparkSession, path: str) -> DataFrame:
    return type_bookings(csv_table(spark, path, order="ord"))


def read_entities(spark: SparkSession, path: str, collection: str, required: Iterable[str] = ("id", "name")) -> DataFrame:
    """`data.<collection>[]` of a JSON document as trimmed entity rows with file order.

    A blank required field, and an id or case-folded name that occurs twice, are rejected.
    """
    raw = spark.read.option("multiLine", True).json(path)
    rows = raw.select(F.posexplode(f"data.{collection}").alias("ord", "e")).select("ord", "e.*")
    rows = require_columns(rows, required, f"Collection '{collection}'").withColumns(
        {"id": F.trim(F.col("id").cast("string")), "name": F.trim("name")})
    absent = missing_required(rows, list(required)).where(F.size("missing_fields") > 0).select("missing_fields").limit(1).collect()
    if absent:
        raise ValueError(f"Entries in '{collection}' are missing required fields: {', '.join(absent[0][0])}")
    repeated = duplicate_entities(rows).limit(1).collect()
    if repeated:
        raise ValueError(f"Duplicate {repeated[0]['kind']} '{repeated[0]['value']}' found in '{collection}'")
    return rows


def parse_calendar(df: DataFrame, column: str = "date") -> DataFrame:
    """dd-MM-yyyy text to column d; null where it does not parse."""
    return df.withColumn("d", F.try_to_date(F.trim(column), "dd-MM-yyyy"))


def read_calendar(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("multiLine", True).json(path).select(F.explode("data.checkIns").alias("e"))
    parsed = parse_calendar(raw.select("e.date"))
    bad = F.raise_error(F.concat(F.lit("Date '"), F.coalesce("date", F.lit("")), F.lit("' is not in 'DD-MM-YYYY' format")))
    return parsed.select(F.when(F.col("d").isNotNull(), F.col("d")).otherwise(bad).alias("d")).orderBy("d")


def read_alias_entries(spark: SparkSession, path: str, categories: Iterable[str]) -> DataFrame:
    """Locale vocabulary: (category, target, values[lang, value]) per entry."""
    raw = spark.read.option("multiLine", True).json(path)
    parts = [raw.select(F.lit(c).alias("category"), F.explode(c).alias("e")).select("category", "e.target", "e.values")
             for c in categories if c in raw.columns]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def parse_request_batch(df: DataFrame, column: str, default_mode: str | None = None, default_method: str | None = None) -> DataFrame:
    """A JSON array of strings or {text, mode, method} per row to request rows.

    Entries without text carry request_error instead of vanishing.
    """
    keys = [c for c in df.columns if c != column]
    parsed = df.select(*keys, F.try_parse_json(column).alias("_v"))
    each = parsed.select(*keys, F.posexplode(F.try_variant_get("_v", "$", "array<variant>")).alias("pos", "_e"))
    is_object = F.schema_of_variant("_e").startswith("OBJECT")
    field = lambda n: F.nullif(F.try_variant_get("_e", f"$.{n}", "string"), F.lit(""))
    text = F.trim(F.when(is_object, field("text")).otherwise(F.try_variant_get("_e", "$", "string")))
    return each.select(
        *keys, "pos", text.alias("text"),
        F.coalesce(F.when(is_object, field("mode")), F.lit(default_mode).cast("string")).alias("mode"),
        F.coalesce(F.when(is_object, field("method")), F.lit(default_method).cast("string")).alias("method"),
        F.when(F.coalesce(text, F.lit("")) == "", F.when(is_object, "Batch entries must include a 'text' field").otherwise(
            "Batch entries provided as strings must be non-empty")).alias("request_error"))


def read_request_batch(spark: SparkSession, path: str, **defaults) -> DataFrame:
    """Request files, one JSON array per file; files are read in parallel."""
    return parse_request_batch(spark.read.text(path, wholetext=True), "value", **defaults)


def batch_mode(default: str | None, mode: Column) -> Column:
    """Aggregate: the default, else the only distinct mode, else null."""
    named = F.nullif(mode, F.lit(""))
    derived = F.when(F.min(named) == F.max(named), F.max(named))
    return F.lit(default) if default else derived


def usable_embeddings(df: DataFrame, column: str = "embedding") -> DataFrame:
    return df.where(F.size(column) > 0)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines with embedding and option_ids; records without a vector drop."""
    return usable_embeddings(spark.read.schema("embedding array<double>, option_ids array<string>, utterance string").json(path))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """An object with `results` or a bare array, one row per entry."""
    raw = spark.read.option("multiLine", True).json(path)
    return raw.select(F.explode("results").alias("r")).select("r.*") if "results" in raw.columns else raw


def read_replay(spark: SparkSession, path: str) -> DataFrame:
    """Replay rows with a user input; column headers are trimmed."""
    raw = require_columns(csv_table(spark, path), fv.REPLAY_COLUMNS, "Replay file")
    return raw.where(text_or_empty("User input") != "").select(
        text_or_empty("User input").alias("user_input"), text_or_empty("Expected values").alias("expected_values"))


def read_operations(spark: SparkSession, path: str, run: object = None, name: str = "run_id", buckets: int = OPERATION_BUCKETS) -> DataFrame:
    """Raw operations of `persist_operations`: all of them, or those of one run, from its folder alone."""
    every = spark.read.parquet(path)
    if run is not None:
        # the run as it would be stored, since the folder follows from its text
        asked = F.lit(run).cast(every.schema[name].dataType)
        every = every.where((F.col("run_bucket") == operation_bucket(asked, buckets)) & (F.col(f"`{name}`") == asked))
    return every.drop("run_bucket")
