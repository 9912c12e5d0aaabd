"""Logs, exports and statistics documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.coercion import two_decimals
from ..functions.expected import extracted_text
from ..functions.language import language_summary
from .logs import append_log


def audit_rows(df: DataFrame) -> DataFrame:
    """Request outcomes to the 15 audit columns, all text.

    df: ts, text, request_type, method, mode, status, timings map, language,
    confidence, output (any type). The two language columns have distinct
    names here; write_audit_log gives both the shared header.
    """
    def pick(stage):
        return two_decimals(F.coalesce(*[F.try_element_at("timings", F.lit(n)) for n in fv.AUDIT_TIMINGS[stage]]))

    plain = dict(df.dtypes)["output"] in ("string", "bigint", "int", "double", "boolean")
    shown = F.col("output").cast("string") if plain else F.to_json("output")
    summary = F.when(F.col("language").isNotNull() & F.col("confidence").isNotNull(),
                     language_summary(F.col("language"), F.col("confidence"))).otherwise(F.coalesce("language", F.lit("")))
    values = [
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.col("text"), F.col("request_type"), F.col("method"), F.col("mode"),
        F.initcap(F.lower("status")), pick("language"),
        pick("total"), summary, pick("extraction"),
        pick("mapping"), pick("validation"),
        pick("transcription"), pick("network"), shown]
    names = list(fv.AUDIT_LOG_HEADER)
    names[6], names[8] = "Language Detection (ms)", "Language Detection (summary)"
    return df.select(*[F.coalesce(v, F.lit("")).alias(n) for v, n in zip(values, names)])


def write_audit_log(rows: DataFrame, path: str) -> None:
    """Append to the log under its header, whose language name occurs twice."""
    append_log(rows, path, fv.AUDIT_LOG_HEADER)


def write_summary_log(rows: DataFrame, path: str) -> None:
    """Append summary rows to the log under its header."""
    append_log(rows, path, fv.SUMMARY_LOG_HEADER)


def summary_rows(jobs: DataFrame) -> DataFrame:
    """Job summaries to text log columns, two decimals, missing values empty."""
    def whole(name):
        return F.col(name).cast("string")

    def moment(name):
        return F.date_format(name, "yyyy-MM-dd'T'HH:mm:ss.SSS")

    values = [moment("finished_at"), F.col("mode"), F.col("status"), whole("total_requests"), whole("success_count"),
              whole("failed_count"), whole("error_count"), two_decimals(F.col("duration_ms")), two_decimals(F.col("processing_ms")),
              two_decimals(F.col("p50")), two_decimals(F.col("p95")), two_decimals(F.col("peak_cpu")),
              two_decimals(F.col("peak_memory_mb")), whole("throttle_count"),
              F.when(F.size("breaches") > 0, F.to_json("breaches")), moment("started_at"), moment("finished_at")]
    return jobs.select(*[F.coalesce(v, F.lit("")).alias(n) for v, n in zip(values, fv.SUMMARY_LOG_HEADER)])


def write_csv(df: DataFrame, path: str, mode: str = "append") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def session_export(df: DataFrame, input_column: str, rows_column: str) -> DataFrame:
    return df.select(F.col(input_column).alias("User input"), extracted_text(F.col(rows_column)).alias("Extracted values"))


def write_statistics(statistics: DataFrame, path: str) -> None:
    statistics.write.mode("overwrite").partitionBy("scope").parquet(path)


def statistics_metadata(bookings: DataFrame, digests: DataFrame, schema_version: int = 1) -> DataFrame:
    """Header of a statistics document, one row per `source`: version, moment, digest, bytes and rows of what it was built from.

    bookings carry their source; digests: source, sha256, length (from `file_digest`).
    """
    counted = bookings.groupBy("source").agg(F.count(F.lit(1)).alias("row_count"))
    return counted.join(digests.select("source", F.col("sha256").alias("source_sha256"), "length"), "source", "left").select(
        F.lit(schema_version).alias("schema_version"), F.current_timestamp().alias("generated_at"), "source", "source_sha256", "length", "row_count")


def write_dataset(df: DataFrame, path: str, columns: list[str]) -> None:
    write_csv(df.select(*columns), path, "overwrite")


OPERATION_BUCKETS = 64


def operation_bucket(run: Column, buckets: int = OPERATION_BUCKETS) -> Column:
    """Folder of a run: by its text, so a run has one folder whatever number type it is asked with."""
    return F.pmod(F.xxhash64(run.cast("string")), F.lit(buckets)).cast("int")


def persist_operations(ops: DataFrame, path: str, run: str = "run_id", buckets: int = OPERATION_BUCKETS) -> None:
    """Raw operations appended per run; rows of a run lie together, and a run of any size splits by bytes.

    A run has one of `buckets` folders, and files are in the order of runs, so one
    run is read from a part of one folder (`read_operations`). A folder for
    every run would cost files and listings with the number of runs. The run stays a column of
    its own type; `run_bucket` is that of the folders.
    """
    rest = [F.col(f"`{c}`") for c in ops.columns if c != run]
    placed = ops.select(*rest, F.col(f"`{run}`"), operation_bucket(F.col(f"`{run}`"), buckets).alias("run_bucket"))
    placed.hint("rebalance", F.col("run_bucket")).sortWithinPartitions("run_bucket", f"`{run}`").write.mode("append").partitionBy(
        "run_bucket").parquet(path)
