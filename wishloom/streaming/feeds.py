"""Request feeds, logs and live counters as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators import evaluation as ev


def request_feed(spark: SparkSession, folder: str, schema: StructType | str, pattern: str = "*.parquet",
                 fmt: str = "parquet", files_per_trigger: int | None = 100) -> DataFrame:
    """New files of a folder, or of all that a path pattern fits, as a stream.

    `files_per_trigger` bounds a micro-batch; None takes all that is there into one.
    """
    reader = spark.readStream.format(fmt).schema(schema).option("pathGlobFilter", pattern)
    return (reader if files_per_trigger is None else reader.option("maxFilesPerTrigger", files_per_trigger)).load(folder)


def append_log(stream: DataFrame, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Finished requests appended as files; the checkpoint makes restarts exactly-once."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", folder).option(
        "checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def live_counters(stream: DataFrame, status: str = "status", ms: str = "total_ms") -> DataFrame:
    """Counts by status and latency bucket; at most 3 x 7 rows of state."""
    outcome = F.when(F.col(status).isin("success", "failed"), F.col(status)).otherwise("error")
    return stream.groupBy(outcome.alias("outcome"), ev.bucket_label(F.col(ms)).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def publish_counters(counters: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Each trigger writes the full, bounded counter table under its batch number."""
    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return counters.writeStream.outputMode("complete").foreachBatch(write).option(
        "checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_counters(spark: SparkSession, folder: str) -> DataFrame:
    rows = spark.read.option("recursiveFileLookup", True).parquet(folder)
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), "batch").drop("batch")


def process_feed(stream: DataFrame, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Any stateless request transformation runs unchanged on a stream."""
    return transform(stream)
