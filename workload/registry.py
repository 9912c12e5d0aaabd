"""Query and oracle registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wishloom.streaming.feeds import request_feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


class Tables:
    """Parquet tables of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def feed(self, name: str, files_per_trigger: int | None = 100) -> DataFrame:
        """A table as a stream, whether it is one file or a folder of files with any names.

        The path is a pattern, because a stream takes a plain path for a folder.
        """
        return request_feed(self.spark, f"{self.folder}/{name}[.]parquet", getattr(self, name).schema, "*",
                            files_per_trigger=files_per_trigger)


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return register


def r6(column):
    return F.round(column, 6)
