"""Checked sizes: a broadcast only where the bytes are known to be few."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32_000_000


def measured(df: DataFrame, row_bytes: Column | int) -> DataFrame:
    """df marked for broadcast if its measured bytes are within the bound; else df as it is.

    df must be settled (read from a checkpoint or table), as measuring reads it.
    """
    each = F.lit(row_bytes) if isinstance(row_bytes, int) else row_bytes
    total = df.agg(F.sum(each.cast("long"))).first()[0] or 0
    return F.broadcast(df) if total <= BROADCAST_BYTES else df
