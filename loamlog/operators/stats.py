"""What Catalyst knows of a plan's size, and what follows from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's upper estimate of the result's size."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Hints a broadcast if the estimate is at most ``limit``; beyond it the join is left to
    Catalyst, which sorts and merges."""
    return F.broadcast(df) if estimated_bytes(df) <= limit else df
