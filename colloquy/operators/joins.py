"""Join helpers: broadcast only behind a size check."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def estimated_bytes(df: DataFrame) -> int | None:
    """Catalyst's size estimate of the optimised plan (no job is run)."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes().toString())
    except Exception:  # Spark Connect or a plan without statistics
        return None


def broadcast_limit(df: DataFrame) -> int:
    """The session's ``spark.sql.autoBroadcastJoinThreshold`` in bytes; -1 is off."""
    text = str(df.sparkSession.conf.get("spark.sql.autoBroadcastJoinThreshold", "10485760")).strip().lower().rstrip("b")
    unit = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(text[-1:], 1)
    return int(text.rstrip("kmg")) * unit


def broadcast_if_small(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Hint a broadcast only when the estimated size is known and below the
    session's limit (or a smaller ``limit``); otherwise leave the choice to
    the planner and AQE, which re-plans from runtime sizes."""
    size = estimated_bytes(df)
    if size is not None and size <= (broadcast_limit(df) if limit is None else min(limit, broadcast_limit(df))):
        return F.broadcast(df)
    return df
