"""Join strategy and run-time checks.

Only the label dimension is broadcast by hint, and only behind a check of its size in bytes;
every other join is left to Catalyst and AQE, which see bytes and split skewed partitions.
Checks are filters, so no column selection or count can prune them away.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Upper bound on the bytes of a side that is shipped to every executor by hint.
BROADCAST_BYTES = 64 << 20


def broadcast_within(df: DataFrame, size_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if its measured size is within ``limit``, else as it is."""
    return F.broadcast(df) if size_bytes <= limit else df


def require(df: DataFrame, bad: Column, message: Column | str) -> DataFrame:
    """``df``, raising ``message`` on the first row for which ``bad`` holds."""
    text = F.lit(message) if isinstance(message, str) else message
    return df.filter(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(text).cast("boolean")).otherwise(F.lit(True)))
