"""Join helpers with an explicit size check before broadcasting."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Broadcast only below this estimated size; above it the join stays a shuffle join (and AQE may
# still switch strategy from runtime statistics).
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def checked_broadcast(df: DataFrame, row_bytes: int = 256, array_cols: tuple[str, ...] = (),
                      limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``broadcast(df)`` when its measured size is under ``limit``, else ``df`` unchanged.

    The size is measured with one small aggregate (row count plus total array elements), so the
    decision is made from the data, not assumed. ``df`` should be a small derived table (one row
    per ticker, per contract, ...)."""
    aggs = [F.count(F.lit(1)).alias("rows")] + [F.sum(F.size(c)).alias(c) for c in array_cols]
    stats = df.agg(*aggs).collect()[0]
    est = stats["rows"] * row_bytes + sum(8 * int(stats[c] or 0) for c in array_cols)
    return F.broadcast(df) if est <= limit else df
