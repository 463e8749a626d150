"""Dealing candidate groups to tasks as tiles, and what the tile tasks share.

Rows that may match share a key (a bit block, a hash bucket). A group of at most ``tile_rows`` rows
is one unit of work. A larger group is cut into tiles by a hash of the row's id and becomes one unit
per pair of tiles, so no unit ever holds more than two tiles, whatever share of all rows a key has.
Units report pairs as links to the smallest member of what they connect: at most one per row, never
the pairs themselves."""
from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TILE_ROWS = 1024


def deal(rows: DataFrame, keys: list[str], id_col: str, tile_rows: int = TILE_ROWS) -> DataFrame:
    """``rows`` of groups with two rows or more, once per unit of work they take part in, with the
    unit's tiles ``ta`` <= ``tb`` and the row's own tile ``tile``."""
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_group")).where("n_group > 1")
    k = F.ceil(F.col("n_group") / F.lit(tile_rows)).cast("int")
    out = rows.join(sizes, keys).withColumn("n_tiles", k)
    out = out.withColumn("tile", F.pmod(F.xxhash64(id_col), F.col("n_tiles")).cast("int"))
    out = out.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_tiles") - 1)))
    return (out.withColumn("ta", F.least("tile", "other")).withColumn("tb", F.greatest("tile", "other"))
            .drop("n_group", "n_tiles", "other"))


def gather(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Bring each unit's rows together, contiguous within a partition."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(n, *keys).sortWithinPartitions(*keys)


def smallest_reachable(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 linked by pairs (i, j): the smallest node each one reaches."""
    low = np.arange(n)
    while len(i):
        m = np.minimum(low[i], low[j])
        new = low.copy()
        np.minimum.at(new, i, m)
        np.minimum.at(new, j, m)
        new = new[new]
        if np.array_equal(new, low):
            break
        low = new
    return low
