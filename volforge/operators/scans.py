"""Recursions along long ordered series, without one task per series: dense positions from a range
partitioning, and first-order (affine) recursions by composing their steps block by block."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cpu_partitions, ensure_checkpoint_dir
from .joins import checked_broadcast

FAN = 64      # steps of a block, blocks of a block of blocks, ...


def dense_positions(df: DataFrame, key: str, order: str, name: str = "idx") -> DataFrame:
    """``df`` with ``name``: 0, 1, ... in ``order`` within each ``key``. Rows are dealt to ranges of (key,
    order), so that a long series lies in several tasks; what a range holds of a key is counted, and the
    counts (a row per range and key) are run up. Materialised, since positions depend on the ranges."""
    ensure_checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(cpu_partitions(df.sparkSession), key, order).sortWithinPartitions(key, order)
    ranged = ranged.withColumn("_at", F.monotonically_increasing_id()).withColumn("_range", F.shiftright("_at", 33)).checkpoint(eager=True)
    held = ranged.groupBy(key, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    held = held.select(F.col(key).alias("_key"), F.col("_range").alias("_of"), "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    out = ranged.join(checked_broadcast(held, row_bytes=96), (F.col(key) == F.col("_key")) & (F.col("_range") == F.col("_of")))
    return out.select(*df.columns, (F.col("_at") - F.col("_first") + F.col("_before")).alias(name))


def _composed(steps: str) -> Column:
    """struct(add, times) of all steps of an array, first to last: x -> add + times * x, composed."""
    return F.aggregate(steps, F.struct(F.lit(0.0).alias("add"), F.lit(1.0).alias("times")), lambda done, s: F.struct(
        (s["add"] + s["times"] * done["add"]).alias("add"), (s["times"] * done["times"]).alias("times")))


def _with_starts(steps: str, start: Column) -> Column:
    """The array's steps with ``x``, the value each of them begins with."""
    seen = F.aggregate(F.slice(F.col(steps), 1, F.size(steps) - 1), F.array(start), lambda xs, s: F.concat(
        xs, F.array(s["add"] + s["times"] * F.element_at(xs, -1))))
    return F.zip_with(steps, seen, lambda s, x: F.struct(s["at"].alias("at"), x.alias("x")))


def affine_values(steps: DataFrame, key: str, starts: DataFrame, at: str = "idx", fan: int = FAN) -> DataFrame:
    """(key, at, x): the value before each step of x -> add + times * x, from the key's first value.

    ``steps``: (key, at, add, times), positions dense from 0; ``starts``: (key, start). A block of ``fan``
    steps is one affine step itself; blocks are composed to blocks of blocks until a key has at most
    ``fan`` of them, which one row scans; values then go back down level by level. No row holds more than
    ``fan`` steps, and every level but the last is spread by (key, block)."""
    levels = []
    now = steps.select(key, F.col(at).cast("long").alias("at"), "add", "times")
    longest = now.agg(F.max("at")).first()[0]
    longest = 0 if longest is None else int(longest)
    while True:
        rows = now.groupBy(key, F.expr(f"at DIV {int(fan)}").alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "add", "times"))).alias("steps"))
        levels.append(rows)
        if longest < fan:
            break
        longest //= fan
        now = rows.select(key, F.col("block").alias("at"), _composed("steps").alias("_c")).select(key, "at", "_c.add", "_c.times")
    x = starts.select(key, F.lit(0).cast("long").alias("block"), F.col("start").cast("double").alias("x"))
    for rows in reversed(levels):
        found = rows.join(x, [key, "block"]).select(key, F.explode(_with_starts("steps", F.col("x"))).alias("s"))
        x = found.select(key, F.col("s.at").alias("block"), F.col("s.x").alias("x"))
    return x.withColumnRenamed("block", at)
