"""The growth table: what the samplers simulated, written once per run and read by everything priced from it.

A row is one path's growth exp(log_sum) over its horizon. The table lies in the cluster's shared folder,
partitioned by method, so that a price, a correction factor or another scale reads stored rows instead of
running a sampler again, and one method's rows without the others'."""
from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.mathfn import TRADING_DAYS, clip_log_sum
from ..session import ensure_checkpoint_dir

GROWTH_KEYS = ["hist_ticker", "T", "method"]
GROWTH_SCHEMA = "hist_ticker string, T int, path_id long, g double, method string"


def growth(log_sums: DataFrame) -> DataFrame:
    """(hist_ticker, T, path_id, g, method): the clipped growth of each path."""
    return log_sums.select("hist_ticker", F.col("T").cast("int").alias("T"), F.col("path_id").cast("long").alias("path_id"),
                           F.exp(clip_log_sum(F.col("log_sum"))).alias("g"), "method")


@contextmanager
def stored_growth(spark: SparkSession, log_sums: DataFrame) -> Iterator[DataFrame]:
    """The growth table of ``log_sums``, written to a folder of its own, which goes when the block is
    left: materialise what is computed from it inside."""
    folder = f"{ensure_checkpoint_dir(spark)}/growth-{uuid.uuid4().hex}"
    growth(log_sums).write.partitionBy("method").parquet(folder)
    try:
        yield spark.read.schema(GROWTH_SCHEMA).parquet(folder)
    finally:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scale_index(path_id, scales: list[int]):
    """Index of the first scale that includes path_id (scales sorted ascending); null beyond the last."""
    expr = F.when(path_id < F.lit(scales[0]), F.lit(0))
    for i, s in enumerate(scales[1:], 1):
        expr = expr.when(path_id < F.lit(s), F.lit(i))
    return expr


def prefix_means(table: DataFrame, scales: list[int]) -> DataFrame:
    """(hist_ticker, T, method, scale, mean_growth): the mean over the paths of each scale, which are the
    first ones. One pass with map-side sums per stretch between two scales, then a running total."""
    part = table.withColumn("scale", scale_index(F.col("path_id"), scales)).where(F.col("scale").isNotNull())
    part = part.groupBy(*GROWTH_KEYS, "scale").agg(F.sum("g").alias("_s"), F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*GROWTH_KEYS).orderBy("scale").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return part.select(*GROWTH_KEYS, "scale", (F.sum("_s").over(upto) / F.sum("_n").over(upto)).alias("mean_growth"))


def martingale_factor(mean_growth, r, T):
    """exp(rT/252) / mean growth; 1 where the mean is not positive."""
    return F.when(mean_growth > 0, F.exp(r * T.cast("double") / F.lit(TRADING_DAYS)) / mean_growth).otherwise(F.lit(1.0))
