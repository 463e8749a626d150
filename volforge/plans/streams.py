"""Registered plans that run the streaming jobs to completion over file drops derived from the
tables, then read the resulting table back (batch answer = stream answer)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..streaming import jobs as sj
from .common import Inputs, rounded
from .relational import query

N_DROPS = 3


def _drops(df: DataFrame, col: str, landing: str, order: list[int]) -> None:
    """Split ``df`` into N_DROPS consecutive value ranges of ``col`` (bounds from a one-row min/max
    aggregate, so no global sort or single task) and land them as separate file drops, in ``order``
    (a late drop arrives after a newer one)."""
    num = F.unix_date(F.col(col)) if dict(df.dtypes)[col] == "date" else F.col(col)
    x = df.withColumn("_v", num.cast("double"))
    bounds = x.agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))          # one row
    ranked = x.crossJoin(bounds).withColumn(
        "_q", F.least(F.lit(N_DROPS - 1), F.floor((F.col("_v") - F.col("_lo")) * F.lit(N_DROPS)
                                                  / (F.col("_hi") - F.col("_lo") + F.lit(1.0))).cast("int")))
    ranked = ranked.drop("_v", "_lo", "_hi")
    for i in order:
        ranked.where(F.col("_q") == i).drop("_q").write.mode("overwrite").parquet(f"{landing}/drop={i}")


@query("stream_prices")
def q_stream_prices(inp: Inputs) -> DataFrame:
    """ST1: the landed prices as file drops, the newest before the middle one, some rows first with
    wrong prices and volumes and corrected by a last drop; one run of the stream for each drop. The
    table equals the batch price table (T1..T5 over all rows)."""
    spark = inp.spark
    base = sj.scratch_dir(spark, "st1")
    landing, table, ck = f"{base}/landing", f"{base}/table", f"{base}/ck"
    wrong = F.pmod(F.unix_date("Date"), F.lit(7)) == 0
    faulty = inp.prices.withColumn("Close", F.when(wrong, F.col("Close") * 2).otherwise(F.col("Close")))
    faulty = faulty.withColumn("Adj_Close", F.when(wrong, F.lit(1.0)).otherwise(F.col("Adj_Close")))
    _drops(faulty, "Date", landing, [0, 1, 2])
    inp.prices.where(wrong).write.mode("overwrite").parquet(f"{landing}/drop=3")
    for drop in (0, 2, 1, 3):
        sj.stream_prices(spark, f"{landing}/drop={drop}", table, f"{ck}-{drop}", first_batch=10 * (1 + (0, 2, 1, 3).index(drop))).awaitTermination()
    return rounded(sj.read_prices(spark, table), 8)


@query("stream_job_state")
def q_stream_job_state(inp: Inputs) -> DataFrame:
    """ST2: three file drops of job events (the newest lands before the middle one) through the
    watermarked, de-duplicated streaming fold; equals the batch fold."""
    spark = inp.spark
    base = sj.scratch_dir(spark, "st2")
    landing, table, ck = f"{base}/landing", f"{base}/table", f"{base}/ck"
    _drops(inp.job_events, "event_id", landing, [0, 2, 1])
    q = sj.stream_job_state(spark, f"{landing}/*", table, ck, watermark="3650 days")
    q.awaitTermination()
    return sj.read_job_state(spark, table)
