"""Result-table operators: per-job result rows, gating, method selection and comparisons (J5, J6, C1..C4, A7q)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mathfn import round_half_up

# Fixed value: methods shown by default when present.
DEFAULT_METHODS = ["black_scholes", "fhs_rn", "multifractal", "window"]


def gate_results(results: DataFrame, jobs: DataFrame) -> DataFrame:
    """Result rows of SUCCEEDED jobs only (left semi join); other jobs are rejected with
    their status (left anti join). Returns (job_id, status, accepted, n_rows)."""
    ok = jobs.where(F.col("status") == "SUCCEEDED").select(F.col("id").alias("job_id"))
    acc = results.join(ok, "job_id", "left_semi").groupBy("job_id").agg(F.count(F.lit(1)).alias("n_rows"))
    acc = acc.select("job_id", F.lit("SUCCEEDED").alias("status"), F.lit(True).alias("accepted"), "n_rows")
    rej = (jobs.where(F.col("status") != "SUCCEEDED")
               .select(F.col("id").alias("job_id"), "status", F.lit(False).alias("accepted"),
                       F.lit(0).cast("bigint").alias("n_rows")))
    return acc.unionByName(rej)


def select_methods(results: DataFrame, chosen: list[str] | None = None) -> DataFrame:
    """Keep the chosen methods (default list) that are present; when none is present, keep all."""
    chosen = chosen or DEFAULT_METHODS
    spark = results.sparkSession
    pick = spark.createDataFrame([(m,) for m in chosen], "method string")
    present = results.select("method").distinct()
    hit = present.join(pick, "method", "left_semi")
    n_hit = hit.agg(F.count(F.lit(1)).alias("_h"))                   # one row
    keep = present.crossJoin(n_hit).join(pick.withColumn("_c", F.lit(True)), "method", "left") \
                  .where(F.col("_c").isNotNull() | (F.col("_h") == 0)).select("method")
    return results.join(keep, "method", "left_semi")


def bs_reference(results: DataFrame, key: str = "job_id") -> DataFrame:
    """Per-job black_scholes means joined LEFT onto every method row."""
    bs = (results.where(F.col("method") == "black_scholes").groupBy(key)
                 .agg(F.avg("CallPrice").alias("BS_call"), F.avg("PutPrice").alias("BS_put")))
    return results.join(bs, key, "left")


def bs_deviation(results: DataFrame, key: str = "job_id") -> DataFrame:
    """% deviation of Call/Put from the job's black_scholes row; prices to 4, deltas to 2 places."""
    m = bs_reference(results, key)
    return m.select(key, "method", round_half_up(F.col("CallPrice"), 4).alias("CallPrice"),
                    round_half_up(F.try_divide(F.col("CallPrice") - F.col("BS_call"), F.col("BS_call")) * F.lit(100.0), 2).alias("call_dev_pct"),
                    round_half_up(F.col("PutPrice"), 4).alias("PutPrice"),
                    round_half_up(F.try_divide(F.col("PutPrice") - F.col("BS_put"), F.col("BS_put")) * F.lit(100.0), 2).alias("put_dev_pct"))


def job_label(id_col, ticker, strike, period, sims):
    """'#id ticker K=strike T=periodd n=sims'."""
    return F.format_string("#%d %s K=%s T=%dd n=%d", id_col, F.coalesce(ticker, F.lit("")),
                           strike.cast("string"), period, sims)


def price_mean_by_method(results: DataFrame) -> DataFrame:
    """A7q: mean Call/Put by method, sorted by method."""
    return (results.groupBy("method").agg(F.avg("CallPrice").alias("CallPrice"), F.avg("PutPrice").alias("PutPrice"))
                   .orderBy("method"))


def method_by_job(results: DataFrame, methods: list[str]) -> DataFrame:
    """C4: job x method matrix of call prices. The pivot runs over the (bounded) method list, so
    the column count does not grow with the number of jobs."""
    return results.groupBy("job_id").pivot("method", methods).agg(F.avg("CallPrice"))
