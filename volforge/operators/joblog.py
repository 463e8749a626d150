"""Job-log analytics (K1..K5, X1, X3, A12q): the job table and its status events as DataFrames."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ACTIVE = ["QUEUED", "RUNNING"]
TERMINAL = ["SUCCEEDED", "FAILED"]
PARAMS_SCHEMA = "ticker string, strike double, period_days int, num_simulations int"
DEFAULT_LIMIT, MAX_LIMIT = 50, 200
ERROR_WIDTH = 120


def _said(message):
    """A message, or null if it is missing or blank."""
    return F.when(F.trim(message) != "", message)


def job_view(jobs: DataFrame) -> DataFrame:
    """K1: job rows with the request parameters echoed as columns."""
    p = F.from_json("params", PARAMS_SCHEMA)
    return jobs.select("id", "status", "created_at", "started_at", "finished_at",
                       p["ticker"].alias("ticker"), p["strike"].alias("strike"),
                       p["period_days"].alias("period_days"), p["num_simulations"].alias("num_simulations"))


def job_runtime(jobs: DataFrame, now: str) -> DataFrame:
    """K2: runtime = finished - started, or now - started while active; seconds rounded to 1;
    the error, also truncated to 120 characters for lists; status upper-cased. ``now`` is a literal timestamp."""
    status = F.upper(F.coalesce(F.col("status"), F.lit("")))
    secs = lambda a, b: (F.unix_micros(a) - F.unix_micros(b)).cast("double") / F.lit(1e6)
    rt = (F.when(F.col("started_at").isNotNull() & F.col("finished_at").isNotNull(), secs(F.col("finished_at"), F.col("started_at")))
           .when(F.col("started_at").isNotNull() & status.isin(*ACTIVE), secs(F.lit(now).cast("timestamp"), F.col("started_at"))))
    return jobs.select("id", status.alias("status"), F.round(rt, 1).alias("runtime_s"),
                       F.substring(F.coalesce(F.col("error_message"), F.lit("")), 1, ERROR_WIDTH).alias("error"),
                       F.coalesce(F.col("error_message"), F.lit("")).alias("full_error"))


def avg_time_by_scale(jobs: DataFrame) -> DataFrame:
    """A8q: mean seconds from start to finish of the jobs of each ``num_simulations``."""
    micros = F.unix_micros("finished_at") - F.unix_micros("started_at")
    timed = jobs.where(F.col("started_at").isNotNull() & F.col("finished_at").isNotNull())
    scale = F.from_json("params", PARAMS_SCHEMA)["num_simulations"]
    return timed.select(scale.alias("num_simulations"), micros.alias("micros")).groupBy("num_simulations").agg(
        F.count(F.lit(1)).alias("n_jobs"),
        (F.sum("micros").cast("double") / F.count(F.lit(1)) / F.lit(1e6)).alias("avg_seconds"))


def job_counts(jobs: DataFrame, status: str | None = None, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """A12q: total (optionally of one status), number active, number shown on a page."""
    j = jobs.where(F.col("status") == status) if status else jobs
    return j.agg(F.count(F.lit(1)).alias("total"),
                 F.count_if(F.col("status").isin(*ACTIVE)).alias("active")) \
            .withColumn("shown", F.least(F.col("total"), F.lit(limit).cast("bigint")))


def page_jobs(jobs: DataFrame, status: str | None = None, offset: int = 0, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Optional status filter, newest first (id breaks ties), offset; a limit outside 1..200 is
    rejected. The sort + limit is planned as a per-partition top-k (TakeOrderedAndProject)."""
    if not 1 <= int(limit) <= MAX_LIMIT or offset < 0:
        raise ValueError(f"limit must be in 1..{MAX_LIMIT} and offset not negative, got {limit} and {offset}")
    j = jobs.where(F.col("status") == status) if status else jobs
    j = j.orderBy(F.col("created_at").desc(), F.col("id").desc())
    return (j.offset(offset) if offset else j).limit(limit)


def next_queued(jobs: DataFrame) -> DataFrame:
    """The oldest QUEUED job."""
    return jobs.where(F.col("status") == "QUEUED").orderBy("created_at", "id").limit(1)


def map_run_state(runs: DataFrame) -> DataFrame:
    """K4: (life_cycle, result, message) of a remote run -> job status and error message.
    PENDING/RUNNING/TERMINATING -> RUNNING; TERMINATED+SUCCESS -> SUCCEEDED; TERMINATED otherwise ->
    FAILED with the message or 'Databricks failed: <result>'; anything else -> NULL (no change)."""
    life = F.upper(F.coalesce(F.col("life_cycle"), F.lit("")))
    res = F.upper(F.coalesce(F.col("result"), F.lit("")))
    status = (F.when(life.isin("PENDING", "RUNNING", "TERMINATING"), F.lit("RUNNING"))
               .when((life == "TERMINATED") & (res == "SUCCESS"), F.lit("SUCCEEDED"))
               .when(life == "TERMINATED", F.lit("FAILED")))
    err = F.when(status == "FAILED", F.coalesce(_said(F.col("message")), F.concat(F.lit("Databricks failed: "), res)))
    return runs.withColumn("new_status", status).withColumn("new_error", err)


def fold_job_state(events: DataFrame) -> DataFrame:
    """K5: status events (job_id, ts, event_id, status, message) -> the job row they leave behind.

    RUNNING sets started_at once; SUCCEEDED / FAILED set finished_at; the last terminal event
    decides the error (FAILED: message or 'Unknown failure'; SUCCEEDED clears it). Written as
    conditional aggregates over the events of a job (partial aggregation, no per-job collect), so
    a job with a third of all events is still reduced map-side."""
    order = F.struct("ts", "event_id")
    term = F.col("status").isin(*TERMINAL)
    last_term = F.max_by(F.struct("status", "message", "ts"), F.when(term, order))
    return (events.groupBy("job_id")
                  .agg(F.max_by("status", order).alias("status"),
                       F.min(F.when(F.col("status") == "RUNNING", F.col("ts"))).alias("started_at"),
                       last_term.alias("_lt"),
                       F.max("ts").alias("updated_at"),
                       F.count(F.lit(1)).alias("n_events"))
                  .select("job_id", "status", "started_at", F.col("_lt.ts").alias("finished_at"),
                          F.when(F.col("_lt.status") == "FAILED", F.coalesce(_said(F.col("_lt.message")), F.lit("Unknown failure")))
                           .alias("error_message"),
                          "updated_at", "n_events"))
