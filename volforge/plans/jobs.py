"""Registered plans for the job log, per-job results and the sinks' frame forms
(K1..K5, X1, X3, A7q, A12q, J5, J6, C1..C4, S9..S13)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.validate import job_run_errors, valid_ticker
from ..operators import joblog as jl
from ..operators import pricing as pc
from ..operators import prices as pr
from ..operators import results as rs
from ..sources import fixtures as fx
from ..sources import sinks
from .common import Inputs, rounded
from .relational import query

# Fixed value: "now" of the runtime report.
NOW = "2001-09-01 00:00:00"
RESULT_METHODS = ["black_scholes", "multifractal"]


def job_results(inp: Inputs) -> DataFrame:
    """Result rows of every job with a valid request: the closed-form methods priced for the
    job's (ticker, strike, period, paths) against the ticker's latest close and volatility.
    Layout of the pricing-result table plus job_id; K kept as double here (S10 types it)."""
    jv = jl.job_view(inp.job_log)
    ok = jv.where(valid_ticker(F.col("ticker")) & (F.col("strike") > 0) & (F.col("period_days") > 0)
                  & (F.col("num_simulations") > 0))
    s0 = fx.latest_quote_state(inp.prices).select("ticker", "S0")
    base = (ok.join(inp.stats.select("ticker", "vol"), "ticker").join(s0, "ticker").crossJoin(inp.rate)   # rate: one row
              .select(F.col("id").alias("job_id"), "ticker", F.col("strike").alias("K"),
                      F.col("period_days").alias("T"), F.col("num_simulations").alias("Runs"), "S0", "vol", "r"))
    b = pc.bs_price(base)
    return b.select("job_id", "ticker", "K", "T", "Runs", "S0",
                    F.explode(F.array(*[F.lit(m) for m in RESULT_METHODS])).alias("method"),
                    F.col("bs_call").alias("CallPrice"), F.col("bs_put").alias("PutPrice"))


@query("job_view")
def q_job_view(inp: Inputs) -> DataFrame:
    return rounded(jl.job_view(inp.job_log))


@query("job_runtime")
def q_job_runtime(inp: Inputs) -> DataFrame:
    return rounded(jl.job_runtime(inp.job_log, NOW))


@query("avg_time_by_scale")
def q_avg_time_by_scale(inp: Inputs) -> DataFrame:
    """A8q: mean duration of finished jobs by number of simulations, with the seconds per million."""
    return rounded(jl.avg_time_by_scale(inp.job_log))


@query("job_counts")
def q_job_counts(inp: Inputs) -> DataFrame:
    return jl.job_counts(inp.job_log)


@query("page_jobs")
def q_page_jobs(inp: Inputs) -> DataFrame:
    """First page (50) of FAILED jobs, newest first, after skipping 10."""
    return jl.page_jobs(inp.job_log, "FAILED", 10, 50).select("id", "status", "created_at")


@query("next_queued")
def q_next_queued(inp: Inputs) -> DataFrame:
    return jl.next_queued(inp.job_log).select("id", "created_at")


def _runs(inp: Inputs) -> DataFrame:
    """Remote-run states derived from job events (life cycle, result, message)."""
    e = fx.table(inp.spark, inp.sf_dir, "events").select("event_id", "user_id", "event_type", "props")
    life = (F.when(F.col("event_type") == "signup", F.lit("PENDING"))
             .when(F.col("event_type").isin("click", "view"), F.lit("RUNNING"))
             .when(F.col("event_type").isin("purchase", "error"), F.lit("TERMINATED")))
    result = (F.when(F.col("event_type") == "purchase", F.lit("SUCCESS"))
               .when(F.col("event_type") == "error", F.lit("FAILED")))
    msg = F.when((F.col("event_type") == "error") & (F.col("event_id") % 2 == 0), F.col("props"))
    return e.select("event_id", F.col("user_id").alias("job_id"), life.alias("life_cycle"), result.alias("result"),
                    msg.alias("message"))


@query("map_run_state")
def q_map_run_state(inp: Inputs) -> DataFrame:
    return jl.map_run_state(_runs(inp)).select("event_id", "job_id", "new_status", "new_error")


@query("fold_job_state")
def q_fold_job_state(inp: Inputs) -> DataFrame:
    return jl.fold_job_state(inp.job_events)


@query("job_metrics")
def q_job_metrics(inp: Inputs) -> DataFrame:
    """K3: duration in seconds and result row count per finished job."""
    j = inp.job_log.where(F.col("finished_at").isNotNull())
    n = job_results(inp).groupBy("job_id").agg(F.count(F.lit(1)).alias("row_count"))
    return (j.select(F.col("id").alias("job_id"),
                     ((F.unix_micros("finished_at") - F.unix_micros("started_at")) / F.lit(1e6)).alias("duration_seconds"))
             .join(n, "job_id", "left").na.fill(0, ["row_count"]))


@query("gate_results")
def q_gate(inp: Inputs) -> DataFrame:
    g = rs.gate_results(job_results(inp), inp.job_log)
    return g.groupBy("status", "accepted").agg(F.count(F.lit(1)).alias("n_jobs"), F.sum("n_rows").alias("n_rows"))


@query("typed_results")
def q_typed(inp: Inputs) -> DataFrame:
    """Result rows in the stored types (Runs INT, K FLOAT, T INT), created_at dropped for comparison."""
    return rounded(sinks.typed_results(job_results(inp)).drop("created_at"))


@query("read_results")
def q_read_results(inp: Inputs) -> DataFrame:
    """Filters on present columns only; K compared as FLOAT."""
    t = sinks.typed_results(job_results(inp)).drop("created_at")
    return rounded(sinks.read_results(t, ticker="3-MEDIUM", K=None, T=30, Runs=1000, job_id=None))


@query("select_methods")
def q_select_methods(inp: Inputs) -> DataFrame:
    return rs.select_methods(job_results(inp)).groupBy("method").agg(F.count(F.lit(1)).alias("n"))


@query("bs_reference_join")
def q_bs_ref(inp: Inputs) -> DataFrame:
    return rounded(rs.bs_reference(job_results(inp)).select("job_id", "method", "CallPrice", "BS_call", "PutPrice", "BS_put"))


@query("bs_deviation")
def q_bs_dev(inp: Inputs) -> DataFrame:
    return rounded(rs.bs_deviation(job_results(inp)))


@query("compare_jobs")
def q_compare(inp: Inputs) -> DataFrame:
    """Result rows labelled '#id ticker K= T=d n='."""
    r = job_results(inp)
    jv = jl.job_view(inp.job_log).select(F.col("id").alias("job_id"), F.col("ticker").alias("jt"), "strike",
                                         "period_days", "num_simulations")
    x = r.join(jv, "job_id")
    return rounded(x.select("job_id", "method", "CallPrice", "PutPrice",
                            rs.job_label(F.col("job_id"), F.col("jt"), F.col("strike"), F.col("period_days"),
                                         F.col("num_simulations")).alias("job_label")))


@query("method_by_job")
def q_method_by_job(inp: Inputs) -> DataFrame:
    return rounded(rs.method_by_job(job_results(inp), RESULT_METHODS))


@query("price_mean_by_method")
def q_price_mean(inp: Inputs) -> DataFrame:
    return rounded(rs.price_mean_by_method(job_results(inp)))


@query("date_spine")
def q_date_spine(inp: Inputs) -> DataFrame:
    """The calendar days of every job's request, from its creation over its period, and how many jobs
    cover each."""
    j = jl.job_view(inp.job_log).select("id", F.to_date("created_at").alias("start"), "period_days")
    days = sinks.date_spine(F.col("start"), F.date_add("start", F.col("period_days")))
    return j.select("id", F.explode(days).alias("business_date")).groupBy("business_date").agg(F.count(F.lit(1)).alias("n_jobs"))


@query("export_summary")
def q_export_summary(inp: Inputs) -> DataFrame:
    """Export the typed results and summarise what was written."""
    from ..streaming.jobs import scratch_dir
    path = scratch_dir(inp.spark, "s13") + "/results"
    sinks.export_snapshot(sinks.typed_results(job_results(inp)), path)
    return sinks.export_summary(inp.spark.read.parquet(path), "simulation_results", "results/")


@query("read_results_strike")
def q_read_results_strike(inp: Inputs) -> DataFrame:
    """S9 with a strike: of each ticker's results, those of its lowest strike of 30 days. The strike is asked
    for as the double it was requested with, and stored as FLOAT."""
    r = job_results(inp)
    asked = r.where(F.col("T") == 30).groupBy("ticker").agg(F.min("K").alias("K")).collect()          # a row for each ticker
    t = sinks.typed_results(r).drop("created_at")
    out = t.where(F.lit(False))
    for request in asked:
        out = out.unionByName(sinks.read_results(t, ticker=request.ticker, K=request.K, T=30))
    return rounded(out)


@query("valid_run_params")
def q_valid_run_params(inp: Inputs) -> DataFrame:
    """Per job, the errors of its run: id, dates (those of jobs not yet finished hold their status) and names."""
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    end = F.when(F.col("id") % 7 == 0, day(F.date_sub(F.to_date("created_at"), 1))).otherwise(F.coalesce(day("finished_at"), F.col("status")))
    errs = job_run_errors(F.col("id"), day("created_at"), end, {"output_ref": F.col("output_ref"), "status": F.col("status")})
    return inp.job_log.select("id", F.size(errs).alias("n_errors"), F.array_join(errs, "; ").alias("errors"))


@query("concat_frames")
def q_concat(inp: Inputs) -> DataFrame:
    """Union by name of the stored table and the increment (missing columns NULL)."""
    inc = pr.increment_after(inp.prices, inp.stored).withColumn("source", F.lit("increment"))
    u = inp.stored.unionByName(inc, allowMissingColumns=True)
    return u.groupBy("ticker", F.coalesce("source", F.lit("stored")).alias("source")).agg(F.count(F.lit(1)).alias("n"))


@query("replace_partition")
def q_replace_partition(inp: Inputs) -> DataFrame:
    """Write the typed results partitioned by ticker, then overwrite only the '2-HIGH' partition
    with its multifractal rows (dynamic partition overwrite); read the table back."""
    from ..streaming.jobs import scratch_dir
    path = scratch_dir(inp.spark, "s5") + "/results"
    t = sinks.typed_results(job_results(inp)).drop("created_at")
    t.write.mode("overwrite").partitionBy("ticker").parquet(path)
    sinks.replace_partition(t.where((F.col("ticker") == "2-HIGH") & (F.col("method") == "multifractal")), path)
    back = inp.spark.read.parquet(path)
    return back.groupBy("ticker", "method").agg(F.count(F.lit(1)).alias("n"))


@query("export_snapshot")
def q_export_snapshot(inp: Inputs) -> DataFrame:
    """Stamp the option chain, export a snapshot without the audit column, read it back."""
    from ..operators.chain import stamp
    from ..streaming.jobs import scratch_dir
    path = scratch_dir(inp.spark, "s7") + "/quotes"
    sinks.export_snapshot(stamp(inp.chain.select("*", "chain_key.ck_order", "chain_key.ck_line").drop("chain_key")).withColumnRenamed("fetched_at", "created_at"), path)
    return rounded(inp.spark.read.parquet(path))
