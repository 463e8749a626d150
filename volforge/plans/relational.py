"""Registered plans for the relational operators: price table, ingestion, option chain (S, T, O)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.validate import job_param_errors, valid_ticker
from ..operators import chain as ch
from ..operators import prices as pr
from ..operators import stats as st
from .common import Inputs, rounded

Q: dict = {}


def query(name):
    def deco(fn):
        Q[name] = fn
        return fn
    return deco


@query("prices")
def q_prices(inp: Inputs) -> DataFrame:
    return rounded(inp.prices)


@query("read_history")
def q_read_history(inp: Inputs) -> DataFrame:
    """(ticker, Date, Adj_Close, log_return) for every ticker with history."""
    return rounded(st.clean_returns(inp.returns).join(inp.prices.select("ticker", "Date", "Adj_Close"), ["ticker", "Date"])
                   .select("ticker", "Date", "Adj_Close", "log_return"), 8)


@query("latest_close")
def q_latest_close(inp: Inputs) -> DataFrame:
    """S0 = Adj_Close at the latest Date."""
    return rounded(inp.prices.groupBy("ticker").agg(F.max_by("Adj_Close", "Date").alias("S0"),
                                                    F.max("Date").alias("last_date")))


@query("return_array")
def q_return_array(inp: Inputs) -> DataFrame:
    """S3: the ordered return vector per ticker (checked through its length, ends and sum)."""
    a = st.return_arrays(inp.returns)
    return rounded(a.select("ticker", "n", F.element_at("returns", 1).alias("first_return"),
                            F.element_at("returns", -1).alias("last_return"),
                            F.aggregate("returns", F.lit(0.0), lambda acc, x: acc + x).alias("sum_returns")), 8)


@query("adj_close")
def q_adj_close(inp: Inputs) -> DataFrame:
    """T1 on a frame without an adjusted close: Adj_Close copies Close."""
    raw = inp.prices.drop("Adj_Close")
    return rounded(pr.adj_close(raw).select("ticker", "Date", "Close", "Adj_Close"))


@query("pct_change")
def q_pct_change(inp: Inputs) -> DataFrame:
    return rounded(inp.returns.select("ticker", "Date", "pct_change"), 8)


@query("log_return")
def q_log_return(inp: Inputs) -> DataFrame:
    return rounded(inp.returns.select("ticker", "Date", "log_return"), 8)


@query("drop_incomplete")
def q_drop_incomplete(inp: Inputs) -> DataFrame:
    """T4: rows kept after dropping incomplete ones, per ticker."""
    return pr.drop_incomplete(inp.returns).groupBy("ticker").agg(
        F.count(F.lit(1)).alias("rows_kept"), F.min("Date").alias("first_date"))


@query("project_prices")
def q_project_prices(inp: Inputs) -> DataFrame:
    """T1..T5: the 10-column price table."""
    return rounded(inp.price_table, 8)


@query("existing_tickers")
def q_existing(inp: Inputs) -> DataFrame:
    """Every ticker of the price table."""
    return pr.existing_tickers(inp.price_table)


@query("latest_dates")
def q_latest_dates(inp: Inputs) -> DataFrame:
    """The last day of every ticker of the price table."""
    return pr.latest_dates(inp.price_table)


def _requested(inp: Inputs) -> DataFrame:
    """Requested tickers: every landed ticker, ordinal = rank by name."""
    t = inp.prices.select("ticker").distinct()
    # the requested list is one row per ticker: a single ordered task is bounded by the ticker count
    return t.select("ticker", F.dense_rank().over(Window.orderBy("ticker")).alias("ordinal"))


@query("missing_tickers")
def q_missing(inp: Inputs) -> DataFrame:
    """Requested minus stored, request order kept."""
    return pr.missing_tickers(_requested(inp), inp.stored)


@query("increment_after")
def q_increment(inp: Inputs) -> DataFrame:
    """Landed rows after each ticker's stored high-water mark, returns against the stored last row."""
    return rounded(pr.increment_after(inp.prices, inp.stored), 8)


@query("upsert_prices")
def q_upsert(inp: Inputs) -> DataFrame:
    """Final table content after upserting the increment into the stored table (keys ticker, Date)."""
    from ..sources.sinks import upsert_frame
    return rounded(upsert_frame(inp.stored, pr.increment_after(inp.prices, inp.stored), pr.KEYS), 8)


@query("upsert_prices_sink")
def q_upsert_sink(inp: Inputs) -> DataFrame:
    """S4 through the partitioned table: stored tickers with stale volumes, then an upsert that
    overlaps them from the middle of the year before the split on (updates and inserts)."""
    from ..sources.sinks import upsert_prices
    from ..streaming.jobs import scratch_dir
    path = scratch_dir(inp.spark, "s4")
    upsert_prices(inp.spark, inp.stored.withColumn("Volume", F.lit(-1).cast("bigint")), path)
    upsert_prices(inp.spark, inp.price_table.where(F.col("Date") >= F.lit("2000-07-01").cast("date")), path)
    return rounded(inp.spark.read.parquet(path).select(*inp.price_table.columns), 8)


@query("table_stats")
def q_table_stats(inp: Inputs) -> DataFrame:
    """T10 over the upserted table."""
    from ..sources.sinks import upsert_frame
    return pr.table_stats(upsert_frame(inp.stored, pr.increment_after(inp.prices, inp.stored), pr.KEYS))


@query("valid_ticker")
def q_valid_ticker(inp: Inputs) -> DataFrame:
    """Tickers requested by jobs, with the allowlist verdict."""
    t = inp.job_log.select(F.get_json_object("params", "$.ticker").alias("ticker"))
    return t.groupBy("ticker").agg(F.count(F.lit(1)).alias("n_jobs")).withColumn("valid", valid_ticker(F.col("ticker")))


@query("valid_job_params")
def q_valid_job_params(inp: Inputs) -> DataFrame:
    """Per job, the list of parameter errors (empty = valid)."""
    p = F.col("params")
    errs = job_param_errors(F.get_json_object(p, "$.ticker"),
                            F.get_json_object(p, "$.strike").cast("double"),
                            F.get_json_object(p, "$.period_days").cast("int"),
                            F.get_json_object(p, "$.num_simulations").cast("int"))
    return inp.job_log.select("id", F.size(errs).alias("n_errors"),
                              F.array_join(errs, "; ").alias("errors"))


# ----------------------------------------------------------------------- option chain

@query("quotes_raw")
def q_quotes_raw(inp: Inputs) -> DataFrame:
    return rounded(inp.quotes_raw)


@query("busdays_to_expiry")
def q_busdays(inp: Inputs) -> DataFrame:
    """O1 over every quote: distinct (quote_date, expiration_date, days)."""
    return ch.busdays_to_expiry(inp.quotes_raw).select("quote_date", "expiration_date", "days_to_expiry").distinct()


@query("expiry_window")
def q_expiry_window(inp: Inputs) -> DataFrame:
    return (ch.expiry_window(ch.busdays_to_expiry(inp.quotes_raw))
              .groupBy("ticker", "days_to_expiry").agg(F.count(F.lit(1)).alias("n")))


@query("first_n_expiries")
def q_first_n(inp: Inputs) -> DataFrame:
    q = ch.first_n_expiries(ch.expiry_window(ch.busdays_to_expiry(inp.quotes_raw)), ch.MAX_EXPIRIES)
    return q.groupBy("ticker", "expiration_date").agg(F.count(F.lit(1)).alias("n"))


@query("liquidity_filter")
def q_liquidity(inp: Inputs) -> DataFrame:
    return ch.liquidity_filter(inp.quotes_raw).groupBy("ticker", "option_type").agg(F.count(F.lit(1)).alias("n"))


@query("strike_band")
def q_strike_band(inp: Inputs) -> DataFrame:
    return ch.strike_band(inp.quotes_raw).groupBy("ticker", "option_type").agg(F.count(F.lit(1)).alias("n"))


@query("mid_price")
def q_mid_price(inp: Inputs) -> DataFrame:
    """O6 over every raw quote."""
    m = ch.mid_price(inp.quotes_raw)
    return rounded(m.groupBy("ticker", "option_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("mid_price").alias("sum_mid"),
        F.sum(F.when(F.col("mid_price") == F.col("last"), 1).otherwise(0)).cast("bigint").alias("n_last_fallback")), 4)


@query("option_chain")
def q_option_chain(inp: Inputs) -> DataFrame:
    """O1, O2, O4..O7: the whole contract table, with the quote's order and line."""
    return rounded(inp.chain.select("*", "chain_key.ck_order", "chain_key.ck_line").drop("chain_key"))


@query("row_cap")
def q_row_cap(inp: Inputs) -> DataFrame:
    """O8 after O3: rows, expirations and last strike per ticker of the capped chain."""
    c = ch.option_chain(inp.quotes_raw, ch.MAX_EXPIRIES, ch.MAX_ROWS)
    return rounded(c.groupBy("ticker").agg(F.count(F.lit(1)).alias("rows"), F.countDistinct("expiration_date").alias("expirations"),
                                           F.max_by("strike", "chain_key").alias("last_strike")))


@query("chain_breakdown")
def q_breakdown(inp: Inputs) -> DataFrame:
    return ch.chain_breakdown(inp.chain)


@query("chain_ranges")
def q_ranges(inp: Inputs) -> DataFrame:
    return rounded(ch.chain_ranges(inp.chain))


@query("chain_by_ticker")
def q_chain_by_ticker(inp: Inputs) -> DataFrame:
    return rounded(ch.chain_by_ticker(inp.chain))


@query("option_type_counts")
def q_option_type_counts(inp: Inputs) -> DataFrame:
    return ch.option_type_counts(inp.chain)


# ----------------------------------------------------------------------- statistics

@query("vol_stats")
def q_vol_stats(inp: Inputs) -> DataFrame:
    return rounded(inp.stats, 8)


@query("tail_stats")
def q_tail_stats(inp: Inputs) -> DataFrame:
    return rounded(st.tail_stats(inp.returns), 6)


@query("residual_pool")
def q_residual_pool(inp: Inputs) -> DataFrame:
    return rounded(st.residual_pool(inp.returns), 8)


@query("head_n")
def q_head_n(inp: Inputs) -> DataFrame:
    """The first 10 rows of the price table in (ticker, Date) order (a top-k, planned as a
    per-partition TakeOrderedAndProject)."""
    return rounded(inp.price_table.orderBy("ticker", "Date").limit(10), 8)
