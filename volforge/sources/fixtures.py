"""Deterministic views over the driver tables that play the roles of the reference's inputs.

* ``prices``       daily price history per ticker (one series per order priority, or per
                   nation x priority for the larger variant)
* ``quotes_raw``   an option-quote snapshot built from lineitem x orders
* ``job_log``      the job table, ``job_events`` the job status event stream
* ``history_map``  option ticker -> history ticker map

All are plain Column expressions so the SQL oracle computes the same values. Values are rounded
at the source (prices 4 dp, strikes and quotes 2 dp) so that inclusive filters agree exactly
across engines.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.mathfn import round_half_up
from .tables import table

# Fixed values of the fixture definitions (they must equal the oracle SQL's).
DAILY_SCALE = 0.01          # z-score -> daily log move
DAILY_DRIFT = 0.0002
START_LEVEL = 100.0
EXPIRY_SPREAD_DAYS = 90     # expiration = quote date + 1 + (7*suppkey + linenumber) mod 90
STRIKE_LEVELS = 61          # strike = S0 * (703 + 10*(partkey mod 61)) / 1000
NO_TRADE_QUANTITY = 50.0    # last price 0 when quantity = 50
OPEN_INTEREST_MOD = 40
FAILED_EVERY = 10           # every 10th finished job fails
# Option ticker -> history ticker (the rest map to themselves).
HISTORY_MAP = [("1-URGENT", "2-HIGH")]


def _daily_levels(day: DataFrame) -> DataFrame:
    """(ticker, Date, m, Volume) -> OHLCV rows. The per-ticker day table is small (one row per
    calendar day), so whole-ticker windows here are bounded by the number of days."""
    w_all = Window.partitionBy("ticker")
    w_ord = Window.partitionBy("ticker").orderBy("Date")
    z = (F.col("m") - F.avg("m").over(w_all)) / F.stddev_pop("m").over(w_all)
    cum = F.sum(F.lit(DAILY_SCALE) * F.col("z") + F.lit(DAILY_DRIFT)).over(
        w_ord.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    out = (day.withColumn("z", z)
              .withColumn("Close", round_half_up(F.lit(START_LEVEL) * F.exp(cum), 4))
              .withColumn("Open", F.coalesce(F.lag("Close").over(w_ord), F.col("Close"))))
    return out.select(
        "ticker", "Date", "Open",
        F.greatest("Open", "Close").alias("High"),
        F.least("Open", "Close").alias("Low"),
        "Close",
        F.col("Close").alias("Adj_Close"),
        F.col("Volume").cast("bigint").alias("Volume"),
    )


def prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One price series per order priority."""
    o = table(spark, sf_dir, "orders")
    day = (o.groupBy(F.col("o_orderpriority").alias("ticker"),
                     F.to_date("o_orderdate").alias("Date"))
            .agg(F.avg("o_totalprice").alias("m"), F.count(F.lit(1)).alias("Volume")))
    return _daily_levels(day)


def nation_ticker(nationkey: Column, priority: Column) -> Column:
    return F.concat(F.lit("N"), F.lpad(nationkey.cast("string"), 2, "0"), F.lit("."), priority)


def prices_by_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Larger variant: one series per (customer nation, order priority) — 125 series."""
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority", "o_orderdate", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey)
    day = (j.groupBy(nation_ticker(F.col("c_nationkey"), F.col("o_orderpriority")).alias("ticker"),
                     F.to_date("o_orderdate").alias("Date"))
            .agg(F.avg("o_totalprice").alias("m"), F.count(F.lit(1)).alias("Volume")))
    return _daily_levels(day)


def latest_quote_state(px: DataFrame) -> DataFrame:
    """(ticker, S0, quote_date): latest adjusted close and its date, one row per ticker."""
    return px.groupBy("ticker").agg(F.max_by("Adj_Close", "Date").alias("S0"),
                                    F.max("Date").alias("quote_date"))


def quotes_raw(spark: SparkSession, sf_dir: str, px: DataFrame | None = None) -> DataFrame:
    """Option quotes from lineitem x orders; one quote per line item.

    The join lineitem x orders is the only large join here (shuffle on the order key); the
    per-ticker state joined afterwards has one row per ticker, which AQE broadcasts from its
    measured size."""
    px = px if px is not None else prices(spark, sf_dir)
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
        "l_discount", "l_tax", "l_returnflag", "l_linestatus")
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("ticker"))
    q = li.join(o, li.l_orderkey == o.o_orderkey).join(latest_quote_state(px), "ticker")
    is_call = F.col("l_linestatus") == "F"
    strike = round_half_up(F.col("S0") * ((F.lit(703) + F.lit(10) * (F.col("l_partkey") % STRIKE_LEVELS)).cast("double")
                                          / F.lit(1000.0)), 2)
    q = q.withColumn("strike", strike)
    intrinsic = F.when(is_call, F.greatest(F.col("S0") - F.col("strike"), F.lit(0.0))) \
                 .otherwise(F.greatest(F.col("strike") - F.col("S0"), F.lit(0.0)))
    last = F.when(F.col("l_quantity") == NO_TRADE_QUANTITY, F.lit(0.0)) \
            .otherwise(round_half_up(intrinsic + F.lit(0.05) * F.col("l_quantity"), 2))
    q = q.withColumn("last", last)
    return q.select(
        "ticker",
        "quote_date",
        F.date_add("quote_date", (F.lit(1) + (F.lit(7) * F.col("l_suppkey") + F.col("l_linenumber"))
                                  % EXPIRY_SPREAD_DAYS).cast("int")).alias("expiration_date"),
        F.when(is_call, F.lit("call")).otherwise(F.lit("put")).alias("option_type"),
        "strike",
        "last",
        F.when(F.col("l_discount") == 0.0, F.lit(None).cast("double"))
         .otherwise(round_half_up(F.col("last") * (F.lit(1.0) - F.col("l_tax")), 2)).alias("bid"),
        F.when(F.col("l_discount") == 0.01, F.lit(0.0))
         .otherwise(round_half_up(F.col("last") * (F.lit(1.0) + F.col("l_tax")), 2)).alias("ask"),
        F.when(F.col("l_returnflag") == "N", F.lit(None).cast("int"))
         .otherwise(F.col("l_quantity").cast("int")).alias("volume"),
        (F.col("l_partkey") % OPEN_INTEREST_MOD).cast("int").alias("open_interest"),
        (F.lit(0.10) + F.col("l_tax")).alias("implied_volatility"),
        F.col("S0").alias("underlying_price"),
        # contract identity: a total order for ties
        F.col("l_orderkey").alias("ck_order"), F.col("l_linenumber").alias("ck_line"),
        F.col("l_partkey").alias("ck_part"), F.col("l_suppkey").alias("ck_supp"),
        F.col("l_extendedprice").alias("ck_price"),
    )


CONTRACT_ORDER = ["ck_order", "ck_line", "ck_part", "ck_supp", "ck_price"]


def history_map(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(HISTORY_MAP, "option_ticker string, hist_ticker string")


def job_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job table from orders: one job per order (key o_orderkey)."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_orderdate",
                                              "o_orderpriority", "o_totalprice")
    k = F.col("o_orderkey")
    status = (F.when(F.col("o_orderstatus") == "O", F.lit("QUEUED"))
                .when(F.col("o_orderstatus") == "P", F.lit("RUNNING"))
                .when(k % FAILED_EVERY == 0, F.lit("FAILED"))
                .otherwise(F.lit("SUCCEEDED")))
    created = F.col("o_orderdate").cast("timestamp")
    started = F.when(F.col("status") != "QUEUED",
                     F.timestamp_add("SECOND", (k % 600).cast("int"), F.col("created_at")))
    finished = F.when(F.col("status").isin("SUCCEEDED", "FAILED"),
                      F.timestamp_add("SECOND", (k % 3600).cast("int"), F.col("started_at")))
    params = F.to_json(F.struct(
        F.col("o_orderpriority").alias("ticker"),
        round_half_up(F.col("o_totalprice") / F.lit(1000.0), 2).alias("strike"),
        (F.lit(5) + k % 60).cast("int").alias("period_days"),
        (F.lit(1000) * (F.lit(1) + k % 5)).cast("int").alias("num_simulations")))
    return (o.withColumn("status", status)
             .withColumn("created_at", created)
             .withColumn("started_at", started)
             .withColumn("finished_at", finished)
             .select(k.alias("id"), "created_at", "status", params.alias("params"),
                     "started_at", "finished_at",
                     F.when(F.col("status") == "FAILED", F.lit("Unknown failure")).alias("error_message"),
                     F.when(F.col("status") == "SUCCEEDED",
                            F.concat(F.lit("results/job="), k.cast("string"))).alias("output_ref")))


EVENT_STATUS = [("signup", "QUEUED"), ("click", "RUNNING"), ("view", "RUNNING"),
                ("purchase", "SUCCEEDED"), ("error", "FAILED")]


def event_status(event_type: Column) -> Column:
    expr = None
    for ev, st in EVENT_STATUS:
        expr = (F.when(event_type == ev, F.lit(st)) if expr is None
                else expr.when(event_type == ev, F.lit(st)))
    return expr


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Job status events from the events table: (job_id, ts, event_id, status, message)."""
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "props")
    return e.select(F.col("user_id").alias("job_id"), F.col("ts").cast("timestamp").alias("ts"),
                    "event_id", event_status(F.col("event_type")).alias("status"),
                    F.col("props").alias("message"))
