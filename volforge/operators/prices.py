"""Price-table operators: adjusted close, returns, incremental loads, table probes, validation."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.validate import valid_ticker

KEYS = ["ticker", "Date"]
PRICE_COLUMNS = ["ticker", "Date", "Open", "High", "Low", "Close", "Adj_Close", "Volume",
                 "pct_change", "log_return"]


def adj_close(df: DataFrame) -> DataFrame:
    """Use the adjusted close when the frame has one, else copy Close."""
    if "Adj_Close" in df.columns:
        return df.withColumn("Adj_Close", F.coalesce(F.col("Adj_Close"), F.col("Close")))
    if "Adj Close" in df.columns:
        return df.withColumn("Adj_Close", F.coalesce(F.col("`Adj Close`"), F.col("Close"))).drop("Adj Close")
    return df.withColumn("Adj_Close", F.col("Close"))


def _by_ticker():
    return Window.partitionBy("ticker").orderBy("Date")


def with_returns(df: DataFrame, price: str = "Adj_Close") -> DataFrame:
    """T2 + T3: simple and log return against the previous row of the same ticker (by Date).
    One shuffle on ticker; a day table per ticker is bounded by the number of trading days."""
    prev = F.lag(price).over(_by_ticker())
    ratio = F.try_divide(F.col(price), prev)
    return (df.withColumn("pct_change", ratio - F.lit(1.0))
              .withColumn("log_return", F.when(ratio > 0, F.log(ratio))))


def drop_incomplete(df: DataFrame) -> DataFrame:
    """T4: drop rows with any missing value (NULL or NaN), i.e. each ticker's first row."""
    return df.na.drop("any")


def project_prices(df: DataFrame) -> DataFrame:
    """T5: the fixed 10-column layout of the price table."""
    return df.select(
        F.col("ticker").cast("string"), F.to_date("Date").alias("Date"),
        *[F.col(c).cast("double") for c in ("Open", "High", "Low", "Close", "Adj_Close")],
        F.col("Volume").cast("bigint"),
        F.col("pct_change").cast("double"), F.col("log_return").cast("double"))


def transform_prices(raw: DataFrame) -> DataFrame:
    """T1..T5 for a landed OHLCV frame: the price-table rows."""
    return project_prices(drop_incomplete(with_returns(adj_close(raw))))


def existing_tickers(stored: DataFrame) -> DataFrame:
    """Distinct tickers of the stored table."""
    return stored.select("ticker").distinct()


def latest_dates(stored: DataFrame) -> DataFrame:
    """High-water mark per ticker."""
    return stored.groupBy("ticker").agg(F.max("Date").alias("max_date"))


def missing_tickers(requested: DataFrame, stored: DataFrame) -> DataFrame:
    """Requested (ticker, ordinal) minus stored tickers, request order kept."""
    return (requested.join(existing_tickers(stored), "ticker", "left_anti")
                     .orderBy("ordinal"))


def increment_after(landed: DataFrame, stored: DataFrame) -> DataFrame:
    """Landed rows strictly after each ticker's stored high-water mark (new tickers: all rows),
    with returns computed against the stored last row, so only a ticker's very first row ever
    lacks a return (the reference loses each increment's first day instead)."""
    hw = latest_dates(stored)
    new_rows = (landed.join(hw, "ticker", "left")
                      .where(F.col("max_date").isNull() | (F.col("Date") > F.col("max_date")))
                      .drop("max_date")
                      .withColumn("_new", F.lit(True)))
    last_stored = (stored.join(hw, "ticker").where(F.col("Date") == F.col("max_date"))
                         .select(*[c for c in landed.columns]).withColumn("_new", F.lit(False)))
    both = with_returns(new_rows.unionByName(last_stored, allowMissingColumns=True))
    return project_prices(drop_incomplete(both.where("_new").drop("_new")))


def table_stats(df: DataFrame) -> DataFrame:
    """Row count and distinct tickers."""
    return df.agg(F.count(F.lit(1)).alias("row_count"),
                  F.countDistinct("ticker").alias("ticker_count"))


def split_valid_tickers(df: DataFrame, col: str = "ticker") -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected-with-reason)."""
    ok = valid_ticker(F.col(col))
    return df.where(ok), df.where(~ok).withColumn("reason", F.lit("invalid ticker"))
