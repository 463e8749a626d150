"""Shared plumbing for the registered query plans: lazily built inputs and output rounding."""
from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions.mathfn import round_half_up
from ..operators import chain as ch
from ..operators import evaluate as ev
from ..operators import prices as pr
from ..operators import stats as st
from ..operators.pricing import risk_free_rate
from ..session import ensure_checkpoint_dir
from ..sources import fixtures as fx

# Doubles are compared across engines after rounding to this many places.
OUT_DIGITS = 6
# Split date and stored tickers of the landed/stored price fixture.
SPLIT_DATE = "2001-01-01"
STORED_TICKERS = ["1-URGENT", "2-HIGH", "3-MEDIUM"]


def rounded(df: DataFrame, digits: int = OUT_DIGITS) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, DoubleType):   # FLOAT columns keep their stored type
            cols.append(round_half_up(F.col(f"`{f.name}`"), digits).alias(f.name))
        else:
            cols.append(F.col(f"`{f.name}`"))
    return df.select(*cols)


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialised in the cluster's checkpoint folder, with the lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


class Inputs:
    """The fixture views of one table directory, built lazily (nothing is computed here)."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    @cached_property
    def prices(self) -> DataFrame:
        return fx.prices(self.spark, self.sf_dir)

    @cached_property
    def series(self) -> DataFrame:
        """The prices, one row per ticker and day, materialised in the checkpoint folder: returns, statistics,
        the rate and the quotes' spot all read them, and the orders are reduced to days once."""
        return checkpointed(self.prices)

    @cached_property
    def prices_nation(self) -> DataFrame:
        return fx.prices_by_nation(self.spark, self.sf_dir)

    @cached_property
    def returns(self) -> DataFrame:
        return pr.with_returns(self.series)

    @cached_property
    def price_table(self) -> DataFrame:
        return pr.transform_prices(self.prices)

    @cached_property
    def stored(self) -> DataFrame:
        return self.price_table.where(F.col("ticker").isin(STORED_TICKERS) & (F.col("Date") < F.lit(SPLIT_DATE).cast("date")))

    @cached_property
    def quotes_raw(self) -> DataFrame:
        return fx.quotes_raw(self.spark, self.sf_dir, self.series)

    @cached_property
    def chain(self) -> DataFrame:
        return ch.option_chain(self.quotes_raw)

    @cached_property
    def first_quotes(self) -> DataFrame:
        """The chain reduced to the first quote of each contract side, materialised in the checkpoint folder:
        the contracts and the observed mids are read from it, and the quotes are joined and read once,
        however often a plan refers to either."""
        return checkpointed(ev.first_quotes(self.chain))

    @cached_property
    def stats(self) -> DataFrame:
        return st.vol_stats(self.returns)

    @cached_property
    def rate(self) -> DataFrame:
        return risk_free_rate(self.series)

    @cached_property
    def contracts(self) -> DataFrame:
        """(ticker, K, T, S0, hist_ticker) of the accuracy study, materialised in the checkpoint folder: several
        steps of a plan share it, its size check then reads stored rows, and its lineage is cut. A plan that
        needs the observed mids, too, asks for ``first_quotes`` before; the contracts are then read from it."""
        quotes = self.first_quotes if "first_quotes" in self.__dict__ else self.chain
        return checkpointed(ev.map_history_ticker(ev.accuracy_contracts(quotes), fx.history_map(self.spark)))

    @property
    def contracts_cp(self) -> DataFrame:
        return self.contracts

    @cached_property
    def job_log(self) -> DataFrame:
        return fx.job_log(self.spark, self.sf_dir)

    @cached_property
    def job_events(self) -> DataFrame:
        return fx.job_events(self.spark, self.sf_dir)
