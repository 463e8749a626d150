"""Option-chain preparation (O1..O11): from a raw quote snapshot to the priced contract table."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathfn import busdays
from ..sources.fixtures import CONTRACT_ORDER

# Fixed values of the chain filters; the caps are values for callers that ask for a capped chain.
MIN_DAYS, MAX_DAYS = 5, 60
MAX_EXPIRIES = 12
MIN_VOLUME, MIN_OPEN_INTEREST = 1, 10
BAND_LO, BAND_HI = 0.8, 1.2
MAX_ROWS = 120


def busdays_to_expiry(q: DataFrame) -> DataFrame:
    """O1: business days in [quote_date, expiration_date)."""
    return q.withColumn("days_to_expiry", busdays(F.col("quote_date"), F.col("expiration_date")))


def expiry_window(q: DataFrame, lo: int = MIN_DAYS, hi: int = MAX_DAYS) -> DataFrame:
    """O2: keep lo <= days <= hi."""
    return q.where(F.col("days_to_expiry").between(lo, hi))


def first_n_expiries(q: DataFrame, n: int) -> DataFrame:
    """O3: the first n in-range expirations per ticker. Ranks the *distinct* (ticker, expiration)
    pairs — a tiny table after partial aggregation — and semi-joins back, so a ticker holding a
    third of all quotes never lands in one window task."""
    exp = q.select("ticker", "expiration_date").distinct()
    keep = (exp.withColumn("_r", F.dense_rank().over(Window.partitionBy("ticker").orderBy("expiration_date")))
               .where(F.col("_r") <= n).drop("_r"))
    return q.join(keep, ["ticker", "expiration_date"], "left_semi")


def liquidity_filter(q: DataFrame) -> DataFrame:
    """Volume >= 1, open interest >= 10 (missing = 0), last > 0 (missing last is dropped)."""
    return q.where((F.coalesce(F.col("volume"), F.lit(0)) >= MIN_VOLUME)
                   & (F.coalesce(F.col("open_interest"), F.lit(0)) >= MIN_OPEN_INTEREST)
                   & (F.col("last") > 0))


def strike_band(q: DataFrame, lo: float = BAND_LO, hi: float = BAND_HI) -> DataFrame:
    """lo*S0 <= strike <= hi*S0, inclusive."""
    return q.where((F.col("strike") >= F.lit(lo) * F.col("underlying_price"))
                   & (F.col("strike") <= F.lit(hi) * F.col("underlying_price")))


def mid_price(q: DataFrame) -> DataFrame:
    """Mid of bid/ask when both are positive, else the last price (missing bid/ask = 0)."""
    bid = F.coalesce(F.col("bid"), F.lit(0.0))
    ask = F.coalesce(F.col("ask"), F.lit(0.0))
    return q.withColumn("mid_price", F.when((bid > 0) & (ask > 0), (bid + ask) / F.lit(2.0))
                                      .otherwise(F.col("last")))


CHAIN_ORDER = ["expiration_date", "option_type", "strike", *CONTRACT_ORDER]


def chain_rows(q: DataFrame) -> DataFrame:
    """The quote-table layout; missing bid/ask/IV/volume/OI become 0. ``chain_key`` orders the
    quotes of a ticker (expiration, call before put, strike, contract) by value, so that no window
    over a whole ticker is needed to number them."""
    return q.select(
        "ticker", "expiration_date", F.col("days_to_expiry").cast("int").alias("days_to_expiry"),
        "option_type", "strike", F.col("last").alias("last_price"),
        F.coalesce(F.col("bid"), F.lit(0.0)).alias("bid"),
        F.coalesce(F.col("ask"), F.lit(0.0)).alias("ask"),
        "mid_price",
        F.coalesce(F.col("implied_volatility"), F.lit(0.0)).alias("implied_volatility"),
        F.coalesce(F.col("volume"), F.lit(0)).cast("int").alias("volume"),
        F.coalesce(F.col("open_interest"), F.lit(0)).cast("int").alias("open_interest"),
        "underlying_price", F.struct(*CHAIN_ORDER).alias("chain_key"))


def row_cap(q: DataFrame, n: int) -> DataFrame:
    """First n rows per ticker in (expiration, call-then-put, strike, contract) order, with the
    position kept as ``chain_pos``. ``row_number() <= n`` is planned with a partial
    WindowGroupLimit before the shuffle, so each task ships at most n rows per ticker."""
    w = Window.partitionBy("ticker").orderBy(*CHAIN_ORDER)
    return q.withColumn("chain_pos", F.row_number().over(w)).where(F.col("chain_pos") <= n)


def option_chain(quotes: DataFrame, max_expiries: int | None = None, max_rows: int | None = None) -> DataFrame:
    """O1..O8 composed: the contract table the pricers consume. Every quote that passes the filters
    stays; the caps on expirations (O3) and rows (O8) apply only where the caller names them."""
    q = expiry_window(busdays_to_expiry(quotes))
    if max_expiries is not None:
        q = first_n_expiries(q, max_expiries)
    q = mid_price(strike_band(liquidity_filter(q)))
    return chain_rows(q if max_rows is None else row_cap(q, max_rows))


def chain_breakdown(chain: DataFrame) -> DataFrame:
    """Rows per ticker x option type, missing = 0."""
    return (chain.groupBy("ticker").pivot("option_type", ["call", "put"]).count()
                 .na.fill(0, ["call", "put"]))


def chain_ranges(chain: DataFrame) -> DataFrame:
    """O10 (global part): day and strike ranges, distinct tickers and expirations."""
    return chain.agg(F.min("days_to_expiry").alias("min_days"), F.max("days_to_expiry").alias("max_days"),
                     F.min("strike").alias("min_strike"), F.max("strike").alias("max_strike"),
                     F.countDistinct("ticker").alias("n_tickers"),
                     F.countDistinct("expiration_date").alias("n_expirations"),
                     F.count(F.lit(1)).alias("n_rows"))


def chain_by_ticker(chain: DataFrame) -> DataFrame:
    """O10 (per ticker): rows, first S0 in chain order, distinct expiries."""
    return chain.groupBy("ticker").agg(
        F.count(F.lit(1)).alias("rows"),
        F.min_by("underlying_price", "chain_key").alias("S0"),
        F.countDistinct("days_to_expiry").alias("expirations"))


def stamp(chain: DataFrame) -> DataFrame:
    """fetched_at = now (UTC session)."""
    return chain.withColumn("fetched_at", F.current_timestamp())


def option_type_counts(chain: DataFrame) -> DataFrame:
    """A13q: value counts of option_type."""
    return chain.groupBy("option_type").agg(F.count(F.lit(1)).alias("n"))
