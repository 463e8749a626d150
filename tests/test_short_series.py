"""Tickers with few days keep their rows in the GARCH plans and are flagged in the filtered prices."""
import pytest
from pyspark.sql import functions as F

from datasets import SF_SMALL
from volforge.plans import montecarlo as mc
from volforge.plans.common import Inputs
from volforge.plans.relational import Q


@pytest.fixture(scope="module")
def inp(spark):
    made = Inputs(spark, SF_SMALL)
    all_prices = made.prices
    first = all_prices.groupBy("ticker").agg(F.array_sort(F.collect_list("Date")).alias("d"))
    first = first.select("ticker", F.element_at("d", 11).alias("tenth"), F.element_at("d", 1).alias("only"))
    x = all_prices.join(first, "ticker")
    x = x.where(~F.col("ticker").isin("1-URGENT", "2-HIGH") | ((F.col("ticker") == "1-URGENT") & (F.col("Date") <= F.col("tenth")))
                | ((F.col("ticker") == "2-HIGH") & (F.col("Date") <= F.col("only"))))
    made.__dict__["prices"] = x.select(*all_prices.columns).cache()
    return made


def test_garch_plans_keep_short_tickers(inp):
    tickers = {r.ticker for r in inp.prices.select("ticker").distinct().collect()}
    fit = {r.ticker: r for r in Q["garch_fit"](inp).collect()}
    assert set(fit) == tickers and len(tickers) == 5
    assert (fit["1-URGENT"].n, fit["2-HIGH"].n) == (10, 0)
    for t, r in fit.items():
        short = t in ("1-URGENT", "2-HIGH")
        assert (r.omega is None, r.beta is None, r.reason) == (short, short, mc.SHORT if short else None)
    rows = Q["garch_filter"](inp).where("ticker = '1-URGENT'").collect()
    assert len(rows) == 10 and all(r.sigma2 is None and r.z is None and r.reason == mc.SHORT for r in rows)
    assert Q["garch_filter"](inp).where("ticker = '3-MEDIUM' and sigma2 is not null and reason is null").count() > 30


def test_fallback_is_flagged(inp, spark):
    inp.__dict__["contracts"] = spark.createDataFrame(
        [(t, t, 100.0, 5, 100.0) for t in ("1-URGENT", "3-MEDIUM")], "ticker string, hist_ticker string, K double, T int, S0 double")
    priced = spark.createDataFrame([("1-URGENT", 1.0), ("3-MEDIUM", 2.0)], "ticker string, CallPrice double")
    got = {r.ticker: r.fallback for r in mc.with_fallback(inp, priced).collect()}
    assert got == {"1-URGENT": mc.SHORT, "3-MEDIUM": None}
