"""Registered plans for closed-form pricing and the accuracy study (P1..P5, P14, J1, J3, A1q..A6q, E1..E4, X2)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mathfn import norm_cdf
from ..operators import evaluate as ev
from ..operators import pricing as pc
from ..sources import fixtures as fx
from .common import Inputs, rounded
from .relational import query

CLOSED_FORM_RUNS = 0      # Runs value of analytical rows
SE_PATHS = 10_000         # path count the standard error is quoted for


def closed_form_priced(inp: Inputs) -> DataFrame:
    return pc.closed_form_prices(inp.contracts, inp.stats, inp.rate).withColumn("Runs", F.lit(CLOSED_FORM_RUNS))


def closed_form_errors(inp: Inputs) -> DataFrame:
    quotes = inp.first_quotes
    return ev.long_errors(ev.comparison(closed_form_priced(inp), quotes))


def _bs_inputs(inp: Inputs) -> DataFrame:
    st = inp.stats.select(F.col("ticker").alias("hist_ticker"), "vol")
    return inp.contracts.join(st, "hist_ticker").crossJoin(inp.rate)     # rate: one row


@query("risk_free_rate")
def q_rate(inp: Inputs) -> DataFrame:
    return rounded(inp.rate)


@query("map_history_ticker")
def q_map_history(inp: Inputs) -> DataFrame:
    """Contracts with their history ticker; contracts without history are dropped by the inner join."""
    hist = inp.stats.select(F.col("ticker").alias("hist_ticker"))
    return rounded(inp.contracts.join(hist, "hist_ticker").select("ticker", "hist_ticker", "K", "T", "S0"))


@query("dedupe_quotes")
def q_dedupe(inp: Inputs) -> DataFrame:
    d = ev.dedupe_quotes(inp.chain)
    return rounded(d.select("ticker", "strike", "days_to_expiry", "option_type", "mid_price", "last_price",
                            "underlying_price"))


@query("sample_contracts")
def q_sample(inp: Inputs) -> DataFrame:
    s = ev.sample_contracts(ev.dedupe_quotes(inp.chain), ev.MAX_COMBOS_PER_TICKER)
    return rounded(s.select("ticker", "strike", "days_to_expiry", "option_type"))


@query("distinct_kt")
def q_distinct_kt(inp: Inputs) -> DataFrame:
    return rounded(ev.accuracy_contracts(inp.chain))


@query("norm_cdf")
def q_norm_cdf(inp: Inputs) -> DataFrame:
    """N(d1), N(d2) for every contract."""
    b = pc.bs_price(_bs_inputs(inp))
    return rounded(b.select("ticker", "K", "T", norm_cdf(F.col("d1")).alias("n_d1"),
                            norm_cdf(F.col("d2")).alias("n_d2")), 10)


@query("bs_price")
def q_bs_price(inp: Inputs) -> DataFrame:
    """P2 over the whole contract grid."""
    b = pc.bs_price(_bs_inputs(inp))
    return rounded(b.select("ticker", "K", "T", "S0", "vol", "r", "d1", "d2", "bs_call", "bs_put"))


@query("bs_stderr")
def q_bs_stderr(inp: Inputs) -> DataFrame:
    """Payoff variance and standard error at SE_PATHS paths (put by its own second moment)."""
    b = pc.bs_stderr(_bs_inputs(inp), SE_PATHS)
    return rounded(b.select("ticker", "K", "T", "var_call", "var_put", "var_put_ref", "se_call", "se_put"))


@query("put_call_parity")
def q_parity(inp: Inputs) -> DataFrame:
    """P5 on the closed-form prices."""
    b = pc.bs_price(_bs_inputs(inp))
    p = pc.parity_columns(F.col("S0"), F.col("K"), F.col("T"), F.col("r"), F.col("bs_call"), F.col("bs_put"))
    return rounded(b.select("ticker", "K", "T", p["parity_theoretical"].alias("parity_theoretical"),
                            p["parity_sampled"].alias("parity_sampled"),
                            p["parity_ok"].alias("parity_ok")))


@query("actual_lookup")
def q_actual_lookup(inp: Inputs) -> DataFrame:
    return rounded(ev.actual_lookup(inp.chain))


@query("comparison")
def q_comparison(inp: Inputs) -> DataFrame:
    quotes = inp.first_quotes
    return rounded(ev.comparison(closed_form_priced(inp), quotes))


@query("pricing_error")
def q_pricing_error(inp: Inputs) -> DataFrame:
    """E1 + E2: observed (> 0.5) rows with signed and % errors."""
    e = closed_form_errors(inp)
    return rounded(e.select("ticker", "K", "T", "method", "option_type", "error", "pct_error"))


@query("error_report")
def q_error_report(inp: Inputs) -> DataFrame:
    """A3q, flagship: closed-form error report by option type and method."""
    return rounded(ev.error_report(closed_form_errors(inp)))


@query("best_method")
def q_best_method(inp: Inputs) -> DataFrame:
    return rounded(ev.best_method(ev.mape_by_method(closed_form_errors(inp))))


@query("mape_by_method")
def q_mape_by_method(inp: Inputs) -> DataFrame:
    return rounded(ev.mape_by_method(closed_form_errors(inp))).orderBy("option_type", "mape", "method")


@query("atm_filter")
def q_atm_filter(inp: Inputs) -> DataFrame:
    e = ev.atm_filter(closed_form_errors(inp))
    return rounded(e.select("ticker", "K", "T", "method", "option_type", "pct_error"))


@query("atm_report")
def q_atm_report(inp: Inputs) -> DataFrame:
    return rounded(ev.atm_report(closed_form_errors(inp)))
