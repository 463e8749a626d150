"""The reports with the study's own contract: ten days at the money of every ticker with prices, whether it
is quoted or not; and their registered SQL over all contracts."""
import datetime as dt
import os
import sys

import pytest

from volforge.plans import analysis as an
from volforge.plans.common import Inputs

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
START = dt.datetime(2001, 3, 1)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Prices of a ticker quoted at one horizon other than ten days, of one that is not quoted, and of none."""
    where = str(tmp_path_factory.mktemp("study"))
    tickers = ["3-MEDIUM", "5-LOW", None]
    orders = [(d * 3 + i, d, "F", 1000.0 + (d * 37 + i * 11) % 101, START + dt.timedelta(d), t)
              for d in range(40) for i, t in enumerate(tickers)]
    quotes = [(d * 3, 30 + d % 5, 1, 1, 10.0, 100.0, 0.05, 0.02, "A", "F" if d % 2 else "O", START) for d in range(6)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, "
                          "o_orderdate timestamp, o_orderpriority string").write.parquet(f"{where}/orders.parquet")
    spark.createDataFrame(quotes, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                          "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                          "l_shipdate timestamp").write.parquet(f"{where}/lineitem.parquet")
    return where


def test_contracts_need_no_quote(spark, tables):
    inp = Inputs(spark, tables)
    quoted = {(r.ticker, r["T"]) for r in an.conv_contracts(inp).collect()}
    assert quoted and {t for t, _ in quoted} == {"3-MEDIUM"} and an.CONV_T not in {h for _, h in quoted}
    rows = an.study_contracts(inp).collect()
    assert sorted((r.ticker, r["T"]) for r in rows) == sorted(quoted | {(t, an.CONV_T) for t in ("3-MEDIUM", "5-LOW")})
    assert all(r.hist_ticker == r.ticker and r.K == round(r.S0, 2) for r in rows)


def test_contracts_quoted_at_ten_days_come_once(spark):
    inp = Inputs(spark, "unused")
    inp.__dict__["series"] = spark.createDataFrame([("1-URGENT", dt.date(2001, 1, d), 100.0 + d) for d in (1, 2)],
                                                   "ticker string, Date date, Adj_Close double")
    inp.__dict__["contracts"] = spark.createDataFrame(
        [("1-URGENT", "2-HIGH", k, t, 102.0) for k in (90.0, 102.0) for t in (10, 11)],
        "ticker string, hist_ticker string, K double, T int, S0 double")
    got = sorted((r.ticker, r.hist_ticker, r.K, r["T"], r.S0) for r in an.study_contracts(inp).collect())
    assert got == [("1-URGENT", "2-HIGH", 102.0, 10, 102.0), ("1-URGENT", "2-HIGH", 102.0, 11, 102.0)]


@pytest.mark.parametrize("name", sorted(an.STUDY_REPORTS))
def test_registered_report_covers_the_study_and_matches_its_sql(spark, tables, name):
    import __spark_entry__ as E
    from check_oracle import digest, duck
    con = duck(tables)
    for t in ("orders", "lineitem"):                  # folders of files here
        con.execute(f"CREATE OR REPLACE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
    got = E.queries()[name](spark, tables).toPandas()
    assert {(t, an.CONV_T) for t in ("3-MEDIUM", "5-LOW")} <= set(zip(got["ticker"], got["T"]))
    assert digest(got) == digest(con.execute(E.oracle_sql()[name]).df())


def test_closed_form_without_volatility_is_growth_at_the_rate(spark):
    """A ticker of two days has one return and no volatility; unquoted, it had no contract to fail on before."""
    import math

    from volforge.operators import pricing as pc
    c = spark.createDataFrame([("A", "A", k, 10, 100.0) for k in (90.0, 100.0, 110.0)],
                              "ticker string, hist_ticker string, K double, T int, S0 double")
    stats = spark.createDataFrame([("A", 0.0)], "ticker string, vol double")
    rate = spark.createDataFrame([(0.045,)], "r double")
    for r in pc.closed_form_prices(c, stats, rate, ("black_scholes",)).collect():
        ahead = 100.0 - r.K * math.exp(-0.045 * 10 / 252)
        assert (r.CallPrice, r.PutPrice) == (pytest.approx(max(ahead, 0.0)), pytest.approx(max(-ahead, 0.0)))
    few = pc.closed_form_prices(c, spark.createDataFrame([("A", 1e-9)], "ticker string, vol double"), rate, ("black_scholes",))
    none = pc.closed_form_prices(c, stats, rate, ("black_scholes",))
    close = lambda df: {r.K: (round(r.CallPrice, 6), round(r.PutPrice, 6)) for r in df.collect()}
    assert close(few) == close(none)
