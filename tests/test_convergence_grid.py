"""The convergence reports: every ticker and horizon, contracts kept apart, and agreement with their SQL on a
few contracts (whole tables: tools/check_oracle.py)."""
import os
import sys

import pytest
from pyspark.sql import functions as F

from datasets import SF_SMALL
from volforge.operators import evaluate as ev
from volforge.plans import analysis as an
from volforge.plans.common import Inputs, checkpointed, rounded

SCALES = [50, 100]
TOOLS = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools")


@pytest.fixture(scope="module")
def inp(spark):
    return Inputs(spark, SF_SMALL)


@pytest.fixture(scope="module")
def some(inp):
    """Contracts of two tickers and their prices."""
    s0 = inp.contracts.select("ticker", "hist_ticker", "S0").distinct().orderBy("ticker").limit(2)
    c = checkpointed(s0.select("ticker", "hist_ticker", F.round("S0", 2).alias("K"), F.explode(F.array(F.lit(3), F.lit(5))).alias("T"), "S0"))
    return c, an.conv_prices(inp, c, SCALES, an.mc.ORACLE_CFG)        # the stream that SQL can follow


def test_every_ticker_and_horizon_of_the_chain(inp):
    want = {(r.ticker, r.T) for r in inp.chain.select("ticker", F.col("days_to_expiry").alias("T")).distinct().collect()}
    got = [(r.ticker, r.T) for r in an.conv_contracts(inp).collect()]
    assert set(got) == want and len(got) == len(want) and len({t for t, _ in got}) > 1 and len({h for _, h in got}) > 1


def test_every_weight_scale_and_method_once(some):
    c, prices = some
    n = prices.count()
    methods = len(an.CONV_METHODS) + 1
    assert n == c.count() * len(an.CONV_WEIGHTS) * len(SCALES) * methods
    assert prices.select(*an.CONV_KEYS, "alt_weight", "runs", "method").distinct().count() == n


@pytest.mark.parametrize("name", list(an.CONV_REPORTS))
def test_reports_keep_contracts_apart(inp, some, name):
    """A report of all contracts holds, for each, what the report of it alone holds."""
    c, prices = some
    whole = an.conv_report(name, prices, lambda: an.analytic_calls(inp, c), max(SCALES)).collect()
    one = c.first()
    mine = (F.col("ticker") == one.ticker) & (F.col("T") == one["T"])
    alone = an.conv_report(name, prices.where(mine), lambda: an.analytic_calls(inp, c.where(mine)), max(SCALES)).collect()
    row = lambda r: tuple(round(v, 6) if isinstance(v, float) else v for v in r)
    assert {(r.ticker, r["T"]) for r in whole} == {(r.ticker, r["T"]) for r in c.collect()}
    assert sorted(map(row, alone), key=str) == sorted((row(r) for r in whole if (r.ticker, r["T"]) == (one.ticker, one["T"])), key=str)


def test_spread_lists_the_price_of_each_weight(some):
    _, prices = some
    rows = ev.spread_vs_bs(prices, an.CONV_KEYS, max(SCALES)).where("method = 'student_t'").collect()
    assert {r.alt_weight for r in rows} == set(an.CONV_WEIGHTS) and len({r.call for r in rows}) > len(an.CONV_WEIGHTS)
    by = {}
    for r in rows:
        by.setdefault((r.ticker, r["T"]), []).append(r)
    for group in by.values():
        assert group[0].avg_call == pytest.approx(sum(r.call for r in group) / len(group), rel=1e-12)


def test_block_lengths_of_one_pass_equal_single_runs(spark, inp):
    from dataclasses import replace

    from volforge.operators import resample as rs
    from volforge.plans import montecarlo as mc
    state = mc.series_state(inp, ["block_bootstrap"])
    h = spark.createDataFrame([(state.frame.first().hist_ticker, 9)], "hist_ticker string, T int")
    cfg = rs.MCConfig(n_paths=40)
    paths = rs.path_table(h, ["block_bootstrap"], 40)
    got = rs.boot_block_lengths(paths, state.rows, cfg, [1.0, 3.0, 8.0], "b", state.returns).collect()
    for i, length in enumerate((1.0, 3.0, 8.0)):
        want = rs.boot_block(paths, state.rows, replace(cfg, block_len=length), "b", state.returns).collect()
        assert {r.path_id: round(r.log_sum, 12) for r in want} == {r.path_id: round(r.log_sum, 12) for r in got if r.method.endswith(f"#{i}")}


@pytest.fixture(scope="module")
def small_sql(some):
    """DuckDB with the same few contracts, and the SQL module cut to their scales."""
    sys.path.insert(0, TOOLS)
    from check_oracle import duck

    from volforge.plans import oracle_analysis as oa
    con = duck(SF_SMALL)
    con.register("some_contracts", some[0].toPandas())
    patch = pytest.MonkeyPatch()
    patch.setattr(oa, "CONV_SCALES", SCALES)
    patch.setattr(oa, "CC", ("cc", "SELECT ticker, hist_ticker, K, CAST(T AS INTEGER) AS T, S0 FROM some_contracts"))
    yield con, oa
    patch.undo()


def test_prices_agree_with_their_sql(some, small_sql):
    con, oa = small_sql
    rows = con.execute(oa.conv_sql("SELECT ticker, T, alt_weight, runs, method, CallPrice, PutPrice FROM cp")).fetchall()
    want = {(t, T, round(w, 6), n, m): (a, b) for t, T, w, n, m, a, b in rows}
    got = {(r.ticker, r["T"], round(r.alt_weight, 6), r.runs, r.method): (r.CallPrice, r.PutPrice) for r in some[1].collect()}
    assert got.keys() == want.keys()
    for k in want:
        assert got[k] == pytest.approx(want[k], rel=1e-9, abs=1e-9), k


@pytest.mark.parametrize("name", list(an.CONV_REPORTS))
def test_reports_agree_with_their_sql(inp, some, small_sql, name):
    from check_oracle import digest
    con, oa = small_sql
    c, prices = some
    got = rounded(an.conv_report(name, prices, lambda: an.analytic_calls(inp, c), max(SCALES)))
    assert digest(got.toPandas()) == digest(con.execute(oa.conv_report_sql(name)).df())
