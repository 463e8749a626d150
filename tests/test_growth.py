"""The strike ladder and the growth table against prices taken path by path."""
import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from volforge.operators import growth as gr
from volforge.operators import mcpricing as mp

SCALES = [5, 20, 60]
R = 0.05


@pytest.fixture(scope="module")
def paths():
    rng = np.random.default_rng(1)
    rows = []
    for hist in ("A", "B"):
        for T in (5, 20):
            for method in ("plain", "fixed", "all"):
                for p in range(70 if method != "all" else 33):
                    rows.append((hist, T, method, p, float(rng.normal(0, 0.02 * math.sqrt(T)))))
    rows.append(("A", 5, "plain", 3, 0.0))          # growth 1: exactly at a strike
    return rows


CONTRACTS = [("X", "A", k, T, s) for T in (5, 20) for s, tick in ((100.0, "X"),) for k in (60.0, 95.0, 100.0, 100.5, 130.0)]
CONTRACTS += [("Y", "A", 50.0 + i, 5, 52.0) for i in range(9)] + [("Z", "B", 10.0, 20, 10.0)]


def by_hand(paths, contracts, emc, scales):
    out = {}
    for ticker, hist, K, T, S0 in contracts:
        for method in ("plain", "fixed", "all"):
            for s in scales:
                g = [math.exp(x) for h, t, m, p, x in paths if (h, t, m) == (hist, T, method) and (method == "all" or p < s)]
                f = math.exp(R * T / 252) / (sum(g) / len(g)) if method in emc else 1.0
                disc = math.exp(-R * T / 252) if method == "fixed" else 1.0
                call = sum(max(S0 * v * f - K, 0) for v in g) / len(g) * disc
                put = sum(max(K - S0 * v * f, 0) for v in g) / len(g) * disc
                out[ticker, K, T, method, s] = (call, put)
    return out


@pytest.mark.parametrize("emc", [set(), {"fixed"}, {"plain", "fixed", "all"}])
@pytest.mark.parametrize("scales", [[60], SCALES])
def test_ladder_prices_equal_path_by_path(spark, paths, emc, scales):
    ls = spark.createDataFrame(paths, "hist_ticker string, T int, method string, path_id long, log_sum double").repartition(5)
    contracts = spark.createDataFrame(CONTRACTS, "ticker string, hist_ticker string, K double, T int, S0 double")
    rate = spark.createDataFrame([(R,)], "r double")
    with gr.stored_growth(spark, ls) as table:
        got = mp.price_growth(table, contracts, rate, ["plain", "fixed", "all"], {"fixed"}, emc, scales, {"all"}).collect()
    want = by_hand(paths, CONTRACTS, emc, scales)
    assert len(got) == len(want)
    for r in got:
        call, put = want[r.ticker, r.K, r.T, r.method, r.Runs]
        assert r.CallPrice == pytest.approx(call, rel=1e-12, abs=1e-11) and r.PutPrice == pytest.approx(put, rel=1e-12, abs=1e-11)


def test_no_rows_of_a_path_and_a_strike(spark, paths):
    """The rows that meet the ladder are the paths; strikes add rungs, not paths."""
    ls = spark.createDataFrame(paths, "hist_ticker string, T int, method string, path_id long, log_sum double")
    contracts = spark.createDataFrame(CONTRACTS, "ticker string, hist_ticker string, K double, T int, S0 double")
    at = gr.growth(ls).withColumn("scale", F.lit(0)).select("hist_ticker", "T", "method", "scale", "g")
    sums = mp.interval_sums(at, mp.strike_ladder(contracts), ["plain", "fixed", "all"], 1)
    priced = [(h, t) for _, h, _, t, _ in CONTRACTS]
    assert sums.agg(F.sum("n")).first()[0] == sum((h, t) in priced for h, t, *_ in paths)
    assert sums.count() == 3 * sum(len({k / s for _, h, k, t, s in CONTRACTS if (h, t) == pair}) + 1 for pair in set(priced))


def test_growth_folder_goes_after_use(spark, paths):
    ls = spark.createDataFrame(paths, "hist_ticker string, T int, method string, path_id long, log_sum double")
    with gr.stored_growth(spark, ls) as table:
        files = [f.removeprefix("file:") for f in table.inputFiles()]
        assert files and all(os.path.exists(f) for f in files) and all("/method=" in f for f in files)
        means = {(r.hist_ticker, r["T"], r.method, r.scale): r.mean_growth for r in gr.prefix_means(table, SCALES).collect()}
    assert not any(os.path.exists(f) for f in files)
    for (hist, T, method, i), mean in means.items():
        g = [math.exp(x) for h, t, m, p, x in paths if (h, t, m) == (hist, T, method) and p < SCALES[i]]
        assert mean == pytest.approx(sum(g) / len(g), rel=1e-12)
