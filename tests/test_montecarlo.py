"""Invariants of the samplers and fits (the reference's property tests, with tolerances)."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from volforge.operators import resample as rs
from volforge.operators import stats as st
from volforge.sources.sinks import upsert_frame


@pytest.fixture(scope="module")
def series_state(spark):
    rng = np.random.default_rng(5)
    r = [float(v) for v in rng.normal(0.0005, 0.01, 400)]
    mu, sd = float(np.mean(r)), float(np.std(r))
    z = [(v - mu) / sd for v in r]
    return spark.createDataFrame([("X", r, len(r), mu, sd, sd * math.sqrt(252), z, len(z), False)],
                                 "hist_ticker string, returns array<double>, n int, mu double, std double, vol double, "
                                 "z_pool array<double>, n_z int, degenerate boolean")


def _paths(spark, n=300, T=7):
    h = spark.createDataFrame([("X", T)], "hist_ticker string, T int")
    return rs.path_table(h, ["m"], n, chunk=64)


def test_iid_is_partitioning_invariant(spark, series_state):
    cfg = rs.MCConfig(n_paths=300, rng="xxhash")
    a = rs.boot_iid(_paths(spark).repartition(1), series_state, cfg).orderBy("path_id").collect()
    b = rs.boot_iid(_paths(spark).repartition(17), series_state, cfg).orderBy("path_id").collect()
    assert [r.log_sum for r in a] == [r.log_sum for r in b]


def test_block_length_one_is_iid(spark, series_state):
    cfg = rs.MCConfig(n_paths=200, block_len=1.0)
    a = rs.boot_block(_paths(spark, 200), series_state, cfg, "t").orderBy("path_id").collect()
    b = rs.boot_iid(_paths(spark, 200), series_state, cfg, "t").orderBy("path_id").collect()
    assert [r.log_sum for r in a] == [r.log_sum for r in b]


def test_block_indices_follow_blocks(spark, series_state):
    """With a huge mean block length every path is one contiguous wrapped window."""
    cfg = rs.MCConfig(n_paths=50, block_len=1e9)
    r = series_state.collect()[0].returns
    got = rs.boot_block(_paths(spark, 50, 12), series_state, cfg, "t").collect()
    sums = {round(sum(r[(s + j) % len(r)] for j in range(12)), 12) for s in range(len(r))}
    assert all(round(g.log_sum, 12) in sums for g in got)


def test_cascade_lambda_zero_is_gaussian_time(spark, series_state):
    cfg = rs.MCConfig(n_paths=400, lam=0.0)
    p = _paths(spark, 400, 10).withColumn("_rate", F.lit(0.03))
    ls = [r.log_sum for r in rs.boot_cascade(p, series_state, cfg, F.col("_rate")).collect()]
    vol = series_state.collect()[0].vol
    drift = (0.03 - 0.5 * vol * vol) * 10 / 252
    # theta = 1: log-sum = drift + vol/sqrt(252) * sum of 10 standardised residuals (mean 0, var 1)
    m = np.mean(ls)
    assert abs(m - drift) < 4 * vol * math.sqrt(10 / 252) / math.sqrt(400)
    assert abs(np.std(ls) / (vol * math.sqrt(10 / 252)) - 1) < 0.15


def test_student_t_fit_recovers_df(spark):
    rng = np.random.default_rng(11)
    rows = [(f"T{df}", [float(v) for v in 0.01 * rng.standard_t(df, 3000)], 3000) for df in (3.0, 8.0)]
    arr = spark.createDataFrame(rows, "ticker string, returns array<double>, n int")
    fit = {r.ticker: r for r in st.student_t_fit(arr).collect()}
    assert abs(fit["T3.0"].df / 3.0 - 1) < 0.15 and abs(fit["T8.0"].df / 8.0 - 1) < 0.3


def test_garch_fit_finds_clustering(spark):
    g = np.random.default_rng(7)
    s2, out = 1e-4, []
    for _ in range(3000):
        r = math.sqrt(s2) * g.standard_normal()
        out.append(float(r))
        s2 = 1e-6 + 0.08 * r * r + 0.9 * s2
    arr = spark.createDataFrame([("G", out, len(out))], "ticker string, returns array<double>, n int")
    f = st.garch_fit(arr).collect()[0]
    assert 0.03 <= f.alpha <= 0.15 and abs((f.alpha + f.beta) - 0.98) < 0.03


def _garch(seed, alpha, beta, n=3000):
    g = np.random.default_rng(seed)
    s2, out = 1e-4, []
    for _ in range(n):
        r = math.sqrt(s2) * g.standard_normal()
        out.append(float(r))
        s2 = (1 - alpha - beta) * 1e-4 + alpha * r * r + beta * s2
    return out


def _nll(r, omega, alpha, beta):
    e = np.array(r) - np.mean(r)
    s2, total = max(float(np.var(e)), 1e-12), 0.0
    for x in e:
        total += 0.5 * (math.log(max(s2, 1e-16)) + x * x / max(s2, 1e-16))
        s2 = omega + alpha * x * x + beta * s2
    return total


def test_garch_fit_is_a_maximum(spark):
    rng = np.random.default_rng(0)
    series = {"a": _garch(7, 0.08, 0.9), "b": _garch(8, 0.15, 0.8), "c": _garch(9, 0.03, 0.95, 1200), "none": _garch(10, 0.0, 0.0, 800)}
    arr = spark.createDataFrame([(k, r, len(r)) for k, r in series.items()], "ticker string, returns array<double>, n int")
    coarse = {r.ticker: r.nll for r in st.garch_grid(arr).collect()}
    for f in st.garch_fit(arr).collect():
        r = series[f.ticker]
        assert f.converged and f.nll <= coarse[f.ticker] + 1e-9 and f.nll == pytest.approx(_nll(r, f.omega, f.alpha, f.beta), abs=1e-6)
        for _ in range(60):
            omega = f.omega * math.exp(rng.normal(0, 0.1))
            alpha, beta = max(0.0, f.alpha + rng.normal(0, 0.01)), max(0.0, f.beta + rng.normal(0, 0.01))
            if alpha + beta < 0.999:
                assert _nll(r, omega, alpha, beta) >= f.nll - 1e-3, (f.ticker, omega, alpha, beta)
        if f.ticker == "a":
            assert abs(f.alpha / 0.08 - 1) < 0.15 and abs(f.beta / 0.9 - 1) < 0.15


def test_garch_fit_of_series_without_variance(spark):
    arr = spark.createDataFrame([("flat", [0.0] * 50, 50), ("tiny", [0.01, -0.02, 0.01], 3)], "ticker string, returns array<double>, n int")
    for f in st.garch_fit(arr).collect():
        assert math.isfinite(f.nll) and f.omega > 0 and f.alpha >= 0 and f.beta >= 0 and f.alpha + f.beta < 0.999


def test_upsert_is_idempotent(spark):
    old = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 2.0), ("B", 1, 3.0)], "ticker string, Date int, v double")
    new = spark.createDataFrame([("A", 2, 20.0), ("C", 1, 5.0)], "ticker string, Date int, v double")
    once = upsert_frame(old, new, ["ticker", "Date"])
    twice = upsert_frame(once, new, ["ticker", "Date"])
    assert sorted(once.collect()) == sorted(twice.collect())
    assert sorted(tuple(r) for r in once.collect()) == [("A", 1, 1.0), ("A", 2, 20.0), ("B", 1, 3.0), ("C", 1, 5.0)]
