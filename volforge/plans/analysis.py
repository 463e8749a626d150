"""Registered plans for convergence, scale, sweep and EMC analytics
(W4, E5..E9, A5q, A9q..A11q, X6, J4, P6..P12)."""
from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mathfn import clip_log_sum, round_half_up
from ..operators import evaluate as ev
from ..operators import pricing as pc
from ..operators import resample as rs
from ..sources import fixtures as fx
from . import montecarlo as mc
from .common import Inputs, checkpointed, rounded
from .relational import query

# Fixed values of the convergence study (one contract at the money of every ticker and horizon, several
# scales and mixture weights).
CONV_KEYS = ("ticker", "T")
CONV_T = 10             # the horizon of the study's own contract
CONV_SCALES = [250, 500, 1000, 2000]
CONV_WEIGHTS = [0.1, 0.2, 0.3, 0.4, 0.5]
CONV_METHODS = ["historical", "window", "window_10d", "window_20d", "block_bootstrap", "multifractal_empirical",
                "black_scholes", "multifractal"]
# Fixed values of the accuracy sweeps.
ACC_SCALES = [250, 500, 1000]
SQL_METHODS = ["historical", "window", "window_10d", "window_20d", "student_t", "block_bootstrap",
               "multifractal_empirical", "black_scholes", "multifractal"]
BLOCK_LENGTHS = [1, 2, 3, 5, 8, 13, 21]
LAMBDAS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
EMC_TARGETS = ["historical", "window", "block_bootstrap"]


def conv_contracts(inp: Inputs) -> DataFrame:
    """The convergence contracts: of every ticker and horizon of the chain, at the money (K = S0 to the cent)."""
    return _at_the_money(inp.contracts)


def study_contracts(inp: Inputs) -> DataFrame:
    """``conv_contracts`` and the study's own contract, ``CONV_T`` days at the money, of every ticker with prices:
    it needs no quote of that horizon, nor of that ticker."""
    s = fx.latest_quote_state(inp.series).where(F.col("ticker").isNotNull())
    s = ev.map_history_ticker(s.select("ticker", F.lit(CONV_T).alias("T"), "S0"), fx.history_map(inp.spark))
    return _at_the_money(inp.contracts.select("ticker", "hist_ticker", "T", "S0").unionByName(s))


def _at_the_money(contracts: DataFrame) -> DataFrame:
    s = contracts.groupBy("ticker", "hist_ticker", "T").agg(F.min("S0").alias("S0"))
    return s.select("ticker", "hist_ticker", round_half_up(F.col("S0"), 2).alias("K"), "T", "S0")


def conv_prices(inp: Inputs, c: DataFrame, scales: list[int] = CONV_SCALES, cfg: rs.MCConfig = mc.FAST_CFG) -> DataFrame:
    """(ticker, T, alt_weight, runs, method, CallPrice, PutPrice) of the contracts ``c``, one for each
    ticker and T: every method at every scale and weight. Only the Student-t mixture depends on the
    weight; it is sampled once for all weights (same draws, other thresholds), and the other methods are
    priced once and reported for each weight."""
    state = mc.series_state(inp, CONV_METHODS + ["student_t"])
    cfg = replace(cfg, n_paths=max(scales))
    horizons = c.select("hist_ticker", "T").distinct()
    sampled = [m for m in CONV_METHODS if m not in mc.CLOSED_FORM]
    mixed = [f"student_t#{i}" for i in range(len(CONV_WEIGHTS))]
    sums = mc.log_sums(inp, horizons, cfg, sampled, state).unionByName(rs.boot_t_mixture_weights(
        rs.path_table(horizons, ["student_t"], cfg.n_paths, cfg.chunk), state.rows, cfg, CONV_WEIGHTS, "student_t", state.returns))
    priced = mc.sampled_prices(inp, c, sums, sampled + mixed, scales, [mc.EMC_DEFAULT])[0]
    return _by_weight(priced.unionByName(conv_closed_form(inp, c, scales)))


def conv_closed_form(inp: Inputs, c: DataFrame, scales: list[int] = CONV_SCALES) -> DataFrame:
    return mc.run_methods(inp, c, mc.ORACLE_CFG, mc.CLOSED_FORM, scales)


def _by_weight(priced: DataFrame) -> DataFrame:
    """Prices with the weight they are of: their own, or each where they do not depend on it."""
    weights = F.array(*[F.lit(w) for w in CONV_WEIGHTS])
    setting = F.split("method", "#")
    every = F.when(F.size(setting) > 1, F.array(F.get(weights, F.get(setting, F.lit(1)).cast("int")))).otherwise(weights)
    out = priced.select("*", F.explode(every).alias("alt_weight"))
    return out.select(*CONV_KEYS, "alt_weight", F.col("Runs").alias("runs"), F.get(F.split("method", "#"), F.lit(0)).alias("method"),
                      "CallPrice", "PutPrice")


def analytic_calls(inp: Inputs, c: DataFrame) -> DataFrame:
    """(ticker, T, bs_call): the closed-form call of each contract."""
    c = c.join(inp.stats.select(F.col("ticker").alias("hist_ticker"), "vol"), "hist_ticker")
    return pc.bs_price(c.crossJoin(inp.rate)).select(*CONV_KEYS, "bs_call")                  # rate: one row


def conv_report(name: str, p: DataFrame, calls: Callable[[], DataFrame], top: int) -> DataFrame:
    """A report over convergence prices, of each contract on its own. ``top``: the largest scale."""
    if name in ("convergence", "transition_report", "weight_summary"):
        conv = ev.convergence(p, by=CONV_KEYS)
        return conv if name == "convergence" else getattr(ev, name)(conv, CONV_KEYS)
    if name == "premium_over_bs":
        return ev.premium_over_bs(p, calls(), CONV_KEYS, top)
    if name == "highest_scale":
        return ev.highest_scale(p, "runs", top)
    return getattr(ev, name)(p, CONV_KEYS, top)


CONV_REPORTS = {
    "convergence": "W4: price change between successive scales per (weight, method); converged when <= 1%.",
    "transition_report": "E9: PASS / FAIL per weight and method at the last transition.",
    "weight_summary": "A11q: per weight at the last transition, how many methods converged, and the best.",
    "bs_consistency": "A9q: mean and deviation of the closed-form price over the weights.",
    "spread_vs_bs": "A10q: the price of each weight, the average over weights, and its distance from the closed form.",
    "premium_over_bs": "E8: (average call over weights - closed-form call) in per cent per method at the top scale.",
    "highest_scale": "X6: rows at the maximum scale.",
}
# Reports of the study's own contracts, too, checked against SQL over all contracts (the md5 stream).
STUDY_REPORTS = {"convergence", "transition_report", "weight_summary", "highest_scale"}
for _name, _doc in CONV_REPORTS.items():
    def _make(name):
        def plan(inp: Inputs) -> DataFrame:
            c = checkpointed(study_contracts(inp) if name in STUDY_REPORTS else conv_contracts(inp))
            cfg = mc.ORACLE_CFG if name in STUDY_REPORTS else mc.FAST_CFG
            prices = _by_weight(conv_closed_form(inp, c)) if name == "bs_consistency" else conv_prices(inp, c, cfg=cfg)
            return rounded(conv_report(name, prices, lambda: analytic_calls(inp, c), max(CONV_SCALES)))
        return plan
    _plan = _make(_name)
    _plan.__doc__ = _doc + " Of every ticker and horizon of the chain" + (
        f", and of {CONV_T} days of every ticker with prices." if _name in STUDY_REPORTS else ".")
    query(_name)(_plan)


# ------------------------------------------------------------------ accuracy at several scales / sweeps

def scale_errors(inp: Inputs) -> DataFrame:
    quotes, state = inp.first_quotes, mc.series_state(inp, SQL_METHODS)
    priced = mc.run_methods(inp, inp.contracts_cp, mc.ORACLE_CFG, SQL_METHODS, ACC_SCALES, state=state)
    return ev.long_errors(ev.comparison(priced, quotes))


@query("mape_by_scale")
def q_mape_by_scale(inp: Inputs) -> DataFrame:
    """A5q: mean absolute % error by (option type, method, paths)."""
    return rounded(ev.mape_by_scale(scale_errors(inp)))


def _with_best(df: DataFrame, key: str) -> DataFrame:
    best = df.agg(F.min_by(key, F.struct("put_mape", key)).alias("_best"))     # one row
    return df.crossJoin(best).withColumn("best", F.col(key) == F.col("_best")).drop("_best")


@query("block_sweep")
def q_block_sweep(inp: Inputs) -> DataFrame:
    """E5: put MAPE by mean block length; the argmin is flagged."""
    inp.first_quotes        # before the contracts, which are then read from it
    method, cfg, contracts = "block_bootstrap", mc.ORACLE_CFG, inp.contracts_cp
    state = mc.series_state(inp, [method])
    paths = rs.path_table(contracts.select("hist_ticker", "T"), [method], cfg.n_paths, cfg.chunk)
    sums = rs.boot_block_lengths(paths, state.rows, cfg, [float(v) for v in BLOCK_LENGTHS], method, state.returns)
    return _sweep(inp, contracts, sums, method, "block_len", BLOCK_LENGTHS, mc.RISK_NEUTRAL)


def _sweep(inp: Inputs, contracts: DataFrame, sums: DataFrame, method: str, key: str, settings: list, risk_neutral: set[str]) -> DataFrame:
    """Put MAPE by setting, from the log-sums of ``<method>#<setting index>``; the argmin is flagged."""
    names = [f"{method}#{i}" for i in range(len(settings))]
    discounted = set(names) if method in risk_neutral else set()
    priced = mc.sampled_prices(inp, contracts, sums, names, [mc.ORACLE_CFG.n_paths], [mc.EMC_DEFAULT], discounted)[0]
    setting = F.split("method", "#").getItem(1).cast("int")
    priced = priced.withColumn(key, F.element_at(F.array(*[F.lit(v) for v in settings]), setting + 1))
    return rounded(_with_best(_put_mape_by(priced, inp, key), key))


def _put_mape_by(priced: DataFrame, inp: Inputs, key: str) -> DataFrame:
    cmp = priced.join(ev.actual_lookup(inp.first_quotes), ["ticker", "K", "T"], "left")
    a = F.col("actual_put")
    e = cmp.where(a.isNotNull() & (a > ev.MIN_OBSERVED)).select(key, ((F.col("PutPrice") - a) / a * F.lit(100.0)).alias("pe"))
    return e.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.abs("pe")).alias("put_mape"))


@query("lambda_sweep")
def q_lambda_sweep(inp: Inputs) -> DataFrame:
    """Put MAPE of the empirical-residual cascade by intermittency lambda (discounted)."""
    inp.first_quotes        # before the contracts, which are then read from it
    method, cfg, contracts = "multifractal_empirical", mc.ORACLE_CFG, inp.contracts_cp
    state = mc.series_state(inp, [method])
    paths = mc.with_rate(inp, rs.path_table(contracts.select("hist_ticker", "T"), [method], cfg.n_paths, cfg.chunk))
    sums = rs.boot_cascade_lambdas(paths, state.pool("z_res"), cfg, F.col("_rate"), LAMBDAS, method, state.residuals)
    return _sweep(inp, contracts, sums, method, "lam", LAMBDAS, mc.RISK_NEUTRAL)


@query("emc_effect")
def q_emc_effect(inp: Inputs) -> DataFrame:
    """E7 + J4: MAPE without and with the empirical martingale correction for three samplers."""
    quotes, contracts, cfg = inp.first_quotes, inp.contracts_cp, mc.ORACLE_CFG
    sums = mc.log_sums(inp, contracts.select("hist_ticker", "T").distinct(), cfg, EMC_TARGETS, mc.series_state(inp, EMC_TARGETS))
    pre, post = mc.sampled_prices(inp, contracts, sums, EMC_TARGETS, [cfg.n_paths], [mc.EMC_DEFAULT, mc.EMC_DEFAULT | set(EMC_TARGETS)])
    rep = lambda p: ev.mape_by_method(ev.long_errors(ev.comparison(p, quotes)))
    return rounded(ev.emc_pre_post(rep(pre), rep(post)))


# ------------------------------------------------------------------ pricing steps (P6..P12) on the i.i.d. sampler

def _iid_log_sums(inp: Inputs) -> DataFrame:
    state = mc.series_state(inp, ["historical"])
    horizons = inp.contracts.select("hist_ticker", "T").distinct()
    paths = rs.path_table(horizons, ["historical"], mc.ORACLE_PATHS, mc.ORACLE_CFG.chunk)
    return rs.boot_iid(paths, state.rows, mc.ORACLE_CFG, "historical", state.returns)


@query("clip_log_sum")
def q_clip(inp: Inputs) -> DataFrame:
    """How many simulated log-sums the +-10 clamp touches, per horizon."""
    ls = _iid_log_sums(inp)
    return rounded(ls.groupBy("hist_ticker", "T").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.abs("log_sum") > 10).alias("n_clipped"),
        F.max(clip_log_sum(F.col("log_sum"))).alias("max_clipped"), F.min(clip_log_sum(F.col("log_sum"))).alias("min_clipped")))


@query("terminal_price")
def q_terminal(inp: Inputs) -> DataFrame:
    """Mean and spread of S0 * exp(log_sum) per contract ticker and horizon."""
    ls = _iid_log_sums(inp)
    s0 = inp.contracts.select("ticker", "hist_ticker", "T", "S0").distinct()
    x = ls.join(s0, ["hist_ticker", "T"]).withColumn("ST", F.col("S0") * F.exp(clip_log_sum(F.col("log_sum"))))
    return rounded(x.groupBy("ticker", "T").agg(F.avg("ST").alias("mean_ST"), F.min("ST").alias("min_ST"),
                                               F.max("ST").alias("max_ST")))


@query("martingale_correct")
def q_emc(inp: Inputs) -> DataFrame:
    """EMC factor exp(rT/252) / mean(exp(log_sum)) per horizon of the i.i.d. sampler."""
    ls = _iid_log_sums(inp)
    g = ls.withColumn("g", F.exp(clip_log_sum(F.col("log_sum")))).crossJoin(inp.rate)     # rate: one row
    return rounded(g.groupBy("hist_ticker", "T", "r").agg(F.avg("g").alias("mean_growth"))
                    .select("hist_ticker", "T", "mean_growth",
                            (F.exp(F.col("r") * F.col("T").cast("double") / F.lit(252.0)) / F.col("mean_growth")).alias("factor")))


@query("payoffs")
def q_payoffs(inp: Inputs) -> DataFrame:
    """P9 + P10: mean call / put payoff per contract (i.i.d. sampler, undiscounted) and path count."""
    p = mc.run_methods(inp, inp.contracts_cp, mc.ORACLE_CFG, ["historical"])
    return rounded(p.select("ticker", "K", "T", "Runs", "CallPrice", "PutPrice"))


@query("discount")
def q_discount(inp: Inputs) -> DataFrame:
    """Discount factors applied to risk-neutral methods, per horizon."""
    h = inp.contracts.select("T").distinct().crossJoin(inp.rate)            # rate: one row
    m = pc.method_registry(inp.spark)
    x = h.crossJoin(m.select("method", "risk_neutral"))                      # 12 literal rows
    return rounded(x.select("T", "method", F.when(F.col("risk_neutral"), pc.discount_factor(F.col("r"), F.col("T")))
                            .otherwise(F.lit(1.0)).alias("discount")))


@query("method_registry")
def q_registry(inp: Inputs) -> DataFrame:
    """The method table; EMC set = defaults union extras."""
    m = pc.method_registry(inp.spark)
    return m.withColumn("emc_with_extras", F.col("emc") | F.col("method").isin(*EMC_TARGETS))
