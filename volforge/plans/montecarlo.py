"""Monte Carlo pricing of every contract by every method, and the reports built on it
(P6..P13, R1..R10, E5..E9, W4, A5q, A8q..A11q)."""
from __future__ import annotations

from dataclasses import replace
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.mathfn import round_half_up
from ..operators import evaluate as ev
from ..operators import pricing as pc
from ..operators import resample as rs
from ..operators import stats as st
from ..operators.growth import stored_growth
from ..operators.joins import checked_broadcast
from ..operators.mcpricing import price_growth
from ..session import ensure_checkpoint_dir
from .common import Inputs, checkpointed

# Fixed values of the registered Monte Carlo plans.
SIM_METHODS = ["historical", "window", "window_10d", "window_20d", "student_t", "multifractal_empirical",
               "block_bootstrap", "fhs", "fhs_rn"]
CLOSED_FORM = ["black_scholes", "multifractal"]
RISK_NEUTRAL = {m for m, _, rn, _ in pc.METHODS if rn}
EMC_DEFAULT = {m for m, _, _, e in pc.METHODS if e}
EXACT = {"window", "window_10d", "window_20d"}


class SeriesState:
    """What the samplers need of each history ticker, one row each, materialised; and its size-checked
    broadcast forms, decided once."""

    def __init__(self, frame: DataFrame):
        self.frame = frame

    @cached_property
    def rows(self) -> DataFrame:
        return checked_broadcast(self.frame, row_bytes=512, array_cols=("returns", "z_fhs", "z_res"))

    @cached_property
    def returns(self) -> DataFrame:
        return checked_broadcast(rs.long_values(self.frame, "returns"), row_bytes=48)

    @cached_property
    def residuals(self) -> DataFrame:
        return checked_broadcast(rs.long_values(self.frame, "z_res"), row_bytes=48)

    def pool(self, column: str) -> DataFrame:
        return self.rows.withColumn("z_pool", F.col(column)).withColumn("n_z", F.size(column))


def series_state(inp: Inputs, methods: list[str] | None = None) -> SeriesState:
    """One row per history ticker with what the requested samplers need: the return array and D1
    stats always; the D2 Student-t fit for student_t; the D3/D4 GARCH fit and filtered residual
    pool for fhs / fhs_rn; the D8 standardised residual pool for multifractal_empirical.

    The table is small (one return array per ticker) but expensive (the fits), so it is
    checkpointed once into the cluster's checkpoint folder: the fits run once, the lineage is cut,
    and the broadcast size check reads the materialised rows."""
    need = set(methods or SIM_METHODS)
    arrays = st.return_arrays(inp.returns)
    x = arrays.join(inp.stats.select("ticker", "mu", "std", "vol"), "ticker")
    empty = F.array().cast("array<double>")
    if "student_t" in need:
        tfit = st.student_t_fit(arrays)
        x = x.join(tfit.select("ticker", F.col("df").alias("t_df"), F.col("tloc").alias("t_loc"),
                               F.col("tscale").alias("t_scale")), "ticker", "left")
    else:
        x = x.select("*", *[F.lit(None).cast("double").alias(c) for c in ("t_df", "t_loc", "t_scale")])
    if need & {"fhs", "fhs_rn"}:
        gfit = checkpointed(st.garch_fit(arrays.where(F.col("n") >= 30)))
        filt = st.garch_filter(gfit, inp.returns)
        zpool = (filt.groupBy("ticker")
                     .agg(F.array_sort(F.collect_list(F.struct("Date", "z"))).alias("_z"),
                          F.first("sigma2_next").alias("sigma2_next"))
                     .select("ticker", F.transform("_z", lambda e: e["z"]).alias("z_fhs"), "sigma2_next"))
        x = x.join(gfit.select("ticker", "omega", "alpha", "beta"), "ticker", "left").join(zpool, "ticker", "left")
    else:
        x = x.select("*", *[F.lit(None).cast("double").alias(c) for c in ("omega", "alpha", "beta", "sigma2_next")],
                     F.lit(None).cast("array<double>").alias("z_fhs"))
    degenerate = (F.col("n") < 2) | (F.col("std") == 0)
    x = x.select(F.col("ticker").alias("hist_ticker"), "returns", "n", "mu", "std", "vol", "t_df", "t_loc", "t_scale",
                 "omega", "alpha", "beta", "sigma2_next", F.coalesce("z_fhs", empty).alias("z_fhs"),
                 degenerate.alias("degenerate"),
                 F.when(~degenerate, F.transform("returns", lambda v: (v - F.col("mu")) / F.col("std")))
                  .otherwise(empty).alias("z_res"))
    ensure_checkpoint_dir(inp.spark)
    return SeriesState(x.checkpoint(eager=True))


def with_rate(inp: Inputs, paths: DataFrame) -> DataFrame:
    return paths.crossJoin(inp.rate.select(F.col("r").alias("_rate")))                    # rate: one row


def log_sums(inp: Inputs, horizons: DataFrame, cfg: rs.MCConfig, methods: list[str], state: SeriesState) -> DataFrame:
    """The log-sums of every sampled path of ``methods`` (all starts of the exact ones)."""
    rc = F.col("_rate")
    gens = {
        "historical": lambda p: rs.boot_iid(p, state.rows, cfg, "historical", state.returns),
        "student_t": lambda p: rs.boot_t_mixture(p, state.rows, cfg, "student_t", state.returns),
        "block_bootstrap": lambda p: rs.boot_block(p, state.rows, cfg, "block_bootstrap", state.returns),
        "fhs": lambda p: rs.boot_filtered(with_rate(inp, p), state.pool("z_fhs"), cfg, False, rc, "fhs"),
        "fhs_rn": lambda p: rs.boot_filtered(with_rate(inp, p), state.pool("z_fhs"), cfg, True, rc, "fhs_rn"),
        "multifractal_empirical": lambda p: rs.boot_cascade(with_rate(inp, p), state.pool("z_res"), cfg, rc, "multifractal_empirical", state.residuals),
    }
    parts = [rs.boot_window(rs.window_paths(horizons, state.rows, [m]), state.rows, pc.WINDOW_STRIDE[m], state.returns) if m in EXACT
             else gens[m](rs.path_table(horizons, [m], cfg.n_paths, cfg.chunk)) for m in sorted(set(methods))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sampled_prices(inp: Inputs, contracts: DataFrame, sums: DataFrame, methods: list[str], scales: list[int],
                   emc_sets: list[set[str]], risk_neutral: set[str] = frozenset(RISK_NEUTRAL)) -> list[DataFrame]:
    """The prices of ``contracts`` from the log-sums of ``methods``, once for each set of corrected methods.
    The samplers run once, into the growth table; the prices are materialised from it."""
    k = contracts.select("ticker", "hist_ticker", "K", "T", "S0")
    with stored_growth(inp.spark, sums) as table:
        return [price_growth(table, k, inp.rate, sorted(set(methods)), risk_neutral, emc, scales, EXACT & set(methods)).checkpoint(eager=True)
                for emc in emc_sets]


def run_methods(inp: Inputs, contracts: DataFrame, cfg: rs.MCConfig, methods: list[str], scales: list[int] | None = None,
                extra_emc: set[str] = frozenset(), state: SeriesState | None = None) -> DataFrame:
    """P13 re-aimed: every method for every contract. Paths are generated once per (history ticker, T,
    method), stored as growth and shared by all strikes and scales of that horizon."""
    scales = sorted(scales or [cfg.n_paths])
    cfg = replace(cfg, n_paths=max(scales))
    sampled = sorted(set(methods) - set(CLOSED_FORM))
    out = None
    if sampled:
        state = state if state is not None else series_state(inp, methods)
        sums = log_sums(inp, contracts.select("hist_ticker", "T").distinct(), cfg, sampled, state)
        out = sampled_prices(inp, contracts, sums, sampled, scales, [EMC_DEFAULT | set(extra_emc)])[0]
    closed = [m for m in methods if m in CLOSED_FORM]
    if closed:
        cf = pc.closed_form_prices(contracts, inp.stats, inp.rate, tuple(closed))
        cf = cf.select("*", F.explode(F.array(*[F.lit(s) for s in scales])).alias("Runs"))
        cf = cf.select(*[c for c in ["ticker", "K", "T", "S0", "method"]], F.col("Runs").cast("int"), "CallPrice", "PutPrice")
        out = cf if out is None else out.unionByName(cf)
    return out


# ---------------------------------------------------------------- registered plans
from .common import rounded  # noqa: E402
from .relational import query  # noqa: E402

# Monte Carlo plans checked against SQL use the md5 stream (identical draws in both engines).
ORACLE_PATHS = 1000     # of each of some 220 horizons (every ticker and T of the chain)
ORACLE_CFG = rs.MCConfig(n_paths=ORACLE_PATHS, seed=42, rng="md5")
# The others draw from the cheaper stream; tests compare them with SQL on a few contracts by the md5 stream.
FAST_CFG = replace(ORACLE_CFG, rng="xxhash")
RESULT_COLS = ["ticker", "K", "T", "S0", "method", "Runs", "CallPrice", "PutPrice"]


def _priced(inp: Inputs, methods: list[str], cfg: rs.MCConfig = ORACLE_CFG, **kw) -> DataFrame:
    return rounded(run_methods(inp, inp.contracts_cp, cfg, methods, **kw).select(*RESULT_COLS))


# Fewer returns are not fitted: the filtered samplers then draw i.i.d. (``fhs_min_obs``).
MIN_FIT = ORACLE_CFG.fhs_min_obs
SHORT = f"fewer than {MIN_FIT} returns"


def return_counts(inp: Inputs) -> DataFrame:
    """(ticker, n, reason): the returns of every ticker with prices, and why it has no GARCH fit (else null)."""
    n = st.return_arrays(inp.returns).select("ticker", "n")
    out = inp.prices.select("ticker").distinct().join(n, "ticker", "left").select("ticker", F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumn("reason", F.when(F.col("n") < MIN_FIT, F.lit(SHORT)))


def with_fallback(inp: Inputs, priced: DataFrame) -> DataFrame:
    """Filtered prices with ``fallback``: why their ticker was resampled i.i.d. instead (else null)."""
    why = return_counts(inp).select(F.col("ticker").alias("hist_ticker"), F.col("reason").alias("fallback"))
    named = inp.contracts.select("ticker", "hist_ticker").distinct().join(why, "hist_ticker", "left").drop("hist_ticker")
    return priced.join(named, "ticker", "left")


for _name, _method in [("boot_iid", "historical"), ("boot_window", "window"), ("boot_window_10", "window_10d"),
                       ("boot_window_20", "window_20d"), ("boot_t_mixture", "student_t"),
                       ("boot_block", "block_bootstrap"), ("boot_filtered", "fhs"), ("boot_filtered_rn", "fhs_rn"),
                       ("boot_cascade", "multifractal_empirical")]:
    def _make(m):
        def plan(inp: Inputs) -> DataFrame:
            out = _priced(inp, [m])  # noqa: B023
            return with_fallback(inp, out) if m in ("fhs", "fhs_rn") else out  # noqa: B023
        plan.__doc__ = f"Prices of every contract by the {m} sampler ({ORACLE_PATHS} paths, md5 stream)."
        return plan
    query(_name)(_make(_method))


def _sampled_and_closed(inp: Inputs) -> DataFrame:
    """Contracts with the sampled (historical) and the closed-form prices and standard errors."""
    from .accuracy import q_bs_price, q_bs_stderr
    keys = ["ticker", "K", "T"]
    mc = _priced(inp, ["historical"]).select(*keys, "S0", F.col("CallPrice").alias("mc_call"), F.col("PutPrice").alias("mc_put"))
    bs = q_bs_price(inp).select(*keys, "r", "bs_call", "bs_put")
    return mc.join(bs, keys).join(q_bs_stderr(inp).select(*keys, "se_call", "se_put"), keys)


@query("mc_vs_bs")
def q_mc_vs_bs(inp: Inputs) -> DataFrame:
    """Sampled against closed-form prices: difference, absolute error in per cent, and whether the
    difference is within two standard errors of the sampled number of paths."""
    from .accuracy import SE_PATHS
    x = _sampled_and_closed(inp)
    grow = F.sqrt(F.lit(float(SE_PATHS))) / F.sqrt(F.lit(float(ORACLE_PATHS)))
    out = ["ticker", "K", "T"]
    for side in ("call", "put"):
        diff = F.col(f"mc_{side}") - F.col(f"bs_{side}")
        out += [diff.alias(f"{side}_diff"),
                F.when(F.col(f"bs_{side}") != 0, F.abs(diff) / F.col(f"bs_{side}") * F.lit(100.0)).alias(f"{side}_err_pct"),
                (F.abs(diff) <= F.lit(2.0) * F.col(f"se_{side}") * grow).alias(f"{side}_within_2se")]
    return rounded(x.select(*out), 6)


@query("put_call_parity_sampled")
def q_parity_sampled(inp: Inputs) -> DataFrame:
    """P5 over sampled prices: call minus put against S0 - K exp(-rT), and the deviation in per cent."""
    x = _sampled_and_closed(inp)
    theory = F.col("S0") - F.col("K") * F.exp(-F.col("r") * F.col("T") / F.lit(252.0))
    x = x.withColumn("theory", theory).withColumn("sampled", F.col("mc_call") - F.col("mc_put"))
    dev = F.abs(F.col("sampled") - F.col("theory")) / F.abs(F.col("theory")) * F.lit(100.0)
    return rounded(x.select("ticker", "K", "T", F.col("theory").alias("parity_theoretical"), F.col("sampled").alias("parity_sampled"),
                            dev.alias("parity_dev_pct"), (dev < F.lit(5.0)).alias("parity_ok")), 6)


@query("run_methods")
def q_run_methods(inp: Inputs) -> DataFrame:
    """All twelve methods for every contract in one plan."""
    return _priced(inp, SIM_METHODS + CLOSED_FORM, FAST_CFG)


@query("mc_error_report")
def q_mc_error_report(inp: Inputs) -> DataFrame:
    """A3q over all twelve methods against the observed mids."""
    quotes = inp.first_quotes
    priced = run_methods(inp, inp.contracts_cp, FAST_CFG, SIM_METHODS + CLOSED_FORM)
    return rounded(ev.error_report(ev.long_errors(ev.comparison(priced, quotes))))


@query("student_t_fit")
def q_student_t_fit(inp: Inputs) -> DataFrame:
    """Student-t maximum likelihood (df, loc, scale) per ticker."""
    f = st.student_t_fit(st.return_arrays(inp.returns))
    return f.select("ticker", round_half_up(F.col("df"), 4).alias("df"), round_half_up(F.col("tloc"), 6).alias("tloc"),
                    round_half_up(F.col("tscale"), 6).alias("tscale"))


@query("garch_fit")
def q_garch_fit(inp: Inputs) -> DataFrame:
    """D3: GARCH(1,1) maximum likelihood per ticker, and whether it converged; without enough returns,
    null parameters and the reason."""
    f = st.garch_fit(st.return_arrays(inp.returns).where(F.col("n") >= MIN_FIT)).drop("n")
    return rounded(return_counts(inp).join(f, "ticker", "left").select("ticker", "n", "omega", "alpha", "beta", "nll", "converged", "reason"), 10)


@query("garch_filter")
def q_garch_filter(inp: Inputs) -> DataFrame:
    """Conditional variance, recentred standardised residual and next-day variance per day; nulls
    and the reason on the days of a ticker without enough returns."""
    f = checkpointed(st.garch_fit(st.return_arrays(inp.returns).where(F.col("n") >= MIN_FIT)))
    short = return_counts(inp).where(F.col("reason").isNotNull()).select("ticker", "reason")
    days = st.clean_returns(inp.returns).select("ticker", "Date").join(short, "ticker")
    days = days.select("ticker", "Date", *[F.lit(None).cast("double").alias(c) for c in ("sigma2", "z", "sigma2_next")], "reason")
    return rounded(st.garch_filter(f, inp.returns).withColumn("reason", F.lit(None).cast("string")).unionByName(days), 10)


@query("garch_filter_start")
def q_garch_filter_start(inp: Inputs) -> DataFrame:
    """D4 at the optimiser's starting parameters (checked against a recursive SQL)."""
    return rounded(st.garch_filter(checkpointed(st.garch_start(st.return_arrays(inp.returns))), inp.returns), 10)


@query("analogue_features")
def q_analogue_features(inp: Inputs) -> DataFrame:
    return rounded(st.analogue_features(inp.returns), 8)


@query("zscore_features")
def q_zscore(inp: Inputs) -> DataFrame:
    return rounded(st.zscore_features(st.analogue_features(inp.returns)).select("ticker", "Date", "z_sum", "z_std"), 8)


@query("knn_analogues")
def q_knn(inp: Inputs) -> DataFrame:
    return rounded(st.knn_analogues(inp.returns), 8)
