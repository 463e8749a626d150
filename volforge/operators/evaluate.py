"""Accuracy, convergence and comparison analytics over priced contracts (J, A*q, E, W4, X2, X6)."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathfn import TRADING_DAYS, round_half_up  # noqa: F401

# Fixed values of the accuracy study.
MAX_COMBOS_PER_TICKER = 30      # (strike, days, type) combos kept per ticker (15 x call/put)
SAMPLE_SEED = 42
MIN_OBSERVED = 0.5              # observed mid must exceed this to count
ATM_BAND = 0.05                 # |K/S0 - 1| <= 5%
CONVERGENCE_PCT = 1.0


# ---------------------------------------------------------------- joins

def map_history_ticker(contracts: DataFrame, hmap: DataFrame) -> DataFrame:
    """Option ticker -> history ticker (default identity). hmap: (option_ticker, hist_ticker)."""
    return (contracts.join(hmap, contracts.ticker == hmap.option_ticker, "left")
                     .withColumn("hist_ticker", F.coalesce(F.col("hist_ticker"), F.col("ticker")))
                     .drop("option_ticker"))


def dedupe_quotes(chain: DataFrame) -> DataFrame:
    """A1q: one row per (ticker, strike, days, type): first value of each column in chain order."""
    keys = ["ticker", "strike", "days_to_expiry", "option_type"]
    rest = [c for c in chain.columns if c not in keys and c != "chain_key"]
    return chain.groupBy(*keys).agg(*[F.min_by(c, F.when(F.col(c).isNotNull(), F.col("chain_key"))).alias(c)
                                      for c in rest], F.min("chain_key").alias("chain_key"))


def first_quotes(chain: DataFrame) -> DataFrame:
    """A1q for the columns that contracts and observed mids are made of: per (ticker, strike, days, type) the
    first quote in chain order, with the least spot. ``distinct_kt`` and ``actual_lookup`` give the same rows
    over it as over the chain, but it has one row per contract and side, whatever the number of quotes."""
    first = F.min(F.struct("chain_key", "mid_price")).alias("_q")
    return (chain.groupBy("ticker", "strike", "days_to_expiry", "option_type").agg(first, F.min("underlying_price").alias("underlying_price"))
                 .select("ticker", "strike", "days_to_expiry", "option_type", "_q.mid_price", "underlying_price", "_q.chain_key"))


def sample_contracts(combos: DataFrame, n: int, seed: int = SAMPLE_SEED) -> DataFrame:
    """At most n combos per ticker, chosen by a seeded hash order (reproducible in any engine).
    ``row_number() <= n`` plans a partial WindowGroupLimit before the shuffle."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("ticker"),
                            F.round(F.col("strike") * 100).cast("bigint").cast("string"),
                            F.col("days_to_expiry").cast("string"), F.col("option_type")))
    w = Window.partitionBy("ticker").orderBy(key, "chain_key")
    return combos.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def distinct_kt(combos: DataFrame) -> DataFrame:
    """A2q: distinct (ticker, K, T) with the ticker's S0."""
    return (combos.groupBy("ticker", F.col("strike").alias("K"), F.col("days_to_expiry").alias("T"))
                  .agg(F.min("underlying_price").alias("S0")))


def accuracy_contracts(chain: DataFrame, per_ticker: int | None = None) -> DataFrame:
    """The (ticker, K, T, S0) grid of the accuracy study: dedupe -> distinct (K, T); with
    ``per_ticker``, of a sample (X2) of that many combos per ticker."""
    if per_ticker is None:      # distinct (K, T) subsumes the dedupe, as one ticker has one S0 a snapshot
        return distinct_kt(chain)
    return distinct_kt(sample_contracts(dedupe_quotes(chain), per_ticker))


def actual_lookup(chain: DataFrame) -> DataFrame:
    """First call mid and first put mid (chain order) per (ticker, K, T); NULL when absent."""
    return chain.groupBy("ticker", F.col("strike").alias("K"), F.col("days_to_expiry").alias("T")).agg(
        F.min_by("mid_price", F.when(F.col("option_type") == "call", F.col("chain_key"))).alias("actual_call"),
        F.min_by("mid_price", F.when(F.col("option_type") == "put", F.col("chain_key"))).alias("actual_put"))


def comparison(priced: DataFrame, chain: DataFrame) -> DataFrame:
    """Priced rows (ticker, K, T, S0, Runs, method, CallPrice, PutPrice) LEFT JOIN observed mids."""
    return (priced.join(actual_lookup(chain), ["ticker", "K", "T"], "left")
                  .select("ticker", "K", "T", "S0", F.col("Runs").alias("num_runs"), "method",
                          F.col("CallPrice").alias("mc_call"), F.col("PutPrice").alias("mc_put"),
                          "actual_call", "actual_put"))


# ---------------------------------------------------------------- errors (E1, E2, A3q..A6q, E3, E4)

def long_errors(cmp: DataFrame) -> DataFrame:
    """E1 + E2 for calls and puts stacked: (…, option_type, mc, actual, error, pct_error)."""
    def side(t: str) -> DataFrame:
        a, m = F.col(f"actual_{t}"), F.col(f"mc_{t}")
        return (cmp.where(a.isNotNull() & (a > MIN_OBSERVED))
                   .select("ticker", "K", "T", "S0", "num_runs", "method", F.lit(t).alias("option_type"),
                           m.alias("mc"), a.alias("actual"), (m - a).alias("error"),
                           ((m - a) / a * F.lit(100.0)).alias("pct_error")))
    return side("call").unionByName(side("put"))


BRACKET = 0.001         # half width, in ranks, of the bracket the median is looked for in
BRACKET_MIN_ROWS = 100_000


def with_exact_median(df: DataFrame, keys: list[str], value: str, name: str, *aggs) -> DataFrame:
    """``aggs`` and the exact median per group (mean of the two middle values; nulls left out), for
    groups of any size.

    The first pass brackets the middle by two approximate quantiles, ten times further apart than
    their guaranteed rank error; the second counts what lies below the bracket and the distinct
    values in it, with map-side combine, and only those counts are ordered per group. A group of few
    rows is its own bracket."""
    v = F.col(value)
    quantiles = F.percentile_approx(v, F.array(F.lit(0.5 - BRACKET), F.lit(0.5 + BRACKET)), 10_000)
    b = df.groupBy(*keys).agg(*aggs, F.count(v).alias("_n"), F.min(v).alias("_min"), F.max(v).alias("_max"), quantiles.alias("_q"))
    large = F.col("_n") >= BRACKET_MIN_ROWS
    b = b.select("*", F.when(large, F.col("_q")[0]).otherwise(F.col("_min")).alias("_lo"),
                 F.when(large, F.col("_q")[1]).otherwise(F.col("_max")).alias("_hi")).drop("_min", "_max", "_q")
    side = F.when(F.col("_v") < F.col("_lo"), -1).when(F.col("_v") > F.col("_hi"), 1).otherwise(0)
    per_group = [c for c in b.columns if c not in ("_lo", "_hi")]
    c = (df.select(*keys, v.alias("_v")).join(b, keys).select(*per_group, side.alias("_side"), "_v")
           .groupBy(*per_group, "_side", F.when(F.col("_side") == 0, F.col("_v")).alias("_mid"))
           .agg(F.count("_v").alias("_c")))
    upto = Window.partitionBy(*keys).orderBy("_side", "_mid").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("_upto", F.sum("_c").over(upto))
    mid = [F.min(F.when(F.col("_upto") >= rank, F.col("_mid"))) for rank in
           (F.floor((F.col("_n") + 1) / 2), F.floor(F.col("_n") / 2) + 1)]
    return c.groupBy(*per_group).agg(((mid[0] + mid[1]) / F.lit(2.0)).alias(name)).drop("_n")


def error_report(errors: DataFrame) -> DataFrame:
    """A3q: per (option type, method): n, MAE, MAPE, median signed % error."""
    return with_exact_median(errors, ["option_type", "method"], "pct_error", "median_pct_error",
                             F.count(F.lit(1)).alias("n"), F.avg(F.abs("error")).alias("mae"),
                             F.avg(F.abs("pct_error")).alias("mape"))


def best_method(report: DataFrame) -> DataFrame:
    """A4q: argmin MAPE per option type; ties (to six places) broken by method name."""
    return report.groupBy("option_type").agg(
        F.min_by("method", F.struct(round_half_up(F.col("mape"), 6).alias("mape"), F.col("method"))).alias("best_method"),
        F.min("mape").alias("best_mape"))


def atm_filter(errors: DataFrame, band: float = ATM_BAND) -> DataFrame:
    """|K/S0 - 1| <= band."""
    return errors.where(F.abs(F.col("K") / F.col("S0") - F.lit(1.0)) <= F.lit(band))


def atm_report(errors: DataFrame) -> DataFrame:
    """ATM error report + best ATM method and its MAPE improvement over the all-strike best."""
    best_all = best_method(mape_by_method(errors)).select(
        "option_type", F.col("best_method").alias("best_all"), F.col("best_mape").alias("best_mape_all"))
    of_type = Window.partitionBy("option_type")          # over the report's rows, one per method
    first = F.min(F.struct(round_half_up(F.col("mape"), 6).alias("mape"), F.col("method"))).over(of_type)
    atm = (error_report(atm_filter(errors)).withColumn("best_atm", first["method"])
           .withColumn("best_mape_atm", F.min("mape").over(of_type)))
    return (atm.join(best_all, "option_type", "left")
               .withColumn("improvement", F.col("best_mape_all") - F.col("best_mape_atm")))


def mape_by_scale(errors: DataFrame) -> DataFrame:
    """A5q: mean abs % error by (option type, method, num_runs)."""
    return errors.groupBy("option_type", "method", "num_runs").agg(F.avg(F.abs("pct_error")).alias("mape"))


def mape_by_method(errors: DataFrame) -> DataFrame:
    """A6q: mean abs % error by (option type, method)."""
    return errors.groupBy("option_type", "method").agg(F.avg(F.abs("pct_error")).alias("mape"))


def highest_scale(df: DataFrame, col: str = "num_runs", top: int | None = None) -> DataFrame:
    """Rows at the maximum scale: ``top`` where the caller knows it, else looked up by a one-row
    aggregate over ``df`` (which then should be materialised)."""
    if top is not None:
        return df.where(F.col(col) == F.lit(top))
    mx = df.agg(F.max(col).alias("_mx"))
    return df.join(mx, F.col(col) == F.col("_mx"), "left_semi")


# ---------------------------------------------------------------- convergence (W4, E9, A11q, A9q, A10q, E8)

def convergence(prices: DataFrame, threshold: float = CONVERGENCE_PCT, by: tuple[str, ...] = ()) -> DataFrame:
    """Prices (alt_weight, runs, method, CallPrice, PutPrice) -> transitions between successive
    scales per (alt_weight, method). Price = Call unless it is exactly 0, then Put; the converged
    flag is computed before rounding. Here and below, ``by`` names the contract's columns where the
    prices are of several contracts: each is then reported on its own."""
    w = Window.partitionBy(*by, "alt_weight", "method").orderBy("runs")
    px = F.when(F.col("CallPrice") > 0, F.col("CallPrice")).otherwise(F.col("PutPrice"))
    d = (prices.withColumn("curr_price", px)
               .withColumn("prev_price", F.lag("curr_price").over(w))
               .withColumn("from_runs", F.lag("runs").over(w))
               .where(F.col("from_runs").isNotNull()))
    pct = (F.when((F.col("prev_price") == 0) & (F.col("curr_price") == 0), F.lit(0.0))
             .when(F.col("prev_price") == 0, F.lit(100.0))
             .otherwise(F.abs((F.col("curr_price") - F.col("prev_price")) / F.col("prev_price")) * F.lit(100.0)))
    d = d.withColumn("pct_change", pct)
    return d.select(*by, "alt_weight", "method", F.col("from_runs").cast("int").alias("from_runs"),
                    F.col("runs").cast("int").alias("to_runs"),
                    round_half_up(F.col("prev_price"), 4).alias("prev_price"),
                    round_half_up(F.col("curr_price"), 4).alias("curr_price"),
                    round_half_up(F.col("pct_change"), 4).alias("pct_change"),
                    (F.col("pct_change") <= F.lit(threshold)).alias("converged"))


def transition_report(conv: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """PASS/FAIL per (alt_weight, method) at the last transition."""
    last = F.max("to_runs").over(Window.partitionBy(*by, "alt_weight"))        # a row per method and scale
    return (conv.withColumn("_last", last).where(F.col("to_runs") == F.col("_last")).drop("_last")
                .withColumn("verdict", F.when(F.col("converged"), F.lit("PASS")).otherwise(F.lit("FAIL"))))


def weight_summary(conv: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """A11q: per weight at the last transition: #converged, total, best method, min pct_change, all-pass."""
    last = transition_report(conv, by)
    return last.groupBy(*by, "alt_weight").agg(
        F.sum(F.col("converged").cast("int")).cast("bigint").alias("n_converged"),
        F.count(F.lit(1)).alias("n_methods"),
        F.min_by("method", F.struct("pct_change", "method")).alias("best_method"),
        F.min("pct_change").alias("min_pct_change"),
        F.bool_and("converged").alias("all_converged"))


def bs_consistency(prices: DataFrame, by: tuple[str, ...] = (), top: int | None = None) -> DataFrame:
    """A9q: mean and sample std of the black_scholes price across weights (at the top scale);
    consistent when std < 1.0."""
    bs = highest_scale(prices.where(F.col("method") == "black_scholes"), "runs", top)
    return bs.groupBy(*by).agg(F.avg("CallPrice").alias("mean_call"), F.stddev_samp("CallPrice").alias("std_call"),
                  F.avg("PutPrice").alias("mean_put"), F.stddev_samp("PutPrice").alias("std_put")) \
             .withColumn("consistent", F.coalesce(F.col("std_call"), F.lit(0.0)) < F.lit(1.0))


def spread_vs_bs(prices: DataFrame, by: tuple[str, ...] = (), top: int | None = None) -> DataFrame:
    """A10q at the top scale: the call price of each weight and method, the method's average over the
    weights, and its % difference from the black_scholes average (0 when that is <= 0)."""
    rows = highest_scale(prices, "runs", top)
    of_method, of_contract = Window.partitionBy(*by, "method"), Window.partitionBy(*by)
    bs_avg = F.avg(F.when(F.col("method") == "black_scholes", F.col("CallPrice"))).over(of_contract)
    rows = rows.select(*by, "alt_weight", "method", "CallPrice", F.avg("CallPrice").over(of_method).alias("avg_call"), bs_avg.alias("_bs"))
    pct = F.when(F.col("_bs") > 0, (F.col("avg_call") - F.col("_bs")) / F.col("_bs") * F.lit(100.0)).otherwise(F.lit(0.0))
    return rows.select(*by, "alt_weight", "method", F.col("CallPrice").alias("call"), "avg_call", pct.alias("pct_vs_bs"))


def premium_over_bs(prices: DataFrame, analytic_call: DataFrame, by: tuple[str, ...] = (), top: int | None = None) -> DataFrame:
    """(avg call - BS analytical) / BS * 100 by method; analytic_call: one row a contract (bs_call)."""
    rows = highest_scale(prices, "runs", top)
    avg_m = rows.groupBy(*by, "method").agg(F.avg("CallPrice").alias("avg_call"))
    return ((avg_m.join(analytic_call, list(by)) if by else avg_m.crossJoin(analytic_call))
               .withColumn("premium_pct", (F.col("avg_call") - F.col("bs_call")) / F.col("bs_call") * F.lit(100.0)))


def emc_pre_post(pre: DataFrame, post: DataFrame) -> DataFrame:
    """Outer-aligned pre/post MAPE by (option type, method), deltas, rounded to 2."""
    a = pre.select("option_type", "method", F.col("mape").alias("mape_pre"))
    b = post.select("option_type", "method", F.col("mape").alias("mape_post"))
    return (a.join(b, ["option_type", "method"], "full_outer")
             .select("option_type", "method", round_half_up(F.col("mape_pre"), 2).alias("mape_pre"),
                     round_half_up(F.col("mape_post"), 2).alias("mape_post"),
                     round_half_up(F.col("mape_post") - F.col("mape_pre"), 2).alias("delta")))
