"""Closed-form pricing, standard errors, parity, payoffs, EMC, discounting and the method registry."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.mathfn import TRADING_DAYS, norm_cdf, norm_cdf_col

DEFAULT_RATE = 0.045
RATE_TICKER = "^IRX"

# The twelve pricing methods, their family, and whether the method prices under the
# risk-neutral measure (discounted) and takes the empirical martingale correction by default.
METHODS = [
    ("historical", "iid", False, False),
    ("window", "window", False, False),
    ("window_10d", "window", False, False),
    ("window_20d", "window", False, False),
    ("student_t", "t_mixture", False, False),
    ("black_scholes", "closed_form", True, False),
    ("multifractal", "closed_form", True, False),
    ("multifractal_empirical", "cascade", True, False),
    ("block_bootstrap", "block", False, False),
    ("fhs", "filtered", False, False),
    ("fhs_rn", "filtered", True, True),
    ("analogue", "analogue", False, False),
]
WINDOW_STRIDE = {"window": 1, "window_10d": 10, "window_20d": 20}


def method_registry(spark: SparkSession) -> DataFrame:
    """(method, family, risk_neutral, emc) — 12 literal rows, safe to broadcast."""
    return spark.createDataFrame(METHODS, "method string, family string, risk_neutral boolean, emc boolean")


def risk_free_rate(prices: DataFrame, default: float = DEFAULT_RATE) -> DataFrame:
    """Latest close of the rate series / 100, else the default. One row."""
    return (prices.where(F.col("ticker") == RATE_TICKER)
                  .agg(F.max_by("Close", "Date").alias("_c"))
                  .select(F.coalesce(F.col("_c") / F.lit(100.0), F.lit(default)).alias("r")))


def _years(T: Column) -> Column:
    return T.cast("double") / F.lit(TRADING_DAYS)


def with_d(df: DataFrame, S0="S0", K="K", T="T", r="r", vol="vol") -> DataFrame:
    """Stage 1 of P2: tau, sigma*sqrt(tau), d1, d2, discount as plain columns. Later stages refer to
    these columns, so Catalyst keeps one projection per stage instead of inlining d1 into every
    normal-CDF term."""
    tau = _years(F.col(T))
    out = (df.withColumn("_tau", tau)
             .withColumn("_sq", F.col(vol) * F.sqrt(F.col("_tau"))))
    out = out.withColumn("d1", (F.log(F.col(S0) / F.col(K)) + (F.col(r) + F.lit(0.5) * F.col(vol) * F.col(vol))
                                * F.col("_tau")) / F.col("_sq"))
    return (out.withColumn("d2", F.col("d1") - F.col("_sq"))
               .withColumn("_disc", F.exp(-F.col(r) * F.col("_tau"))))


def bs_price(df: DataFrame, S0="S0", K="K", T="T", r="r", vol="vol") -> DataFrame:
    """P2 over a whole contract table: adds d1, d2, bs_call, bs_put (T in trading days)."""
    out = with_d(df, S0, K, T, r, vol)
    out = out.select("*", norm_cdf_col("d1").alias("_n1"), norm_cdf_col("d2").alias("_n2"),
                     norm_cdf_col("d1", True).alias("_m1"), norm_cdf_col("d2", True).alias("_m2"))
    out = (out.withColumn("bs_call", F.col(S0) * F.col("_n1") - F.col(K) * F.col("_disc") * F.col("_n2"))
              .withColumn("bs_put", F.col(K) * F.col("_disc") * F.col("_m2") - F.col(S0) * F.col("_m1")))
    return out.drop("_n1", "_n2", "_m1", "_m2")


def bs_stderr(df: DataFrame, n_paths: Column | int, S0="S0", K="K", T="T", r="r", vol="vol") -> DataFrame:
    """Standard error of the discounted-payoff mean. The call second moment is the reference's
    formula; the put uses its own second moment E[(K-S)+^2] (N6); ``var_put_ref`` keeps the
    reference's var_put = var_call."""
    b = bs_price(df, S0, K, T, r, vol)
    b = b.withColumn("_d1p", F.col("d1") + F.col("_sq"))
    b = b.select("*", norm_cdf_col("_d1p").alias("_np"), norm_cdf_col("d1").alias("_n1"),
                 norm_cdf_col("d2").alias("_n2"), norm_cdf_col("d2", True).alias("_m2"),
                 norm_cdf_col("d1", True).alias("_m1"), norm_cdf_col("_d1p", True).alias("_mp"),
                 F.exp((F.lit(2.0) * F.col(r) + F.col(vol) * F.col(vol)) * F.col("_tau")).alias("_grow"),
                 F.exp(F.col(r) * F.col("_tau")).alias("_fwd"))
    S0c, Kc = F.col(S0), F.col(K)
    e2_call = S0c * S0c * F.col("_grow") * F.col("_np") - F.lit(2.0) * Kc * S0c * F.col("_fwd") * F.col("_n1") \
        + Kc * Kc * F.col("_n2")
    e2_put = Kc * Kc * F.col("_m2") - F.lit(2.0) * Kc * S0c * F.col("_fwd") * F.col("_m1") \
        + S0c * S0c * F.col("_grow") * F.col("_mp")
    n = (F.lit(n_paths) if isinstance(n_paths, int) else n_paths).cast("double")
    disc2 = F.col("_disc") * F.col("_disc")
    out = (b.withColumn("var_call", disc2 * e2_call - F.col("bs_call") * F.col("bs_call"))
            .withColumn("var_put", disc2 * e2_put - F.col("bs_put") * F.col("bs_put")))
    return (out.withColumn("var_put_ref", F.col("var_call"))
               .withColumn("se_call", F.sqrt(F.greatest(F.col("var_call"), F.lit(0.0))) / F.sqrt(n))
               .withColumn("se_put", F.sqrt(F.greatest(F.col("var_put"), F.lit(0.0))) / F.sqrt(n))
               .drop("_np", "_n1", "_n2", "_m1", "_m2", "_mp", "_grow", "_fwd", "_d1p"))


def parity_columns(S0: Column, K: Column, T: Column, r: Column, call: Column, put: Column) -> dict[str, Column]:
    """P5: S0 - K e^{-rT} against C - P; deviation % and pass (< 5%)."""
    theo = S0 - K * F.exp(-r * _years(T))
    dev = F.abs((call - put) - theo) / F.abs(theo) * F.lit(100.0)
    return {"parity_theoretical": theo, "parity_sampled": call - put,
            "parity_dev_pct": dev, "parity_ok": dev < F.lit(5.0)}


def discount_factor(r: Column, T: Column) -> Column:
    """e^{-rT/252}."""
    return F.exp(-r * _years(T))


def closed_form_prices(contracts: DataFrame, stats: DataFrame, rate: DataFrame,
                       methods: tuple[str, ...] = ("black_scholes", "multifractal")) -> DataFrame:
    """Closed-form rows in the pricing-result layout for the Gaussian-terminal methods
    (black_scholes, and multifractal whose horizon law is the same lognormal).
    contracts: (ticker, hist_ticker, K, T, S0); stats: (ticker, vol); rate: one row (r). Without
    volatility d1 is undefined, and the price is the limit: that of growth at the rate."""
    st = stats.select(F.col("ticker").alias("hist_ticker"), F.nullif("vol", F.lit(0.0)).alias("vol"))
    base = contracts.join(st, "hist_ticker").crossJoin(rate)   # rate: a one-row aggregate
    ahead = F.col("S0") - F.col("K") * F.col("_disc")

    def price(formula: str, limit: Column) -> Column:
        return F.when(F.col("vol").isNull(), F.greatest(limit, F.lit(0.0))).otherwise(F.col(formula))
    priced = bs_price(base).select("ticker", "K", "T", "S0", price("bs_call", ahead).alias("CallPrice"),
                                   price("bs_put", -ahead).alias("PutPrice"))
    m = F.explode(F.array(*[F.lit(x) for x in methods])).alias("method")
    return priced.select("*", m)
