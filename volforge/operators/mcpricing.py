"""From simulated growth to option prices (P6..P11, P13): empirical martingale correction, payoffs,
mean per contract and method, discounting.

The strikes of a horizon form a ladder: as multiples of the spot price, sorted, they cut the axis of
growth into intervals. A path adds its count and its distances to the two ends of its interval, with
map-side sums; running sums along the ladder then give the call and the put of every strike. There are no
rows of a path and a strike, so the cost does not grow with the number of strikes."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathfn import TRADING_DAYS
from .growth import GROWTH_KEYS, martingale_factor, prefix_means, scale_index
from .joins import checked_broadcast

RESULT_KEYS = ["ticker", "K", "T", "S0", "method"]
_RUNG = [*GROWTH_KEYS, "scale"]


def strike_ladder(contracts: DataFrame) -> DataFrame:
    """(hist_ticker, T, cuts): the strikes of each horizon as growth K / S0, sorted, each once."""
    return contracts.groupBy("hist_ticker", "T").agg(F.sort_array(F.collect_set(F.col("K") / F.col("S0"))).alias("cuts"))


def _cut(i):
    """The i-th cut (from 1) of a ladder; null below the first and above the last."""
    return F.get("cuts", i - F.lit(1))


def interval_sums(paths: DataFrame, ladder: DataFrame, methods: list[str], n_scales: int) -> DataFrame:
    """(hist_ticker, T, method, scale, i, n, over, under, low, high) for every interval of every ladder,
    method and scale: paths with growth in (cut i, cut i+1], and the sums of their distances to the two
    ends. ``paths``: (hist_ticker, T, method, scale, g)."""
    most = ladder.agg(F.max(F.size("cuts"))).first()[0] or 0
    at = paths.join(checked_broadcast(ladder, row_bytes=96, array_cols=("cuts",)), ["hist_ticker", "T"]).withColumn("i", F.lit(0))
    for bit in reversed(range(int(most).bit_length())):          # how many cuts lie below g, by halving
        at = at.withColumn("i", F.col("i") + F.when(F.get("cuts", F.col("i") + F.lit((1 << bit) - 1)) < F.col("g"), F.lit(1 << bit)).otherwise(F.lit(0)))
    none = F.lit(None).cast("double")
    at = at.select(*_RUNG, "i", F.lit(1).cast("long").alias("n"), (F.col("g") - _cut(F.col("i"))).alias("over"),
                   (_cut(F.col("i") + F.lit(1)) - F.col("g")).alias("under"), none.alias("low"), none.alias("high"))
    rungs = ladder.select("hist_ticker", "T", "cuts", F.explode(F.array(*map(F.lit, methods))).alias("method"))
    rungs = rungs.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_scales - 1))).alias("scale"))
    rungs = rungs.select("*", F.explode(F.sequence(F.lit(0), F.size("cuts"))).alias("i"))
    rungs = rungs.select(*_RUNG, "i", F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("over"), F.lit(0.0).alias("under"),
                         _cut(F.col("i")).alias("low"), _cut(F.col("i") + F.lit(1)).alias("high"))
    return at.unionByName(rungs).groupBy(*_RUNG, "i").agg(F.sum("n").alias("n"), F.sum("over").alias("over"), F.sum("under").alias("under"),
                                                          F.max("low").alias("low"), F.max("high").alias("high"))


def payoff_sums(sums: DataFrame) -> DataFrame:
    """(hist_ticker, T, method, scale, p, n, call, put): over all paths, the sum of max(g - cut p, 0) and of
    max(cut p - g, 0). All terms of the running sums are positive, so nothing cancels."""
    up = Window.partitionBy(*_RUNG).orderBy("i")
    below = up.rowsBetween(Window.unboundedPreceding, -1)
    above = Window.partitionBy(*_RUNG).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.coalesce(F.col("high") - F.col("low"), F.lit(0.0))
    x = sums.withColumn("n_below", F.coalesce(F.sum("n").over(below), F.lit(0)))
    x = x.withColumn("total", F.sum("n").over(Window.partitionBy(*_RUNG)))
    x = x.withColumn("add_call", F.coalesce("over", F.lit(0.0)) + step * (F.col("total") - F.col("n_below") - F.col("n")))
    x = x.withColumn("add_put", F.coalesce("under", F.lit(0.0)) + step * F.col("n_below"))
    x = x.select(*_RUNG, F.col("i").alias("p"), F.col("total").alias("n"), F.sum("add_call").over(above).alias("call"),
                 F.sum("add_put").over(below).alias("put"))
    return x.where("p > 0")


def price_growth(table: DataFrame, contracts: DataFrame, rate: DataFrame, methods: list[str], risk_neutral: set[str],
                 emc: set[str], scales: list[int], exact: set[str] = frozenset()) -> DataFrame:
    """The growth table x contracts (ticker, hist_ticker, K, T, S0) -> (ticker, K, T, S0, method, Runs,
    CallPrice, PutPrice) for every scale in ``scales``. ``methods``: those in the table.

    Order of operations (N11): clip -> growth -> EMC -> payoff -> mean -> discount. A path counts in every
    scale that includes it: sums are taken between two scales and then run up. EMC methods, whose growth is
    corrected by a factor of the scale, are expanded to the scales that contain them instead. Methods in
    ``exact`` (all-start window sums) are scale-free: the full set is priced once and reported at every
    scale."""
    scales = sorted(scales)
    last = len(scales) - 1
    # the one rate table row is attached to small tables only
    rung = ["hist_ticker", "T", "method", "scale", "g"]
    kinds = {"whole": [m for m in methods if m in exact], "corrected": [m for m in methods if m in emc and m not in exact]}
    kinds["running"] = [m for m in methods if m not in exact and m not in emc]
    parts = []

    def rungs(paths: DataFrame, kind: str, n_scales: int) -> DataFrame:
        return interval_sums(paths.select(*rung), ladder, kinds[kind], n_scales)

    ladder = strike_ladder(contracts)

    def factors(of: DataFrame, at: list[int]) -> DataFrame:
        f = prefix_means(of, at).crossJoin(rate)                                        # rate: one row
        return f.select(*GROWTH_KEYS, "scale", martingale_factor(F.col("mean_growth"), F.col("r"), F.col("T")).alias("f"))

    if kinds["whole"]:
        w = table.where(F.col("method").isin(kinds["whole"])).withColumn("scale", F.lit(0))
        if set(kinds["whole"]) & set(emc):
            f = factors(w.where(F.col("method").isin(*emc)), [1 << 62])
            w = w.join(checked_broadcast(f), [*GROWTH_KEYS, "scale"], "left").withColumn("g", F.col("g") * F.coalesce("f", F.lit(1.0)))
        out = payoff_sums(rungs(w, "whole", 1))
        parts.append(out.withColumn("scale", F.explode(F.sequence(F.lit(0), F.lit(last)))))
    if kinds["corrected"]:
        c = table.where(F.col("method").isin(kinds["corrected"]))
        f = factors(c, scales)
        first = scale_index(F.col("path_id"), scales)
        c = c.withColumn("first", first).where(F.col("first").isNotNull())
        c = c.withColumn("scale", F.explode(F.sequence(F.col("first"), F.lit(last))))
        c = c.join(checked_broadcast(f), [*GROWTH_KEYS, "scale"]).withColumn("g", F.col("g") * F.col("f"))
        parts.append(payoff_sums(rungs(c, "corrected", len(scales))))
    if kinds["running"]:
        o = table.where(F.col("method").isin(kinds["running"])).withColumn("scale", scale_index(F.col("path_id"), scales))
        sums = rungs(o.where(F.col("scale").isNotNull()), "running", len(scales))
        if last:
            upto = Window.partitionBy(*GROWTH_KEYS, "i").orderBy("scale").rowsBetween(Window.unboundedPreceding, Window.currentRow)
            sums = sums.select(*_RUNG, "i", *[F.sum(c).over(upto).alias(c) for c in ("n", "over", "under")], "low", "high")
        parts.append(payoff_sums(sums))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)

    place = contracts.join(ladder, ["hist_ticker", "T"]).crossJoin(rate).select(                # rate: one row
        "ticker", "hist_ticker", "K", "T", "S0", "r", F.array_position("cuts", F.col("K") / F.col("S0")).cast("int").alias("p"))
    out = out.join(place, ["hist_ticker", "T", "p"])
    disc = F.when(F.col("method").isin(*risk_neutral),
                  F.exp(-F.col("r") * F.col("T").cast("double") / F.lit(TRADING_DAYS))).otherwise(F.lit(1.0)) \
        if risk_neutral else F.lit(1.0)
    runs = F.element_at(F.array(*map(F.lit, scales)), F.col("scale") + F.lit(1)).cast("int")
    return out.select(*RESULT_KEYS, runs.alias("Runs"), (F.col("S0") * F.col("call") / F.col("n") * disc).alias("CallPrice"),
                      (F.col("S0") * F.col("put") / F.col("n") * disc).alias("PutPrice"))
