"""Resampling path generators (R1..R10) re-aimed from driver-side samplers to Spark jobs.

Every generator takes the small per-ticker *series state* (return array, fits, residual pools;
one row per history ticker) and the *path table* (one row per (history ticker, horizon T,
method, path id)) and returns ``(hist_ticker, T, method, path_id, log_sum)``.

Paths are rows: the path table is built from (ticker, T, chunk) task rows, spread over the
cluster and exploded into path ids, so one (ticker, T) with millions of paths never sits in one
task. Stateless samplers explode the T steps into rows (whole-stage codegen) and sum per path
with a partial aggregate (the block bootstrap after a running window over them); the filtered
simulation folds its steps with ``aggregate``. Draws come from keyed hash streams (functions.rng), so a path's value
does not depend on partitioning, task order or recomputation after executor loss.
"""
from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.mathfn import TRADING_DAYS
from ..functions.rng import Stream
from ..session import cpu_partitions

PATH_KEYS = ["hist_ticker", "T", "method", "path_id"]
TASKS_PER_CORE = 6      # horizons differ in length: several tasks a core even them out


def _path_keys(df: DataFrame) -> list[str]:
    """The keys to group a path's steps by. With the task's ``_chunk`` among them the grouping finds
    its rows where the path table put them, and needs no exchange of its own."""
    return [*PATH_KEYS, "_chunk"] if "_chunk" in df.columns else PATH_KEYS


@dataclass(frozen=True)
class MCConfig:
    n_paths: int = 2000
    seed: int = 42
    rng: str = "md5"
    chunk: int = 4096
    alt_weight: float = 0.1
    block_len: float = 5.0
    lam: float = 0.4
    cascade_levels: int | None = None
    k_neighbors: int = 20
    window: int = 5
    fhs_min_obs: int = 30

    @property
    def stream(self) -> Stream:
        return Stream(self.seed, self.rng)


def path_table(horizons: DataFrame, methods: list[str], n_paths: int, chunk: int = 4096) -> DataFrame:
    """(hist_ticker, T, method, _chunk, path_id) for path ids 0..n_paths-1 of every horizon and method.
    Task rows (horizon, method, chunk) are tiny; they are spread with an explicit partition count
    (so AQE does not coalesce them by bytes) before each is exploded into at most ``chunk`` paths."""
    n_chunks = max(1, math.ceil(n_paths / chunk))
    tasks = horizons.select("hist_ticker", "T").distinct().select(
        "hist_ticker", "T",
        F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"),
        F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))).alias("_chunk"))
    tasks = tasks.repartition(cpu_partitions(horizons.sparkSession, TASKS_PER_CORE), "hist_ticker", "T", "method", "_chunk")
    lo = F.col("_chunk") * F.lit(chunk)
    hi = F.least(lo + F.lit(chunk), F.lit(n_paths)) - F.lit(1)
    return tasks.select("hist_ticker", "T", "method", "_chunk",
                        F.explode(F.sequence(lo.cast("bigint"), hi.cast("bigint"))).alias("path_id"))


def _with_state(paths: DataFrame, state: DataFrame, cols: list[str]) -> DataFrame:
    """Attach per-ticker state to path rows. ``state`` must be the size-checked broadcast form
    (see plans.montecarlo.series_state); the join is then a map-side hash lookup."""
    return paths.join(state.select("hist_ticker", *cols), "hist_ticker")


def long_values(state: DataFrame, array_col: str, value: str = "v") -> DataFrame:
    """(hist_ticker, idx, v): an array column of the per-ticker state as rows, 1-based idx. The
    samplers look values up with an equi-join on (hist_ticker, idx) against this table, which
    the caller broadcasts behind a size check — path rows never carry whole arrays."""
    return state.select("hist_ticker", F.posexplode(array_col).alias("_p", value)) \
                .select("hist_ticker", (F.col("_p") + F.lit(1)).alias("idx"), value)


def _lookup(steps: DataFrame, table: DataFrame, idx: Column, value: str = "v") -> DataFrame:
    return steps.withColumn("idx", idx).join(table.withColumnRenamed("v", value), ["hist_ticker", "idx"])


def _pkey(cfg: MCConfig, tag: str) -> Column:
    return cfg.stream.path_key(tag, F.col("hist_ticker"), F.col("T"), F.col("path_id"))


def _steps(df: DataFrame) -> DataFrame:
    return df.select("*", F.explode(F.sequence(F.lit(0), F.col("T") - F.lit(1))).alias("j"))


def _sum_per_path(steps: DataFrame, x: Column) -> DataFrame:
    keys = _path_keys(steps)
    return steps.select(*keys, x.alias("_x")).groupBy(*keys).agg(F.sum("_x").alias("log_sum")).select(*PATH_KEYS, "log_sum")


def boot_iid(paths: DataFrame, state: DataFrame, cfg: MCConfig, tag: str = "iid",
             rets: DataFrame | None = None) -> DataFrame:
    """T draws with replacement from the ticker's returns, summed. ``rets`` is the
    (hist_ticker, idx, v) lookup table (see long_values)."""
    rets = rets if rets is not None else long_values(state, "returns")
    s = _steps(_with_state(paths, state, ["n"]).withColumn("_k", _pkey(cfg, tag)))
    s = _lookup(s, rets, cfg.stream.u_index(F.col("n"), F.col("_k"), F.col("j")))
    return _sum_per_path(s, F.col("v"))


def boot_window(paths: DataFrame, state: DataFrame, stride: int, rets: DataFrame | None = None) -> DataFrame:
    """R2..R4, exact form: every start s in [0, n) is one path; path s sums returns at
    (s + j*stride) mod n, j < T. The mean over all starts is the limit of the random-start
    estimator, so no randomness is needed. ``paths`` carries path_id = start (see window_paths)."""
    rets = rets if rets is not None else long_values(state, "returns")
    s = _steps(_with_state(paths, state, ["n"]))
    idx = F.pmod(F.col("path_id") + F.col("j") * F.lit(stride), F.col("n")) + F.lit(1)
    return _sum_per_path(_lookup(s, rets, F.coalesce(idx.cast("int"), F.lit(0))), F.col("v"))


def window_paths(horizons: DataFrame, state: DataFrame, methods: list[str], chunk: int = 4096) -> DataFrame:
    """Path table of the exact window methods: path_id = start in [0, n) of the history ticker."""
    h = horizons.select("hist_ticker", "T").distinct().join(state.select("hist_ticker", "n"), "hist_ticker")
    tasks = h.select("hist_ticker", "T", "n", F.explode(F.array(*[F.lit(m) for m in methods])).alias("method"),
                     F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / chunk).cast("int"))).alias("_chunk"))
    tasks = tasks.repartition(cpu_partitions(horizons.sparkSession, TASKS_PER_CORE), "hist_ticker", "T", "method", "_chunk")
    lo = F.col("_chunk").cast("bigint") * F.lit(chunk)
    hi = F.least(lo + F.lit(chunk), F.col("n").cast("bigint")) - F.lit(1)
    return tasks.select("hist_ticker", "T", "method", "_chunk", F.explode(F.sequence(lo, hi)).alias("path_id"))


def boot_t_mixture(paths: DataFrame, state: DataFrame, cfg: MCConfig, tag: str = "tmix",
                   rets: DataFrame | None = None) -> DataFrame:
    """Each step is, with probability alt_weight, a Student-t(df, loc, scale) draw (fitted per
    ticker, D2), else a historical draw."""
    rets = rets if rets is not None else long_values(state, "returns")
    s = _steps(_with_state(paths, state, ["n", "t_df", "t_loc", "t_scale"]).withColumn("_k", _pkey(cfg, tag)))
    st = cfg.stream
    k, j = F.col("_k"), F.col("j")
    s = _lookup(s, rets, st.u_index(F.col("n"), k, j, "h"))
    t = F.col("t_loc") + F.col("t_scale") * st.u_student_t(F.col("t_df"), k, j)
    x = F.when(st.u(k, j, "m") < F.lit(cfg.alt_weight), t).otherwise(F.col("v"))
    return _sum_per_path(s, x)


def _block_index(cfg: MCConfig, length: float, steps: Window) -> Column:
    """The 1-based index of each step's return: that of the last step at which a block began (step 0, and
    then with probability 1 / length), plus the steps since, wrapping. Draws do not depend on the length."""
    st = cfg.stream
    k, j, n = F.col("_k"), F.col("j"), F.col("n")
    if length <= 1.0:
        return st.u_index(n, k, j)
    begins = (j == 0) | (F.col("_b") < F.lit(1.0 / length))
    last = F.last(F.when(begins, F.struct(j.alias("j"), F.col("_s").alias("s"))), ignorenulls=True).over(steps)
    return F.coalesce((F.pmod(last["s"] + j - last["j"], n) + F.lit(1)).cast("int"), F.lit(0))


def _block_steps(paths: DataFrame, state: DataFrame, cfg: MCConfig, tag: str) -> tuple[DataFrame, Window]:
    x = _steps(_with_state(paths, state, ["n"]).withColumn("_k", _pkey(cfg, tag)))
    st, k, j = cfg.stream, F.col("_k"), F.col("j")
    x = x.withColumn("_b", st.u(k, j, "b")).withColumn("_s", F.floor(st.u(k, j, "s") * F.col("n")).cast("int"))
    return x, Window.partitionBy(*_path_keys(x)).orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)


def boot_block(paths: DataFrame, state: DataFrame, cfg: MCConfig, tag: str = "blk",
               rets: DataFrame | None = None) -> DataFrame:
    """Stationary bootstrap — a new block (uniform start) at step 0 and then with probability
    1/L, otherwise the previous index + 1 (wrapping). L <= 1 is i.i.d. resampling. The steps of a path
    are rows in one partition already; a running last block start gives the indices."""
    rets = rets if rets is not None else long_values(state, "returns")
    if cfg.block_len <= 1.0:
        return boot_iid(paths, state, cfg, tag, rets)
    x, steps = _block_steps(paths, state, cfg, tag)
    s = x.select(*_path_keys(x), _block_index(cfg, cfg.block_len, steps).alias("_i"))
    return _sum_per_path(_lookup(s, rets, F.col("_i")), F.col("v"))


def boot_block_lengths(paths: DataFrame, state: DataFrame, cfg: MCConfig, lengths: list[float], tag: str,
                       rets: DataFrame) -> DataFrame:
    """R6 for several mean block lengths in one pass: the same two uniforms of a step serve all of them,
    with one running block start each. Rows come back with method ``<method>#<length index>``."""
    x, steps = _block_steps(paths, state, cfg, tag)
    keys = _path_keys(x)
    s = x.select(*keys, *[_block_index(cfg, length, steps).alias(f"_i{i}") for i, length in enumerate(lengths)])
    for i in range(len(lengths)):
        s = s.join(rets.select("hist_ticker", F.col("idx").alias(f"_i{i}"), F.col("v").alias(f"_v{i}")), ["hist_ticker", f"_i{i}"])
    sums = s.groupBy(*keys).agg(*[F.sum(f"_v{i}").alias(f"_w{i}") for i in range(len(lengths))])
    return _per_setting(sums, [f"_w{i}" for i in range(len(lengths))])


def boot_filtered(paths: DataFrame, state: DataFrame, cfg: MCConfig, risk_neutral: bool, r: Column,
                  tag: str = "fhs") -> DataFrame:
    """Filtered historical simulation. Per step a standardised residual z is drawn from
    the ticker's GARCH-filtered pool, shock = sigma_t z, the daily return is mu + shock (R7) or
    r/252 - sigma_t^2/2 + shock (R8), and sigma^2 <- omega + alpha shock^2 + beta sigma^2, starting
    from the one-step-ahead forecast. Tickers with fewer than ``fhs_min_obs`` returns fall back to
    i.i.d. resampling."""
    cols = ["returns", "n", "mu", "omega", "alpha", "beta", "sigma2_next", "z_pool", "n_z"]
    x = _with_state(paths, state, cols).withColumn("_k", _pkey(cfg, tag)).withColumn("_r", r)
    st = cfg.stream
    k = F.col("_k")
    enough = (F.col("n") >= cfg.fhs_min_obs) & F.col("omega").isNotNull()

    def step(acc, j):
        z = F.element_at("z_pool", st.u_index(F.col("n_z"), k, j))
        shock = F.sqrt(acc["s2"]) * z
        drift = (F.col("_r") / F.lit(TRADING_DAYS) - F.lit(0.5) * acc["s2"]) if risk_neutral else F.col("mu")
        return F.element_at(F.transform(F.array(shock), lambda sh: F.struct(
            (F.col("omega") + F.col("alpha") * sh * sh + F.col("beta") * acc["s2"]).alias("s2"),
            (acc["s"] + drift + sh).alias("s"))), 1)
    fhs = F.aggregate(F.sequence(F.lit(0), F.col("T") - 1),
                      F.struct(F.col("sigma2_next").alias("s2"), F.lit(0.0).alias("s")), step)["s"]
    iid = F.aggregate(F.sequence(F.lit(0), F.col("T") - 1), F.lit(0.0),
                      lambda a, j: a + F.element_at("returns", st.u_index(F.col("n"), k, j)))
    return x.select(*PATH_KEYS, F.when(enough, fhs).otherwise(iid).alias("log_sum"))


def cascade_levels(T: Column, override: int | None) -> Column:
    """L = ceil(log2(max(T, 2))) unless overridden (an override must satisfy 2^L >= T)."""
    if override is not None:
        return F.lit(int(override))
    # the 1e-9 guard keeps exact powers of two exact whatever the engine's log2 rounding
    return F.ceil(F.log2(F.greatest(T, F.lit(2)).cast("double")) - F.lit(1e-9)).cast("int")


def _cascade_steps(x: DataFrame, cfg: MCConfig, start: float, add) -> DataFrame:
    """Steps (column j) of the paths ``x`` (with _k, _L and T), each with _g: the sum over its levels of
    ``add(total, gaussian of its cell)``, from ``start``. The Gaussians of a level's cells, 0 ..
    (T - 1) >> (L - l - 1), are drawn once per path and looked up by the steps that share them."""
    st, k, L, last = cfg.stream, F.col("_k"), F.col("_L"), F.col("T") - F.lit(1)
    cell = lambda j, lv: F.call_function("shiftright", j, L - lv - F.lit(1))
    levels = F.sequence(F.lit(0), L - F.lit(1))
    x = x.withColumn("_cells", F.transform(levels, lambda lv: F.transform(
        F.sequence(F.lit(0), cell(last, lv)), lambda c: st.u_gauss(k, F.lit("c"), lv, c))))
    per_step = F.transform(F.sequence(F.lit(0), last), lambda j: F.aggregate(
        levels, F.lit(float(start)), lambda total, lv: add(total, F.get(F.get("_cells", lv), cell(j, lv)))))
    return x.select("*", F.posexplode(per_step).alias("j", "_g")).drop("_cells")


def boot_cascade(paths: DataFrame, state: DataFrame, cfg: MCConfig, r: Column, tag: str = "mfe",
                 zres: DataFrame | None = None) -> DataFrame:
    """Multifractal time with empirical residuals. Step weights theta_i are a lognormal
    multiplicative cascade: leaf i takes, at each level l < L, the multiplier of its cell
    i >> (L-l-1), exp(-lam^2/2 + lam g(l, cell)), so siblings share multipliers; theta is cropped
    to T leaves and renormalised to sum to T. Daily return (r - vol^2/2) theta_i/252 +
    vol sqrt(theta_i/252) z_i with z from the ticker's standardised residual pool (Gaussian when
    the pool is degenerate). lam = 0 gives theta = 1."""
    if cfg.lam < 0:
        raise ValueError(f"lam must be >= 0, got {cfg.lam}")
    st = cfg.stream
    zres = zres if zres is not None else long_values(state, "z_pool")
    x = _with_state(paths, state, ["vol", "n_z", "degenerate"]).withColumn("_k", _pkey(cfg, tag))
    x = x.withColumn("_L", cascade_levels(F.col("T"), cfg.cascade_levels)).withColumn("_r", r)
    lam, k, j = cfg.lam, F.col("_k"), F.col("j")
    if lam == 0.0:
        s, theta = _steps(x), F.lit(1.0)
    else:
        s = _cascade_steps(x, cfg, 0.0, lambda total, g: total + F.lit(-0.5 * lam * lam) + F.lit(lam) * g)
        theta = F.exp("_g")
    # degenerate pools have no rows: the left join leaves v NULL and the Gaussian draw is used
    s = s.withColumn("idx", st.u_index(F.col("n_z"), k, j, "z")).join(zres, ["hist_ticker", "idx"], "left")
    z = F.when(F.col("degenerate"), st.u_gauss(k, j, "z")).otherwise(F.col("v"))
    keys = _path_keys(s)
    per = s.select(*keys, "vol", "_r", theta.alias("_th"), z.alias("_z"))
    agg = per.groupBy(*keys, "vol", "_r").agg(F.sum("_th").alias("_S"),
                                                   F.sum(F.sqrt("_th") * F.col("_z")).alias("_Q"))
    Tc = F.col("T").cast("double")
    drift = (F.col("_r") - F.lit(0.5) * F.col("vol") * F.col("vol")) * Tc / F.lit(TRADING_DAYS)
    diff = F.col("vol") * F.sqrt(Tc / F.col("_S")) * F.col("_Q") / F.lit(math.sqrt(TRADING_DAYS))
    return agg.select(*PATH_KEYS, (drift + diff).alias("log_sum"))


def _per_setting(agg: DataFrame, sums: list[str]) -> DataFrame:
    """One row per path and setting out of one log-sum column per setting: method ``<method>#<index>``."""
    per = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.col(c).alias("ls")) for i, c in enumerate(sums)]))
    return (agg.select("hist_ticker", "T", "method", "path_id", per.alias("_p"))
               .select("hist_ticker", "T", F.concat("method", F.lit("#"), F.col("_p.i").cast("string")).alias("method"),
                       "path_id", F.col("_p.ls").alias("log_sum")))


def boot_cascade_lambdas(paths: DataFrame, state: DataFrame, cfg: MCConfig, r: Column, lambdas: list[float],
                         tag: str, zres: DataFrame) -> DataFrame:
    """R10 for several lambdas in one pass: the Gaussians of the cells and the residuals do not depend
    on lambda, and a leaf's weight is exp(-L lam^2/2 + lam G) with G the sum of its cells' Gaussians.
    Rows come back with method ``<method>#<lambda index>``."""
    st = cfg.stream
    x = _with_state(paths, state, ["vol", "n_z", "degenerate"]).withColumn("_k", _pkey(cfg, tag))
    x = x.withColumn("_L", cascade_levels(F.col("T"), cfg.cascade_levels)).withColumn("_r", r)
    k, j = F.col("_k"), F.col("j")
    s = _cascade_steps(x, cfg, 0.0, lambda total, g: total + g)
    s = s.withColumn("idx", st.u_index(F.col("n_z"), k, j, "z")).join(zres, ["hist_ticker", "idx"], "left")
    z = F.when(F.col("degenerate"), st.u_gauss(k, j, "z")).otherwise(F.col("v"))
    keys = _path_keys(s)
    s = s.select(*keys, "vol", "_r", "_L", "_g", z.alias("_z"))
    sums = []
    for i, lam in enumerate(lambdas):
        theta = F.exp(F.lit(-0.5 * lam * lam) * F.col("_L") + F.lit(lam) * F.col("_g"))
        sums += [F.sum(theta).alias(f"_S{i}"), F.sum(F.sqrt(theta) * F.col("_z")).alias(f"_Q{i}")]
    agg = s.groupBy(*keys, "vol", "_r").agg(*sums)
    Tc, vol = F.col("T").cast("double"), F.col("vol")
    drift = (F.col("_r") - F.lit(0.5) * vol * vol) * Tc / F.lit(TRADING_DAYS)
    ls = [(drift + vol * F.sqrt(Tc / F.col(f"_S{i}")) * F.col(f"_Q{i}") / F.lit(math.sqrt(TRADING_DAYS))).alias(f"_w{i}")
          for i in range(len(lambdas))]
    return _per_setting(agg.select(*PATH_KEYS, *ls), [f"_w{i}" for i in range(len(lambdas))])


def boot_t_mixture_weights(paths: DataFrame, state: DataFrame, cfg: MCConfig, weights: list[float],
                           tag: str = "student_t", rets: DataFrame | None = None) -> DataFrame:
    """R5 for several mixture weights in one pass: the per-step draws (historical value, Student-t
    value, mixture uniform) do not depend on the weight, so each path's log-sum for every weight
    is a conditional sum over the same step rows. Rows come back with method
    ``<method>#<weight index>``."""
    rets = rets if rets is not None else long_values(state, "returns")
    s = _steps(_with_state(paths, state, ["n", "t_df", "t_loc", "t_scale"]).withColumn("_k", _pkey(cfg, tag)))
    st = cfg.stream
    k, j = F.col("_k"), F.col("j")
    s = _lookup(s, rets, st.u_index(F.col("n"), k, j, "h"))
    keys = _path_keys(s)
    s = s.select(*keys, (F.col("t_loc") + F.col("t_scale") * st.u_student_t(F.col("t_df"), k, j)).alias("_t"),
                 F.col("v").alias("_h"), st.u(k, j, "m").alias("_m"))
    sums = [F.sum(F.when(F.col("_m") < F.lit(w), F.col("_t")).otherwise(F.col("_h"))).alias(f"_w{i}")
            for i, w in enumerate(weights)]
    return _per_setting(s.groupBy(*keys).agg(*sums), [f"_w{i}" for i in range(len(weights))])
