"""SQL oracles (DuckDB) of the Monte Carlo plans, using the md5 random stream.

Independent formulations: steps are rows (``unnest(range(T))``), the block bootstrap's index
comes from window functions instead of a fold, the Student-t fit is a chain of EM CTEs."""
from __future__ import annotations

import math

from ..functions.rng import gaussian_sql, student_t_sql, uniform_sql
from ..operators import stats as st
from .oracle import SQL
from .sqlfix import d, with_ctes

SEED = 42
N = 1000
ALT_WEIGHT = 0.1
BLOCK_P = 1.0 / 5.0
LAM = 0.4
RISK_NEUTRAL = {"black_scholes", "multifractal", "multifractal_empirical", "fhs_rn"}

BASE = [
    ("ret_idx", """SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY "Date") AS idx, log_return
        FROM returns WHERE log_return IS NOT NULL AND NOT isnan(log_return)"""),
    ("hz", "SELECT DISTINCT hist_ticker, T FROM contracts_h"),
]
NEEDS = ["returns", "vstats", "contracts_h", "rate"]


def key(tag: str, *step: str) -> tuple[str, ...]:
    """Key parts after the seed: tag, hist_ticker, T, path_id, then the step parts."""
    return (repr(tag), "hist_ticker", "T", "path_id", *step)


def u(tag: str, *step: str) -> str:
    return uniform_sql(SEED, *key(tag, *step))


def paths_cte(n: int = N) -> tuple[str, str]:
    return ("paths", f"SELECT hist_ticker, T, CAST(range AS BIGINT) AS path_id FROM hz, range({n})")


def draws(name: str, uniform: str) -> tuple[str, str]:
    """Steps with the 1-based index of the return that each draws."""
    return (name, f"SELECT s.*, CAST(floor({uniform} * v.n) AS BIGINT) + 1 AS ix FROM steps s JOIN vstats v ON v.ticker = s.hist_ticker")


STEPS = ("steps", "SELECT p.*, unnest(range(p.T)) AS j FROM paths p")


def priced(method: str, ls: str = "ls") -> list[tuple[str, str]]:
    disc = f"exp(-rate.r * CAST(T AS DOUBLE) / {d(252.0)})" if method in RISK_NEUTRAL else d(1.0)
    return [
        ("g", f"""SELECT hist_ticker, T, path_id, exp(greatest(least(log_sum, {d(10.0)}), {d(-10.0)})) AS g FROM {ls}"""),
        ("px", f"""SELECT c.ticker, c.K, c.T, c.S0, avg(greatest(c.S0 * g.g - c.K, {d(0.0)})) AS c_,
            avg(greatest(c.K - c.S0 * g.g, {d(0.0)})) AS p_ FROM g JOIN contracts_h c USING (hist_ticker, T) GROUP BY 1, 2, 3, 4"""),
        ("out", f"""SELECT ticker, K, T, S0, '{method}' AS method, CAST({N} AS INTEGER) AS Runs, c_ * {disc} AS CallPrice,
            p_ * {disc} AS PutPrice FROM px CROSS JOIN rate"""),
    ]


FINAL = """SELECT ticker, round(K, 6) AS K, T, round(S0, 6) AS S0, method, Runs, round(CallPrice, 6) AS CallPrice,
    round(PutPrice, 6) AS PutPrice FROM out"""


def register(name: str, method: str, ctes: list[tuple[str, str]]):
    SQL[name] = with_ctes(NEEDS, FINAL, BASE + ctes + priced(method))


# R1 historical
register("boot_iid", "historical", [paths_cte(), STEPS, draws("s_ix", u("historical", "j")),
    ("ls", """SELECT s.hist_ticker, s.T, s.path_id, sum(r.log_return) AS log_sum
    FROM s_ix s JOIN ret_idx r ON r.ticker = s.hist_ticker AND r.idx = s.ix GROUP BY 1, 2, 3""")])

# R2..R4 exact windows: every start is a path
for name, method, stride in [("boot_window", "window", 1), ("boot_window_10", "window_10d", 10),
                             ("boot_window_20", "window_20d", 20)]:
    register(name, method, [
        ("wp", "SELECT h.hist_ticker, h.T, v.n, unnest(range(v.n)) AS path_id FROM hz h JOIN vstats v ON v.ticker = h.hist_ticker"),
        ("ws", "SELECT w.*, unnest(range(w.T)) AS j FROM wp w"),
        ("ls", f"""SELECT w.hist_ticker, w.T, w.path_id, sum(r.log_return) AS log_sum FROM ws w
            JOIN ret_idx r ON r.ticker = w.hist_ticker AND r.idx = (w.path_id + w.j * {stride}) % w.n + 1 GROUP BY 1, 2, 3""")])


# D2 Student-t fit: EM rounds as chained CTEs
def tfit_ctes(rounds: int = 30) -> list[tuple[str, str]]:
    grid = ", ".join(f"({d(nu)}, {d(st._t_const(nu))})" for nu in st.t_df_grid())
    out = [("rx", "SELECT ticker, log_return AS x FROM returns WHERE log_return IS NOT NULL AND NOT isnan(log_return)"),
           ("tgrid", f"SELECT * FROM (VALUES {grid}) t(df, c)"),
           ("em0", "SELECT v.ticker, g.df, g.c, v.n, v.mu AS loc, v.std AS scale FROM vstats v, tgrid g WHERE v.n >= 2")]
    w = "(e.df + 1) / (e.df + ((r.x - e.loc) / e.scale) * ((r.x - e.loc) / e.scale))"
    for i in range(1, rounds + 1):
        out.append((f"em{i}a", f"""SELECT e.ticker, e.df, e.c, e.n, e.loc, e.scale, sum({w}) AS sw, sum({w} * r.x) AS swx
            FROM em{i - 1} e JOIN rx r USING (ticker) GROUP BY e.ticker, e.df, e.c, e.n, e.loc, e.scale"""))
        out.append((f"em{i}", f"""SELECT e.ticker, e.df, e.c, e.n, e.swx / e.sw AS loc,
            sqrt(sum({w} * (r.x - e.swx / e.sw) * (r.x - e.swx / e.sw)) / e.n) AS scale
            FROM em{i}a e JOIN rx r USING (ticker) GROUP BY e.ticker, e.df, e.c, e.n, e.swx, e.sw, e.loc, e.scale"""))
    out.append(("tll", f"""SELECT e.ticker, e.df, e.loc, e.scale, e.n * (e.c - ln(e.scale))
        - (e.df + 1) / 2 * sum(ln(1 + ((r.x - e.loc) / e.scale) * ((r.x - e.loc) / e.scale) / e.df)) AS ll
        FROM em{rounds} e JOIN rx r USING (ticker) GROUP BY e.ticker, e.df, e.c, e.n, e.loc, e.scale"""))
    out.append(("tfit", "SELECT ticker, arg_max(df, ll) AS t_df, arg_max(loc, ll) AS t_loc, arg_max(scale, ll) AS t_scale, max(ll) AS ll FROM tll GROUP BY ticker"))
    return out


SQL["student_t_fit"] = with_ctes(["returns", "vstats"], """SELECT ticker, round(t_df, 4) AS df, round(t_loc, 6) AS tloc,
    round(t_scale, 6) AS tscale FROM tfit""", tfit_ctes())

# R5 Student-t mixture
_t = student_t_sql(SEED, "f.t_df", *key("student_t", "j"))
register("boot_t_mixture", "student_t", tfit_ctes() + [paths_cte(), STEPS, draws("s_ix", u("student_t", "j", repr("h"))),
    ("ls", f"""SELECT s.hist_ticker, s.T, s.path_id,
    sum(CASE WHEN {u('student_t', 'j', repr('m'))} < {d(ALT_WEIGHT)} THEN f.t_loc + f.t_scale * {_t} ELSE r.log_return END) AS log_sum
    FROM s_ix s JOIN tfit f ON f.ticker = s.hist_ticker JOIN ret_idx r ON r.ticker = s.hist_ticker AND r.idx = s.ix
    GROUP BY 1, 2, 3""")])

# R6 stationary block bootstrap: index = (start of the current block + steps since it) mod n
register("boot_block", "block_bootstrap", [paths_cte(), STEPS,
    ("bs", f"""SELECT s.hist_ticker, s.T, s.path_id, s.j, v.n, (s.j = 0 OR {u('block_bootstrap', 'j', repr('b'))} < {d(BLOCK_P)}) AS fresh,
        CAST(floor({u('block_bootstrap', 'j', repr('s'))} * v.n) AS BIGINT) AS start
        FROM steps s JOIN vstats v ON v.ticker = s.hist_ticker"""),
    ("bb", """SELECT *, max(CASE WHEN fresh THEN j END) OVER w AS b,
        last_value(CASE WHEN fresh THEN start END IGNORE NULLS) OVER w AS st0 FROM bs
        WINDOW w AS (PARTITION BY hist_ticker, T, path_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
    ("ls", """SELECT b.hist_ticker, b.T, b.path_id, sum(r.log_return) AS log_sum FROM bb b
        JOIN ret_idx r ON r.ticker = b.hist_ticker AND r.idx = (b.st0 + b.j - b.b) % b.n + 1 GROUP BY 1, 2, 3""")])

# R10 cascade with empirical residuals
_mu_w = -0.5 * LAM * LAM
_g = gaussian_sql(SEED, *key("multifractal_empirical", "'c'", "lvl", "cell"))
_zg = gaussian_sql(SEED, *key("multifractal_empirical", "j", "'z'"))
register("boot_cascade", "multifractal_empirical", [paths_cte(), STEPS,
    ("zres", """SELECT r.ticker, r.idx, (r.log_return - v.mu) / v.std AS z FROM ret_idx r JOIN vstats v USING (ticker)"""),
    ("cl", f"""SELECT s.*, CAST(ceil(log2(CAST(greatest(s.T, 2) AS DOUBLE)) - {d(1e-9)}) AS INTEGER) AS levels FROM steps s"""),
    ("lv", """SELECT c.*, unnest(range(c.levels)) AS lvl FROM cl c"""),
    ("cells", """SELECT *, CAST(floor(j / pow(2.0, levels - lvl - 1)) AS INTEGER) AS cell FROM lv"""),
    ("th", f"""SELECT hist_ticker, T, path_id, j, exp(sum({d(_mu_w)} + {d(LAM)} * {_g})) AS theta FROM cells GROUP BY 1, 2, 3, 4"""),
    ("tz", f"""SELECT t.*, v.vol, CASE WHEN v.n < 2 OR v.std = 0 THEN {_zg} ELSE z.z END AS zz
        FROM th t JOIN vstats v ON v.ticker = t.hist_ticker
        LEFT JOIN zres z ON z.ticker = t.hist_ticker
             AND z.idx = CAST(floor({u('multifractal_empirical', 'j', repr('z'))} * v.n) AS BIGINT) + 1"""),
    ("agg", """SELECT hist_ticker, T, path_id, vol, sum(theta) AS S, sum(sqrt(theta) * zz) AS Q FROM tz GROUP BY 1, 2, 3, 4"""),
    ("ls", f"""SELECT hist_ticker, T, path_id, (rate.r - {d(0.5)} * vol * vol) * CAST(T AS DOUBLE) / {d(252.0)}
        + vol * sqrt(CAST(T AS DOUBLE) / S) * Q / {d(math.sqrt(252.0))} AS log_sum FROM agg CROSS JOIN rate""")])

# The sampled and closed-form prices of the registered queries side by side

def _side_by_side() -> str:
    return f"""(SELECT m.ticker, m.K, m.T, m.S0, b.r, m.CallPrice AS mc_call, m.PutPrice AS mc_put, b.bs_call, b.bs_put, s.se_call, s.se_put
        FROM ({SQL["boot_iid"]}) m JOIN ({SQL["bs_price"]}) b USING (ticker, K, T) JOIN ({SQL["bs_stderr"]}) s USING (ticker, K, T))"""


def _gap(side: str) -> str:
    d = f"mc_{side} - bs_{side}"
    return f"""round({d}, 6) + 0.0 AS {side}_diff, round(CASE WHEN bs_{side} <> 0 THEN abs({d}) / bs_{side} * 100.0 END, 6) AS {side}_err_pct,
        abs({d}) <= 2.0 * se_{side} * (sqrt(10000.0) / sqrt({N}.0)) AS {side}_within_2se"""


SQL["mc_vs_bs"] = f"SELECT ticker, K, T, {_gap('call')}, {_gap('put')} FROM {_side_by_side()}"
SQL["put_call_parity_sampled"] = f"""SELECT ticker, K, T, round(theory, 6) AS parity_theoretical, round(sampled, 6) AS parity_sampled,
    round(abs(sampled - theory) / abs(theory) * 100.0, 6) AS parity_dev_pct, abs(sampled - theory) / abs(theory) * 100.0 < 5.0 AS parity_ok
    FROM (SELECT *, S0 - K * exp(-r * T / 252.0) AS theory, mc_call - mc_put AS sampled FROM {_side_by_side()})"""


# The variance recursion day by day, at the starting parameters
SQL["garch_filter_start"] = "WITH RECURSIVE " + with_ctes(["returns", "vstats"], """SELECT ticker, "Date", round(s2, 10) AS sigma2,
    round(e / sqrt(s2) - avg(e / sqrt(s2)) OVER (PARTITION BY ticker), 10) AS z,
    round(last_value(om + al * e * e + be * s2) OVER (PARTITION BY ticker ORDER BY idx
          ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 10) AS sigma2_next
    FROM (SELECT *, greatest(v, 1e-16::DOUBLE) AS s2 FROM walked)""", [
    ("dated", """SELECT ticker, "Date", log_return, row_number() OVER (PARTITION BY ticker ORDER BY "Date") AS idx
        FROM returns WHERE log_return IS NOT NULL AND NOT isnan(log_return)"""),
    ("params", f"""SELECT ticker, mu, greatest(std * std, 1e-12::DOUBLE) AS var0, greatest(std * std, 1e-12::DOUBLE) * {d(st.GARCH_START[0])} AS om,
        {d(st.GARCH_START[1])} AS al, {d(st.GARCH_START[2])} AS be FROM vstats WHERE n >= 2"""),
    ("walked", """SELECT p.ticker, t."Date", t.idx, t.log_return - p.mu AS e, p.var0 AS v, om, al, be, mu FROM params p
          JOIN dated t ON t.ticker = p.ticker AND t.idx = 1
        UNION ALL SELECT w.ticker, t."Date", t.idx, t.log_return - w.mu, om + al * w.e * w.e + be * w.v, om, al, be, mu
          FROM walked w JOIN dated t ON t.ticker = w.ticker AND t.idx = w.idx + 1"""),
]).removeprefix("WITH ")
