"""SQL oracles (DuckDB) of the convergence, scale, sweep, EMC and pricing-step plans.

Each sampler's log-sums come from a prefixed CTE family (``<p>_ls``), priced at every scale by
joining a scales table on ``path_id < runs`` (exact window methods: all starts at every scale)."""
from __future__ import annotations

import math

from ..functions.rng import gaussian_sql, student_t_sql
from .oracle import SQL
from .oracle_mc import LAM, N, SEED, draws, key, tfit_ctes, u
from .sqlfix import d, norm_cdf_sql, rnd, with_ctes

RISK_NEUTRAL = {"black_scholes", "multifractal", "multifractal_empirical", "fhs_rn"}
NEEDS = ["returns", "vstats", "qr_state", "rate", "contracts_h"]
RET_IDX = ("ret_idx", """SELECT ticker, row_number() OVER (PARTITION BY ticker ORDER BY "Date") AS idx, log_return
    FROM returns WHERE log_return IS NOT NULL AND NOT isnan(log_return)""")


def common(contracts: str, n: int) -> list[tuple[str, str]]:
    return [RET_IDX,
            ("hz", f"SELECT DISTINCT hist_ticker, T FROM {contracts}"),
            ("paths", f"SELECT hist_ticker, T, CAST(range AS BIGINT) AS path_id FROM hz, range({n})"),
            ("steps", "SELECT p.*, unnest(range(p.T)) AS j FROM paths p")]


def ls_iid(p: str, tag: str) -> list[tuple[str, str]]:
    return [draws(f"{p}_ix", u(tag, "j")),
            (f"{p}_ls", f"""SELECT s.hist_ticker, s.T, s.path_id, sum(r.log_return) AS log_sum FROM {p}_ix s
        JOIN ret_idx r ON r.ticker = s.hist_ticker AND r.idx = s.ix
        GROUP BY 1, 2, 3""")]


def ls_tmix(p: str, weight: float) -> list[tuple[str, str]]:
    t = student_t_sql(SEED, "f.t_df", *key("student_t", "j"))
    return [draws(f"{p}_ix", u("student_t", "j", repr("h"))), (f"{p}_ls", f"""SELECT s.hist_ticker, s.T, s.path_id,
        sum(CASE WHEN {u('student_t', 'j', repr('m'))} < {d(weight)} THEN f.t_loc + f.t_scale * {t} ELSE r.log_return END) AS log_sum
        FROM {p}_ix s JOIN tfit f ON f.ticker = s.hist_ticker JOIN ret_idx r ON r.ticker = s.hist_ticker AND r.idx = s.ix
        GROUP BY 1, 2, 3""")]


def ls_tmix_weights(p: str, weights: list[float]) -> list[tuple[str, str]]:
    """``<p><i>_ls`` for each weight, from one pass over the draws."""
    t = student_t_sql(SEED, "f.t_df", *key("student_t", "j"))
    sums = ", ".join(f"sum(CASE WHEN m < {d(w)} THEN drawn ELSE past END) AS w{i}" for i, w in enumerate(weights))
    return [draws(f"{p}_ix", u("student_t", "j", repr("h"))),
            (f"{p}_st", f"""SELECT s.hist_ticker, s.T, s.path_id, {u('student_t', 'j', repr('m'))} AS m, f.t_loc + f.t_scale * {t} AS drawn, r.log_return AS past
        FROM {p}_ix s JOIN tfit f ON f.ticker = s.hist_ticker JOIN ret_idx r ON r.ticker = s.hist_ticker AND r.idx = s.ix"""),
            (f"{p}_sum", f"SELECT hist_ticker, T, path_id, {sums} FROM {p}_st GROUP BY 1, 2, 3"),
            *[(f"{p}{i}_ls", f"SELECT hist_ticker, T, path_id, w{i} AS log_sum FROM {p}_sum") for i in range(len(weights))]]


def ls_block(p: str, L: float) -> list[tuple[str, str]]:
    if L <= 1.0:
        return ls_iid(p, "block_bootstrap")
    tag = "block_bootstrap"
    return [
        (f"{p}_bs", f"""SELECT s.hist_ticker, s.T, s.path_id, s.j, v.n, (s.j = 0 OR {u(tag, 'j', repr('b'))} < {d(1.0 / L)}) AS fresh,
            CAST(floor({u(tag, 'j', repr('s'))} * v.n) AS BIGINT) AS start FROM steps s JOIN vstats v ON v.ticker = s.hist_ticker"""),
        (f"{p}_bb", f"""SELECT *, max(CASE WHEN fresh THEN j END) OVER w AS b,
            last_value(CASE WHEN fresh THEN start END IGNORE NULLS) OVER w AS st0 FROM {p}_bs
            WINDOW w AS (PARTITION BY hist_ticker, T, path_id ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""),
        (f"{p}_ls", f"""SELECT b.hist_ticker, b.T, b.path_id, sum(r.log_return) AS log_sum FROM {p}_bb b
            JOIN ret_idx r ON r.ticker = b.hist_ticker AND r.idx = (b.st0 + b.j - b.b) % b.n + 1 GROUP BY 1, 2, 3""")]


def ls_cascade(p: str, lam: float) -> list[tuple[str, str]]:
    tag = "multifractal_empirical"
    g = gaussian_sql(SEED, *key(tag, "'c'", "lvl", "cell"))
    zg = gaussian_sql(SEED, *key(tag, "j", "'z'"))
    theta = (f"exp(sum({d(-0.5 * lam * lam)} + {d(lam)} * {g}))" if lam != 0 else d(1.0))
    return [
        ("zres", """SELECT r.ticker, r.idx, (r.log_return - v.mu) / v.std AS z FROM ret_idx r JOIN vstats v USING (ticker)"""),
        (f"{p}_cells", f"""SELECT *, CAST(floor(j / pow(2.0, levels - lvl - 1)) AS INTEGER) AS cell FROM (
            SELECT c.*, unnest(range(c.levels)) AS lvl FROM (
              SELECT s.*, CAST(ceil(log2(CAST(greatest(s.T, 2) AS DOUBLE)) - {d(1e-9)}) AS INTEGER) AS levels FROM steps s) c)"""),
        (f"{p}_th", f"""SELECT hist_ticker, T, path_id, j, {theta} AS theta FROM {p}_cells GROUP BY 1, 2, 3, 4"""),
        (f"{p}_tz", f"""SELECT t.*, v.vol, CASE WHEN v.n < 2 OR v.std = 0 THEN {zg} ELSE z.z END AS zz
            FROM {p}_th t JOIN vstats v ON v.ticker = t.hist_ticker
            LEFT JOIN zres z ON z.ticker = t.hist_ticker AND z.idx = CAST(floor({u(tag, 'j', repr('z'))} * v.n) AS BIGINT) + 1"""),
        (f"{p}_ls", f"""SELECT hist_ticker, T, path_id, (rate.r - {d(0.5)} * vol * vol) * CAST(T AS DOUBLE) / {d(252.0)}
            + vol * sqrt(CAST(T AS DOUBLE) / S) * Q / {d(math.sqrt(252.0))} AS log_sum FROM (
              SELECT hist_ticker, T, path_id, vol, sum(theta) AS S, sum(sqrt(theta) * zz) AS Q FROM {p}_tz GROUP BY 1, 2, 3, 4)
            CROSS JOIN rate""")]


def ls_window(p: str, stride: int) -> list[tuple[str, str]]:
    return [
        (f"{p}_wp", "SELECT h.hist_ticker, h.T, v.n, unnest(range(v.n)) AS path_id FROM hz h JOIN vstats v ON v.ticker = h.hist_ticker"),
        (f"{p}_ws", f"SELECT w.*, unnest(range(w.T)) AS j FROM {p}_wp w"),
        (f"{p}_ls", f"""SELECT w.hist_ticker, w.T, w.path_id, sum(r.log_return) AS log_sum FROM {p}_ws w
            JOIN ret_idx r ON r.ticker = w.hist_ticker AND r.idx = (w.path_id + w.j * {stride}) % w.n + 1 GROUP BY 1, 2, 3""")]


def scales_sql(scales: list[int]) -> str:
    return "(VALUES " + ", ".join(f"({s})" for s in scales) + ") sc(runs)"


def priced(p: str, method: str, contracts: str, scales: list[int], exact: bool = False, emc: bool = False) -> list:
    sc = scales_sql(scales)
    out = [(f"{p}_g", f"""SELECT hist_ticker, T, path_id, exp(greatest(least(log_sum, {d(10.0)}), {d(-10.0)})) AS g FROM {p}_ls""")]
    fac = f"CASE WHEN avg(g) > 0 THEN exp(rate.r * CAST(T AS DOUBLE) / {d(252.0)}) / avg(g) ELSE {d(1.0)} END"
    if exact:
        if emc:
            out.append((f"{p}_f", f"SELECT hist_ticker, T, {fac} AS f FROM {p}_g CROSS JOIN rate GROUP BY hist_ticker, T, rate.r"))
            out.append((f"{p}_gs", f"""SELECT g.hist_ticker, g.T, g.path_id, g.g * f.f AS g, sc.runs FROM {p}_g g
                JOIN {p}_f f USING (hist_ticker, T) CROSS JOIN {sc}"""))
        else:
            out.append((f"{p}_gs", f"SELECT g.*, sc.runs FROM {p}_g g CROSS JOIN {sc}"))
    else:
        src = f"{p}_gs0" if emc else f"{p}_gs"
        out.append((src, f"SELECT g.*, sc.runs FROM {p}_g g JOIN {sc} ON g.path_id < sc.runs"))
        if emc:
            out.append((f"{p}_f", f"SELECT hist_ticker, T, runs, {fac} AS f FROM {p}_gs0 CROSS JOIN rate GROUP BY hist_ticker, T, runs, rate.r"))
            out.append((f"{p}_gs", f"""SELECT g.hist_ticker, g.T, g.path_id, g.g * f.f AS g, g.runs FROM {p}_gs0 g
                JOIN {p}_f f USING (hist_ticker, T, runs)"""))
    disc = f"exp(-rate.r * CAST(c.T AS DOUBLE) / {d(252.0)})" if method in RISK_NEUTRAL else d(1.0)
    out.append((f"{p}_out", f"""SELECT c.ticker, c.K, c.T, c.S0, '{method}' AS method, CAST(gs.runs AS INTEGER) AS Runs,
        avg(greatest(c.S0 * gs.g - c.K, {d(0.0)})) * {disc} AS CallPrice, avg(greatest(c.K - c.S0 * gs.g, {d(0.0)})) * {disc} AS PutPrice
        FROM {p}_gs gs JOIN {contracts} c USING (hist_ticker, T) CROSS JOIN rate GROUP BY c.ticker, c.K, c.T, c.S0, gs.runs, rate.r"""))
    return out


def closed_form(p: str, contracts: str, scales: list[int], methods=("black_scholes", "multifractal")) -> list:
    vals = ", ".join(f"('{m}')" for m in methods)
    return [
        (f"{p}_in", f"""SELECT c.ticker, c.K, c.T, c.S0, v.vol, rate.r, CAST(c.T AS DOUBLE) / {d(252.0)} AS tau
            FROM {contracts} c JOIN vstats v ON v.ticker = c.hist_ticker CROSS JOIN rate"""),
        (f"{p}_d", f"""SELECT *, (ln(S0 / K) + (r + {d(0.5)} * vol * vol) * tau) / (vol * sqrt(tau)) AS d1,
            (ln(S0 / K) + (r + {d(0.5)} * vol * vol) * tau) / (vol * sqrt(tau)) - vol * sqrt(tau) AS d2 FROM {p}_in"""),
        (f"{p}_out", f"""SELECT ticker, K, T, S0, m.method, CAST(sc.runs AS INTEGER) AS Runs,
            S0 * {norm_cdf_sql('d1')} - K * exp(-r * tau) * {norm_cdf_sql('d2')} AS CallPrice,
            K * exp(-r * tau) * {norm_cdf_sql('-d2')} - S0 * {norm_cdf_sql('-d1')} AS PutPrice
            FROM {p}_d CROSS JOIN (VALUES {vals}) m(method) CROSS JOIN {scales_sql(scales)}""")]


def union(names: list[str], extra_cols: str = "") -> str:
    return " UNION ALL ".join(f"SELECT {extra_cols}* FROM {n}" for n in names)


# ---------------------------------------------------------------- convergence study
CONV_SCALES = [250, 500, 1000, 2000]
CONV_WEIGHTS = [0.1, 0.2, 0.3, 0.4, 0.5]
CC = ("cc", f"""SELECT ticker, hist_ticker, {rnd('min(S0)', 2)} AS K, T, min(S0) AS S0 FROM contracts_h GROUP BY ticker, hist_ticker, T""")
# The study's own contract, ten days at the money, is one of every ticker with prices, quoted or not.
STUDY = ("study_h", """SELECT ticker, hist_ticker, T, S0 FROM contracts_h UNION ALL
    SELECT s.ticker, coalesce(h.hist_ticker, s.ticker), CAST(10 AS INTEGER), s.S0
    FROM qr_state s LEFT JOIN hmap h ON h.option_ticker = s.ticker WHERE s.ticker IS NOT NULL""")
STUDY_REPORTS = {"convergence", "transition_report", "weight_summary", "highest_scale"}
WEIGHTS = "(VALUES " + ", ".join(f"({d(w)})" for w in CONV_WEIGHTS) + ") wt(alt_weight)"


def conv_ctes(study: bool = False) -> list:
    """``study``: of the study's own contracts, too, with the last transition and the largest scale looked up in the rows."""
    contracts = [STUDY, (CC[0], CC[1].replace("contracts_h", "study_h"))] if study else [CC]
    c = contracts + common("cc", max(CONV_SCALES)) + tfit_ctes()
    outs = []
    for p, m, gen, exact in [("hi", "historical", ls_iid("hi", "historical"), False),
                             ("w1", "window", ls_window("w1", 1), True), ("w10", "window_10d", ls_window("w10", 10), True),
                             ("w20", "window_20d", ls_window("w20", 20), True),
                             ("bl", "block_bootstrap", ls_block("bl", 5.0), False),
                             ("mf", "multifractal_empirical", ls_cascade("mf", LAM), False)]:
        c += gen + priced(p, m, "cc", CONV_SCALES, exact)
        outs.append(f"{p}_out")
    c += closed_form("cf", "cc", CONV_SCALES)
    outs.append("cf_out")
    tw = []
    c += ls_tmix_weights("t", CONV_WEIGHTS)
    for i, w in enumerate(CONV_WEIGHTS):
        c += priced(f"t{i}", "student_t", "cc", CONV_SCALES)
        tw.append(f"SELECT {d(w)} AS alt_weight, * FROM t{i}_out")
    c.append(("cp_all", f"SELECT wt.alt_weight, u.* FROM ({union(outs)}) u CROSS JOIN {WEIGHTS} UNION ALL " + " UNION ALL ".join(tw)))
    c.append(("cp", "SELECT ticker, T, alt_weight, Runs AS runs, method, CallPrice, PutPrice FROM cp_all"))
    c.append(("cv1", """SELECT *, lag(px) OVER w AS prev, lag(runs) OVER w AS from_runs FROM (
        SELECT ticker, T, alt_weight, method, runs, CASE WHEN CallPrice > 0 THEN CallPrice ELSE PutPrice END AS px FROM cp)
        WINDOW w AS (PARTITION BY ticker, T, alt_weight, method ORDER BY runs)"""))
    c.append(("cv", f"""SELECT ticker, T, alt_weight, method, CAST(from_runs AS INTEGER) AS from_runs, CAST(runs AS INTEGER) AS to_runs,
        {rnd('prev', 4)} AS prev_price, {rnd('px', 4)} AS curr_price,
        {rnd('CASE WHEN prev = 0 AND px = 0 THEN 0.0 WHEN prev = 0 THEN 100.0 ELSE abs((px - prev) / prev) * 100.0 END', 4)} AS pct_change,
        (CASE WHEN prev = 0 AND px = 0 THEN 0.0 WHEN prev = 0 THEN 100.0 ELSE abs((px - prev) / prev) * 100.0 END) <= 1.0 AS converged
        FROM cv1 WHERE from_runs IS NOT NULL"""))
    last = ("JOIN (SELECT ticker, T, alt_weight, max(to_runs) AS mx FROM cv GROUP BY ALL) USING (ticker, T, alt_weight) WHERE to_runs = mx"
            if study else f"WHERE to_runs = {max(CONV_SCALES)}")
    c.append(("lastt", f"""SELECT *, CASE WHEN converged THEN 'PASS' ELSE 'FAIL' END AS verdict FROM cv {last}"""))
    top = "(SELECT max(runs) FROM cp)" if study else max(CONV_SCALES)
    c.append(("top", f"SELECT * FROM cp WHERE runs = {top}"))
    return c


def conv_sql(body: str) -> str:
    return with_ctes(NEEDS, body, conv_ctes())


CONV_BODIES = {}
CONV_BODIES["convergence"] = ("""SELECT ticker, T, alt_weight, method, from_runs, to_runs, round(prev_price, 6) AS prev_price,
    round(curr_price, 6) AS curr_price, round(pct_change, 6) AS pct_change, converged FROM cv""")
CONV_BODIES["transition_report"] = ("""SELECT ticker, T, alt_weight, method, from_runs, to_runs, round(prev_price, 6) AS prev_price,
    round(curr_price, 6) AS curr_price, round(pct_change, 6) AS pct_change, converged, verdict FROM lastt""")
CONV_BODIES["weight_summary"] = ("""SELECT ticker, T, alt_weight, CAST(sum(CAST(converged AS INTEGER)) AS BIGINT) AS n_converged,
    count(*) AS n_methods, arg_min(method, (pct_change, method)) AS best_method, round(min(pct_change), 6) AS min_pct_change,
    bool_and(converged) AS all_converged FROM lastt GROUP BY ticker, T, alt_weight""")
# the closed form does not depend on the sampled paths
CONV_BODIES["bs_consistency"] = ("""SELECT ticker, T, round(avg(CallPrice), 6) AS mean_call, round(stddev_samp(CallPrice), 6) AS std_call,
    round(avg(PutPrice), 6) AS mean_put, round(stddev_samp(PutPrice), 6) AS std_put,
    coalesce(stddev_samp(CallPrice), 0) < 1.0 AS consistent FROM an_out CROSS JOIN """ + WEIGHTS + " GROUP BY ticker, T")
CONV_BODIES["spread_vs_bs"] = ("""SELECT ticker, T, alt_weight, method, round(CallPrice, 6) AS call, round(avg_call, 6) AS avg_call,
    round(CASE WHEN bs > 0 THEN (avg_call - bs) / bs * 100.0 ELSE 0.0 END, 6) AS pct_vs_bs
    FROM top JOIN (SELECT ticker, T, method, avg(CallPrice) AS avg_call FROM top GROUP BY ALL) USING (ticker, T, method)
    JOIN (SELECT ticker, T, avg(CallPrice) AS bs FROM top WHERE method = 'black_scholes' GROUP BY ALL) USING (ticker, T)""")
CONV_BODIES["premium_over_bs"] = """SELECT ticker, T, method, round(avg_call, 6) AS avg_call, round(b.CallPrice, 6) AS bs_call,
    round((avg_call - b.CallPrice) / b.CallPrice * 100.0, 6) AS premium_pct
    FROM (SELECT ticker, T, method, avg(CallPrice) AS avg_call FROM top GROUP BY ALL)
    JOIN (SELECT ticker, T, CallPrice FROM an_out) b USING (ticker, T)"""
CONV_BODIES["highest_scale"] = ("""SELECT ticker, T, alt_weight, runs, method, round(CallPrice, 6) AS CallPrice, round(PutPrice, 6) AS PutPrice FROM top""")


def conv_report_sql(name: str) -> str:
    """The SQL of a convergence report. The closed form alone needs no sampled paths."""
    analytic = closed_form("an", "cc", [1], ("black_scholes",))
    ctes = [CC] + analytic if name == "bs_consistency" else conv_ctes(name in STUDY_REPORTS) + (analytic if name == "premium_over_bs" else [])
    return with_ctes(NEEDS, CONV_BODIES[name], ctes)


SQL.update({name: conv_report_sql(name) for name in CONV_BODIES})


# ---------------------------------------------------------------- accuracy at scales, sweeps, EMC
ACC_SCALES = [250, 500, 1000]


def cmp_ctes(priced_union: str, p: str) -> list:
    return [(f"{p}_cmp", f"""SELECT u.*, a.actual_call, a.actual_put FROM ({priced_union}) u
        LEFT JOIN actual a USING (ticker, K, T)"""),
            (f"{p}_err", f"""SELECT *, 'call' AS option_type, (CallPrice - actual_call) / actual_call * 100.0 AS pe,
                CallPrice - actual_call AS err FROM {p}_cmp WHERE actual_call IS NOT NULL AND actual_call > 0.5
            UNION ALL SELECT *, 'put', (PutPrice - actual_put) / actual_put * 100.0, PutPrice - actual_put FROM {p}_cmp
                WHERE actual_put IS NOT NULL AND actual_put > 0.5""")]


def acc_methods(scales: list[int], emc: bool = False, methods=None) -> tuple[list, list[str]]:
    c = common("contracts_h", max(scales))
    outs = []
    specs = [("hi", "historical", lambda p: ls_iid(p, "historical"), False),
             ("w1", "window", lambda p: ls_window(p, 1), True), ("w10", "window_10d", lambda p: ls_window(p, 10), True),
             ("w20", "window_20d", lambda p: ls_window(p, 20), True),
             ("tm", "student_t", lambda p: ls_tmix(p, 0.1), False),
             ("bl", "block_bootstrap", lambda p: ls_block(p, 5.0), False),
             ("mf", "multifractal_empirical", lambda p: ls_cascade(p, LAM), False)]
    for p, m, gen, exact in specs:
        if methods is not None and m not in methods:
            continue
        if m == "student_t":
            c += tfit_ctes()
        c += gen(p) + priced(p, m, "contracts_h", scales, exact, emc)
        outs.append(f"{p}_out")
    return c, outs


_c, _o = acc_methods(ACC_SCALES)
_c += closed_form("cf", "contracts_h", ACC_SCALES)
SQL["mape_by_scale"] = with_ctes(NEEDS + ["actual"], """SELECT option_type, method, Runs AS num_runs, round(avg(abs(pe)), 6) AS mape
    FROM sc_err GROUP BY 1, 2, 3""", _c + cmp_ctes(union(_o + ["cf_out"]), "sc"))

BLOCK_LENGTHS = [1, 2, 3, 5, 8, 13, 21]
_c = common("contracts_h", N)
_u = []
for L in BLOCK_LENGTHS:
    _c += ls_block(f"b{L}", float(L)) + priced(f"b{L}", "block_bootstrap", "contracts_h", [N])
    _u.append(f"SELECT CAST({L} AS INTEGER) AS block_len, * FROM b{L}_out")
SQL["block_sweep"] = with_ctes(NEEDS + ["actual"], """SELECT block_len, n, round(put_mape, 6) AS put_mape,
    block_len = (SELECT arg_min(block_len, (put_mape, block_len)) FROM pm) AS best FROM pm""",
    _c + [("bsw", " UNION ALL ".join(_u)),
          ("pm", """SELECT block_len, count(*) AS n, avg(abs((b.PutPrice - a.actual_put) / a.actual_put * 100.0)) AS put_mape
            FROM bsw b LEFT JOIN actual a USING (ticker, K, T) WHERE a.actual_put IS NOT NULL AND a.actual_put > 0.5
            GROUP BY block_len""")])

LAMBDAS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8]
_c = common("contracts_h", N)
_u = []
for i, lam in enumerate(LAMBDAS):
    _c += ls_cascade(f"l{i}", lam) + priced(f"l{i}", "multifractal_empirical", "contracts_h", [N])
    _u.append(f"SELECT {d(lam)} AS lam, * FROM l{i}_out")
SQL["lambda_sweep"] = with_ctes(NEEDS + ["actual"], """SELECT lam, n, round(put_mape, 6) AS put_mape,
    lam = (SELECT arg_min(lam, (put_mape, lam)) FROM pm) AS best FROM pm""",
    _c + [("lsw", " UNION ALL ".join(_u)),
          ("pm", """SELECT lam, count(*) AS n, avg(abs((b.PutPrice - a.actual_put) / a.actual_put * 100.0)) AS put_mape
            FROM lsw b LEFT JOIN actual a USING (ticker, K, T) WHERE a.actual_put IS NOT NULL AND a.actual_put > 0.5 GROUP BY lam""")])

EMC_TARGETS = ["historical", "window", "block_bootstrap"]
_pre, _po = acc_methods([N], False, EMC_TARGETS)
_post, _qo = acc_methods([N], True, EMC_TARGETS)


def _rename(ctes: list, outs: list[str], tag: str) -> tuple[list, list[str]]:
    shared = {"ret_idx", "hz", "paths", "steps", "zres", "rx", "tgrid"}
    names = [n for n, _ in ctes if n not in shared]
    import re
    pat = re.compile(r"\b(" + "|".join(re.escape(m) for m in sorted(names, key=len, reverse=True)) + r")\b")
    out = []
    for n, s in ctes:
        if n in shared:
            continue
        out.append((tag + n, pat.sub(lambda mm: tag + mm.group(1), s)))
    return out, [tag + o for o in outs]


_post, _qo = acc_methods([N], True, EMC_TARGETS)
_post, _qo = _rename(_post, _qo, "e_")
SQL["emc_effect"] = with_ctes(NEEDS + ["actual"], """SELECT coalesce(a.option_type, b.option_type) AS option_type,
    coalesce(a.method, b.method) AS method, round(a.mape, 2) AS mape_pre, round(b.mape, 2) AS mape_post,
    round(b.mape - a.mape, 2) AS delta
    FROM (SELECT option_type, method, avg(abs(pe)) AS mape FROM pre_err GROUP BY 1, 2) a
    FULL OUTER JOIN (SELECT option_type, method, avg(abs(pe)) AS mape FROM post_err GROUP BY 1, 2) b
      ON a.option_type = b.option_type AND a.method = b.method""",
    _pre + _post + cmp_ctes(union(_po), "pre") + cmp_ctes(union(_qo), "post"))

# ---------------------------------------------------------------- pricing steps on the i.i.d. sampler
_iid = common("contracts_h", N) + ls_iid("hi", "historical")
SQL["clip_log_sum"] = with_ctes(NEEDS, """SELECT hist_ticker, T, count(*) AS n, count(*) FILTER (WHERE abs(log_sum) > 10) AS n_clipped,
    round(max(greatest(least(log_sum, 10.0), -10.0)), 6) AS max_clipped, round(min(greatest(least(log_sum, 10.0), -10.0)), 6) AS min_clipped
    FROM hi_ls GROUP BY 1, 2""", _iid)
SQL["terminal_price"] = with_ctes(NEEDS, f"""SELECT ticker, T, round(avg(ST), 6) AS mean_ST, round(min(ST), 6) AS min_ST,
    round(max(ST), 6) AS max_ST FROM (SELECT c.ticker, c.T, c.S0 * exp(greatest(least(l.log_sum, {d(10.0)}), {d(-10.0)})) AS ST
    FROM hi_ls l JOIN (SELECT DISTINCT ticker, hist_ticker, T, S0 FROM contracts_h) c USING (hist_ticker, T)) GROUP BY 1, 2""", _iid)
SQL["martingale_correct"] = with_ctes(NEEDS, f"""SELECT hist_ticker, T, round(avg(g), 6) AS mean_growth,
    round(exp(rate.r * CAST(T AS DOUBLE) / {d(252.0)}) / avg(g), 6) AS factor
    FROM (SELECT hist_ticker, T, exp(greatest(least(log_sum, {d(10.0)}), {d(-10.0)})) AS g FROM hi_ls) CROSS JOIN rate
    GROUP BY hist_ticker, T, rate.r""", _iid)
SQL["payoffs"] = with_ctes(NEEDS, """SELECT ticker, round(K, 6) AS K, T, Runs, round(CallPrice, 6) AS CallPrice,
    round(PutPrice, 6) AS PutPrice FROM hi_out""", _iid + priced("hi", "historical", "contracts_h", [N]))
_methods = [("historical", False), ("window", False), ("window_10d", False), ("window_20d", False), ("student_t", False),
            ("black_scholes", True), ("multifractal", True), ("multifractal_empirical", True), ("block_bootstrap", False),
            ("fhs", False), ("fhs_rn", True), ("analogue", False)]
_mv = ", ".join(f"('{m}', {str(rn).lower()})" for m, rn in _methods)
SQL["discount"] = with_ctes(NEEDS, f"""SELECT t.T, m.method, round(CASE WHEN m.risk_neutral THEN exp(-rate.r * CAST(t.T AS DOUBLE) / {d(252.0)})
    ELSE 1.0 END, 6) AS discount FROM (SELECT DISTINCT T FROM contracts_h) t CROSS JOIN rate CROSS JOIN (VALUES {_mv}) m(method, risk_neutral)""")
_reg = [("historical", "iid", False, False), ("window", "window", False, False), ("window_10d", "window", False, False),
        ("window_20d", "window", False, False), ("student_t", "t_mixture", False, False),
        ("black_scholes", "closed_form", True, False), ("multifractal", "closed_form", True, False),
        ("multifractal_empirical", "cascade", True, False), ("block_bootstrap", "block", False, False),
        ("fhs", "filtered", False, False), ("fhs_rn", "filtered", True, True), ("analogue", "analogue", False, False)]
_rv = ", ".join(f"('{m}', '{f}', {str(rn).lower()}, {str(e).lower()})" for m, f, rn, e in _reg)
SQL["method_registry"] = f"""SELECT method, family, risk_neutral, emc,
    emc OR method IN ('historical', 'window', 'block_bootstrap') AS emc_with_extras FROM (VALUES {_rv}) t(method, family, risk_neutral, emc)"""
