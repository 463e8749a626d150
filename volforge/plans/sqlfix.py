"""SQL text (DuckDB dialect) of the fixture views, written independently of the Spark code.

``with_ctes(names, body)`` prefixes a query with every CTE it needs, in dependency order. Decimal
literals are written as DOUBLE so both engines do the same floating-point operations."""
from __future__ import annotations

from ..functions import mathfn


def d(x: float) -> str:
    """A DOUBLE literal."""
    return f"CAST({x!r} AS DOUBLE)"


def rnd(x: str, digits: int) -> str:
    """Round half up on the binary value (see functions.mathfn.round_half_up)."""
    sc = f"CAST({10 ** digits} AS DOUBLE)"
    return f"(CASE WHEN isnan({x}) THEN ({x}) ELSE floor(({x}) * {sc} + {d(0.5)}) / {sc} END)"


def norm_cdf_sql(x: str) -> str:
    ax = f"abs({x})"
    def horner(cs):
        acc = d(cs[0])
        for c in cs[1:]:
            acc = f"({acc} * {ax} + {d(c)})"
        return acc
    e = f"exp(-{ax} * {ax} / {d(2.0)})"
    near = f"({e} * {horner(mathfn._P)} / {horner(mathfn._Q)})"
    cf = f"({ax} + {d(0.65)})"
    for k in (4.0, 3.0, 2.0, 1.0):
        cf = f"({ax} + {d(k)} / {cf})"
    far = f"({e} / {cf} / {d(mathfn._SQRT_2PI)})"
    tail = f"(CASE WHEN {ax} > {d(mathfn._CUTOFF)} THEN {d(0.0)} WHEN {ax} < {d(mathfn._SPLIT)} THEN {near} ELSE {far} END)"
    return f"(CASE WHEN ({x}) > 0 THEN {d(1.0)} - {tail} ELSE {tail} END)"


def busdays_sql(b: str, e: str) -> str:
    def wd(s, n):
        dow = f"(isodow({s}) - 1)"
        return (f"(5 * (({n}) // 7) + greatest(0, least(({n}) % 7, 5 - {dow}))"
                f" + greatest(0, least({dow} + ({n}) % 7 - 7, 5)))")
    n = f"(({e}) - ({b}))"
    return f"CAST(CASE WHEN {n} >= 0 THEN {wd(b, n)} ELSE -{wd(f'(({e}) + 1)', f'(-{n})')} END AS INTEGER)"


def price_cte(prefix: str, day_sql: str, name: str) -> dict[str, str]:
    return {
        f"{prefix}_z": f"""SELECT *, (m - avg(m) OVER (PARTITION BY ticker)) / stddev_pop(m) OVER (PARTITION BY ticker) AS z
            FROM ({day_sql})""",
        f"{prefix}_lv": f"""SELECT *, {rnd(d(100.0) + ' * exp(sum(' + d(0.01) + ' * z + ' + d(0.0002) + ') OVER (PARTITION BY ticker ORDER BY "Date" ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))', 4)} AS "Close" FROM {prefix}_z""",
        f"{prefix}_oc": f"""SELECT *, coalesce(lag("Close") OVER (PARTITION BY ticker ORDER BY "Date"), "Close") AS "Open" FROM {prefix}_lv""",
        name: f"""SELECT ticker, "Date", "Open", greatest("Open", "Close") AS "High", least("Open", "Close") AS "Low",
            "Close", "Close" AS "Adj_Close", CAST(Volume AS BIGINT) AS "Volume" FROM {prefix}_oc""",
    }


CTES: dict[str, str] = {}
DEPS: dict[str, list[str]] = {}


def cte(name: str, sql: str, deps: list[str] | None = None):
    CTES[name] = sql
    DEPS[name] = deps or []


# --- prices (one series per order priority) and the nation x priority variant
def _chain(items: dict[str, str]):
    prev = None
    for k, v in items.items():
        cte(k, v, [prev] if prev else [])
        prev = k


_chain(price_cte("px", """SELECT o_orderpriority AS ticker, CAST(o_orderdate AS DATE) AS "Date",
        avg(o_totalprice) AS m, count(*) AS Volume FROM orders GROUP BY 1, 2""", "prices"))
_chain(price_cte("pn", """SELECT 'N' || lpad(CAST(c.c_nationkey AS VARCHAR), 2, '0') || '.' || o.o_orderpriority AS ticker,
        CAST(o.o_orderdate AS DATE) AS "Date", avg(o.o_totalprice) AS m, count(*) AS Volume
        FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey GROUP BY 1, 2""", "prices_nation"))

# --- returns and per-ticker statistics
cte("returns", """SELECT ticker, "Date", "Adj_Close",
        "Adj_Close" / lag("Adj_Close") OVER (PARTITION BY ticker ORDER BY "Date") - 1 AS pct_change,
        ln("Adj_Close" / lag("Adj_Close") OVER (PARTITION BY ticker ORDER BY "Date")) AS log_return
    FROM prices""", ["prices"])
cte("vstats", f"""SELECT ticker, count(*) AS n, avg(log_return) AS mu, stddev_pop(log_return) AS std,
        stddev_pop(log_return) * sqrt({d(252.0)}) AS vol
    FROM returns WHERE log_return IS NOT NULL GROUP BY ticker""", ["returns"])
cte("rate", f"""SELECT coalesce((SELECT arg_max("Close", "Date") FROM prices WHERE ticker = '^IRX') / {d(100.0)}, {d(0.045)}) AS r""",
    ["prices"])
cte("hmap", """SELECT * FROM (VALUES ('1-URGENT', '2-HIGH')) t(option_ticker, hist_ticker)""")

# --- option quotes
cte("qr_state", """SELECT ticker, arg_max("Adj_Close", "Date") AS S0, max("Date") AS quote_date FROM prices GROUP BY ticker""",
    ["prices"])
cte("qr_base", f"""SELECT o.o_orderpriority AS ticker, s.S0, s.quote_date, l.l_orderkey, l.l_partkey, l.l_suppkey,
        l.l_linenumber, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax, l.l_returnflag,
        l.l_linestatus = 'F' AS is_call,
        {rnd('s.S0 * (CAST(703 + 10 * (l.l_partkey % 61) AS DOUBLE) / ' + d(1000.0) + ')', 2)} AS strike
    FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey JOIN qr_state s ON s.ticker = o.o_orderpriority""",
    ["qr_state"])
cte("qr_last", f"""SELECT *, CASE WHEN l_quantity = {d(50.0)} THEN {d(0.0)} ELSE {rnd(
        'CASE WHEN is_call THEN greatest(S0 - strike, ' + d(0.0) + ') ELSE greatest(strike - S0, ' + d(0.0) + ') END + '
        + d(0.05) + ' * l_quantity', 2)} END AS "last" FROM qr_base""", ["qr_base"])
cte("quotes_raw", f"""SELECT ticker, quote_date,
        quote_date + CAST(1 + (7 * l_suppkey + l_linenumber) % 90 AS INTEGER) AS expiration_date,
        CASE WHEN is_call THEN 'call' ELSE 'put' END AS option_type, strike, "last",
        CASE WHEN l_discount = {d(0.0)} THEN NULL ELSE {rnd('"last" * (' + d(1.0) + ' - l_tax)', 2)} END AS bid,
        CASE WHEN l_discount = {d(0.01)} THEN {d(0.0)} ELSE {rnd('"last" * (' + d(1.0) + ' + l_tax)', 2)} END AS ask,
        CASE WHEN l_returnflag = 'N' THEN NULL ELSE CAST(l_quantity AS INTEGER) END AS volume,
        CAST(l_partkey % 40 AS INTEGER) AS open_interest,
        {d(0.10)} + l_tax AS implied_volatility, S0 AS underlying_price,
        l_orderkey AS ck_order, l_linenumber AS ck_line, l_partkey AS ck_part, l_suppkey AS ck_supp,
        l_extendedprice AS ck_price
    FROM qr_last""", ["qr_last"])

# --- option chain (O1..O8)
cte("ch_days", f"""SELECT *, {busdays_sql('quote_date', 'expiration_date')} AS days_to_expiry FROM quotes_raw""",
    ["quotes_raw"])
cte("ch_win", """SELECT * FROM ch_days WHERE days_to_expiry BETWEEN 5 AND 60""", ["ch_days"])
cte("ch_exp", """SELECT * EXCLUDE (er) FROM (SELECT *, dense_rank() OVER (PARTITION BY ticker ORDER BY expiration_date) AS er
    FROM ch_win) WHERE er <= 12""", ["ch_win"])
cte("ch_flt", f"""SELECT * FROM ch_win WHERE coalesce(volume, 0) >= 1 AND coalesce(open_interest, 0) >= 10 AND "last" > 0
        AND strike >= {d(0.8)} * underlying_price AND strike <= {d(1.2)} * underlying_price""", ["ch_win"])
cte("ch_pos", """SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY expiration_date, option_type, strike,
        ck_order, ck_line, ck_part, ck_supp, ck_price) AS pos FROM ch_flt""", ["ch_flt"])
cte("option_chain", f"""SELECT ticker, expiration_date, days_to_expiry, option_type, strike, "last" AS last_price,
        coalesce(bid, {d(0.0)}) AS bid, coalesce(ask, {d(0.0)}) AS ask,
        CASE WHEN coalesce(bid, 0) > 0 AND coalesce(ask, 0) > 0 THEN (coalesce(bid, 0) + coalesce(ask, 0)) / {d(2.0)}
             ELSE "last" END AS mid_price,
        coalesce(implied_volatility, {d(0.0)}) AS implied_volatility,
        CAST(coalesce(volume, 0) AS INTEGER) AS volume, CAST(coalesce(open_interest, 0) AS INTEGER) AS open_interest,
        underlying_price, ck_order, ck_line, pos AS chain_pos
    FROM ch_pos""", ["ch_pos"])
cte("capped", """SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY ticker ORDER BY chain_pos) AS cap_pos FROM option_chain c
        WHERE (ticker, expiration_date) IN (SELECT (ticker, expiration_date) FROM ch_exp)) WHERE cap_pos <= 120""",
    ["option_chain", "ch_exp"])

# --- accuracy-study contract grid and observed mids
cte("combos", """SELECT ticker, strike, days_to_expiry, option_type, min(chain_pos) AS chain_pos,
        arg_min(underlying_price, chain_pos) AS underlying_price, arg_min(mid_price, chain_pos) AS mid_price
    FROM option_chain GROUP BY 1, 2, 3, 4""", ["option_chain"])
cte("sampled", """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY
        md5(concat_ws(':', '42', ticker, CAST(CAST(round(strike * 100) AS BIGINT) AS VARCHAR),
                      CAST(days_to_expiry AS VARCHAR), option_type)), chain_pos) AS rn FROM combos) WHERE rn <= 30""",
    ["combos"])
cte("contracts", """SELECT ticker, strike AS K, days_to_expiry AS T, min(underlying_price) AS S0 FROM combos GROUP BY 1, 2, 3""",
    ["combos"])
cte("actual", """SELECT ticker, strike AS K, days_to_expiry AS T,
        arg_min(mid_price, chain_pos) FILTER (WHERE option_type = 'call') AS actual_call,
        arg_min(mid_price, chain_pos) FILTER (WHERE option_type = 'put') AS actual_put
    FROM option_chain GROUP BY 1, 2, 3""", ["option_chain"])
cte("contracts_h", """SELECT c.*, coalesce(h.hist_ticker, c.ticker) AS hist_ticker
    FROM contracts c LEFT JOIN hmap h ON c.ticker = h.option_ticker""", ["contracts", "hmap"])
cte("cf_in", f"""SELECT c.ticker, c.K, c.T, c.S0, v.vol, rate.r, CAST(c.T AS DOUBLE) / {d(252.0)} AS tau
    FROM contracts_h c JOIN vstats v ON v.ticker = c.hist_ticker CROSS JOIN rate""", ["contracts_h", "vstats", "rate"])
cte("cf_d", f"""SELECT *, (ln(S0 / K) + (r + {d(0.5)} * vol * vol) * tau) / (vol * sqrt(tau)) AS d1,
        (ln(S0 / K) + (r + {d(0.5)} * vol * vol) * tau) / (vol * sqrt(tau)) - vol * sqrt(tau) AS d2 FROM cf_in""",
    ["cf_in"])
cte("cf_px", f"""SELECT ticker, K, T, S0,
        S0 * {norm_cdf_sql('d1')} - K * exp(-r * tau) * {norm_cdf_sql('d2')} AS CallPrice,
        K * exp(-r * tau) * {norm_cdf_sql('-d2')} - S0 * {norm_cdf_sql('-d1')} AS PutPrice FROM cf_d""", ["cf_d"])


def _order(names: list[str]) -> list[str]:
    out: list[str] = []
    def visit(n):
        if n in out:
            return
        for dep in DEPS[n]:
            visit(dep)
        out.append(n)
    for n in names:
        visit(n)
    return out


def half_up(sql_text: str) -> str:
    """Rewrite every two-argument ``round(x, n)`` into :func:`rnd` so output rounding is the same
    IEEE computation as the Spark plans' ``round_half_up``."""
    out, i, low = [], 0, sql_text.lower()
    while True:
        j = low.find("round(", i)
        if j < 0 or (j > 0 and (low[j - 1].isalnum() or low[j - 1] == "_")):
            if j < 0:
                out.append(sql_text[i:])
                return "".join(out)
            out.append(sql_text[i:j + 6])
            i = j + 6
            continue
        depth, k, comma = 1, j + 6, -1
        while depth:
            ch = sql_text[k]
            if ch == "(":
                depth += 1
            elif ch == ")":
                depth -= 1
            elif ch == "," and depth == 1:
                comma = k
            k += 1
        out.append(sql_text[i:j])
        inner = sql_text[j + 6:k - 1]
        if comma < 0:
            out.append("round(" + half_up(inner) + ")")
        else:
            out.append(rnd(half_up(sql_text[j + 6:comma]), int(sql_text[comma + 1:k - 1].strip())))
        i = k


def with_ctes(names: list[str], body: str, extra: list[tuple[str, str]] | None = None) -> str:
    """``WITH <fixtures needed>, <extra CTEs> <body>``."""
    parts = [f"{n} AS ({CTES[n]})" for n in _order(names)]
    seen = set()
    for n, s in extra or []:
        if n not in seen:          # a helper CTE shared by several sampler families is defined once
            seen.add(n)
            # drawn indices are computed once, before DuckDB picks a join order for the returns they point at
            parts.append(f"{n} AS {'MATERIALIZED ' if n.endswith('_ix') else ''}({s})")
    return half_up(("WITH " + ",\n".join(parts) + "\n" + body) if parts else body)
