"""Independent DuckDB SQL for every registered plan that is expressible in SQL.

Doubles are rounded exactly as the Spark plans round them (``rounded`` in common.py)."""
from __future__ import annotations

from .sqlfix import busdays_sql, d, half_up, rnd, with_ctes

SQL: dict[str, str] = {}


def sql(name: str, needs: list[str], body: str, extra=None):
    SQL[name] = with_ctes(needs, body, extra)


def r(expr: str, digits: int = 6, alias: str | None = None) -> str:
    return f"round({expr}, {digits}) AS {alias or expr}"


PRICE_COLS = '''ticker, "Date", round("Open", 6) AS "Open", round("High", 6) AS "High", round("Low", 6) AS "Low",
    round("Close", 6) AS "Close", round("Adj_Close", 6) AS "Adj_Close", "Volume"'''

sql("prices", ["prices"], f"SELECT {PRICE_COLS} FROM prices")

sql("read_history", ["returns"], """SELECT ticker, "Date", round("Adj_Close", 8) AS "Adj_Close",
    round(log_return, 8) AS log_return FROM returns WHERE log_return IS NOT NULL AND NOT isnan(log_return)""")

sql("latest_close", ["prices"], """SELECT ticker, round(arg_max("Adj_Close", "Date"), 6) AS S0, max("Date") AS last_date
    FROM prices GROUP BY ticker""")

sql("return_array", ["returns"], """SELECT ticker, count(*) AS n,
    round(arg_min(log_return, "Date"), 8) AS first_return, round(arg_max(log_return, "Date"), 8) AS last_return,
    round(list_sum(list(log_return ORDER BY "Date")), 8) AS sum_returns
    FROM returns WHERE log_return IS NOT NULL GROUP BY ticker""")

sql("adj_close", ["prices"], """SELECT ticker, "Date", round("Close", 6) AS "Close", round("Close", 6) AS "Adj_Close" FROM prices""")

sql("pct_change", ["returns"], """SELECT ticker, "Date", round(pct_change, 8) AS pct_change FROM returns""")
sql("log_return", ["returns"], """SELECT ticker, "Date", round(log_return, 8) AS log_return FROM returns""")
sql("drop_incomplete", ["returns"], """SELECT ticker, count(*) AS rows_kept, min("Date") AS first_date
    FROM returns WHERE log_return IS NOT NULL GROUP BY ticker""")

PT = """SELECT ticker, "Date", round("Open", 8) AS "Open", round("High", 8) AS "High", round("Low", 8) AS "Low",
    round("Close", 8) AS "Close", round("Adj_Close", 8) AS "Adj_Close", "Volume",
    round(pct_change, 8) AS pct_change, round(log_return, 8) AS log_return"""
sql("project_prices", ["prices", "returns"], f"""{PT} FROM (SELECT p.*, r.pct_change, r.log_return FROM prices p
    JOIN returns r USING (ticker, "Date") WHERE r.log_return IS NOT NULL)""")

STORED = """stored AS (SELECT p.*, r.pct_change, r.log_return FROM prices p JOIN returns r USING (ticker, "Date")
    WHERE r.log_return IS NOT NULL AND ticker IN ('1-URGENT', '2-HIGH', '3-MEDIUM') AND "Date" < DATE '2001-01-01')"""


def with_stored(body: str, needs=("prices", "returns"), extra=None) -> str:
    base = with_ctes(list(needs), "", extra)
    return half_up(base.rstrip() + ",\n" + STORED + "\n" + body)


sql("existing_tickers", ["prices", "returns"], "SELECT DISTINCT ticker FROM returns WHERE log_return IS NOT NULL")
sql("latest_dates", ["prices", "returns"], """SELECT ticker, max("Date") AS max_date FROM returns
    WHERE log_return IS NOT NULL GROUP BY ticker""")
SQL["missing_tickers"] = with_stored("""SELECT ticker, CAST(ordinal AS INTEGER) AS ordinal FROM
    (SELECT ticker, dense_rank() OVER (ORDER BY ticker) AS ordinal FROM (SELECT DISTINCT ticker FROM prices))
    WHERE ticker NOT IN (SELECT ticker FROM stored)""")
# increment: landed rows after the high-water mark; the return of the first new row uses the stored last row,
# i.e. it is the ordinary lag over the full landed series (the stored rows are a prefix of it).
INC = """, hw AS (SELECT ticker, max("Date") AS max_date FROM stored GROUP BY ticker),
    inc AS (SELECT p.*, r.pct_change, r.log_return FROM prices p JOIN returns r USING (ticker, "Date")
            LEFT JOIN hw USING (ticker) WHERE (hw.max_date IS NULL OR p."Date" > hw.max_date) AND r.log_return IS NOT NULL)"""
SQL["increment_after"] = with_stored(INC + "\n" + PT + " FROM inc")
SQL["upsert_prices"] = with_stored(INC + ", merged AS (SELECT * FROM inc UNION ALL SELECT * FROM stored s WHERE NOT EXISTS "
                                   "(SELECT 1 FROM inc i WHERE i.ticker = s.ticker AND i.\"Date\" = s.\"Date\"))\n"
                                   + PT + " FROM merged")
SQL["upsert_prices_sink"] = with_stored(""", landed AS (SELECT p.*, r.pct_change, r.log_return FROM prices p JOIN returns r USING (ticker, "Date")
    WHERE r.log_return IS NOT NULL AND "Date" >= DATE '2000-07-01'),
    merged AS (SELECT * FROM landed UNION ALL SELECT * REPLACE (CAST(-1 AS BIGINT) AS Volume) FROM stored WHERE "Date" < DATE '2000-07-01')
    """ + PT + " FROM merged")
SQL["table_stats"] = with_stored(INC + ", merged AS (SELECT ticker, \"Date\" FROM inc UNION ALL SELECT ticker, \"Date\" FROM stored)\n"
                                 "SELECT count(*) AS row_count, count(DISTINCT ticker) AS ticker_count FROM merged")

JOB_LOG = f"""job_log AS (SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS created_at,
    CASE WHEN o_orderstatus = 'O' THEN 'QUEUED' WHEN o_orderstatus = 'P' THEN 'RUNNING'
         WHEN o_orderkey % 10 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
    o_orderpriority AS p_ticker, {rnd('o_totalprice / ' + d(1000.0), 2)} AS p_strike,
    CAST(5 + o_orderkey % 60 AS INTEGER) AS p_period, CAST(1000 * (1 + o_orderkey % 5) AS INTEGER) AS p_sims,
    o_orderkey FROM orders)"""

sql("valid_ticker", [], """SELECT p_ticker AS ticker, count(*) AS n_jobs,
    coalesce(regexp_full_match(p_ticker, '^[A-Za-z0-9.\\-^=]{1,16}$'), false) AS valid FROM job_log GROUP BY p_ticker""",
    [("job_log", JOB_LOG.split(" AS (", 1)[1][:-1])])
sql("valid_job_params", [], """SELECT id, CAST(len(errs) AS INTEGER) AS n_errors, array_to_string(errs, '; ') AS errors FROM (
    SELECT id, list_filter([CASE WHEN NOT coalesce(regexp_full_match(p_ticker, '^[A-Za-z0-9.\\-^=]{1,16}$'), false) THEN 'invalid ticker' END,
                 CASE WHEN coalesce(p_strike, 0) <= 0 THEN 'strike must be > 0' END,
                 CASE WHEN coalesce(p_period, 0) <= 0 THEN 'period_days must be > 0' END,
                 CASE WHEN coalesce(p_sims, 0) <= 0 THEN 'num_simulations must be > 0' END], lambda x: x IS NOT NULL) AS errs
    FROM job_log)""", [("job_log", JOB_LOG.split(" AS (", 1)[1][:-1])])

QR_COLS = """ticker, quote_date, expiration_date, option_type, round(strike, 6) AS strike, round("last", 6) AS "last",
    round(bid, 6) AS bid, round(ask, 6) AS ask, volume, open_interest, round(implied_volatility, 6) AS implied_volatility,
    round(underlying_price, 6) AS underlying_price, ck_order, ck_line, ck_part, ck_supp, round(ck_price, 6) AS ck_price"""
sql("quotes_raw", ["quotes_raw"], f"SELECT {QR_COLS} FROM quotes_raw")
sql("busdays_to_expiry", ["ch_days"], "SELECT DISTINCT quote_date, expiration_date, days_to_expiry FROM ch_days")
sql("expiry_window", ["ch_win"], "SELECT ticker, days_to_expiry, count(*) AS n FROM ch_win GROUP BY 1, 2")
sql("first_n_expiries", ["ch_exp"], "SELECT ticker, expiration_date, count(*) AS n FROM ch_exp GROUP BY 1, 2")
sql("liquidity_filter", ["quotes_raw"], """SELECT ticker, option_type, count(*) AS n FROM quotes_raw
    WHERE coalesce(volume, 0) >= 1 AND coalesce(open_interest, 0) >= 10 AND "last" > 0 GROUP BY 1, 2""")
sql("strike_band", ["quotes_raw"], f"""SELECT ticker, option_type, count(*) AS n FROM quotes_raw
    WHERE strike >= {d(0.8)} * underlying_price AND strike <= {d(1.2)} * underlying_price GROUP BY 1, 2""")
sql("mid_price", ["quotes_raw"], f"""SELECT ticker, option_type, count(*) AS n, round(sum(mid), 4) AS sum_mid,
    CAST(sum(CASE WHEN mid = "last" THEN 1 ELSE 0 END) AS BIGINT) AS n_last_fallback FROM (
    SELECT *, CASE WHEN coalesce(bid, 0) > 0 AND coalesce(ask, 0) > 0 THEN (coalesce(bid, 0) + coalesce(ask, 0)) / {d(2.0)}
                   ELSE "last" END AS mid FROM quotes_raw) GROUP BY 1, 2""")
CH_COLS = """ticker, expiration_date, days_to_expiry, option_type, round(strike, 6) AS strike, round(last_price, 6) AS last_price,
    round(bid, 6) AS bid, round(ask, 6) AS ask, round(mid_price, 6) AS mid_price,
    round(implied_volatility, 6) AS implied_volatility, volume, open_interest, round(underlying_price, 6) AS underlying_price,
    ck_order, ck_line"""
sql("option_chain", ["option_chain"], f"SELECT {CH_COLS} FROM option_chain")
sql("row_cap", ["capped"], """SELECT ticker, count(*) AS rows, count(DISTINCT expiration_date) AS expirations,
    round(arg_max(strike, cap_pos), 6) AS last_strike FROM capped GROUP BY ticker""")
sql("chain_breakdown", ["option_chain"], """SELECT ticker, count(*) FILTER (WHERE option_type = 'call') AS call,
    count(*) FILTER (WHERE option_type = 'put') AS put FROM option_chain GROUP BY ticker""")
sql("chain_ranges", ["option_chain"], """SELECT min(days_to_expiry) AS min_days, max(days_to_expiry) AS max_days,
    round(min(strike), 6) AS min_strike, round(max(strike), 6) AS max_strike, count(DISTINCT ticker) AS n_tickers,
    count(DISTINCT expiration_date) AS n_expirations, count(*) AS n_rows FROM option_chain""")
sql("chain_by_ticker", ["option_chain"], """SELECT ticker, count(*) AS rows, round(arg_min(underlying_price, chain_pos), 6) AS S0,
    count(DISTINCT days_to_expiry) AS expirations FROM option_chain GROUP BY ticker""")
sql("option_type_counts", ["option_chain"], "SELECT option_type, count(*) AS n FROM option_chain GROUP BY 1")

sql("vol_stats", ["vstats"], f"""SELECT ticker, n, round(mu, 8) AS mu, round(std, 8) AS std, round(vol, 8) AS vol FROM vstats""")
# population skewness / excess kurtosis written from central moments (DuckDB's skewness is sample-corrected)
sql("tail_stats", ["returns"], """SELECT ticker, round(m3 / pow(m2, 1.5), 6) AS skewness, round(m4 / (m2 * m2) - 3, 6) AS kurtosis FROM (
    SELECT r.ticker, avg(pow(log_return - mu, 2)) AS m2, avg(pow(log_return - mu, 3)) AS m3, avg(pow(log_return - mu, 4)) AS m4
    FROM returns r JOIN (SELECT ticker, avg(log_return) AS mu FROM returns WHERE log_return IS NOT NULL GROUP BY ticker) USING (ticker)
    WHERE log_return IS NOT NULL GROUP BY r.ticker)""")
sql("residual_pool", ["returns"], """SELECT r.ticker, r."Date",
    round(CASE WHEN s.n >= 2 AND s.sd > 0 THEN (log_return - s.m) / s.sd END, 8) AS z, (s.n < 2 OR s.sd = 0) AS degenerate
    FROM returns r JOIN (SELECT ticker, count(*) AS n, avg(log_return) AS m, stddev_pop(log_return) AS sd FROM returns
    WHERE log_return IS NOT NULL GROUP BY ticker) s USING (ticker) WHERE log_return IS NOT NULL""")

# ---------------------------------------------------------------- closed form and accuracy study
CMP = [("priced", """SELECT ticker, K, T, S0, 0 AS Runs, m.method, CallPrice, PutPrice FROM cf_px
        CROSS JOIN (VALUES ('black_scholes'), ('multifractal')) m(method)"""),
       ("cmp", """SELECT p.ticker, p.K, p.T, p.S0, p.Runs AS num_runs, p.method, p.CallPrice AS mc_call,
        p.PutPrice AS mc_put, a.actual_call, a.actual_put FROM priced p LEFT JOIN actual a USING (ticker, K, T)"""),
       ("errs", """SELECT ticker, K, T, S0, num_runs, method, 'call' AS option_type, mc_call - actual_call AS error,
            (mc_call - actual_call) / actual_call * 100.0 AS pct_error FROM cmp WHERE actual_call IS NOT NULL AND actual_call > 0.5
        UNION ALL SELECT ticker, K, T, S0, num_runs, method, 'put', mc_put - actual_put,
            (mc_put - actual_put) / actual_put * 100.0 FROM cmp WHERE actual_put IS NOT NULL AND actual_put > 0.5""")]
CF = ["cf_px", "actual"]
REPORT = """SELECT option_type, method, count(*) AS n, round(avg(abs(error)), 6) AS mae, round(avg(abs(pct_error)), 6) AS mape,
    round(median(pct_error), 6) AS median_pct_error FROM {src} GROUP BY 1, 2"""

sql("risk_free_rate", ["rate"], "SELECT round(r, 6) AS r FROM rate")
sql("map_history_ticker", ["contracts_h", "vstats"], """SELECT c.ticker, c.hist_ticker, round(c.K, 6) AS K, c.T, round(c.S0, 6) AS S0
    FROM contracts_h c JOIN vstats v ON v.ticker = c.hist_ticker""")
sql("dedupe_quotes", ["option_chain"], """SELECT ticker, round(strike, 6) AS strike, days_to_expiry, option_type,
    round(arg_min(mid_price, chain_pos), 6) AS mid_price, round(arg_min(last_price, chain_pos), 6) AS last_price,
    round(arg_min(underlying_price, chain_pos), 6) AS underlying_price
    FROM option_chain GROUP BY 1, 2, 3, 4""")
sql("sample_contracts", ["sampled"], """SELECT ticker, round(strike, 6) AS strike, days_to_expiry, option_type FROM sampled""")
sql("distinct_kt", ["contracts"], "SELECT ticker, round(K, 6) AS K, T, round(S0, 6) AS S0 FROM contracts")
from .sqlfix import norm_cdf_sql  # noqa: E402
sql("norm_cdf", ["cf_d"], f"""SELECT ticker, round(K, 6) AS K, T, round({norm_cdf_sql('d1')}, 10) AS n_d1,
    round({norm_cdf_sql('d2')}, 10) AS n_d2 FROM cf_d""")
sql("bs_price", ["cf_d", "cf_px"], """SELECT d.ticker, round(d.K, 6) AS K, d.T, round(d.S0, 6) AS S0, round(vol, 6) AS vol,
    round(r, 6) AS r, round(d1, 6) AS d1, round(d2, 6) AS d2, round(CallPrice, 6) AS bs_call, round(PutPrice, 6) AS bs_put
    FROM cf_d d JOIN cf_px p USING (ticker, K, T)""")
_e2 = [("se_in", f"""SELECT d.*, p.CallPrice AS c, p.PutPrice AS p, exp(-r * tau) AS disc, vol * sqrt(tau) AS sq,
        exp(({d(2.0)} * r + vol * vol) * tau) AS grow FROM cf_d d JOIN cf_px p USING (ticker, K, T)"""),
       ("se_v", f"""SELECT ticker, K, T,
        disc * disc * (S0 * S0 * grow * {norm_cdf_sql('d1 + sq')} - {d(2.0)} * K * S0 * exp(r * tau) * {norm_cdf_sql('d1')}
                       + K * K * {norm_cdf_sql('d2')}) - c * c AS var_call,
        disc * disc * (K * K * {norm_cdf_sql('-d2')} - {d(2.0)} * K * S0 * exp(r * tau) * {norm_cdf_sql('-d1')}
                       + S0 * S0 * grow * {norm_cdf_sql('-d1 - sq')}) - p * p AS var_put FROM se_in""")]
sql("bs_stderr", ["cf_d", "cf_px"], """SELECT ticker, round(K, 6) AS K, T, round(var_call, 6) AS var_call, round(var_put, 6) AS var_put,
    round(var_call, 6) AS var_put_ref, round(sqrt(greatest(var_call, 0)) / sqrt(10000.0), 6) AS se_call,
    round(sqrt(greatest(var_put, 0)) / sqrt(10000.0), 6) AS se_put FROM se_v""", _e2)
sql("put_call_parity", ["cf_in", "cf_px"], f"""SELECT ticker, round(K, 6) AS K, T, round(i.S0 - K * exp(-r * tau), 6) AS parity_theoretical,
    round(CallPrice - PutPrice, 6) AS parity_sampled,
    abs((CallPrice - PutPrice) - (i.S0 - K * exp(-r * tau))) / abs(i.S0 - K * exp(-r * tau)) * 100.0 < 5.0 AS parity_ok
    FROM cf_in i JOIN cf_px p USING (ticker, K, T)""")
sql("actual_lookup", ["actual"], """SELECT ticker, round(K, 6) AS K, T, round(actual_call, 6) AS actual_call,
    round(actual_put, 6) AS actual_put FROM actual""")
sql("comparison", CF, """SELECT ticker, round(K, 6) AS K, T, round(S0, 6) AS S0, num_runs, method, round(mc_call, 6) AS mc_call,
    round(mc_put, 6) AS mc_put, round(actual_call, 6) AS actual_call, round(actual_put, 6) AS actual_put FROM cmp""", CMP)
sql("pricing_error", CF, """SELECT ticker, round(K, 6) AS K, T, method, option_type, round(error, 6) AS error,
    round(pct_error, 6) AS pct_error FROM errs""", CMP)
sql("error_report", CF, REPORT.format(src="errs"), CMP)
sql("best_method", CF, """SELECT option_type, arg_min(method, (round(mape, 6), method)) AS best_method, round(min(mape), 6) AS best_mape
    FROM (SELECT option_type, method, avg(abs(pct_error)) AS mape FROM errs GROUP BY 1, 2) GROUP BY 1""", CMP)
sql("mape_by_method", CF, "SELECT option_type, method, round(avg(abs(pct_error)), 6) AS mape FROM errs GROUP BY 1, 2", CMP)
ATM = "SELECT * FROM errs WHERE abs(K / S0 - 1.0) <= 0.05"
sql("atm_filter", CF, f"""SELECT ticker, round(K, 6) AS K, T, method, option_type, round(pct_error, 6) AS pct_error FROM ({ATM})""", CMP)
sql("atm_report", CF, """SELECT a.option_type, a.method, a.n, round(a.mae, 6) AS mae, round(a.mape, 6) AS mape,
    round(a.median_pct_error, 6) AS median_pct_error, b.best_atm, round(b.best_mape_atm, 6) AS best_mape_atm, c.best_all,
    round(c.best_mape_all, 6) AS best_mape_all, round(c.best_mape_all - b.best_mape_atm, 6) AS improvement
    FROM atm_rep a JOIN (SELECT option_type, arg_min(method, (round(mape, 6), method)) AS best_atm, min(mape) AS best_mape_atm FROM atm_rep GROUP BY 1) b
      USING (option_type)
    LEFT JOIN (SELECT option_type, arg_min(method, (round(mape, 6), method)) AS best_all, min(mape) AS best_mape_all FROM all_rep GROUP BY 1) c
      USING (option_type)""",
    CMP + [("atm_rep", f"""SELECT option_type, method, count(*) AS n, avg(abs(error)) AS mae, avg(abs(pct_error)) AS mape,
              median(pct_error) AS median_pct_error FROM ({ATM}) GROUP BY 1, 2"""),
           ("all_rep", "SELECT option_type, method, avg(abs(pct_error)) AS mape FROM errs GROUP BY 1, 2")])

SQL["concat_frames"] = with_stored(INC + """
SELECT ticker, source, count(*) AS n FROM (SELECT ticker, 'stored' AS source FROM stored UNION ALL SELECT ticker, 'increment' FROM inc)
GROUP BY 1, 2""")

# ST1: the streamed table equals the batch price table; ST2: the streamed fold equals the batch fold.
SQL["stream_prices"] = SQL["project_prices"]

# ---------------------------------------------------------------- D5..D7
FEATS = [("rr", """SELECT ticker, "Date", log_return FROM returns WHERE log_return IS NOT NULL AND NOT isnan(log_return)"""),
         ("ff", """SELECT ticker, "Date", sum(log_return) OVER fr AS f_sum, stddev_pop(log_return) OVER fr AS f_std,
            count(*) OVER fr AS c, lead(log_return) OVER w AS next_ret FROM rr
            WINDOW w AS (PARTITION BY ticker ORDER BY "Date"),
                   fr AS (PARTITION BY ticker ORDER BY "Date" ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"""),
         ("feats", "SELECT ticker, \"Date\", f_sum, f_std, next_ret FROM ff WHERE c = 5 AND next_ret IS NOT NULL"),
         ("fz", """SELECT f.*, s.m1, s.s1, s.m2, s.s2, (f.f_sum - s.m1) / CASE WHEN s.s1 > 0 THEN s.s1 ELSE 1.0 END AS z_sum,
            (f.f_std - s.m2) / CASE WHEN s.s2 > 0 THEN s.s2 ELSE 1.0 END AS z_std FROM feats f JOIN (
              SELECT ticker, avg(f_sum) AS m1, stddev_pop(f_sum) AS s1, avg(f_std) AS m2, stddev_pop(f_std) AS s2
              FROM feats GROUP BY ticker) s USING (ticker)""")]
sql("analogue_features", ["returns"], """SELECT ticker, "Date", round(f_sum, 8) AS f_sum, round(f_std, 8) AS f_std,
    round(next_ret, 8) AS next_ret FROM feats""", FEATS)
sql("zscore_features", ["returns"], """SELECT ticker, "Date", round(z_sum, 8) AS z_sum, round(z_std, 8) AS z_std FROM fz""", FEATS)
sql("knn_analogues", ["returns"], """SELECT ticker, CAST(rank AS INTEGER) AS rank, "Date", round(dist, 8) AS dist,
    round(next_ret, 8) AS next_ret FROM (
      SELECT z.ticker, z."Date", z.next_ret, sqrt(pow(z.z_sum - (q.q_sum - z.m1) / CASE WHEN z.s1 > 0 THEN z.s1 ELSE 1.0 END, 2)
             + pow(z.z_std - (q.q_std - z.m2) / CASE WHEN z.s2 > 0 THEN z.s2 ELSE 1.0 END, 2)) AS dist,
             row_number() OVER (PARTITION BY z.ticker ORDER BY sqrt(pow(z.z_sum - (q.q_sum - z.m1) / CASE WHEN z.s1 > 0 THEN z.s1 ELSE 1.0 END, 2)
             + pow(z.z_std - (q.q_std - z.m2) / CASE WHEN z.s2 > 0 THEN z.s2 ELSE 1.0 END, 2)), z."Date") AS rank
      FROM fz z JOIN (SELECT ticker, sum(log_return) AS q_sum, stddev_pop(log_return) AS q_std FROM (
          SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY "Date" DESC) AS rn FROM rr) WHERE rn <= 5 GROUP BY ticker) q
        USING (ticker)) WHERE rank <= 20""", FEATS)
SQL["export_snapshot"] = SQL["option_chain"]
SQL["head_n"] = with_ctes(["prices", "returns"], PT + """ FROM (SELECT p.*, r.pct_change, r.log_return FROM prices p
    JOIN returns r USING (ticker, "Date") WHERE r.log_return IS NOT NULL) ORDER BY ticker, "Date" LIMIT 10""")
