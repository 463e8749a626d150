"""SQL oracles (DuckDB) of the job-log and result plans."""
from __future__ import annotations

from .oracle import SQL
from .sqlfix import d, norm_cdf_sql, rnd, with_ctes

NOW = "TIMESTAMP '2001-09-01 00:00:00'"
TICKER_RE = "'^[A-Za-z0-9.\\-^=]{1,16}$'"

JOBS = [("jobs0", f"""SELECT o_orderkey AS id, CAST(o_orderdate AS TIMESTAMP) AS created_at,
        CASE WHEN o_orderstatus = 'O' THEN 'QUEUED' WHEN o_orderstatus = 'P' THEN 'RUNNING'
             WHEN o_orderkey % 10 = 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
        o_orderpriority AS p_ticker, {rnd('o_totalprice / ' + d(1000.0), 2)} AS p_strike,
        CAST(5 + o_orderkey % 60 AS INTEGER) AS p_period, CAST(1000 * (1 + o_orderkey % 5) AS INTEGER) AS p_sims,
        o_orderkey FROM orders"""),
        ("jobs1", """SELECT *, CASE WHEN status <> 'QUEUED' THEN created_at + to_seconds(o_orderkey % 600) END AS started_at FROM jobs0"""),
        ("jobs", """SELECT *, CASE WHEN status IN ('SUCCEEDED', 'FAILED') THEN started_at + to_seconds(o_orderkey % 3600) END AS finished_at,
            CASE WHEN status = 'FAILED' THEN 'Unknown failure' END AS error_message FROM jobs1""")]

JR = JOBS + [
    ("jr_in", f"""SELECT j.id AS job_id, j.p_ticker AS ticker, j.p_strike AS K, j.p_period AS T, j.p_sims AS Runs, s.S0, v.vol, rate.r,
        CAST(j.p_period AS DOUBLE) / {d(252.0)} AS tau
        FROM jobs j JOIN vstats v ON v.ticker = j.p_ticker JOIN qr_state s ON s.ticker = j.p_ticker CROSS JOIN rate
        WHERE coalesce(regexp_full_match(j.p_ticker, {TICKER_RE}), false) AND j.p_strike > 0 AND j.p_period > 0 AND j.p_sims > 0"""),
    ("jr_d", f"""SELECT *, (ln(S0 / K) + (r + {d(0.5)} * vol * vol) * tau) / (vol * sqrt(tau)) AS d1,
        (ln(S0 / K) + (r + {d(0.5)} * vol * vol) * tau) / (vol * sqrt(tau)) - vol * sqrt(tau) AS d2 FROM jr_in"""),
    ("job_results", f"""SELECT job_id, ticker, K, T, Runs, S0, m.method,
        S0 * {norm_cdf_sql('d1')} - K * exp(-r * tau) * {norm_cdf_sql('d2')} AS CallPrice,
        K * exp(-r * tau) * {norm_cdf_sql('-d2')} - S0 * {norm_cdf_sql('-d1')} AS PutPrice
        FROM jr_d CROSS JOIN (VALUES ('black_scholes'), ('multifractal')) m(method)"""),
]
NEEDS = ["vstats", "qr_state", "rate"]


def sql(name, body, extra=None, needs=None):
    SQL[name] = with_ctes(needs if needs is not None else NEEDS, body, JR + (extra or []))


sql("job_view", """SELECT id, status, created_at, started_at, finished_at, p_ticker AS ticker, round(p_strike, 6) AS strike,
    p_period AS period_days, p_sims AS num_simulations FROM jobs""")
sql("job_runtime", f"""SELECT id, upper(status) AS status, round(round(CASE
        WHEN started_at IS NOT NULL AND finished_at IS NOT NULL THEN (epoch_us(finished_at) - epoch_us(started_at)) / 1e6
        WHEN started_at IS NOT NULL AND upper(status) IN ('QUEUED', 'RUNNING') THEN (epoch_us({NOW}) - epoch_us(started_at)) / 1e6 END, 1), 6)
        AS runtime_s, substring(coalesce(error_message, ''), 1, 120) AS error, coalesce(error_message, '') AS full_error FROM jobs""")
sql("avg_time_by_scale", """SELECT p_sims AS num_simulations, count(*) AS n_jobs,
    round(CAST(sum(epoch_us(finished_at) - epoch_us(started_at)) AS DOUBLE) / count(*) / 1e6, 6) AS avg_seconds
    FROM jobs WHERE started_at IS NOT NULL AND finished_at IS NOT NULL GROUP BY p_sims""")
sql("job_counts", """SELECT count(*) AS total, count(*) FILTER (WHERE status IN ('QUEUED', 'RUNNING')) AS active,
    least(count(*), 50) AS shown FROM jobs""")
sql("page_jobs", """SELECT id, status, created_at FROM jobs WHERE status = 'FAILED' ORDER BY created_at DESC, id DESC LIMIT 50 OFFSET 10""")
sql("next_queued", """SELECT id, created_at FROM jobs WHERE status = 'QUEUED' ORDER BY created_at, id LIMIT 1""")
RUNS = [("runs", """SELECT event_id, user_id AS job_id,
    CASE WHEN event_type = 'signup' THEN 'PENDING' WHEN event_type IN ('click', 'view') THEN 'RUNNING'
         WHEN event_type IN ('purchase', 'error') THEN 'TERMINATED' END AS life_cycle,
    CASE WHEN event_type = 'purchase' THEN 'SUCCESS' WHEN event_type = 'error' THEN 'FAILED' END AS result,
    CASE WHEN event_type = 'error' AND event_id % 2 = 0 THEN props END AS message FROM events""")]
SQL["map_run_state"] = with_ctes([], """SELECT event_id, job_id,
    CASE WHEN upper(coalesce(life_cycle, '')) IN ('PENDING', 'RUNNING', 'TERMINATING') THEN 'RUNNING'
         WHEN upper(coalesce(life_cycle, '')) = 'TERMINATED' AND upper(coalesce(result, '')) = 'SUCCESS' THEN 'SUCCEEDED'
         WHEN upper(coalesce(life_cycle, '')) = 'TERMINATED' THEN 'FAILED' END AS new_status,
    CASE WHEN upper(coalesce(life_cycle, '')) = 'TERMINATED' AND upper(coalesce(result, '')) <> 'SUCCESS'
         THEN coalesce(message, 'Databricks failed: ' || upper(coalesce(result, ''))) END AS new_error FROM runs""", RUNS)
EV = [("ev", """SELECT user_id AS job_id, CAST(ts AS TIMESTAMP) AS ts, event_id,
    CASE event_type WHEN 'signup' THEN 'QUEUED' WHEN 'click' THEN 'RUNNING' WHEN 'view' THEN 'RUNNING'
        WHEN 'purchase' THEN 'SUCCEEDED' WHEN 'error' THEN 'FAILED' END AS status, props AS message FROM events"""),
      ("ev_last", """SELECT job_id, status FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn
        FROM ev) WHERE rn = 1"""),
      ("ev_term", """SELECT job_id, status, message, ts FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) AS rn
        FROM ev WHERE status IN ('SUCCEEDED', 'FAILED')) WHERE rn = 1"""),
      ("ev_agg", """SELECT job_id, min(ts) FILTER (WHERE status = 'RUNNING') AS started_at, max(ts) AS updated_at, count(*) AS n_events
        FROM ev GROUP BY job_id""")]
SQL["fold_job_state"] = with_ctes([], """SELECT a.job_id, l.status, a.started_at, t.ts AS finished_at,
    CASE WHEN t.status = 'FAILED' THEN coalesce(t.message, 'Unknown failure') END AS error_message, a.updated_at, a.n_events
    FROM ev_agg a JOIN ev_last l USING (job_id) LEFT JOIN ev_term t USING (job_id)""", EV)
sql("job_metrics", """SELECT j.id AS job_id, (epoch_us(finished_at) - epoch_us(started_at)) / 1e6 AS duration_seconds,
    coalesce(n.row_count, 0) AS row_count FROM jobs j
    LEFT JOIN (SELECT job_id, count(*) AS row_count FROM job_results GROUP BY job_id) n ON n.job_id = j.id
    WHERE finished_at IS NOT NULL""")
sql("gate_results", """SELECT status, accepted, count(*) AS n_jobs, CAST(sum(n_rows) AS BIGINT) AS n_rows FROM (
    SELECT job_id, 'SUCCEEDED' AS status, true AS accepted, count(*) AS n_rows FROM job_results
        WHERE job_id IN (SELECT id FROM jobs WHERE status = 'SUCCEEDED') GROUP BY job_id
    UNION ALL SELECT id, status, false, 0 FROM jobs WHERE status <> 'SUCCEEDED') GROUP BY status, accepted""")
TYPED = """CAST(Runs AS INTEGER) AS Runs, CAST(K AS FLOAT) AS K, CAST(T AS INTEGER) AS T, round(CallPrice, 6) AS CallPrice,
    round(PutPrice, 6) AS PutPrice, method, ticker, round(S0, 6) AS S0"""
sql("typed_results", f"SELECT {TYPED} FROM job_results")
sql("read_results", f"SELECT {TYPED} FROM job_results WHERE ticker = '3-MEDIUM' AND T = 30 AND Runs = 1000")
sql("read_results_strike", f"""SELECT {TYPED} FROM job_results JOIN (SELECT ticker, min(K) AS asked FROM job_results WHERE T = 30 GROUP BY ticker)
    USING (ticker) WHERE T = 30 AND CAST(K AS FLOAT) = CAST(asked AS FLOAT)""")
sql("valid_run_params", """SELECT id, CAST(len(errs) AS INTEGER) AS n_errors, array_to_string(errs, '; ') AS errors FROM (
    SELECT id, list_filter([CASE WHEN coalesce(id, 0) <= 0 THEN 'job_id must be > 0' END,
        CASE WHEN first IS NULL THEN 'start_date must be YYYY-MM-DD' END, CASE WHEN last IS NULL THEN 'end_date must be YYYY-MM-DD' END,
        CASE WHEN first > last THEN 'start_date must not be after end_date' END,
        CASE WHEN coalesce(trim(output_ref), '') = '' THEN 'output_ref must not be empty' END,
        CASE WHEN coalesce(trim(status), '') = '' THEN 'status must not be empty' END], lambda x: x IS NOT NULL) AS errs
    FROM (SELECT id, status, CASE WHEN status = 'SUCCEEDED' THEN 'results/job=' || id END AS output_ref,
        CAST(created_at AS DATE) AS first,
        CASE WHEN id % 7 = 0 THEN CAST(created_at AS DATE) - 1 WHEN finished_at IS NOT NULL THEN CAST(finished_at AS DATE) END AS last FROM jobs))""", needs=[])
sql("select_methods", """SELECT method, count(*) AS n FROM job_results
    WHERE method IN ('black_scholes', 'fhs_rn', 'multifractal', 'window')
       OR NOT EXISTS (SELECT 1 FROM job_results WHERE method IN ('black_scholes', 'fhs_rn', 'multifractal', 'window'))
    GROUP BY method""")
BS = [("bsj", """SELECT job_id, avg(CallPrice) AS BS_call, avg(PutPrice) AS BS_put FROM job_results WHERE method = 'black_scholes' GROUP BY job_id""")]
sql("bs_reference_join", """SELECT r.job_id, r.method, round(r.CallPrice, 6) AS CallPrice, round(b.BS_call, 6) AS BS_call,
    round(r.PutPrice, 6) AS PutPrice, round(b.BS_put, 6) AS BS_put FROM job_results r LEFT JOIN bsj b USING (job_id)""", BS)
sql("bs_deviation", """SELECT r.job_id, r.method, round(round(r.CallPrice, 4), 6) AS CallPrice,
    round(round((r.CallPrice - b.BS_call) / nullif(b.BS_call, 0) * 100.0, 2), 6) AS call_dev_pct, round(round(r.PutPrice, 4), 6) AS PutPrice,
    round(round((r.PutPrice - b.BS_put) / nullif(b.BS_put, 0) * 100.0, 2), 6) AS put_dev_pct FROM job_results r LEFT JOIN bsj b USING (job_id)""", BS)
sql("compare_jobs", """SELECT r.job_id, r.method, round(r.CallPrice, 6) AS CallPrice, round(r.PutPrice, 6) AS PutPrice,
    printf('#%d %s K=%s T=%dd n=%d', r.job_id, coalesce(j.p_ticker, ''), CAST(j.p_strike AS VARCHAR), j.p_period, j.p_sims) AS job_label
    FROM job_results r JOIN jobs j ON j.id = r.job_id""")
sql("method_by_job", """SELECT job_id, round(avg(CallPrice) FILTER (WHERE method = 'black_scholes'), 6) AS black_scholes,
    round(avg(CallPrice) FILTER (WHERE method = 'multifractal'), 6) AS multifractal FROM job_results GROUP BY job_id""")
sql("price_mean_by_method", """SELECT method, round(avg(CallPrice), 6) AS CallPrice, round(avg(PutPrice), 6) AS PutPrice
    FROM job_results GROUP BY method""")
sql("date_spine", """SELECT CAST(dd AS DATE) AS business_date, count(*) AS n_jobs FROM (
    SELECT id, unnest(generate_series(CAST(CAST(created_at AS DATE) AS TIMESTAMP),
        CAST(CAST(created_at AS DATE) AS TIMESTAMP) + to_days(p_period), INTERVAL 1 DAY)) AS dd FROM jobs) GROUP BY 1""", needs=[])
sql("export_summary", """SELECT 'simulation_results' AS "table", 'results/' AS path, count(*) AS row_count FROM job_results""")

SQL["stream_job_state"] = SQL["fold_job_state"]

sql("replace_partition", """SELECT ticker, method, count(*) AS n FROM job_results
    WHERE ticker <> '2-HIGH' OR method = 'multifractal' GROUP BY 1, 2""")
