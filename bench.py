"""Benchmark the headline plans and print ONE JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each headline plan is built and fully executed (``count`` of a ``noop`` write would skip
columns, so results are collected as aggregates that touch every output column)."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from volforge.operators import prices as pr, stats as st  # noqa: E402
from volforge.operators.resample import MCConfig  # noqa: E402
from volforge.plans import catalog, montecarlo as mc  # noqa: E402
from volforge.plans.common import Inputs  # noqa: E402
from volforge.session import get_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
MC_PATHS = int(os.environ.get("BENCH_MC_PATHS", "1000"))


def consume(df) -> int:
    """Execute a plan completely: every column is hashed into one aggregate."""
    h = F.sum(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]).cast("decimal(38,0)"))
    return df.agg(F.count(F.lit(1)).alias("n"), h.alias("h")).collect()[0]["n"]


def main():
    spark = get_session(f"local[{CPUS}]", CPUS * 2, app_name="volforge-bench",
                        extra={"spark.driver.memory": "24g"})
    qs = catalog.plans()
    timings, rows = {}, {}

    def timed(name, build):
        t0 = time.time()
        rows[name] = consume(build())
        timings[name] = round(time.time() - t0, 3)

    # warm-up (not timed): JVM class loading / JIT of the chain and pricing code paths on the
    # smallest tables, parquet footers of the benchmark tables
    small = os.path.join(os.path.dirname(SF_DIR.rstrip("/")), "sf0.001")
    if os.path.isdir(small):
        consume(qs["error_report"](spark, small))
    consume(qs["prices"](spark, SF_DIR))
    timed("error_report", lambda: qs["error_report"](spark, SF_DIR))
    timed("option_chain", lambda: qs["option_chain"](spark, SF_DIR))
    timed("job_state", lambda: qs["fold_job_state"](spark, SF_DIR))
    timed("job_runtime", lambda: qs["job_runtime"](spark, SF_DIR))
    inp = Inputs(spark, SF_DIR)
    nat = st.return_arrays(pr.with_returns(inp.prices_nation))
    timed("vol_stats_125", lambda: st.vol_stats(pr.with_returns(inp.prices_nation)))
    timed("t_fit_125", lambda: st.student_t_fit(nat))
    timed("garch_fit_125", lambda: st.garch_fit(nat.where(F.col("n") >= 30)))
    cfg = MCConfig(n_paths=MC_PATHS, rng="xxhash", chunk=8192)
    # every contract of the uncapped chain: MC_PATHS paths of each horizon and method
    contracts = inp.contracts_cp
    timed("mc_all_methods", lambda: mc.run_methods(inp, contracts, cfg, mc.SIM_METHODS + mc.CLOSED_FORM))
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "headline_plans_total", "value": total, "unit": "sec", "queries": timings,
                      "rows": rows, "sf": os.path.basename(SF_DIR.rstrip("/")).replace("sf", ""),
                      "cpus": CPUS, "mc_paths": MC_PATHS}))
    spark.stop()


if __name__ == "__main__":
    main()
