"""Registered plans against their DuckDB oracles on the smallest table set (the driver checks sf0.01)."""
import os
import sys

import pytest

from datasets import SF_SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

NAMES = ["prices", "quotes_raw", "option_chain", "project_prices", "increment_after", "upsert_prices", "upsert_prices_sink",
         "stream_prices", "avg_time_by_scale", "mc_vs_bs", "put_call_parity_sampled", "error_report",
         "bs_stderr", "atm_report", "fold_job_state", "job_runtime", "gate_results", "boot_iid", "boot_block",
         "boot_window_10", "emc_effect"]


@pytest.fixture(scope="module")
def duck():
    from check_oracle import duck as make
    return make(SF_SMALL)


@pytest.mark.parametrize("name", NAMES)
def test_plan_matches_oracle(spark, duck, name):
    import __spark_entry__ as E
    from check_oracle import digest
    qs, sqls = E.queries(), E.oracle_sql()
    if name not in qs:
        pytest.skip(f"{name} not registered")
    a = digest(qs[name](spark, SF_SMALL).toPandas())
    b = digest(duck.execute(sqls[name]).df())
    assert a == b


def test_every_query_has_oracle_or_is_declared(spark):
    import __spark_entry__ as E
    from volforge.plans.catalog import NON_SQL, plans
    missing = set(plans()) - set(E.oracle_sql()) - NON_SQL
    assert not missing, missing


def test_entry_runs(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() >= 0 and "mape" in df.columns
