"""The registry of plans: name -> callable(spark, sf_dir) -> DataFrame, and name -> oracle SQL."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import accuracy, analysis, jobs, montecarlo, streams  # noqa: F401  (register plans)
from . import relational
from .common import Inputs
from . import oracle_analysis, oracle_jobs, oracle_mc  # noqa: F401  (register SQL)
from .oracle import SQL


def _bind(fn) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(Inputs(spark, sf_dir))
    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


def plans() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _bind(fn) for name, fn in relational.Q.items()}


# Plans without a SQL oracle (rows-only in the driver; pytest checks them with tolerances or
# against brute force): GARCH-filtered samplers and the plans that include them; and the sampled convergence
# reports on the cheaper stream, whose SQL is compared on a few contracts (tests/test_convergence_grid.py).
NON_SQL = {"boot_filtered", "boot_filtered_rn", "run_methods", "mc_error_report", "garch_fit", "garch_filter",
           "spread_vs_bs", "premium_over_bs"}


def oracle_sql() -> dict[str, str]:
    names = set(relational.Q) - NON_SQL
    return {k: v for k, v in SQL.items() if k in names}
