"""Validation predicates as Columns: rows are split into accepted and rejected-with-reason."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: accepted ticker symbols.
TICKER_PATTERN = r"^[A-Za-z0-9.\-^=]{1,16}$"


def valid_ticker(c: Column) -> Column:
    return F.coalesce(c.rlike(TICKER_PATTERN), F.lit(False))


def job_param_errors(ticker: Column, strike: Column, period: Column, sims: Column) -> Column:
    """Array of error messages (empty when valid) for a pricing request."""
    return F.array_compact(F.array(
        F.when(~valid_ticker(ticker), F.lit("invalid ticker")),
        F.when(F.coalesce(strike, F.lit(0.0)) <= 0, F.lit("strike must be > 0")),
        F.when(F.coalesce(period, F.lit(0)) <= 0, F.lit("period_days must be > 0")),
        F.when(F.coalesce(sims, F.lit(0)) <= 0, F.lit("num_simulations must be > 0")),
    ))


ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"


def iso_date(text: Column) -> Column:
    """A date written as YYYY-MM-DD; null for any other text and for days that do not exist."""
    return F.when(F.coalesce(text.rlike(ISO_DATE), F.lit(False)), F.try_to_date(text, "yyyy-MM-dd"))


def job_run_errors(job_id: Column, start: Column, end: Column, names: dict[str, Column]) -> Column:
    """Array of error messages (empty when valid) for a job run: a positive id, ISO dates in order, and
    ``names`` that are not blank."""
    first, last = iso_date(start), iso_date(end)
    return F.array_compact(F.array(
        F.when(F.coalesce(job_id, F.lit(0)) <= 0, F.lit("job_id must be > 0")),
        F.when(first.isNull(), F.lit("start_date must be YYYY-MM-DD")),
        F.when(last.isNull(), F.lit("end_date must be YYYY-MM-DD")),
        F.when(first > last, F.lit("start_date must not be after end_date")),
        *[F.when(F.coalesce(F.trim(c), F.lit("")) == "", F.lit(f"{name} must not be empty")) for name, c in names.items()],
    ))
