"""Numerical Column helpers."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TRADING_DAYS = 252.0
MAX_LOG_SUM = 10.0

# Rational approximation of the standard normal tail (Hart 1968 as given by
# West 2005, "Better approximations to cumulative normal functions"); double precision.
_P = [0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
      112.079291497871, 221.213596169931, 220.206867912376]
_Q = [0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
      296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752]
_SPLIT = 7.07106781186547
_CUTOFF = 37.0
_SQRT_2PI = 2.506628274631


def _horner(coefs, x: Column) -> Column:
    acc = F.lit(coefs[0])
    for c in coefs[1:]:
        acc = acc * x + F.lit(c)
    return acc


def norm_cdf_col(name: str, negate: bool = False) -> Column:
    """N(x) (or N(-x)) of column ``name``: the same expression as :func:`norm_cdf`, built from SQL
    text in one call (the Column builder costs one Py4J round trip per node)."""
    from ..plans.sqlfix import norm_cdf_sql
    ref = f"(-`{name}`)" if negate else f"`{name}`"
    return F.expr(norm_cdf_sql(ref))


def norm_cdf(x: Column) -> Column:
    """Standard normal CDF as a pure Column expression (Spark has no erf)."""
    ax = F.abs(x)
    e = F.exp(-ax * ax / F.lit(2.0))
    near = e * _horner(_P, ax) / _horner(_Q, ax)
    cf = ax + F.lit(0.65)
    for k in (4.0, 3.0, 2.0, 1.0):
        cf = ax + F.lit(k) / cf
    far = e / cf / F.lit(_SQRT_2PI)
    tail = F.when(ax > _CUTOFF, F.lit(0.0)).when(ax < _SPLIT, near).otherwise(far)
    return F.when(x > 0, F.lit(1.0) - tail).otherwise(tail)


def norm_cdf_py(x: float) -> float:
    """Scalar twin of :func:`norm_cdf` (tests, local checks)."""
    ax = abs(x)
    if ax > _CUTOFF:
        t = 0.0
    else:
        e = math.exp(-ax * ax / 2.0)
        if ax < _SPLIT:
            num = _P[0]
            for c in _P[1:]:
                num = num * ax + c
            den = _Q[0]
            for c in _Q[1:]:
                den = den * ax + c
            t = e * num / den
        else:
            cf = ax + 0.65
            for k in (4.0, 3.0, 2.0, 1.0):
                cf = ax + k / cf
            t = e / cf / _SQRT_2PI
    return 1.0 - t if x > 0 else t


def _weekdays_from(start: Column, n: Column) -> Column:
    """Mon-Fri days in [start, start + n) for n >= 0, closed form (no per-day explode):
    5 per full week plus the weekdays among the remaining n mod 7 days."""
    d0 = F.weekday(start)                      # Monday = 0
    rem = n % 7
    head = F.greatest(F.lit(0), F.least(rem, F.lit(5) - d0))
    wrap = F.greatest(F.lit(0), F.least(d0 + rem - F.lit(7), F.lit(5)))
    return F.floor(n / 7).cast("int") * 5 + head + wrap


def busdays(begin: Column, end: Column) -> Column:
    """Business days (Mon-Fri, no holidays) in [begin, end); when end < begin, minus the business
    days in (end, begin] (NumPy's busday_count convention)."""
    n = F.datediff(end, begin)
    return F.when(n >= 0, _weekdays_from(begin, n)) \
            .otherwise(-_weekdays_from(F.date_add(end, 1), -n)).cast("int")


def clip_log_sum(x: Column, bound: float = MAX_LOG_SUM) -> Column:
    return F.greatest(F.least(x, F.lit(bound)), F.lit(-bound))


def round_half_up(x: Column, digits: int) -> Column:
    """Round half up on the binary value: floor(x * 10^d + 0.5) / 10^d. Unlike ``round`` (which
    rounds the decimal representation) this is the same IEEE computation in every engine, so
    values that sit exactly on a .5 tie agree across Spark and the SQL oracle."""
    s = float(10 ** digits)
    return F.when(F.isnan(x), x).otherwise(F.floor(x * F.lit(s) + F.lit(0.5)) / F.lit(s))
