"""Deterministic random streams as Column expressions.

A draw is a pure function of its key (seed, stream tag, ticker, horizon, path, step, ...), never of
partitioning or task order, so results are identical under any repartition and after executor
loss and recomputation. ``rand()`` is never used.

Two modes:
* ``md5``    u = first 32 bits of md5(concat_ws(':', key)) / 2^32 — the same doubles in Spark and
             in the DuckDB oracle (``('0x' || substr(md5(..), 1, 8))::BIGINT / 2^32``);
* ``xxhash`` u = low 53 bits of xxhash64(key) / 2^53 — JVM-native and cheaper; the production mode.
"""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_PI = 2.0 * math.pi
_M53 = (1 << 53) - 1


class Stream:
    def __init__(self, seed: int = 42, mode: str = "md5"):
        if mode not in ("md5", "xxhash"):
            raise ValueError(f"unknown rng mode {mode!r}")
        self.seed, self.mode = int(seed), mode

    def uniform(self, *key) -> Column:
        """U[0, 1) keyed by ``key`` (Columns or Python scalars)."""
        cols = [k if isinstance(k, Column) else F.lit(k) for k in key]
        if self.mode == "md5":
            h = F.md5(F.concat_ws(":", F.lit(str(self.seed)), *[c.cast("string") for c in cols]))
            return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
        h = F.xxhash64(F.lit(self.seed), *cols)
        return h.bitwiseAND(F.lit(_M53)).cast("double") / F.lit(float(1 << 53))

    # Two-level keys: a per-path key is hashed once, each step then hashes (path key, step...).
    def path_key(self, *key) -> Column:
        cols = [k if isinstance(k, Column) else F.lit(k) for k in key]
        if self.mode == "md5":
            return F.concat_ws(":", F.lit(str(self.seed)), *[c.cast("string") for c in cols])
        return F.xxhash64(F.lit(self.seed), *cols)

    def u(self, pkey: Column, *step) -> Column:
        """U[0, 1) for one step of a path keyed by ``pkey`` (from :meth:`path_key`)."""
        cols = [k if isinstance(k, Column) else F.lit(k) for k in step]
        if self.mode == "md5":
            h = F.md5(F.concat_ws(":", pkey, *[c.cast("string") for c in cols]))
            return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
        return F.xxhash64(pkey, *cols).bitwiseAND(F.lit(_M53)).cast("double") / F.lit(float(1 << 53))

    def u_index(self, n: Column, pkey: Column, *step) -> Column:
        """Uniform 1-based index in [1, n] for ``element_at``. Never null, and the plan sees that: a join on
        it needs no null check, which would draw a second time."""
        return F.coalesce((F.floor(self.u(pkey, *step) * n) + F.lit(1)).cast("int"), F.lit(0))

    def u_gauss(self, pkey: Column, *step) -> Column:
        u1 = F.lit(1.0) - self.u(pkey, *step, "g1")
        u2 = self.u(pkey, *step, "g2")
        return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(TWO_PI) * u2)

    def u_student_t(self, df: Column, pkey: Column, *step) -> Column:
        u = F.lit(1.0) - self.u(pkey, *step, "tu")
        v = self.u(pkey, *step, "tv")
        return F.sqrt(df * (F.pow(u, F.lit(-2.0) / df) - F.lit(1.0))) * F.cos(F.lit(TWO_PI) * v)

    def index(self, n: Column, *key) -> Column:
        """Uniform integer in [1, n] (1-based, for ``element_at``)."""
        return (F.floor(self.uniform(*key) * n) + F.lit(1)).cast("int")

    def gaussian(self, *key) -> Column:
        """Standard normal by Box-Muller from two keyed uniforms."""
        u1 = F.lit(1.0) - self.uniform(*key, "g1")      # (0, 1]
        u2 = self.uniform(*key, "g2")
        return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(TWO_PI) * u2)

    def student_t(self, df: Column, *key) -> Column:
        """Student-t(df) by Bailey's polar identity sqrt(df (U^(-2/df) - 1)) cos(2 pi V); valid for
        non-integer df."""
        u = F.lit(1.0) - self.uniform(*key, "tu")        # (0, 1]
        v = self.uniform(*key, "tv")
        return F.sqrt(df * (F.pow(u, F.lit(-2.0) / df) - F.lit(1.0))) * F.cos(F.lit(TWO_PI) * v)


def uniform_sql(seed: int, *key_sql: str) -> str:
    """DuckDB twin of ``Stream(seed, 'md5').uniform``; key parts are SQL expressions."""
    parts = ", ".join(f"CAST({k} AS VARCHAR)" for k in key_sql)
    return (f"(CAST(('0x' || substr(md5(concat_ws(':', '{int(seed)}', {parts})), 1, 8)) AS BIGINT)"
            f" / CAST(4294967296.0 AS DOUBLE))")


def gaussian_sql(seed: int, *key_sql: str) -> str:
    u1 = f"(CAST(1.0 AS DOUBLE) - {uniform_sql(seed, *key_sql, repr('g1'))})"
    u2 = uniform_sql(seed, *key_sql, repr("g2"))
    return f"(sqrt(CAST(-2.0 AS DOUBLE) * ln({u1})) * cos(CAST({TWO_PI!r} AS DOUBLE) * {u2}))"


def student_t_sql(seed: int, df: str, *key_sql: str) -> str:
    u = f"(CAST(1.0 AS DOUBLE) - {uniform_sql(seed, *key_sql, repr('tu'))})"
    v = uniform_sql(seed, *key_sql, repr("tv"))
    return (f"(sqrt(({df}) * (pow({u}, CAST(-2.0 AS DOUBLE) / ({df})) - CAST(1.0 AS DOUBLE)))"
            f" * cos(CAST({TWO_PI!r} AS DOUBLE) * {v}))")
