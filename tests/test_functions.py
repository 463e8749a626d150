"""Column helpers against plain Python / NumPy definitions."""
import hashlib
import math

import numpy as np
from pyspark.sql import functions as F

from volforge.functions.mathfn import busdays, norm_cdf, norm_cdf_col, norm_cdf_py, round_half_up
from volforge.functions.rng import Stream
from volforge.functions.validate import valid_ticker


def test_norm_cdf_matches_erfc():
    for x in np.linspace(-9, 9, 181):
        exact = 0.5 * math.erfc(-x / math.sqrt(2))
        assert abs(norm_cdf_py(float(x)) - exact) < 1e-14


def test_norm_cdf_column_forms_agree(spark):
    df = spark.range(-40, 41).select((F.col("id") / 5.0).alias("x"))
    rows = df.select("x", norm_cdf(F.col("x")).alias("a"), norm_cdf_col("x").alias("b")).collect()
    for r in rows:
        assert abs(r.a - norm_cdf_py(r.x)) < 1e-15 and abs(r.b - r.a) < 1e-15


def test_busdays_matches_numpy(spark):
    rng = np.random.default_rng(0)
    base = np.datetime64("2024-01-01")
    pairs = [(base + int(a), base + int(b)) for a, b in rng.integers(0, 400, size=(400, 2))]
    df = spark.createDataFrame([(str(a), str(b)) for a, b in pairs], "a string, b string")
    got = df.select(busdays(F.to_date("a"), F.to_date("b")).alias("n")).collect()
    for (a, b), r in zip(pairs, got):
        assert r.n == int(np.busday_count(a, b)), (a, b)


def test_md5_stream_matches_hashlib(spark):
    st = Stream(42, "md5")
    row = spark.range(1).select(st.uniform("iid", "AAA", 5, 7).alias("u")).collect()[0]
    h = hashlib.md5(b"42:iid:AAA:5:7").hexdigest()
    assert row.u == int(h[:8], 16) / 2 ** 32


def test_round_half_up_on_ties(spark):
    df = spark.createDataFrame([(1.005,), (2.675,), (-1.5,), (0.125,)], "x double")
    got = [r.y for r in df.select(round_half_up(F.col("x"), 2).alias("y")).collect()]
    assert got == [math.floor(v * 100 + 0.5) / 100 for v in (1.005, 2.675, -1.5, 0.125)]


def test_valid_ticker(spark):
    df = spark.createDataFrame([("AAPL",), ("^GSPC",), ("BRK.B",), ("BAD TICKER!",), ("",), (None,)], "t string")
    assert [r.v for r in df.select(valid_ticker(F.col("t")).alias("v")).collect()] == [True, True, True, False, False, False]


def test_run_requests_are_checked(spark):
    from pyspark.sql import functions as F

    from volforge.functions.validate import job_run_errors
    rows = [(1, "2024-02-28", "2024-02-29", "t"), (0, "2024-02-28", "2024-02-28", "t"), (None, "2023-02-29", "2023-2-1", " "),
            (5, "2024-03-02", "2024-03-01", None), (6, None, "20240301", "t")]
    df = spark.createDataFrame(rows, "id long, a string, b string, name string")
    got = [r.e for r in df.select(job_run_errors(F.col("id"), F.col("a"), F.col("b"), {"table": F.col("name")}).alias("e")).collect()]
    start, end = "start_date must be YYYY-MM-DD", "end_date must be YYYY-MM-DD"
    assert got == [[], ["job_id must be > 0"], ["job_id must be > 0", start, end, "table must not be empty"],
                   ["start_date must not be after end_date", "table must not be empty"], [start, end]]
