"""Dense positions, the affine scan and the GARCH filter against a walk step by step."""
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from volforge.operators import scans
from volforge.operators import stats as st


@pytest.mark.parametrize("sizes, fan", [({"a": 1, "b": 5, "c": 64, "d": 65, "e": 700}, 4), ({"a": 130, "b": 4097}, 64)])
def test_affine_scan_equals_a_walk(spark, sizes, fan):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for k, n in sizes.items():
        x = 2.0
        for i in range(n):
            add, times = float(rng.random()), float(rng.choice([0.0, 0.5, 0.97]))
            want[k, i] = x
            rows.append((k, i, add, times))
            x = add + times * x
    order = rng.permutation(len(rows))
    steps = spark.createDataFrame([rows[i] for i in order], "k string, idx long, add double, times double")
    starts = spark.createDataFrame([(k, 2.0) for k in sizes], "k string, start double")
    got = {(r.k, r.idx): r.x for r in scans.affine_values(steps, "k", starts, fan=fan).collect()}
    assert got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_positions_are_dense_and_one_key_lies_in_several_tasks(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 10 == 0, "few").otherwise("many").alias("k"), (F.col("id") * 7919 % 5003).alias("t"))
    out = scans.dense_positions(df, "k", "t")
    rows = sorted((r.k, r.t, r.idx) for r in out.collect())
    for k in ("few", "many"):
        assert [i for kk, _, i in rows if kk == k] == list(range(sum(kk == k for kk, *_ in rows)))
    assert out.where("k = 'many'").select(F.spark_partition_id()).distinct().count() > 1


def test_empty_series(spark):
    none = spark.createDataFrame([], "k string, idx long, add double, times double")
    assert scans.affine_values(none, "k", spark.createDataFrame([], "k string, start double")).collect() == []
    assert scans.dense_positions(spark.createDataFrame([], "k string, t long"), "k", "t").collect() == []


def test_garch_filter_equals_a_walk(spark):
    rng = np.random.default_rng(2)
    series = {"L": rng.normal(0, 0.01, 3000), "S": rng.normal(0, 0.02, 40)}
    returns = spark.createDataFrame([(k, f"{2000 + i // 336:04d}-{i // 28 % 12 + 1:02d}-{i % 28 + 1:02d}", float(v)) for k, r in series.items() for i, v in enumerate(r)],
                                    "ticker string, Date string, log_return double").withColumn("Date", F.to_date("Date")).repartition(6)
    fit = spark.createDataFrame([(k, float(np.mean(r)), 2e-6, 0.08, 0.9, float(np.var(r))) for k, r in series.items()],
                                "ticker string, mu double, omega double, alpha double, beta double, var0 double")
    got = st.garch_filter(fit, returns).toPandas().sort_values(["ticker", "Date"])
    for k, r in series.items():
        e, v, s2 = r - r.mean(), np.var(r), []
        for x in e:
            s2.append(v)
            v = 2e-6 + 0.08 * x * x + 0.9 * v
        z = e / np.sqrt(s2)
        mine = got[got.ticker == k]
        assert np.allclose(mine.sigma2, s2, rtol=1e-12) and np.allclose(mine.z, z - z.mean(), atol=1e-12)
        assert np.allclose(mine.sigma2_next, v, rtol=1e-12) and math.isfinite(v)
