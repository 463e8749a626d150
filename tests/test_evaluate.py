"""Exact grouped median against pandas, with and without the bracket, and the uncapped chain."""
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from datasets import SF_SMALL
from volforge.operators import chain as ch
from volforge.operators import evaluate as ev
from volforge.plans.common import Inputs


@pytest.mark.parametrize("min_rows", [100, ev.BRACKET_MIN_ROWS])
def test_exact_median_matches_pandas(spark, monkeypatch, min_rows):
    monkeypatch.setattr(ev, "BRACKET_MIN_ROWS", min_rows)
    rng = np.random.default_rng(7)
    groups = {"hot": rng.normal(size=20_001), "even": rng.normal(size=4_000), "ties": np.repeat([1.0, 2.0, 3.0], 700),
              "two": np.array([1.0, 4.0]), "one": np.array([5.0])}
    pdf = pd.DataFrame([(k, float(v)) for k, vs in groups.items() for v in vs], columns=["g", "v"])
    df = spark.createDataFrame(pdf).unionByName(
        spark.createDataFrame([("hot", None), ("none", None)], "g string, v double"))
    got = {r["g"]: r for r in ev.with_exact_median(df, ["g"], "v", "med", F.count(F.lit(1)).alias("n")).collect()}
    for k, vs in groups.items():
        assert got[k]["med"] == pytest.approx(float(np.median(vs)), abs=1e-12), k
    assert got["hot"]["n"] == 20_002 and got["none"]["med"] is None and got["none"]["n"] == 1


def test_exact_median_of_no_rows(spark):
    empty = spark.createDataFrame([], "g string, v double")
    assert ev.with_exact_median(empty, ["g"], "v", "med").count() == 0


def test_chain_keeps_every_filtered_quote(spark):
    inp = Inputs(spark, SF_SMALL)
    q = ch.strike_band(ch.liquidity_filter(ch.expiry_window(ch.busdays_to_expiry(inp.quotes_raw))))
    assert inp.chain.count() == q.count() > 5 * ch.MAX_ROWS
    assert ch.option_chain(inp.quotes_raw, ch.MAX_EXPIRIES, 10).groupBy("ticker").count().agg(F.max("count")).first()[0] <= 10
    calls = {r["option_type"]: r["n"] for r in ch.option_type_counts(inp.chain).collect()}
    assert set(calls) == {"call", "put"}
