"""T6 and T7 over the whole price table."""
import os
import sys

import pytest

from datasets import SF_SMALL

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))


def test_whole_table_has_every_ticker_and_its_last_day(spark):
    import __spark_entry__ as E
    from volforge.plans.common import STORED_TICKERS, Inputs
    last = {}
    for r in Inputs(spark, SF_SMALL).price_table.select("ticker", "Date").collect():
        last[r.ticker] = max(r.Date, last.get(r.ticker, r.Date))
    qs = E.queries()
    assert sorted(r.ticker for r in qs["existing_tickers"](spark, SF_SMALL).collect()) == sorted(last)
    assert {r.ticker: r.max_date for r in qs["latest_dates"](spark, SF_SMALL).collect()} == last
    assert len(last) > len(STORED_TICKERS)


@pytest.mark.parametrize("name", ["existing_tickers", "latest_dates"])
def test_matches_sql(spark, name):
    import __spark_entry__ as E
    from check_oracle import digest, duck
    assert digest(E.queries()[name](spark, SF_SMALL).toPandas()) == digest(duck(SF_SMALL).execute(E.oracle_sql()[name]).df())
