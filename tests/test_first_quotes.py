"""The quotes reduced to the first of each contract side: the same contracts and observed mids as the whole
chain gives, and one pass over the quotes for plans that use them several times."""
import datetime as dt

from pyspark.sql import functions as F

from datasets import SF_SMALL
from volforge.operators import evaluate as ev
from volforge.plans import accuracy as ac
from volforge.plans.common import Inputs

D = dt.date(2001, 3, 5)


def _chain(spark):
    rows = [("A", 90.0, 7, "call", 2.0, 100.0, D, 5, 1), ("A", 90.0, 7, "call", 1.0, 99.0, D, 4, 2),
            ("A", 90.0, 7, "call", 3.0, 100.0, D + dt.timedelta(1), 1, 1), ("A", 90.0, 7, "call", 1.0, 99.0, D, 4, 2),
            ("A", 90.0, 7, "put", 4.0, 100.0, D, 9, None), ("A", 90.0, 7, "put", 5.0, 100.0, D, 9, 1),
            ("A", 95.0, 7, "put", 6.0, 100.0, D, 2, 1), ("B", 90.0, 8, "call", 0.4, 80.0, D, 3, 1)]
    x = spark.createDataFrame(rows, "ticker string, strike double, days_to_expiry int, option_type string, mid_price double, "
                                    "underlying_price double, expiration_date date, ck_order long, ck_line int")
    return x.withColumn("chain_key", F.struct("expiration_date", "option_type", "strike", "ck_order", "ck_line"))


def test_first_quotes_give_the_contracts_and_mids_of_the_chain(spark):
    chain = _chain(spark)
    first = ev.first_quotes(chain)
    assert first.count() == 4
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(ev.distinct_kt(first)) == rows(ev.distinct_kt(chain))
    assert rows(ev.actual_lookup(first)) == rows(ev.actual_lookup(chain))
    assert ("A", 90.0, 7, 1.0, 4.0) in rows(ev.actual_lookup(first))


def test_reports_do_not_read_the_quotes_again(spark):
    """What is left to run when the plan is built refers to no table: the chain was joined once before."""
    inp = Inputs(spark, SF_SMALL)
    for df in (ev.error_report(ac.closed_form_errors(inp)), ev.atm_report(ac.closed_form_errors(inp)), ac.q_bs_price(inp)):
        assert not df.inputFiles()
