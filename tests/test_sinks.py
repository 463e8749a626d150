"""The write paths: upserts, batch logs, and what they do when a table cannot be read."""
import glob

import pytest
from pyspark.sql import functions as F

from volforge.operators import joblog
from volforge.sources import sinks
from volforge.streaming import jobs as sj

SCHEMA = "ticker string, Date date, Close double"


def rows(spark, *values):
    return spark.createDataFrame([(t, d, c) for t, d, c in values], "ticker string, d string, Close double").select(
        "ticker", F.to_date("d").alias("Date"), "Close")


def content(df):
    return sorted((r.ticker, str(r.Date), r.Close) for r in df.collect())


def test_upsert_updates_inserts_and_leaves_other_tickers(spark, tmp_path):
    path = str(tmp_path / "t")
    sinks.upsert_prices(spark, rows(spark, ("A", "2020-01-01", 1.0), ("A", "2020-01-02", 2.0), ("B", "2020-01-01", 5.0)), path)
    before = sorted(glob.glob(f"{path}/ticker=B/*.parquet"))
    sinks.upsert_prices(spark, rows(spark, ("A", "2020-01-02", 9.0), ("A", "2020-01-03", 3.0), ("C", "2020-01-01", 7.0)), path)
    assert content(spark.read.parquet(path)) == [("A", "2020-01-01", 1.0), ("A", "2020-01-02", 9.0), ("A", "2020-01-03", 3.0),
                                                 ("B", "2020-01-01", 5.0), ("C", "2020-01-01", 7.0)]
    assert sorted(glob.glob(f"{path}/ticker=B/*.parquet")) == before


def test_an_unreadable_table_is_an_error_and_stays(spark, tmp_path):
    path = tmp_path / "t"
    sinks.upsert_prices(spark, rows(spark, ("A", "2020-01-01", 1.0), ("B", "2020-01-01", 5.0)), str(path))
    files = sorted(path.glob("ticker=*/*.parquet"))
    for f in files:
        f.write_bytes(b"broken")
        crc = f.with_name(f".{f.name}.crc")
        if crc.exists():
            crc.unlink()
    with pytest.raises(Exception):
        sinks.upsert_prices(spark, rows(spark, ("C", "2020-01-01", 2.0)), str(path))
    assert sorted(path.glob("ticker=*/*.parquet")) == files


def test_batches_replace_only_themselves_and_the_latest_wins(spark, tmp_path):
    path = str(tmp_path / "log")
    sinks.write_batch(rows(spark, ("A", "2020-01-01", 1.0), ("A", "2020-01-02", 2.0)), path, 0)
    sinks.write_batch(rows(spark, ("A", "2020-01-02", 8.0)), path, 10)
    sinks.write_batch(rows(spark, ("A", "2020-01-02", 9.0), ("B", "2020-01-02", None)), path, 10)      # tried again
    sinks.write_batch(rows(spark, ("A", "2020-01-01", 4.0)), path, 2)
    want = [("A", "2020-01-01", 4.0), ("A", "2020-01-02", 9.0), ("B", "2020-01-02", None)]
    assert content(sinks.read_batches(spark, path, ["ticker", "Date"])) == want


def test_late_rows_and_corrections_reach_the_price_table(spark, tmp_path):
    def land(name, *days):
        df = spark.createDataFrame([("A", f"2020-01-{d:02d}", c) for d, c in days], "ticker string, d string, c double")
        df = df.select("ticker", F.to_date("d").alias("Date"), *(F.col("c").alias(x) for x in ("Open", "High", "Low", "Close", "Adj_Close")),
                       F.lit(1).cast("long").alias("Volume"))
        df.coalesce(1).write.parquet(str(tmp_path / "land" / name))
        sj.stream_prices(spark, str(tmp_path / "land" / "*"), str(tmp_path / "table"), str(tmp_path / "ck")).awaitTermination()
    land("one", (1, 10.0), (2, 20.0), (4, 50.0))
    land("two", (3, 40.0), (4, 80.0), (5, 160.0))        # a late day, a correction, a new day
    got = [(str(r.Date)[-2:], r.Adj_Close, r.pct_change) for r in sj.read_prices(spark, str(tmp_path / "table")).orderBy("Date").collect()]
    assert got == [("02", 20.0, 1.0), ("03", 40.0, 1.0), ("04", 80.0, 1.0), ("05", 160.0, 1.0)]


def test_blank_messages_fall_back(spark):
    runs = spark.createDataFrame([("TERMINATED", "FAILED", ""), ("TERMINATED", "FAILED", " "), ("TERMINATED", "FAILED", "why"),
                                  ("TERMINATED", "FAILED", None)], "life_cycle string, result string, message string")
    said = [r.new_error for r in joblog.map_run_state(runs).collect()]
    assert said[2] == "why" and len({said[0], said[1], said[3]}) == 1 and said[0].endswith("FAILED")
    events = spark.createDataFrame([(1, "2020-01-01 00:00:00", 1, "FAILED", "")], "job_id long, t string, event_id long, status string, message string")
    events = events.withColumn("ts", F.to_timestamp("t"))
    assert joblog.fold_job_state(events).first().error_message == "Unknown failure"


@pytest.mark.parametrize("limit, offset", [(0, 0), (201, 0), (5, -1)])
def test_pages_reject_what_they_cannot_show(spark, limit, offset):
    with pytest.raises(ValueError):
        joblog.page_jobs(spark.createDataFrame([], "id long, status string, created_at timestamp"), limit=limit, offset=offset)
