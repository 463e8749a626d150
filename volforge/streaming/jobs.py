"""ST1 / ST2 as Structured Streaming queries over file sources.

ST1 ``stream_prices``: landed OHLCV files -> ``foreachBatch`` -> a log of raw rows, one folder for
each micro-batch. The price table is read from the log: per (ticker, Date) the row of the latest
batch, with returns computed over all rows that are there. So a late row or a correction changes
its own return and its successor's, whatever order rows land in, and a batch that is tried again
only replaces its own folder.

ST2 ``stream_job_state``: job status events -> watermark -> ``dropDuplicatesWithinWatermark`` on
event_id -> the K5 fold written as a streaming aggregation (max_by / min / count per job, kept in
the state store) -> update-mode ``foreachBatch`` log of states, read back as the latest per job_id. The merge is order-free (max and
min over (ts, event_id)), so an event that arrives late never regresses a job's state.

Both use ``trigger(availableNow=True)`` in the registered plans; on a cluster the same queries run
with a processing-time trigger. Checkpoints live under the cluster's checkpoint folder.
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prices as pr
from ..operators.joblog import fold_job_state
from ..session import ensure_checkpoint_dir
from ..sources.sinks import read_batches, write_batch

RAW_PRICE_SCHEMA = ("ticker string, Date date, Open double, High double, Low double, Close double, "
                    "Adj_Close double, Volume bigint")
EVENT_SCHEMA = "job_id bigint, ts timestamp, event_id bigint, status string, message string"


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh folder under the cluster's shared checkpoint folder (never a machine-local temp)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/volforge-{name}-{uuid.uuid4().hex}"


def stream_prices(spark: SparkSession, landing: str, table: str, checkpoint: str, available_now: bool = True,
                  first_batch: int = 0):
    """ST1: start the price ingestion stream; returns the StreamingQuery. A stream with a checkpoint
    of its own that continues a table starts at a ``first_batch`` beyond the batches before it."""
    src = spark.readStream.schema(RAW_PRICE_SCHEMA).parquet(landing)
    w = src.writeStream.foreachBatch(lambda batch, batch_id: write_batch(batch, table, first_batch + batch_id))
    w = w.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_prices(spark: SparkSession, table: str) -> DataFrame:
    """The price table (T1..T5) that the stream's batches leave."""
    return pr.transform_prices(read_batches(spark, table, pr.KEYS))


def stream_job_state(spark: SparkSession, landing: str, table: str, checkpoint: str,
                     watermark: str = "2 hours", available_now: bool = True):
    """ST2: start the job-state stream; returns the StreamingQuery."""
    ev = (spark.readStream.schema(EVENT_SCHEMA).parquet(landing)
               .withWatermark("ts", watermark)
               .dropDuplicatesWithinWatermark(["event_id"]))
    state = fold_job_state(ev)

    w = state.writeStream.outputMode("update").foreachBatch(lambda batch, batch_id: write_batch(batch, table, batch_id))
    w = w.option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()


def read_job_state(spark: SparkSession, table: str) -> DataFrame:
    """The job states that the stream's batches leave."""
    return read_batches(spark, table, ["job_id"])
