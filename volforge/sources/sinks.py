"""Sinks: upsert, partition-scoped overwrite, snapshots, typed result rows, date spines.

Writes use dynamic partition overwrite, so a job replaces only the partitions (tickers, jobs) it
produced; nothing is counted or collected before writing."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RESULT_COLUMNS = ["Runs", "K", "T", "CallPrice", "PutPrice", "method", "ticker", "S0"]


def upsert_frame(existing: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """S4 as a frame: new rows replace existing rows with the same keys (update-all / insert-all).
    An anti join on the keys (shuffle on keys, partial work on both sides) — no table format needed."""
    cols = new.columns
    return new.unionByName(existing.select(*cols).join(new.select(*keys), keys, "left_anti"))


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether there is anything at ``path``, on whatever file system it names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One micro-batch as a folder of its own, named by its id. A batch that is tried again replaces
    its own folder only, so a crash at any point leaves all others as they were."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={int(batch_id)}")


def read_batches(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The table that the batches at ``path`` leave: per key the row of its latest batch."""
    log = spark.read.parquet(path)
    rest = [c for c in log.columns if c not in (*keys, "batch")]
    last = log.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("batch", *rest)).alias("_row"))
    return last.select(*keys, *(F.col(f"_row.`{c}`").alias(c) for c in rest))


def upsert_prices(spark: SparkSession, new: DataFrame, path: str, keys: list[str] | None = None,
                  partition_by: str = "ticker") -> None:
    """Merge ``new`` into the parquet table at ``path`` on (ticker, Date). Only the touched
    ticker partitions are rewritten (dynamic partition overwrite). A missing table is created; a table
    that is there but cannot be read is an error, and nothing is written."""
    keys = keys or ["ticker", "Date"]
    old = spark.read.parquet(path) if path_exists(spark, path) else None
    if old is None:
        new.write.mode("overwrite").partitionBy(partition_by).parquet(path)
        return
    touched = new.select(partition_by).distinct()
    merged = upsert_frame(old.join(touched, partition_by, "left_semi"), new, keys)
    # Cut the lineage to the table being overwritten before writing over it.
    merged = merged.checkpoint(eager=True)
    (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
           .partitionBy(partition_by).parquet(path))


def replace_partition(df: DataFrame, path: str, partition_by: str = "ticker") -> None:
    """Overwrite only the partitions present in ``df`` (e.g. one ticker or one job_id)."""
    (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
       .partitionBy(partition_by).parquet(path))


def export_snapshot(df: DataFrame, path: str) -> None:
    """Full snapshot overwrite without the audit column."""
    out = df.drop("created_at") if "created_at" in df.columns else df
    out.write.mode("overwrite").parquet(path)


def typed_results(priced: DataFrame) -> DataFrame:
    """The pricing-result layout: Runs INT, K FLOAT (32-bit, as stored), T INT, doubles, created_at."""
    return priced.select(
        F.col("Runs").cast("int").alias("Runs"), F.col("K").cast("float").alias("K"),
        F.col("T").cast("int").alias("T"), F.col("CallPrice").cast("double"), F.col("PutPrice").cast("double"),
        F.col("method").cast("string"), F.col("ticker").cast("string"), F.col("S0").cast("double"),
        F.current_timestamp().alias("created_at"))


def read_results(results: DataFrame, **filters) -> DataFrame:
    """Conjunctive equality filters on the columns that exist, for the values that are given.
    K is compared as FLOAT on both sides (it is stored 32-bit)."""
    out = results
    for col, val in filters.items():
        if val is None or col not in results.columns:
            continue
        if col == "K":
            out = out.where(F.col("K").cast("float") == F.lit(val).cast("float"))
        else:
            out = out.where(F.col(col) == F.lit(val))
    return out


def date_spine(start: Column, end: Column) -> Column:
    """One element per calendar day in [start, end] (explode it); empty when start > end."""
    return F.when(start <= end, F.sequence(start, end, F.expr("INTERVAL 1 DAY")))


def export_summary(df: DataFrame, table: str, path: str) -> DataFrame:
    """Job summary row (table, path, row count) — one aggregate, not a collect."""
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(table).alias("table"), F.lit(path).alias("path"), "row_count")
