"""Helpers shared by the corpus operators: table access, reliable checkpoints, clash-free column
names, and streaming over contiguous key groups inside Arrow map tasks."""
from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_SPACE = " \t\n\x0b\f\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder every executor can read: the one already set, else the one named by
    ``spark.checkpoint.dir``. Only a session whose tasks all run in the driver process may fall
    back to a folder of its own; a cluster without a shared folder is an error."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = sc.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="volforge-checkpoint-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise reliably (shared folder) and cut the lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def store(df: DataFrame, folders: list[str]) -> DataFrame:
    """``df`` written once, compressed, to a folder of its own in the shared folder, and reread; the
    folder's name is added to ``folders``."""
    folders.append(f"{shared_dir(df.sparkSession)}/stored-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(folders[-1])
    return df.sparkSession.read.parquet(folders[-1])


def drop_stored(spark: SparkSession, folders: list[str]) -> None:
    """Delete what ``store`` wrote, once nothing that is still to run reads it."""
    for folder in folders:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(df: DataFrame, name: str) -> str:
    """``name``, or a variant of it that clashes with no column of ``df`` (names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def ascii_lower(c):
    """Lower-case A-Z only."""
    return F.translate(c, ASCII_UPPER, ASCII_UPPER.lower())


def task_partitions(df: DataFrame, rows: int, rows_per_task: int) -> int:
    """Partitions for a CPU-bound stage over ``rows`` rows: at least the session's shuffle
    partitions, and enough that no task gets much more than ``rows_per_task``."""
    base = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(base, -(-rows // rows_per_task))


def key_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.Table]]:
    """Contiguous groups of equal ``keys`` (integer columns, not null) of a partition sorted by
    them. Only the group that is still open is held back between batches."""
    held: list[pa.Table] = []
    held_key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch])
        cols = [t.column(k).to_numpy() for k in keys]
        change = np.zeros(len(t), dtype=bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(change).tolist()]
        for s, e in zip(starts, [*starts[1:], len(t)]):
            key = tuple(int(c[s]) for c in cols)
            if held and key != held_key:
                yield held_key, pa.concat_tables(held)
                held = []
            held_key = key
            held.append(t.slice(s, e - s))
    if held:
        yield held_key, pa.concat_tables(held)
