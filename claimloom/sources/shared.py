"""Cutting lineage in loops, in the folder that driver and executors share, and joins of what was cut."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Rows of a join's side that Spark may broadcast.
BROADCAST = 100_000


def fresh(spark: SparkSession, name: str) -> str:
    """A new folder's path in spark.checkpoint.dir; where that is unset, as in tests, a local session gets a folder of its own, a cluster doesn't."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="claimloom-")
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet to the shared folder and read back."""
    path = fresh(df.sparkSession, "cut")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """The rows, dealt out over as many tasks as shuffles have: files of a few MB are read by one task, however many rows they hold and whatever work a row is."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def beside(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df as a join's right side: beyond BROADCAST rows it is shuffled, never broadcast.

    Spark takes a frame's size from its compressed files, often a small part of what its rows take in the driver's memory. rows: their number or a bound
    of it, if it is known; else they are counted, which costs little for what cut() gives, and only for that.
    """
    return df.hint("merge") if (df.count() if rows is None else rows) > BROADCAST else df
