"""Tables that are written once where all executors see them, and rows dealt out so that tasks stay small."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task that groups rows by item.
TASK_ROWS = 1 << 19


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; where that is unset, of this machine, if all runs in one process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-rankpulse-", dir="/tmp")
    return f"{root.rstrip('/')}/run-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Writes a table to a shared folder and reads it again: what is made from it several times is computed once, and Spark knows its size."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def parts_of(spark: SparkSession, rows: int) -> int:
    """Partitions that keep a task's rows near TASK_ROWS however many there are."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def dealt(df: DataFrame, *keys: str) -> DataFrame:
    """The rows by keys, in as many partitions as keep a task's rows near TASK_ROWS however many there are. Counts the rows, so it is for tables that are read, not computed."""
    return df.repartition(parts_of(df.sparkSession, df.count()), *keys)
