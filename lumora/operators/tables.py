"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir; where that is unset, under a temporary one in local mode, else an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        shared = tempfile.mkdtemp(prefix="lumora-")
        spark.conf.set("spark.checkpoint.dir", shared)
    return f"{shared.rstrip('/')}/lumora-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table: it is computed once, cuts lineage and survives lost executors."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


ROWS = 500_000  # of a task, about


def dealt(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """df of about `rows` rows, by keys in as many partitions as keep a task's sorts small; a small table as it is.

    Spark's own number of partitions is fixed, and it merges them by their compressed size, which says little of rows in memory.
    """
    n = -(-rows // ROWS)
    return df.repartition(n, *keys) if n > 4 else df
