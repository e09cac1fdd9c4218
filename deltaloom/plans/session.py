"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_folder(spark) -> str:
    """spark.checkpoint.dir; where it is unset, a folder of our own, on one machine only (tests)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="deltaloom-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Rows that one task of per-row Python takes.
TASK_ROWS = 20_000


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt by hash to all cores, TASK_ROWS to a task at most: a small file is read by one task, however much is made of its rows."""
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // TASK_ROWS))
    return rows.repartition(tasks, *keys)


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and read it again: later rounds neither recompute it nor depend on executors' memory."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
