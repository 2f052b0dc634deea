"""Session helpers."""

from __future__ import annotations

import os
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: Rows and bytes of an Arrow batch: documents are long, and batches are held on both sides of the pipe.
ARROW = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": "4194304"}


def importable(spark: SparkSession) -> None:
    """Python workers started from now on find this package where the driver found it (on a cluster: the same path, or --py-files), and get small Arrow batches unless the session has its own sizes."""
    for key, own in ARROW.items():
        if not spark.conf.get(key, None):
            spark.conf.set(key, own)
    root = str(Path(__file__).resolve().parents[1])
    environment = spark.sparkContext.environment
    environment.setdefault("ARROW_DEFAULT_MEMORY_POOL", "system")  # what a batch took goes back to the machine
    environment["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([root, *filter(None, environment.get("PYTHONPATH", "").split(os.pathsep))]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in a local session a fresh one under /tmp."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir("/tmp/factloom-checkpoints")
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def saved(df: DataFrame, name: str) -> DataFrame:
    """df, written as Parquet into the shared folder and read back: lineage ends there and lost executors cost nothing.

    The folder is deleted with the session's other checkpoints by the owner of the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
