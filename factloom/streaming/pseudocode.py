"""Pseudocode batches taken in as they arrive (Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

SCHEMA = "image_id long, function long, pseudocode string, plain long, status string, reason string, seconds double, written timestamp"


def incoming(spark: SparkSession, path: str) -> DataFrame:
    """Rows of new Parquet files in a folder."""
    return spark.readStream.schema(SCHEMA).parquet(path)


def once(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """Each function's row of a moment once, though exporters send it again; what is later than the watermark goes."""
    return rows.withWatermark("written", late).dropDuplicatesWithinWatermark(["image_id", "function", "written"])


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Rows appended to the store; a restarted query goes on where it was and repeats nothing."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy("image_id").trigger(availableNow=True).start()


def progress(rows: DataFrame, window: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """Functions, failures and seconds of each image and window of time."""
    w = rows.withWatermark("written", late).groupBy(F.window("written", window), "image_id")
    return w.agg(F.count("*").alias("functions"), F.count_if(F.col("status") != "Ok").alias("failed"), F.sum("seconds").alias("seconds"))


def current(store: DataFrame) -> DataFrame:
    """The last row written of each function."""
    rest = [c for c in store.columns if c not in ("image_id", "function")]
    return store.groupBy("image_id", "function").agg(F.max_by(F.struct(*rest), "written").alias("x")).select("image_id", "function", "x.*")
