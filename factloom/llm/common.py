"""What the operators share: input columns, tables in the shared folder, Arrow maps."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.session import importable as importable
from factloom.session import saved as saved

#: Bytes of text that one step of a vectorised map works on; a longer text is a step of its own.
STEP_BYTES = 1 << 20


def documents(df: DataFrame, *extra: str) -> DataFrame:
    """doc_id long and text (null: empty), and the named extra columns; others go, whatever their names."""
    return df.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *extra)


def text_buffer(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and its len+1 offsets, without copying."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(texts: pa.Array, size: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """(start, length) of slices with about `size` bytes of text each; a longer text is alone."""
    _, off = text_buffer(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(off, off[at] + size, "right")) - 1)
        yield at, to - at
        at = to


def steps(batch: pa.RecordBatch, column: str = "text", size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about `size` bytes of text each."""
    for s in slices(batch.column(column), size):
        yield batch.slice(*s)


def arrow_map(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str, column: str = "text") -> DataFrame:
    """df through work(), some megabytes of text at a time."""

    def run(batches):
        for batch in batches:
            for part in steps(batch, column):
                if (out := work(part)) is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def skew_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi join on a long column, where right comes from an aggregation by it.

    The key is joined with its bits flipped: so right doesn't keep the aggregate's partitioning, both sides get exchanges of their own, and the adaptive planner can split a hot key of left over tasks.
    """
    own = right.withColumn("_key", F.bitwise_not(key)).drop(key)
    return left.withColumn("_key", F.bitwise_not(key)).join(own, "_key", how).drop("_key")
