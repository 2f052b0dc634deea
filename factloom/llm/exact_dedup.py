"""Exact deduplication by a tree merge of sorted digest runs.

Each input partition makes one run: its distinct digests, sorted, with the smallest id and the count. In every round, blocks of `fan_in` neighbouring runs are merged into one (fan_in is a power of two: each round uses up as many binary digits of the run number, as in a binomial reduction), so after log(runs) rounds one run is left. A run is cut into segments by the leading digest bits, and runs merge segment by segment in a multiway merge: no task ever holds a whole run, and a digest stands in a run once, however many documents have it. At each level only the smallest id of each verified digest goes on.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from itertools import islice, repeat
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, saved

FAN_IN = 16
#: Digests of a segment of the last run, about; segments are cut by the leading 16 bits of the digest.
SEGMENT, LEAST_SEGMENTS, MOST_SEGMENTS = 32_768, 8, 65_536
DIGEST = ("sha", "bytes", "check")
#: Entries of an Arrow batch.
ROWS = 10_000
ENTRY = "run int, segment int, sha binary, bytes int, check long, keep_id long, group_size long"
NAMES = [c.split()[0] for c in ENTRY.split(", ")]
Entry = tuple[bytes, int, int, int | None, int]


def normalised(text):
    """A text with each run of the characters x20, x09-x0D as one space."""
    return F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")


def merged(runs: list[Iterable[Entry]]) -> Iterator[Entry]:
    """One sorted run from several: entries (sha, bytes, check, smallest id, count); those that agree in all three marks become one."""
    last: Entry | None = None
    for entry in heapq.merge(*runs, key=itemgetter(0, 1, 2)):
        if last is not None and entry[:3] == last[:3]:
            ids = [i for i in (last[3], entry[3]) if i is not None]
            last = (*last[:3], min(ids, default=None), last[4] + entry[4])
        else:
            if last is not None:
                yield last
            last = entry
    if last is not None:
        yield last


def entries(table: pa.Table) -> list[Entry]:
    """The entries of a run; they are in order as they left its task, or are put in order again."""
    rows = list(zip(*(table.column(c).to_pylist() for c in (*DIGEST, "keep_id", "group_size")), strict=True))
    order = itemgetter(0, 1, 2)
    return rows if all(order(a) < order(b) for a, b in zip(rows, rows[1:], strict=False)) else sorted(rows, key=order)


def batches(found: Iterable[Entry], run: int, segments: int) -> Iterator[pa.RecordBatch]:
    """A run's entries with its number and their segments."""
    kinds = (pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
    found = iter(found)
    while rows := list(islice(found, ROWS)):
        segment = [int.from_bytes(r[0][:2], "big") * segments // MOST_SEGMENTS for r in rows]
        own = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array([run] * len(rows), pa.int32()), pa.array(segment, pa.int32()), *own], names=NAMES)


def first_runs(rows: DataFrame, segments: int) -> DataFrame:
    """The run of each partition: its rows are sorted where they are, and neighbours with one digest made one."""

    def work(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        run = TaskContext.get().partitionId()
        listed = (entry for part in parts for entry in zip(*(part.column(c).to_pylist() for c in (*DIGEST, "doc_id")), repeat(1)))
        yield from batches(merged([listed]), run, segments)

    return rows.select(*DIGEST, "doc_id").sortWithinPartitions(*DIGEST).mapInArrow(work, ENTRY)


def merge_round(level: DataFrame, fan_in: int | None, segments: int) -> DataFrame:
    """Each block of fan_in neighbouring runs becomes one, segment by segment; None: all that are left."""

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        run = table.column("run").to_numpy()
        sources = [entries(table.filter(pa.array(run == r))) for r in np.unique(run)]
        return pa.Table.from_batches(batches(merged(sources), key[0].as_py(), segments))

    block = F.expr(f"run div {fan_in}") if fan_in else F.lit(0)
    return level.withColumn("block", block.cast("int")).groupBy("block", "segment").applyInArrow(merge, ENTRY)


def exact_dedup(docs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts count as empty texts. A digest is the SHA-256 of the normalised text; two other marks (its length in bytes and a 64-bit hash of another family) go along, and entries merge only if all agree. Rows with a null doc_id count in group_size and are kept only where no row of the group has an id. Rows that repeat an id with the same text are all marked alike. Other columns are not looked at. Empty input: empty output.
    """
    text = normalised(F.col("text"))
    digests = (
        documents(docs).select("doc_id", text.alias("norm"))
        .select("doc_id", F.unhex(F.sha2("norm", 256)).alias("sha"), F.octet_length("norm").alias("bytes"), F.xxhash64("norm").alias("check"))
    )
    rows = saved(digests, "digests")
    size = rows.select(F.spark_partition_id().alias("run")).agg(F.max("run").alias("last"), F.count("*").alias("n")).first()
    segments = min(MOST_SEGMENTS, max(LEAST_SEGMENTS, 1 << (size["n"] // SEGMENT).bit_length()))
    level, n = first_runs(rows, segments), (size["last"] or 0) + 1
    while n > fan_in:
        level, n = merge_round(level, fan_in, segments), -(-n // fan_in)
    winners = merge_round(level, None, segments).drop("run", "segment")
    kept = F.coalesce(F.col("doc_id") == F.col("keep_id"), F.col("keep_id").isNull())
    return rows.join(winners, list(DIGEST)).select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
