"""Substring deduplication by content-defined chunks.

A gear rolling hash (the last 16 bytes count) runs over each text; a cut is where it is largest among REACH bytes on either side, so cuts depend on nearby bytes alone and an insertion shifts no later chunk. Digests tell which chunks are repeated, and so which windows of MIN_WORDS words may be; the first place of each such window (smallest id, then position) keeps it. Copied windows are grown byte by byte against the kept text, and the stretches are reported and may be cut out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, saved, skew_join, slices, text_buffer
from .kernels import BYTE, SPACE, U, powers, mix, span_hashes, word_spans

#: A cut is a maximum among 32 bytes on either side: chunks of some 65 bytes.
REACH, MIN_WORDS = 32, 50
#: Longest chunk; only texts that repeat themselves (runs of one character) reach it.
MOST = 512
#: Ids that may be broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Keys of further texts of an id begin here.
FURTHER = 1 << 62
#: Bits of a set of marks: 16 a hash at least, but so many in all at most (64 MB); and bits of one of its segments.
MARK_BITS, MOST_BITS, SEGMENT_BITS = 16, 1 << 29, 1 << 16
WINDOW = "key long, at int, h long, again boolean"


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte: h = 2 * h + G[byte], kept to the last 16 bytes, finished."""
    h = BYTE[data].copy()
    for k in range(4):  # sums over 2, 4, 8, 16 bytes
        step = 1 << k
        h[step:] = h[step:] + (h[:-step] << U(step))
    return mix(h)


def cuts(h: np.ndarray) -> np.ndarray:
    """Places after which a chunk ends: strict maxima of h within REACH on either side."""
    n = len(h)
    if n == 0:
        return np.zeros(0, np.int64)
    padded = np.concatenate([np.zeros(REACH, U), h, np.zeros(REACH, U)])
    size = 2 * REACH + 1
    top, span = padded, 1
    while span * 2 <= size:  # maxima of 2, 4, ... values
        top = np.maximum(top[:-span], top[span:])
        span *= 2
    top = np.maximum(top[: n], top[size - span : size - span + n])
    return np.flatnonzero(h == top) + 1


def chunks(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, start in it, length in bytes and digest of each chunk."""
    data, off = text_buffer(texts)
    # Texts are set apart, so that no cut depends on the neighbouring text.
    ends = [np.zeros(0, np.int64)]
    for d in range(len(texts)):
        if off[d + 1] > off[d]:
            c = cuts(gear(data[off[d] : off[d + 1]])) + off[d]
            ends.append(c if len(c) and c[-1] == off[d + 1] else np.append(c, off[d + 1]))
    end = np.concatenate(ends)
    start = np.concatenate([[0], end[:-1]]) if len(end) else end
    long = np.flatnonzero(end - start > MOST)
    if len(long):
        extra = np.concatenate([np.arange(start[k] + MOST, end[k], MOST) for k in long])
        end = np.unique(np.concatenate([end, extra]))
        start = np.concatenate([[0], end[:-1]])
    of = np.searchsorted(off, start, "right") - 1
    digest = np.empty(len(end), U)
    at = 0
    while at < len(end):  # polynomial digests, a megabyte at a time
        to = max(at + 1, int(np.searchsorted(end, start[at] + (1 << 20), "right")))
        lo, hi = int(start[at]), int(end[to - 1])
        up, down = powers(max(1 << 20, hi - lo))
        total = np.zeros(hi - lo + 1, U)
        np.cumsum(BYTE[data[lo:hi]] * up[: hi - lo], out=total[1:])
        digest[at:to] = (total[end[at:to] - lo] - total[start[at:to] - lo]) * down[start[at:to] - lo]
        at = to
    return of, start - off[of], end - start, mix(digest + (end - start).astype(U) * U(0x9E3779B97F4A7C15))


def identified(docs: DataFrame) -> DataFrame:
    """key, doc_id and text of documents with an id, each id and text once. key is doc_id, but a number beyond all ids for the second text of an id and further ones.

    Where no id is repeated, only the ids are exchanged.
    """
    own = documents(docs).where("doc_id IS NOT NULL")
    again = saved(own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    n = again.count()
    if not n:
        return own.select(F.col("doc_id").alias("key"), "doc_id", "text")
    few = F.broadcast if n <= BROADCAST_IDS else lambda rows: rows
    h = F.xxhash64("text")
    first = saved(own.join(few(again), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(h).alias("first")), "first-texts")
    further = F.xxhash64("doc_id", "text").bitwiseAND(FURTHER - 1) + F.lit(FURTHER)
    several = own.join(few(first), "doc_id").select(F.when(h == F.col("first"), F.col("doc_id")).otherwise(further).alias("key"), "doc_id", "text")
    return own.join(few(again), "doc_id", "left_anti").select(F.col("doc_id").alias("key"), "doc_id", "text").unionByName(several.dropDuplicates(["key"]))


def marks(hashes: DataFrame, most: int = MOST_BITS) -> Broadcast:
    """A set of uniform 64-bit hashes (column h, each once) for marked(): one bit for each, by its low bits, sent to all tasks.

    It spares exchanges of rows that a join would drop. Some one in 16 to 32 other hashes passes too, more where `most` bounds the bits, so a join must follow.
    """
    n = hashes.count()
    bits = min(most, max(SEGMENT_BITS, 1 << (MARK_BITS * n).bit_length()))

    def packed(rows: pa.Table) -> pa.Table:
        own = np.zeros(SEGMENT_BITS, bool)
        own[rows.column("place").to_numpy()] = True
        return pa.table([rows.column("segment").slice(0, 1).cast(pa.int32()), pa.array([np.packbits(own, bitorder="little").tobytes()], pa.binary())], names=["segment", "bits"])

    at = F.col("h").bitwiseAND(bits - 1)
    places = hashes.select(F.shiftright(at, SEGMENT_BITS.bit_length() - 1).cast("int").alias("segment"), at.bitwiseAND(SEGMENT_BITS - 1).cast("int").alias("place"))
    got = places.groupBy("segment").applyInArrow(packed, "segment int, bits binary").toArrow()
    out, size = np.zeros(bits // 8, np.uint8), SEGMENT_BITS // 8
    for k, own in zip(got.column("segment").to_pylist(), got.column("bits").to_pylist(), strict=True):
        out[k * size : (k + 1) * size] = np.frombuffer(own, np.uint8)
    return hashes.sparkSession.sparkContext.broadcast(out)


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes may be in the set; all that are in it are."""
    at = h & U(len(bits) * 8 - 1)
    return (bits[at >> U(3)] >> (at & U(7)).astype(np.uint8) & 1).astype(bool)


def chunk_digests(texts: DataFrame) -> DataFrame:
    """The digest of each chunk of each text."""

    def run(batches):
        for b in batches:
            for s in slices(b.column("text")):
                digest = chunks(b.column("text").slice(*s))[3]
                if len(digest):
                    yield pa.RecordBatch.from_arrays([pa.array(digest.view(np.int64))], names=["h"])

    return texts.select("text").mapInArrow(run, "h long")


def word_windows(text: np.ndarray, finish: np.ndarray, length: np.ndarray, repeated: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of the windows of `size` words, byte for byte, that may stand elsewhere: all chunks that the window alone determines are repeated. Chunks by their ends and lengths."""
    start, end = word_spans(text, np.array([0, len(text)]), ~SPACE)
    if len(start) < size:
        return np.zeros(0, np.int64), np.zeros(0, U)
    lo, hi = start[: len(start) - size + 1], end[size - 1 :]
    # Where a longest chunk ends depends on where it began, and so is no cut of the window's own.
    own = np.flatnonzero(length != MOST)
    cut, bare = finish[own], np.cumsum(~repeated)[own]
    # A cut after byte i depends on bytes i - REACH - 15 to i + REACH; those of a window's first 2 * REACH bytes are left out.
    first, last = np.searchsorted(cut, lo + 2 * REACH), np.searchsorted(cut, hi - REACH, "right") - 1
    good = first >= last
    k = np.flatnonzero(~good)
    good[k] = bare[last[k]] == bare[first[k]]
    at = np.flatnonzero(good)
    return at, span_hashes(text, lo[at], hi[at])


def window_table(texts: DataFrame, size: int, digests: Broadcast, hashes: Broadcast | None = None) -> DataFrame:
    """One row per window that may be repeated: key, at (its first word), h, again (seen before in this text). digests: marks of the repeated chunks; hashes: of the windows asked for, else all."""

    def run(batches):
        for b in batches:
            for s in slices(b.column("text")):
                part, rows = b.slice(*s), []
                data, off = text_buffer(part.column("text"))
                of, start, length, digest = chunks(part.column("text"))
                repeated, bounds = marked(digests.value, digest), np.searchsorted(of, np.arange(len(part) + 1))
                for k, key in enumerate(part.column("key").to_pylist()):
                    c = slice(bounds[k], bounds[k + 1])
                    at, h = word_windows(data[off[k] : off[k + 1]], start[c] + length[c], length[c], repeated[c], size)
                    if hashes is not None and len(at):
                        found = marked(hashes.value, h)
                        at, h = at[found], h[found]
                    if len(at):
                        again = np.ones(len(at), bool)
                        again[np.unique(h, return_index=True)[1]] = False
                        rows.append((np.full(len(at), key), at, h.view(np.int64), again))
                if rows:
                    key, at, h, again = (np.concatenate(c) for c in zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(at, pa.int32()), pa.array(h), pa.array(again)], names=["key", "at", "h", "again"])

    return texts.select("key", "text").mapInArrow(run, WINDOW)


def copied_windows(texts: DataFrame, size: int) -> DataFrame:
    """(key, keep, places): first words of a text's windows whose first place is in the text with the key keep; within a text, of those seen earlier in it."""
    # Partial aggregation leaves one row for each hash and task before the exchange.
    twice = chunk_digests(texts).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").select("h")
    digests = marks(saved(twice, "repeated-chunks"))
    every = window_table(texts, size, digests)
    owners = saved(every.groupBy("h").agg(F.min("key").alias("keep"), F.count("*").alias("n")).where("n > 1").select("h", "keep"), "window-owners")
    asked = window_table(texts, size, digests, marks(owners.select("h")))
    copied = skew_join(asked, owners, "h").where("keep < key OR again")
    return copied.groupBy("key", "keep").agg(F.sort_array(F.collect_set("at")).alias("places"))


def among(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """texts without most of those whose key is not in keys; a join must follow."""
    found = marks(saved(keys.distinct().select(F.xxhash64("key").alias("h")), "keys-asked-for"))

    @F.arrow_udf("boolean")
    def may_be(h: pa.Array) -> pa.Array:
        return pa.array(marked(found.value, h.to_numpy(zero_copy_only=False).view(U)))

    return texts.where(may_be(F.xxhash64("key")))


def agreeing(a: np.ndarray, b: np.ndarray) -> int:
    """How many bytes are equal from the start on."""
    n, at, step = min(len(a), len(b)), 0, 256
    while at < n:
        to = min(n, at + step)
        apart = np.flatnonzero(a[at:to] != b[at:to])
        if len(apart):
            return at + int(apart[0])
        at, step = to, step * 2
    return n


def grown(text: np.ndarray, source: np.ndarray, hay: bytes, begin: int, finish: int, same: bool) -> tuple[int, int] | None:
    """The longest equal stretch of text around [begin, finish) at any of its places in source, whose bytes are hay (in the same text: earlier)."""
    piece, best = text[begin:finish].tobytes(), None
    place = hay.find(piece)
    while place >= 0 and not (same and place >= begin):
        left = agreeing(text[:begin][::-1], source[:place][::-1])
        right = agreeing(text[finish:], source[place + finish - begin :])
        if best is None or left + right > begin - best[0] + best[1] - finish:
            best = begin - left, finish + right
        place = hay.find(piece, place + 1)
    return best


def passages(text: str, source: str, places: list[int], same: bool, min_words: int) -> list[tuple[int, int, int]]:
    """(start, end, words) in code points of the copied stretches of text with min_words whole words or more that hold the windows at these words. Stretches may overlap, as each one is whole in source."""
    a = np.frombuffer(text.encode(), np.uint8)
    b = a if same else np.frombuffer(source.encode(), np.uint8)
    hay = b.tobytes()
    start, end = word_spans(a, np.array([0, len(a)]), ~SPACE)
    at = np.array(places)
    at = at[at + min_words <= len(start)]
    last = end[at + min_words - 1]
    found: list[tuple[int, int]] = []
    k = 0
    while k < len(at):
        span = grown(a, b, hay, int(start[at[k]]), int(last[k]), same)
        if span:
            found.append(span)
        # Windows that a stretch holds are done: the next one starts a stretch of its own.
        k = max(k + 1, int(np.searchsorted(last, span[1], "right"))) if span else k + 1
    points = np.concatenate([[0], np.cumsum((a & 0xC0) != 0x80)])
    out = []
    for begin, finish in found:
        first, final = int(np.searchsorted(start, begin)), int(np.searchsorted(end, finish, "right"))
        out.append((int(points[start[first]]), int(points[end[final - 1]]), final - first))
    return out


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per copied passage: doc_id, start, end (code points, end exclusive), n_words, keep_id (the document that keeps the passage).

    A passage is a longest stretch equal byte for byte to one of keep_id, counted in whole words. Chunks leave the windows of min_words words that may be repeated; each of these is kept by the smallest id that holds it whole, and grown at all its places there. A repetition within a document is copied from its first place. Null texts count as empty and hold nothing. Rows with a null doc_id keep and report nothing. Rows equal in id and text count as one. Rows with one id and several texts are texts of their own, that with the smallest hash before the others and these after all ids: what they hold of the first is copied (keep_id is that id), and spans are those of the row's own text. Other columns are not looked at. Empty input: empty output.
    """
    every = identified(docs)
    runs = saved(copied_windows(every, min_words), "copied-windows")
    # Only texts that hold a copy or keep one are exchanged.
    texts = among(every, runs.select("key"))
    sources = among(every, runs.select(F.col("keep").alias("key"))).select(F.col("key").alias("keep"), F.col("doc_id").alias("keep_id"), F.col("text").alias("source"))
    pairs = runs.join(texts, "key").join(sources, "keep")

    def run(batches):
        for b in batches:
            rows = []
            for doc, keep, same, places, text, source in zip(*(b.column(c).to_pylist() for c in ("doc_id", "keep_id", "same", "places", "text", "source")), strict=True):
                rows += [(doc, s, e, n, keep) for s, e, n in passages(text, source, places, same, min_words)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=["doc_id", "start", "end", "n_words", "keep_id"])

    return pairs.select("doc_id", "keep_id", (F.col("key") == F.col("keep")).alias("same"), "places", "text", "source").mapInArrow(run, "doc_id long, start long, end long, n_words long, keep_id long")


def cut_out(docs: DataFrame, found: DataFrame) -> DataFrame:
    """doc_id and text of each document without its copied passages."""
    spans = found.groupBy("doc_id").agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias("spans"))

    @F.arrow_udf("string")
    def left(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for text, own in zip(texts.to_pylist(), spans.to_pylist(), strict=True):
            at, parts = 0, []
            for s in own or ():
                parts.append(text[at : max(at, s["start"])])
                at = max(at, s["end"])
            out.append("".join(parts) + text[at:])
        return pa.array(out, pa.string())

    return documents(docs).join(spans, "doc_id", "left").select("doc_id", left("text", "spans").alias("text"))
