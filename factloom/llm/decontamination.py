"""Benchmark decontamination by template canonicalisation.

Numbers, names and units of a text become typed placeholders; windows of 5 canonical words of documents and benchmark items are joined by hash. Along each alignment of a document with an item the slots must be consistent: each value of the item stands for one value in the document, that of most windows, and windows that say otherwise are dropped. So verbatim copies are found, and questions whose parameters were replaced throughout. Windows of plain lower-cased words stand beside them, so that copies in capitals or small letters are found, where any word or none looks like a name.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructType

from .common import saved, slices, text_buffer
from .kernels import SPACE, U, LOWER, mix, span_hashes, windows, word_spans

WORDS = 5
#: Literal words that a window needs to count.
LITERALS = 2
#: Share of an item's windows that make a document contaminated.
COVERAGE = 0.5
#: Distinct benchmark windows up to which documents are filtered by a broadcast set (8 bytes each) before the join; beyond it, all their windows are joined by shuffle.
BROADCAST_WINDOWS = 1_000_000
UNITS = (
    "mm cm m km inch inches foot feet ft yard yards mile miles mg g kg gram grams kilogram kilograms ton tons tonne tonnes ounce ounces pound pounds lb lbs ml l litre litres liter liters gallon gallons "
    "s sec second seconds min minute minutes h hour hours day days week weeks month months year years percent degrees degree dollar dollars cent cents euro euros mph kph watt watts volt volts joule joules"
).split()

ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
UPPER = np.zeros(256, bool)
UPPER[65:91] = True
STOP = np.zeros(256, bool)
STOP[[ord(c) for c in ".!?:"]] = True
NUMBER, NAME, UNIT, PLAIN = mix(np.arange(11, 15, dtype=U))


def _units() -> np.ndarray:
    data = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    start, end = word_spans(data, np.array([0, len(data)]), ~SPACE)
    return np.sort(span_hashes(data, start, end))


UNIT_HASHES = _units()


def within(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Is each value in a sorted table?"""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def bare_words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words without outer punctuation: start, end, hash in lower case (A-Z), text, and start and end with the punctuation."""
    start, end = word_spans(data, off, ~SPACE)
    places = np.flatnonzero(ALNUM[data])
    a, b = np.searchsorted(places, start), np.searchsorted(places, end) - 1
    real = a <= b
    raw_start, raw_end = start[real], end[real]
    start, end = places[a[real]], places[b[real]] + 1
    return start, end, span_hashes(LOWER[data], start, end), np.searchsorted(off, start, "right") - 1, raw_start, raw_end


def canonical(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per word without outer punctuation: canonical hash, own hash, is it a slot, its text."""
    data, off = text_buffer(texts)
    start, _, own, of, raw_start, raw_end = bare_words(data, off)
    n = len(own)
    number = DIGIT[data[start]]
    before = np.zeros(n, bool)
    before[1:] = number[:-1] & (of[1:] == of[:-1])
    unit = before & ~number
    unit[unit] = within(own[unit], UNIT_HASHES)
    lines = np.cumsum(data == 10)
    opens = np.ones(n, bool)
    if n:
        opens[1:] = (of[1:] != of[:-1]) | STOP[data[raw_end[:-1] - 1]] | (lines[raw_start[1:]] != lines[raw_end[:-1] - 1])
    second = data[np.minimum(start + 1, max(len(data) - 1, 0))] if n else start
    upper = UPPER[data[start]] | (data[start] == 0xC3) & (second >= 0x80) & (second <= 0x9E) if n else np.zeros(0, bool)
    capital = upper & ~number & ~unit
    name = capital & ~opens
    # A word that opens a sentence is a name if it stands capitalised within one and never in small letters.
    key = own ^ mix(np.arange(1, len(off) + 1, dtype=U))[of]
    first = np.flatnonzero(capital & opens)
    inner = np.unique(key[first[within(key[first], np.unique(key[name]))]])
    if len(inner):
        small = key[~upper]
        inner = np.setdiff1d(inner, small[within(small, inner)])
        name[first[within(key[first], inner)]] = True
    words = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, own)))
    return words, own, number | unit | name, of


def template_windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows with enough literal words: hash, text, first word's place in its text, values of slots (windows x WORDS, 0: no slot)."""
    words, own, slot, of = canonical(texts)
    n = len(texts)
    h, doc, first = windows(words, of, n, WORDS)
    count = np.bincount(of, minlength=n)
    begin = np.cumsum(count) - count
    at = first[:, None] + np.arange(WORDS)
    inside = at < (begin + count)[doc][:, None]
    at = np.minimum(at, max(len(words) - 1, 0))
    enough = np.minimum(LITERALS, count[doc])
    good = (inside & ~slot[at]).sum(1) >= enough if len(h) else np.zeros(0, bool)
    values = np.where(inside & slot[at], own[at], U(0)).view(np.int64) if len(h) else np.zeros((0, WORDS), np.int64)
    return h[good].view(np.int64), doc[good], (first - begin[doc])[good], values[good]


def plain_windows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of lower-cased words without placeholders: hash, text, first word's place in its text."""
    _, _, own, of, _, _ = bare_words(*text_buffer(pc.utf8_lower(texts)))
    n = len(texts)
    h, doc, first = windows(mix(own ^ PLAIN), of, n, WORDS)
    count = np.bincount(of, minlength=n)
    return h.view(np.int64), doc, first - (np.cumsum(count) - count)[doc]


def windowed(df: DataFrame, key: str, only: np.ndarray | None = None) -> DataFrame:
    """(h, key, pos, slots, plain) for the windows of df (key long, text), with and without placeholders; only: sorted hashes to keep."""

    def run(batches):
        for b in batches:
            for s in slices(b.column("text")):
                part = b.slice(*s)
                h, doc, pos = plain_windows(part.column("text"))
                families = ((*template_windows(part.column("text")), False), (h, doc, pos, np.zeros((len(h), WORDS), np.int64), True))
                for h, doc, pos, values, plain in families:
                    if only is not None:
                        keep = within(h, only)
                        h, doc, pos, values = h[keep], doc[keep], pos[keep], values[keep]
                    if len(h):
                        slots = pa.ListArray.from_arrays(np.arange(0, len(h) * WORDS + 1, WORDS, dtype=np.int32), pa.array(values.ravel()))
                        yield pa.RecordBatch.from_arrays([pa.array(h), part.column(key).take(pa.array(doc)), pa.array(pos), slots, pa.array(np.full(len(h), plain))], names=["h", key, "pos", "slots", "plain"])

    return df.mapInArrow(run, f"h long, {key} long, pos long, slots array<long>, plain boolean")


def settled(windows: list[dict]) -> tuple[list[int], int]:
    """The places of an alignment's windows whose slots agree with the majority, and how many of the item's values these change.

    Each value of the item stands for the document's value that most windows give it (of equally many, the item's own, then the smallest).
    """
    votes: dict[int, Counter] = defaultdict(Counter)
    for w in windows:
        for own, other in {(a, b) for a, b in zip(w["item_slots"], w["slots"], strict=True) if a}:
            votes[own][other] += 1
    chosen = {own: min(c, key=lambda v, own=own, c=c: (-c[v], v != own, v)) for own, c in votes.items()}
    good = [w for w in windows if all(chosen[a] == b for a, b in zip(w["item_slots"], w["slots"], strict=True) if a)]
    used = {a for w in good for a in w["item_slots"] if a}
    return sorted({w["item_pos"] for w in good}), sum(chosen[a] != a for a in used)


@F.arrow_udf(StructType().add("places", ArrayType(LongType())).add("changed", LongType()))
def consistent(found: pa.Array) -> pa.Array:
    rows = [settled(windows) for windows in found.to_pylist()]
    kinds = (pa.list_(pa.int64()), pa.int64())
    return pa.StructArray.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["places", "changed"])


def decontaminate(docs: DataFrame, items: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """One row per contaminated document and item: doc_id, item_id, n_windows, n_matched, coverage, n_changed.

    A document is reported when either family of windows, with placeholders or plain, reaches the coverage. n_windows: distinct places of the item's usable windows; n_matched: those found, without windows whose slots clash along their alignment; n_changed: values of the item that are others in the document. Names are capitalised words within sentences, and at their start if the text has them within sentences too and never in small letters. Items without a usable window match nothing. Null texts count as empty. Rows that repeat an id count as one text's windows; a null id is reported as null. Other columns are not looked at. Empty input on either side: empty output.
    """
    own = items.select(F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    item_windows = saved(windowed(own, "item_id").withColumnsRenamed({"pos": "item_pos", "slots": "item_slots"}), "item-windows")
    known = item_windows.select("h").distinct()
    only = None
    if known.count() <= BROADCAST_WINDOWS:
        only = np.sort(known.toArrow().column("h").to_numpy())
    matches = windowed(texts, "doc_id", only).drop("plain").join(item_windows, "h")
    # An alignment has at most as many windows as the item.
    aligned = matches.groupBy("doc_id", "item_id", "plain", (F.col("pos") - F.col("item_pos")).alias("shift")).agg(F.collect_set(F.struct("item_pos", "item_slots", "slots")).alias("found"))
    kept = aligned.select("doc_id", "item_id", "plain", consistent("found").alias("kept"))
    found = kept.groupBy("doc_id", "item_id", "plain").agg(F.size(F.array_distinct(F.flatten(F.collect_list("kept.places")))).cast("long").alias("n_matched"), F.sum("kept.changed").alias("n_changed"))
    sizes = item_windows.groupBy("item_id", "plain").agg(F.countDistinct("item_pos").alias("n_windows"))
    share = F.col("n_matched") / F.col("n_windows")
    own_id = {"item_id": "own_id", "plain": "own_plain"}
    out = found.join(sizes.withColumnsRenamed(own_id), F.col("item_id").eqNullSafe(F.col("own_id")) & (F.col("plain") == F.col("own_plain")))
    reached = out.withColumn("coverage", share).where(F.col("coverage") >= coverage)
    # Where both families reach it, the one with placeholders is reported.
    best = reached.groupBy("doc_id", "item_id").agg(F.min_by(F.struct("n_windows", "n_matched", "coverage", "n_changed"), "plain").alias("best"))
    return best.select("doc_id", "item_id", "best.*")
