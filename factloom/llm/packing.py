"""Best-fit packing planned over a histogram of lengths.

Documents become pieces of at most `size` tokens. Only the counts by length (at most `size` numbers) reach the driver; best-fit decreasing runs over counts: groups of equal sequences take blocks of equal pieces. The plan gives each rank within a length its sequence and offset; pieces get their rank from counts by (length, partition) and take their slot by rank.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import documents, saved, steps

SIZE, END = 4096, 1
#: Words whose ids a Python worker remembers.
MEMO = 240_000
_encoders: dict[str, Encoder] = {}


class Memo(dict):
    """What make() says of each key, for the keys in use: at MEMO / 2 keys the older half goes."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, key):
        out = self.older.get(key)
        if out is None:
            out = self.make(key)
        if len(self) >= MEMO // 2:
            self.older = dict(self)
            self.clear()
        self[key] = out
        return out


#: Bytes of Latin-1 texts that take the direct way: printable ones, spaces and new lines.
DIRECT = bytes([10, *range(32, 127), *range(161, 173), *range(174, 256)])
#: The tokenizer's own pattern (fixed value).
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


def latin_pattern() -> re.Pattern:
    """PATTERN for lower-cased texts of DIRECT characters: its classes as Latin-1 has them."""
    kinds = {k: "".join(re.escape(c) for c in map(chr, range(33, 256)) if unicodedata.category(c)[0] == k) for k in "LN"}
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['L']}]+|[{kinds['N']}]|[^ \\n{kinds['L']}{kinds['N']}]+")


class Encoder:
    """Ids of texts, those of the tokenizer's plain call: a string that names an added token is that token. White space parts the tokens of this tokenizer, so their parts can be encoded one by one and remembered.

    Latin-1 texts without an added token go through the tokenizer's steps one by one: lower case, its pattern, its byte letters, its merges. Words of other texts go through the whole tokenizer.
    """

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        self.direct = made["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] == PATTERN
        self.added = [t["content"] for t in made["added_tokens"]]
        self.find = latin_pattern().findall
        letters = ByteLevel(add_prefix_space=False, use_regex=False)
        self.letters = {chr(c): letters.pre_tokenize_str(chr(c))[0][0] for c in range(33, 256)}
        self.words, self.parts = Memo(self.word), Memo(self.part)

    def part(self, x: str) -> bytes:
        mapped = x if x.isascii() else "".join(map(self.letters.__getitem__, x))
        return array("I", [t.id for t in self.tokenizer.model.tokenize(mapped)]).tobytes()

    def word(self, w: str) -> bytes:
        return array("I", self.tokenizer.encode(w, add_special_tokens=False).ids).tobytes()

    def forget(self) -> None:
        """Gives back what is remembered: the worker may go on with other work."""
        for memo in (self.words, self.parts):
            memo.clear()
            memo.older = {}

    def is_direct(self, text: str) -> bool:
        try:
            return self.direct and not text.encode("latin-1").translate(None, DIRECT) and not any(t in text for t in self.added)
        except UnicodeEncodeError:
            return False

    def ids(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        known, words = self.parts.__getitem__, self.words.__getitem__
        return [b"".join(map(known, self.find(t.lower())) if self.is_direct(t) else map(words, t.replace("\n", " ").split(" "))) for t in texts]


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part int, place long"


def cut(docs: DataFrame, tokenizer: str, size: int, end: int | None) -> DataFrame:
    """The pieces of each document, with the partition that made them and their place among its pieces of that length."""

    def run(batches):
        import os

        from pyspark import TaskContext

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        part, seen = TaskContext.get().partitionId(), np.zeros(size + 1, np.int64)
        tail = b"" if end is None else np.array([end], "<u4").tobytes()
        e = encoder(tokenizer)
        for batch in batches:
            for s in steps(batch):
                rows = []
                for doc, ids in zip(s.column(0).to_pylist(), e.ids(s.column(1).to_pylist()), strict=True):
                    ids += tail
                    for k in range(0, len(ids) // 4, size):
                        own = ids[4 * k : 4 * (k + size)]
                        n = len(own) // 4
                        rows.append((doc, k // size, k, n, zlib.crc32(own), part, int(seen[n])))
                        seen[n] += 1
                if rows:
                    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in PIECES.split(", ")])
        e.forget()

    return documents(docs).mapInArrow(run, PIECES)


def plan(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over counts: blocks (length, first rank, ranks, first sequence, offset, copies in a sequence).

    Rank r of a block goes to sequence first + r // copies, at offset + (r % copies) * length. Groups of sequences with one fill move together, so blocks follow the number of lengths, not of documents.
    """
    blocks, free, used = [], [], 0  # free: (left, first sequence, sequences), sorted
    for length in sorted(counts, reverse=True):
        rank, todo = 0, counts[length]
        while todo:
            at = bisect_left(free, (length,))
            if at < len(free):
                left, first, n = free.pop(at)
            else:
                left, first, n = size, used, -(-todo // (size // length))
                used += n
            copies = min(left // length, todo)
            if todo < copies * n:  # as many sequences as get all copies; the rest stays free
                whole = todo // copies
                if n > whole:
                    insort(free, (left, first + whole, n - whole))
                n = whole
            took = copies * n
            blocks.append((length, rank, took, first, size - left, copies))
            if left - copies * length:
                insort(free, (left - copies * length, first, n))
            rank, todo = rank + took, todo - took
    return blocks


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int | None = END) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts hold the end token alone (with end=None they make no piece). Strings that name an added token of the tokenizer are that token, as in its plain call. Repeated ids are packed as they come; null ids stay null. Other columns are not looked at. Empty input: empty output.
    """
    pieces = saved(cut(docs, tokenizer, size, end), "pieces")
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    ranks = counts.select("length", "part", before.alias("before"))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # `size` rows at most
    blocks = np.array(plan(histogram, size) or np.zeros((0, 6)), np.int64).reshape(-1, 6)
    by_length = np.searchsorted(blocks[:, 0] * -1, -np.arange(size + 2), "left")  # blocks run from long to short

    def place(batches):
        for b in batches:
            t = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "place", "before")}
            rank = t["place"] + t["before"]
            # one sorted key for (length, rank): lengths descend over blocks, ranks ascend within
            at = np.empty(len(rank), np.int64)
            for length in np.unique(t["length"]):
                own = t["length"] == length
                lo, hi = by_length[length], by_length[length - 1]
                at[own] = lo + np.searchsorted(blocks[lo:hi, 1], rank[own], "right") - 1
            k = blocks[at]
            r = rank - k[:, 1]
            sequence, offset = k[:, 3] + r // k[:, 5], k[:, 4] + (r % k[:, 5]) * t["length"]
            keep = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    joined = pieces.join(ranks, ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", "place", "before")
    return joined.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
