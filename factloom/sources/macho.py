"""Mach-O images and split shared caches, parsed from files that Spark's binaryFile source reads."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

#: Numbers of the formats (fixed values).
MAGIC_64, SEGMENT_64, SYMTAB, FUNCTION_STARTS, CACHE_MAGIC = 0xFEEDFACF, 0x19, 0x2, 0x26, b"dyld_v1"


class Malformed(ValueError):
    """The bytes break the format."""


def take(data: bytes, form: str, at: int) -> tuple:
    """Little-endian numbers at a place, bounds checked."""
    if at < 0 or at + struct.calcsize("<" + form) > len(data):
        raise Malformed(f"{form} at {at} lies outside {len(data)} bytes")
    return struct.unpack_from("<" + form, data, at)


def text_at(data: bytes, at: int, size: int | None = None) -> str:
    end = data.find(b"\0", at) if size is None else at + size
    return data[at : end if end >= 0 else len(data)].split(b"\0")[0].decode("latin-1")


def commands(data: bytes):
    """(command, offset, size) of the load commands."""
    magic, _, _, _, count, _, _, _ = take(data, "8I", 0)
    if magic != MAGIC_64:
        raise Malformed(f"magic {magic:#x}")
    at = 32
    for _ in range(count):
        command, size = take(data, "2I", at)
        if size < 8:
            raise Malformed("a load command is too small")
        yield command, at, size
        at += size


def segments(data: bytes) -> list[tuple[str, int, int, int]]:
    """(name, address, size, file offset)"""
    return [(text_at(data, at + 8, 16), *take(data, "3Q", at + 24)) for command, at, _ in commands(data) if command == SEGMENT_64]


def sections(data: bytes) -> list[tuple[str, int, int]]:
    """(SEGMENT.section, address, size)"""
    out = []
    for command, at, _ in commands(data):
        if command == SEGMENT_64:
            (count,) = take(data, "I", at + 64)
            for k in range(count):
                own = at + 72 + 80 * k
                out.append((f"{text_at(data, own + 16, 16)}.{text_at(data, own, 16)}", *take(data, "2Q", own + 32)))
    return out


def symbols(data: bytes) -> list[tuple[str, int, int]]:
    """(name, type, value), unfiltered"""
    out = []
    for command, at, _ in commands(data):
        if command == SYMTAB:
            table, count, strings, size = take(data, "4I", at + 8)
            for k in range(count):
                name, kind, _, _, value = take(data, "IBBHQ", table + 16 * k)
                out.append((text_at(data, strings + name) if name < size else None, kind, value))
    return out


def starts(data: bytes) -> bytes:
    """The encoded function starts."""
    for command, at, _ in commands(data):
        if command == FUNCTION_STARTS:
            offset, size = take(data, "2I", at + 8)
            return data[offset : offset + size]
    return b""


def mappings(data: bytes) -> list[tuple[int, int, int]]:
    """(address, size, file offset) of one file of a split cache, sorted, without repetitions."""
    if not data.startswith(CACHE_MAGIC):
        raise Malformed("not a shared cache")
    offset, count = take(data, "2I", 16)
    return sorted({take(data, "3Q", offset + 32 * k) for k in range(count)})


def cache_uuid(data: bytes) -> str:
    return bytes(take(data, "16B", 0x58)).hex()


PARSERS = {
    "segment": (lambda d: [(n, a, s) for n, a, s, _ in segments(d)], "name string, address long, size long"),
    "section": (sections, "name string, address long, size long"),
    "symbol": (symbols, "name string, type int, value long"),
    "function_starts": (lambda d: [(next((a for n, a, _, _ in segments(d) if n == "__TEXT"), 0), starts(d))], "base long, bytes binary"),
    "mapping": (mappings, "address long, size long, file_offset long"),
}
#: Rows that one frame of numbers holds.
FRAME = 1 << 20


def numbers(data: bytes, kind: str, only_text: bool):
    """Frames (address, number) of the little-endian numbers in the text segment, or in all."""
    size = np.dtype(kind).itemsize
    for name, address, length, offset in segments(data):
        if name == "__TEXT" or not only_text and name != "__LINKEDIT":
            count = max(0, min(length, len(data) - offset)) // size
            for k in range(0, count, FRAME):
                part = np.frombuffer(data, kind, min(FRAME, count - k), offset + k * size)
                yield address + (k + np.arange(len(part))) * size, part.astype(np.int64)


NUMBERS = {"word": ("<u4", True, "va long, word long"), "cell": ("<i8", False, "at long, raw long")}


def files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")


def frames_of(table: str, data: bytes):
    """Frames of one table of a file."""
    if table in NUMBERS:
        kind, only_text, schema = NUMBERS[table]
        names = [c.split()[0] for c in schema.split(", ")]
        for x, y in numbers(data, kind, only_text):
            yield pd.DataFrame(dict(zip(names, (x, y), strict=True)))
    else:
        parse, schema = PARSERS[table]
        yield pd.DataFrame(parse(data), columns=[c.split()[0] for c in schema.split(", ")])


def read(spark: SparkSession, path: str, table: str, strict: bool = True) -> DataFrame:
    """One table of every file under a path: file, and the parser's columns. A file is one task's work; numbers come a million at a time. A malformed file fails the read and is named, or (not strict) has no rows: failures() lists it."""
    schema = NUMBERS[table][2] if table in NUMBERS else PARSERS[table][1]

    def run(frames):
        for f in frames:
            for file, content in zip(f["path"], f["content"], strict=True):
                try:
                    for out in frames_of(table, bytes(content)):
                        out.insert(0, "file", file)
                        yield out
                except Malformed as e:
                    if strict:
                        raise Malformed(f"{file}: {e}") from None

    return files(spark, path).mapInPandas(run, f"file string, {schema}")


def failures(spark: SparkSession, path: str) -> DataFrame:
    """(file, reason) of every file: why it is malformed, or null."""

    def run(frames):
        for f in frames:
            rows = []
            for file, content in zip(f["path"], f["content"], strict=True):
                reason = None
                try:
                    for parse in (segments, sections, symbols, starts):
                        parse(bytes(content))
                except Malformed as e:
                    reason = str(e)
                rows.append((file, reason))
            yield pd.DataFrame(rows, columns=["file", "reason"])

    return files(spark, path).mapInPandas(run, "file string, reason string")
