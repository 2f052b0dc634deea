"""Column functions on machine words, mangled names and raw values."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType

from factloom.functions.text import sign_extend

#: Key of the pointer-authentication hash and low bits of a version-5 chained pointer (fixed values).
DISCRIMINATOR_KEY = bytes.fromhex("b5d4c9eb79104a796fec8b1b428781d4")
POINTER_MASK = 0x3FFFFFFFF
MASK = (1 << 64) - 1


def siphash(data: bytes, key: bytes = DISCRIMINATOR_KEY) -> int:
    """SipHash-2-4, 64 bits."""
    k = struct.unpack("<2Q", key)
    # The initial state is the ASCII text "somepseudorandomlygeneratedbytes".
    v = [int.from_bytes(b"somepseudorandomlygeneratedbytes"[8 * j : 8 * j + 8], "big") ^ k[j % 2] for j in range(4)]

    def rotate(x: int, n: int) -> int:
        return (x << n | x >> (64 - n)) & MASK

    def mix(a: int, b: int, turn: int, halves: bool) -> None:
        v[a] = (v[a] + v[b]) & MASK
        v[b] = rotate(v[b], turn) ^ v[a]
        if halves:
            v[a] = rotate(v[a], 32)

    def rounds(n: int) -> None:
        for _ in range(n):
            for step in ((0, 1, 13, True), (2, 3, 16, False), (0, 3, 21, False), (2, 1, 17, True)):
                mix(*step)

    padded = data + b"\0" * (7 - len(data) % 8) + bytes([len(data) & 255])
    for (word,) in struct.iter_unpack("<Q", padded):
        v[3] ^= word
        rounds(2)
        v[0] ^= word
    v[2] ^= 255
    rounds(4)
    return v[0] ^ v[1] ^ v[2] ^ v[3]


def discriminator_of(name: str) -> int:
    return siphash(name.encode()) % 0xFFFF + 1


@F.arrow_udf(LongType())
def discriminator(names: pa.Array) -> pa.Array:
    """The 16-bit discriminator of a mangled name; null of null."""
    return pa.array([None if n is None else discriminator_of(n) for n in names.to_pylist()], pa.int64())


def suffix_of(name: str) -> str | None:
    """From the last nested name segment of an Itanium name to its end; None if it isn't nested, has template arguments or breaks off."""
    if not name.startswith("_ZN"):
        return None
    rest = name[3:].lstrip("KVr")
    last = None
    while rest:
        if rest[:2] in ("C1", "C2", "C3", "D0", "D1", "D2"):
            last, rest = rest, rest[2:]
            break
        digits = rest[: len(rest) - len(rest.lstrip("0123456789"))]
        if not digits:
            break
        if len(rest) < len(digits) + int(digits):
            return None
        last, rest = rest, rest[len(digits) + int(digits) :]
        if rest.startswith("I"):
            return None
    return last if last is not None and rest.startswith("E") else None


@F.arrow_udf(StringType())
def signature_suffix(names: pa.Array) -> pa.Array:
    return pa.array([None if n is None else suffix_of(n) for n in names.to_pylist()], pa.string())


@F.arrow_udf(DoubleType())
def as_double(raw: pa.Array) -> pa.Array:
    """The 64-bit float with the bits of a long."""
    import numpy as np

    bits = raw.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return pa.array(bits.view(np.float64), mask=raw.is_null().to_numpy(zero_copy_only=False))


def pointer_target(raw: Column, base: int) -> Column:
    """What a version-5 chained pointer points to; null for raw zero."""
    return F.when(raw != 0, raw.bitwiseAND(POINTER_MASK) + base)


def bits(word: Column, low: int, count: int) -> Column:
    """`count` bits of a word from bit `low`."""
    return F.shiftright(word, low).bitwiseAND((1 << count) - 1)


def matches(word: Column, mask: int, value: int) -> Column:
    return word.bitwiseAND(mask) == value


def mnemonic(word: Column) -> Column:
    """The mnemonics that the trackers need, from bit patterns of 32-bit words (longs); null for others."""
    table = (
        ("adrp", 0x9F000000, 0x90000000), ("add", 0xFF800000, 0x91000000), ("ldr", 0xFFC00000, 0xF9400000), ("ldr", 0xFFC00000, 0xFD400000), ("ldur", 0xFFE00C00, 0xF8400000), ("ldur", 0xFFE00C00, 0xFC400000),
        ("ldr", 0xFFE00C00, 0xF8600800), ("bl", 0xFC000000, 0x94000000), ("b", 0xFC000000, 0x14000000), ("braa", 0xFFFFFC00, 0xD71F0800), ("brab", 0xFFFFFC00, 0xD71F0C00), ("br", 0xFFFFFC1F, 0xD61F0000),
        ("blraa", 0xFFFFFC00, 0xD73F0800), ("blrab", 0xFFFFFC00, 0xD73F0C00), ("blraaz", 0xFFFFFC1F, 0xD63F081F), ("blrabz", 0xFFFFFC1F, 0xD63F0C1F), ("braaz", 0xFFFFFC1F, 0xD61F081F), ("brabz", 0xFFFFFC1F, 0xD61F0C1F),
        ("blr", 0xFFFFFC1F, 0xD63F0000), ("retaa", 0xFFFFFFFF, 0xD65F0BFF), ("retab", 0xFFFFFFFF, 0xD65F0FFF), ("ret", 0xFFFFFC1F, 0xD65F0000), ("brk", 0xFFE0001F, 0xD4200000), ("movk", 0xFF800000, 0xF2800000), ("mov", 0xFF800000, 0xD2800000),
        ("mov", 0xFFE0FFE0, 0xAA0003E0), ("ldp", 0xFFC00000, 0xA9400000), ("str", 0xFFC00000, 0xF9000000), ("stp", 0xFFC00000, 0xA9000000),
    )
    out = None
    for name, mask, value in table:
        test = matches(word, mask, value)
        out = F.when(test, name) if out is None else out.when(test, name)
    return out


def operands(word: Column, va: Column) -> Column:
    """Operand text of decoded words, in the usual assembler form."""
    x = [F.concat(F.lit("x"), bits(word, low, 5).cast("string")) for low in (0, 5, 16)]
    d = F.concat(F.when(matches(word, 0x04000000, 0x04000000), "d").otherwise("x"), bits(word, 0, 5).cast("string"))
    page = F.shiftleft(F.shiftright(va, 12) + sign_extend(F.shiftleft(bits(word, 5, 19), 2).bitwiseOR(bits(word, 29, 2)), 21), 12)
    hexed = lambda c: F.when(c < 0, F.concat(F.lit("#-0x"), F.lower(F.hex(-c)))).otherwise(F.concat(F.lit("#0x"), F.lower(F.hex(c))))
    imm12, imm9 = bits(word, 10, 12), sign_extend(bits(word, 12, 9), 9)
    name = mnemonic(word)
    register_offset = matches(word, 0xFFE00C00, 0xF8600800)
    at = lambda c: F.when(c == 0, F.concat(F.lit("["), x[1], F.lit("]"))).otherwise(F.concat(F.lit("["), x[1], F.lit(", "), hexed(c), F.lit("]")))
    branch = F.lower(F.hex(va + sign_extend(bits(word, 0, 26), 26) * 4))
    return (
        F.when(name == "adrp", F.concat_ws(", ", x[0], hexed(page)))
        .when(name == "add", F.concat_ws(", ", x[0], x[1], hexed(F.when(bits(word, 22, 1) == 1, F.shiftleft(imm12, 12)).otherwise(imm12))))
        .when(register_offset, F.concat(x[0], F.lit(", ["), x[1], F.lit(", "), x[2], F.lit("]")))
        .when(name.isin("ldr", "str"), F.concat_ws(", ", d, at(imm12 * 8)))
        .when(name == "ldur", F.concat_ws(", ", d, at(imm9)))
        .when(name.isin("bl", "b"), F.concat(F.lit("#0x"), branch))
        .when(name.isin("blraa", "blrab", "braa", "brab"), F.concat_ws(", ", x[1], F.concat(F.lit("x"), bits(word, 0, 5).cast("string"))))
        .when(name.isin("br", "blr"), x[1])
        .when(name == "movk", F.concat_ws(", ", x[0], hexed(bits(word, 5, 16)), F.concat(F.lit("lsl #"), (bits(word, 21, 2) * 16).cast("string"))))
        .when(matches(word, 0xFFE0FFE0, 0xAA0003E0), F.concat_ws(", ", x[0], x[2]))
        .when(name == "mov", F.concat_ws(", ", x[0], hexed(F.shiftleft(bits(word, 5, 16), (0)))))
        .when(name.isin("ldp", "stp"), F.concat_ws(", ", x[0], F.concat(F.lit("x"), bits(word, 10, 5).cast("string")), F.concat(F.lit("["), x[1], F.lit("]"))))
        .otherwise("")
    )
