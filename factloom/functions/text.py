"""Column functions on strings, addresses and lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column | str) -> Column:
    """Lower case of A-Z alone."""
    return F.translate(c, UPPER, LOWER)


def basename(c: Column | str) -> Column:
    """What follows the last slash."""
    return F.substring_index(c, "/", -1)


def parse_hex(c: Column, prefix_required: bool = False) -> Column:
    """The number of a whole hex string, null for anything else. The prefix 0x or 0X is optional unless required."""
    digits = F.regexp_replace(c, "^0[xX]", "")
    good = c.rlike("^0[xX][0-9a-fA-F]{1,15}$" if prefix_required else "^(0[xX])?[0-9a-fA-F]{1,15}$")
    return F.when(good, F.conv(digits, 16, 10).cast("long"))


def hex_address(c: Column | str) -> Column:
    """0x and small hex digits."""
    return F.concat(F.lit("0x"), F.lower(F.hex(c)))


def placeholder(c: Column | str) -> Column:
    """How pseudocode writes a memory cell: MEMORY[0x<capital hex digits>]."""
    return F.concat(F.lit("MEMORY[0x"), F.hex(c), F.lit("]"))


def lines(c: Column | str, keep_last_empty: bool = False, strip_return: bool = False) -> Column:
    """Lines of a text, split at new lines; the empty line after a final new line goes unless kept; one \\r before the new line may go."""
    parts = F.split(c, "\n", -1)
    if not keep_last_empty:
        parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    return F.transform(parts, lambda x: F.regexp_replace(x, "\r$", "")) if strip_return else parts


def without_section_sign(c: Column) -> Column:
    """Without a leading section sign, be it one character or its two UTF-8 bytes read as Latin-1."""
    return F.regexp_replace(c, "^(Â§|§)", "")


def looks_numeric(c: Column) -> Column:
    return c.rlike("^[0-9.]+$")


def bytes_as_text(c: Column | str) -> Column:
    """Bytes as Latin-1 text: one character per byte, nothing lost."""
    return F.decode(c, "ISO-8859-1")


def text_as_bytes(c: Column | str) -> Column:
    return F.encode(c, "ISO-8859-1")


def sign_extend(c: Column, bits: int) -> Column:
    """The low bits of a number as a signed one."""
    return F.shiftright(F.shiftleft(c, 64 - bits), 64 - bits)
