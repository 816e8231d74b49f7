"""Rendering and parsing of quantities and data as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def quantity(n: Column) -> Column:
    """Minimal lower-case hex of a non-negative whole number; 0x0 for zero."""
    return F.concat(F.lit("0x"), F.lower(F.hex(n)))


def data(b: Column) -> Column:
    """Hex of bytes."""
    return F.concat(F.lit("0x"), F.lower(F.hex(b)))


def storage_word(n: Column) -> Column:
    """A number as a 32-byte word."""
    return F.concat(F.lit("0x"), F.lpad(F.lower(F.hex(n)), 64, "0"))


def parse_data(s: Column, length: int | None = None) -> Column:
    """Bytes of a hex string; null where it is not of even length, not hex or not of `length` bytes."""
    digits = "*" if length is None else f"{{{length}}}"
    return F.when(s.rlike(rf"^0[xX]([0-9a-fA-F]{{2}}){digits}$"), F.unhex(F.substring(s, 3, 1 << 30)))


def parse_quantity(s: Column) -> Column:
    """Number of a hex quantity of at most 14 digits; null where it is malformed."""
    return F.when(s.rlike(r"^0[xX][0-9a-fA-F]{1,14}$"), F.conv(F.substring(s, 3, 16), 16, 10).cast("long"))


def address_word(word: Column) -> Column:
    """The address in a 32-byte calldata word (hex without prefix), null if the word is no address."""
    return F.when(word.rlike("^0{24}[0-9a-f]{40}$") & ~word.rlike("^0{56}"), F.concat(F.lit("0x"), F.substring(word, 25, 40)))
