"""64-bit picture hashes kept as signed longs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_hash(text: Column) -> Column:
    """Hexadecimal text to a long: any case, blanks around it, '0x' before it, leading zeros dropped.
    Null, blank, unreadable, longer than 64 bits and all-zero text give null."""
    digits = F.regexp_extract(F.lower(F.trim(F.regexp_replace(text, r"\s+", " "))), r"^(?:0x)?([0-9a-f]{1,16})$", 1)
    value = F.conv(F.when(digits != "", digits), 16, -10).cast("long")
    return F.when(value != 0, value)


def hash_hex(h: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def hamming(a: Column, b: Column) -> Column:
    """Number of differing bits; null if either is null."""
    return F.bit_count(a.bitwiseXOR(b))


def similar(a: Column, b: Column, threshold: int = 10) -> Column:
    """Whether two hashes are within threshold; false if either is missing."""
    return F.coalesce(hamming(a, b) <= threshold, F.lit(False))
