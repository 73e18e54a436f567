"""64-bit hashes as signed BIGINT of the same bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BITS = 64


def halves(word: Column) -> tuple[Column, Column]:
    """High and low 32 bits of SHA-256 modulo 2^64."""
    digest = F.sha2(word, 256)
    return F.conv(F.substring(digest, 49, 8), 16, 10).cast("long"), F.conv(F.substring(digest, 57, 8), 16, 10).cast("long")


def joined(high: Column, low: Column) -> Column:
    return F.shiftleft(high, 32).bitwiseOR(low)


def hash_word(word: Column) -> Column:
    return joined(*halves(word))


def bit(high: Column, low: Column, i: int) -> Column:
    part, k = (low, i) if i < 32 else (high, i - 32)
    return F.shiftright(part, k).bitwiseAND(F.lit(1).cast("long"))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def similarity(a: Column, b: Column) -> Column:
    return 1 - hamming(a, b) / F.lit(float(BITS))


def prefix(h: Column, bits: int) -> Column:
    return F.shiftrightunsigned(h, BITS - bits)


def from_unsigned(c: Column) -> Column:
    """An unsigned decimal string to the BIGINT of its bits."""
    return F.conv(c.cast("string"), 10, -10).cast("long")
