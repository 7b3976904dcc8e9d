"""Column functions on 64-bit hashes, kept as signed longs with the same bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_bands(h: Column) -> Column:
    """The 8 bytes of a hash, highest first."""
    return F.array(*[F.shiftrightunsigned(h, k).bitwiseAND(F.lit(255)).cast("int") for k in range(56, -1, -8)])


def vector_signature(v: Column) -> Column:
    """Bit i, from the highest, tells whether value i of 64 is above their mean; null for other lengths."""
    mean = F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double")) / F.size(v)
    bits = F.aggregate(v, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x.cast("double") > mean, F.lit(1)).otherwise(F.lit(0)).cast("long")))
    return F.when(F.size(v) == 64, bits)


def distance(a: Column, b: Column) -> Column:
    """Differing bits."""
    return F.bit_count(a.bitwiseXOR(b)).cast("int")


def unsigned(h: Column) -> Column:
    """Decimal digits of the unsigned value."""
    return F.conv(F.hex(h), 16, 10)


def from_unsigned(digits: Column) -> Column:
    return F.conv(digits, 10, -10).cast("long")
