"""Bit-packed digital words as column expressions. Words are longs; bit 63 is the sign."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract_bits(word, mask: int) -> Column:
    """The bits of ``word`` that ``mask`` has, packed into the low bits in order."""
    word = F.col(word) if isinstance(word, str) else word
    out = F.lit(0).cast("long")
    for k, b in enumerate(b for b in range(64) if mask >> b & 1):
        out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(word, b).bitwiseAND(F.lit(1).cast("long")), k))
    return out


def channels_to_mask(channels: Column) -> Column:
    """Mask of an array of channel numbers."""
    return F.aggregate(channels, F.lit(0).cast("long"), lambda a, c: a.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), c.cast("int"))))


def mask_of(channels) -> int:
    out = 0
    for c in channels:
        out |= 1 << int(c)
    return out


def word_to_channels(word: Column) -> Column:
    """64 booleans, the lowest bit first."""
    return F.transform(F.sequence(F.lit(0), F.lit(63)), lambda b: F.getbit(word, b) == 1)


def channels_to_word(channels: Column) -> Column:
    """The word of up to 64 booleans, the lowest bit first."""
    pairs = F.transform(channels, lambda x, i: F.when(x, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
    return F.aggregate(pairs, F.lit(0).cast("long"), lambda a, c: a.bitwiseOR(c))
