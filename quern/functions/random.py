"""Seeded generators as Columns: the same numbers on every machine and in every run, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The increments, multipliers, shifts and offsets of the published 32-bit generators and hash.
MASK = 0xFFFFFFFF
SPLITMIX = (0x9E3779B9, ((16, 0x21F0AAAD), (15, 0x735A2D97)), 15)
MULBERRY = 0x6D2B79F5
FNV_OFFSET, FNV_PRIME = 0x811C9DC5, 0x01000193


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(MASK))


def times(x: Column, y: Column | int) -> Column:
    """The low 32 bits of a product of unsigned 32-bit values, without leaving 64 bits."""
    y = F.lit(y).cast("long") if isinstance(y, int) else y
    high = (x * F.shiftright(y, 16)).bitwiseAND(F.lit(0xFFFF)) * 65536
    return _low(x * y.bitwiseAND(F.lit(0xFFFF)) + high)


def _fold(x: Column, shift: int) -> Column:
    return x.bitwiseXOR(F.shiftright(x, shift))


def fnv1a(text: Column) -> Column:
    """FNV-1a of a text's UTF-8 bytes, as an unsigned 32-bit value."""
    raw = F.hex(F.encode(text, "UTF-8"))
    places = F.when(F.length(raw) > 0, F.sequence(F.lit(1), F.length(raw) - 1, F.lit(2))).otherwise(F.array().cast("array<int>"))
    byte = lambda i: F.conv(F.substring(raw, i, F.lit(2)), 16, 10).cast("long")
    return F.aggregate(places, F.lit(FNV_OFFSET).cast("long"), lambda h, i: times(h.bitwiseXOR(byte(i)), FNV_PRIME))


def splitmix(seed: Column, n: Column | int = 1) -> Column:
    """The ``n``-th number (from 1) of a seed's splitmix sequence, unsigned 32-bit."""
    step, rounds, last = SPLITMIX
    z = _low(seed.cast("long") + times(F.lit(step).cast("long"), F.lit(n).cast("long") if isinstance(n, int) else n.cast("long")))
    for shift, factor in rounds:
        z = times(_fold(z, shift), factor)
    return _fold(z, last)


def mulberry(seed: Column, n: Column | int = 1) -> Column:
    """The ``n``-th number (from 1) of a seed's mulberry sequence, in [0, 1)."""
    a = _low(seed.cast("long") + times(F.lit(MULBERRY).cast("long"), F.lit(n).cast("long") if isinstance(n, int) else n.cast("long")))
    t = times(_fold(a, 15), a.bitwiseOR(F.lit(1).cast("long")))
    t = _low(t + times(_fold(t, 7), t.bitwiseOR(F.lit(61).cast("long")))).bitwiseXOR(t)
    return _fold(t, 14) / F.lit(2.0**32)
