"""Unsigned 64-bit semantics over Spark's signed longs: comparisons, and sums modulo 2^64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = 1 << 64
_LOW = -(1 << 63)


def as_signed(value: int) -> int:
    """The long with the bits of an unsigned 64-bit value."""
    if not 0 <= value < TOP:
        raise ValueError(f"{value} is no unsigned 64-bit value")
    return value - TOP if value >= TOP // 2 else value


def compare(column: Column, op: str, value: int, wide: bool = False) -> Column:
    """``column op value``, unsigned.  Where no value has the top bit (not ``wide``) the plain comparison reaches the scan."""
    held = as_signed(value)
    if op == "=":
        return column == held if wide or value < TOP // 2 else F.lit(False)
    if wide:
        a, b = column.bitwiseXOR(F.lit(_LOW)), F.lit(held ^ _LOW)
        return a < b if op == "<" else a > b
    if value >= TOP // 2:
        return F.lit(op == "<")
    return column < held if op == "<" else column > held


def checksum(column: Column) -> Column:
    """The sum modulo 2^64 as DECIMAL(20, 0); null without rows.

    Four sums of 16 bits each stay longs for up to 2^47 rows, so the aggregation keeps to generated code on longs.
    """
    ten = lambda c: c.cast("decimal(38,0)")
    total = None
    for i in range(4):
        part = ten(F.sum(F.shiftrightunsigned(column, 16 * i).bitwiseAND(F.lit(0xFFFF)))) % F.lit(1 << 48).cast("decimal(38,0)")
        part = part * F.lit(1 << (16 * i)).cast("decimal(15,0)") if i else part
        total = part if total is None else total + part
    return (total.cast("decimal(38,0)") % F.lit(str(TOP)).cast("decimal(20,0)")).cast("decimal(20,0)")


def to_unsigned(column: Column) -> Column:
    """The value of the bits as DECIMAL(20, 0)."""
    wide = column.cast("decimal(20,0)")
    return F.when(column < 0, wide + F.lit(str(TOP)).cast("decimal(20,0)")).otherwise(wide).cast("decimal(20,0)")
