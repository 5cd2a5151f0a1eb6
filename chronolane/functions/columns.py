"""Expressions shared by the operators. All of them stay inside Catalyst."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from chronolane.types import DOUBLE_NO_DATA, INT_NO_DATA


def no_data(kind: str) -> Column:
    """The in-band marker of a result type: INT minimum for ``int``, -infinity for ``double``."""
    if kind == "int":
        return F.lit(INT_NO_DATA).cast("int")
    if kind == "double":
        return F.lit(DOUBLE_NO_DATA).cast("double")
    raise TypeError(f"no marker for type {kind}")


def or_no_data(value: Column, kind: str) -> Column:
    return F.coalesce(value.cast(kind), no_data(kind))


def window_start(ts: Column, lower: int, interval: int) -> Column:
    """Start of the tumbling window of ``ts``, windows being anchored on ``lower`` (integer arithmetic only)."""
    since = ts - F.lit(lower).cast("bigint")
    return ts - F.pmod(since, F.lit(interval).cast("bigint"))


def zigzag_encode(value: Column, bits: int = 64) -> Column:
    """Maps 0, -1, 1, -2, ... to 0, 1, 2, 3, ...; ``bits`` is 32 or 64."""
    kind = "int" if bits == 32 else "bigint"
    v = value.cast(kind)
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, bits - 1)).cast(kind)


def zigzag_decode(value: Column, bits: int = 64) -> Column:
    kind = "int" if bits == 32 else "bigint"
    v = value.cast(kind)
    return F.shiftrightunsigned(v, 1).bitwiseXOR(-v.bitwiseAND(F.lit(1).cast(kind))).cast(kind)


def bit_width(value: Column) -> Column:
    """Bits needed for a non-negative integer; 0 needs none."""
    return F.when(value == 0, F.lit(0)).otherwise(F.length(F.bin(value))).cast("int")


def poly_bucket(vin: Column, buckets: int) -> Column:
    """Storage bucket of an entity, equal for equal ids on every platform."""
    return F.pmod(F.crc32(vin.cast("binary")), F.lit(buckets)).cast("int")


def finite(value: Column) -> Column:
    """The value where it is a finite number, else null (null, NaN and both infinities)."""
    v = value.cast("double")
    good = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    return F.when(good, v)


def fold_text(value: Column) -> Column:
    """Spelling without case and outer white space; null stays null."""
    return F.lower(F.regexp_replace(value, r"^[\s 　]+|[\s 　]+$", ""))
