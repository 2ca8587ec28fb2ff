"""Per-pixel expressions. Integers are longs: quantized values keep to 32 bits, differences need not."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INT_MIN, INT_MAX = -(2**31), 2**31 - 1


def is_nodata(z: Column, nodata: float | None) -> Column:
    """A value that equals the no-data value; NaN equals nothing."""
    return F.lit(False) if nodata is None else (z == nodata) & ~F.isnan(z)


def quantize(z: Column, precision: float, nodata: float | None = None) -> Column:
    """Nearest multiple of ``precision``, halves away from zero; 0 for no data and what isn't finite; clamped to 32 bits."""
    scaled = z * F.lit(1.0 / precision)
    bad = is_nodata(z, nodata) | F.isnan(scaled) | (F.abs(scaled) == float("inf"))
    near = F.greatest(F.lit(float(INT_MIN)), F.least(F.lit(float(INT_MAX)), scaled))
    return F.when(bad, F.lit(0)).otherwise(F.round(near)).cast("long")


def dequantize(q: Column, precision: float, masked: Column | None = None, nodata: float | None = None) -> Column:
    z = q * F.lit(precision)
    return z if masked is None or nodata is None else F.when(masked, F.lit(nodata)).otherwise(z)


def meters(q: Column, multiplier: int) -> Column:
    return F.call_function("div", q, F.lit(multiplier).cast("long"))


def digits(q: Column, multiplier: int) -> Column:
    return q % F.lit(multiplier).cast("long")


def div(a: Column, b: int) -> Column:
    """Integer division, truncated."""
    return F.call_function("div", a, F.lit(b).cast("long"))


def zigzag(v: Column) -> Column:
    return F.when(v >= 0, v * 2).otherwise(v * -2 - 1)


def unzigzag(u: Column) -> Column:
    return F.when(u % 2 == 0, div(u, 2)).otherwise(-div(u, 2) - 1)


def magnitude(u: Column) -> Column:
    """Bits of a zigzag number."""
    return F.when(u == 0, F.lit(0)).otherwise(F.length(F.bin(u)))


def remainder(u: Column) -> Column:
    """What is left of a zigzag number under its leading bit."""
    return F.when(u <= 1, F.lit(0).cast("long")).otherwise(u - F.call_function("shiftleft", F.lit(1).cast("long"), magnitude(u) - 1))


def activity(v: Column) -> Column:
    """0 to 3 by absolute value."""
    a = F.abs(v)
    return F.when(a <= 2, 0).when(a <= 8, 1).when(a <= 32, 2).otherwise(3)


def tile(c: str, size: int) -> Column:
    return div(F.col(c), size)


def rounded(v: Column, places: int) -> Column:
    """As SQL engines round doubles: the scaled number to a whole one. Spark's own rounds the decimal digits, and so ties the other way."""
    return F.round(v * float(10**places)) / float(10**places)
