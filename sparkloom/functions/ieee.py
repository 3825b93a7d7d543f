"""Element-wise arithmetic and comparison with array-library semantics.

Division and logarithms give infinities and NaN instead of errors or nulls, NaN is equal
to nothing, modulo and floor division take the sign of the divisor.  Null stays null.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def dbl(x: Column) -> Column:
    return x.cast("double")


def _nans(out: Column, *args: Column) -> Column:
    """NaN where an argument is NaN, null where one is null."""
    for a in args:
        out = F.when(a.isNull(), F.lit(None)).when(F.isnan(dbl(a)), NAN).otherwise(out)
    return out


def divide(a: Column, b: Column) -> Column:
    """By zero: the infinity of a's sign, and for zero by zero the machine's own NaN, whose sign bit is that of the SQL."""
    a, b = dbl(a), dbl(b)
    return F.when(b == 0, a * INF).otherwise(F.try_divide(a, b))


def _log(fn, x: Column) -> Column:
    x = dbl(x)
    return F.when(x == 0, -INF).when(x < 0, NAN).otherwise(fn(x))


def ln(x: Column) -> Column:
    return _log(F.ln, x)


def log10(x: Column) -> Column:
    return _log(F.log10, x)


def log2(x: Column) -> Column:
    return _log(F.log2, x)


def square(x: Column) -> Column:
    return x * x


def sign(x: Column) -> Column:
    return F.signum(x)


def floor_divide(a: Column, b: Column) -> Column:
    return floor(divide(a, b))


def mod(a: Column, b: Column) -> Column:
    """Remainder with the sign of the divisor; a remainder of zero has none, as in a - b * floor(a / b)."""
    r = F.try_mod(dbl(a), dbl(b)) + 0.0
    return F.when(dbl(b) == 0, NAN).when((r != 0) & ((r < 0) != (dbl(b) < 0)), r + dbl(b)).otherwise(r)


def floor(x: Column) -> Column:
    """Of any double: Spark's own goes through a long, which large numbers leave and in which zero loses its sign.  NaN stays the NaN it is."""
    x = dbl(x)
    near = F.rint(x)
    return F.when(F.isnan(x), x).otherwise(near - F.when(near > x, 1.0).otherwise(0.0))


def ceil(x: Column) -> Column:
    return -floor(-dbl(x))


def clip(x: Column, lo=None, hi=None) -> Column:
    """Bounds may be None; NaN stays NaN and null null."""
    out = dbl(x)
    if hi is not None:
        out = F.least(out, F.lit(hi).cast("double"))
    if lo is not None:
        out = F.greatest(out, F.lit(lo).cast("double"))
    return _nans(out, x)


def maximum(a: Column, b: Column) -> Column:
    return _nans(F.greatest(dbl(a), dbl(b)), a, b)


def minimum(a: Column, b: Column) -> Column:
    return _nans(F.least(dbl(a), dbl(b)), a, b)


def _real(a: Column, b: Column) -> Column:
    return ~F.isnan(dbl(a)) & ~F.isnan(dbl(b))


def equal(a: Column, b: Column) -> Column:
    return (a == b) & _real(a, b)


def not_equal(a: Column, b: Column) -> Column:
    return ~equal(a, b)


def less(a: Column, b: Column) -> Column:
    return (a < b) & _real(a, b)


def less_equal(a: Column, b: Column) -> Column:
    return (a <= b) & _real(a, b)


def greater(a: Column, b: Column) -> Column:
    return (a > b) & _real(a, b)


def greater_equal(a: Column, b: Column) -> Column:
    return (a >= b) & _real(a, b)


def truth(x: Column) -> Column:
    return dbl(x) != 0


def logical_and(a: Column, b: Column) -> Column:
    return truth(a) & truth(b)


def logical_or(a: Column, b: Column) -> Column:
    return truth(a) | truth(b)


def logical_xor(a: Column, b: Column) -> Column:
    return truth(a) != truth(b)


def logical_not(a: Column) -> Column:
    return ~truth(a)


def isclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """|a - b| <= atol + rtol * |b|; equal infinities are close, NaN to nothing."""
    return ((a == b) | (F.abs(dbl(a) - dbl(b)) <= atol + rtol * F.abs(dbl(b)))) & _real(a, b)


def allclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """Aggregate."""
    return F.bool_and(isclose(a, b, rtol, atol))


def where(condition: Column, x: Column, y: Column) -> Column:
    return F.when(condition, x).otherwise(y)


def agg_min(x: Column) -> Column:
    """Aggregate minimum; NaN if any value is (Spark orders NaN last)."""
    return F.when(F.bool_or(F.isnan(dbl(x))), NAN).otherwise(F.min(dbl(x)))


def agg_max(x: Column) -> Column:
    return F.max(dbl(x))


def to_int(x: Column, bits: int, signed: bool = True) -> Column:
    """Whole numbers cast to a width, wrapping around as fixed-width integers do."""
    low = x.cast("long").bitwiseAND(F.lit((1 << bits) - 1)) if bits < 64 else x.cast("long")
    return F.when(low >= (1 << bits - 1), low - (1 << bits)).otherwise(low) if signed and bits < 64 else low


def exponential_decay(x: Column, rate: float, step: Column) -> Column:
    return dbl(x) * F.exp(-F.lit(rate) * step)


def gaussian(x: Column, mu: float = 0.0, sigma: float = 1.0) -> Column:
    z = (dbl(x) - mu) / sigma
    return F.exp(-0.5 * z * z) / (sigma * math.sqrt(2 * math.pi))
