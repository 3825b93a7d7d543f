"""Bitwise operators on whole numbers of a given width.

Spark shifts by the count modulo the type's width and counts bits of 64; values are
masked to their own width first, and shifts by the width or more give 0.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

WIDTH = 32


def _mask(bits: int) -> int:
    return (1 << bits) - 1 if bits < 64 else -1


def low(x: Column, bits: int = WIDTH) -> Column:
    return x.cast("long").bitwiseAND(F.lit(_mask(bits)))


def _shl(x: Column, s: Column) -> Column:
    return F.call_function("shiftleft", x, s.cast("int"))


def _shr(x: Column, s: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, s.cast("int"))


def band(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def bor(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def bxor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def bnot(x: Column, bits: int = WIDTH) -> Column:
    return low(F.bitwise_not(x.cast("long")), bits)


def left_shift(x: Column, s: Column, bits: int = WIDTH) -> Column:
    return F.when(s >= bits, F.lit(0).cast("long")).otherwise(low(_shl(x.cast("long"), s), bits))


def right_shift(x: Column, s: Column, bits: int = WIDTH) -> Column:
    """Logical, on the masked value."""
    return F.when(s >= bits, F.lit(0).cast("long")).otherwise(_shr(low(x, bits), s))


def rotate_left(x: Column, s: Column, bits: int = WIDTH) -> Column:
    k, v = F.pmod(s, F.lit(bits)), low(x, bits)
    return F.when(k == 0, v).otherwise(low(_shl(v, k).bitwiseOR(_shr(v, bits - k)), bits))


def rotate_right(x: Column, s: Column, bits: int = WIDTH) -> Column:
    return rotate_left(x, -s, bits)


def count_ones(x: Column, bits: int = WIDTH) -> Column:
    return F.bit_count(low(x, bits)).cast("int")


def count_zeros(x: Column, bits: int = WIDTH) -> Column:
    return (F.lit(bits) - count_ones(x, bits)).cast("int")


def get_bit(x: Column, p: Column) -> Column:
    return _shr(x.cast("long"), p).bitwiseAND(F.lit(1)).cast("int")


def _one(p: Column) -> Column:
    return _shl(F.lit(1).cast("long"), p)


def set_bit(x: Column, p: Column, value: Column) -> Column:
    on = _shl(value.cast("long").bitwiseAND(F.lit(1)), p)
    return x.cast("long").bitwiseAND(F.bitwise_not(_one(p))).bitwiseOR(on)


def toggle_bit(x: Column, p: Column) -> Column:
    return x.cast("long").bitwiseXOR(_one(p))


MODES = {"xor": Column.bitwiseXOR, "and": Column.bitwiseAND, "or": Column.bitwiseOR}


def interference(waves: list[Column], mode: str = "xor") -> Column:
    """Of columns in a row; over rows, :func:`group_interference`."""
    if mode not in MODES or not waves:
        raise ValueError("needs waves, and a mode of xor, and, or")
    return reduce(MODES[mode], waves)


def group_interference(wave: Column, mode: str = "xor") -> Column:
    if mode not in MODES:
        raise ValueError("mode is one of xor, and, or")
    return {"xor": F.bit_xor, "and": F.bit_and, "or": F.bit_or}[mode](wave)


def propagate(x: Column, shift: Column, bits: int = WIDTH) -> Column:
    """A shift to the left, or to the right if negative."""
    return F.when(shift >= 0, left_shift(x, shift, bits)).otherwise(right_shift(x, -shift, bits))


def duty_cycle(length: Column, share: Column) -> Column:
    """An array of ``length`` bits whose first round(length * share) are 1; halves to even."""
    ones = F.bround(length * share, 0)
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: (i < ones).cast("int"))


def blocky_sin(length: Column, half: Column) -> Column:
    """A square wave of ``half`` ones, then as many zeros."""
    return F.transform(F.sequence(F.lit(0), length - 1), lambda i: ((i % (2 * half)) < half).cast("int"))


def rotate_elements(wave: Column, shift: int) -> Column:
    """An array's elements moved to the right, around its end."""
    n = F.size(wave)
    k = F.pmod(F.lit(shift), n)
    return F.when(n == 0, wave).otherwise(F.concat(F.slice(wave, n - k + 1, k), F.slice(wave, 1, n - k)))
