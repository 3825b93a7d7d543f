"""Vectors in array columns: norms, products, distances, transforms and wave measures."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.ieee import dbl


def let(x: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn(x)`` with ``x`` computed once for the row, also where ``fn`` uses it for every element."""
    return F.transform(F.array(x), fn)[0]


def total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + dbl(x))


def length(xs: Column) -> Column:
    """The number of entries; null for a null or empty array, so that what is divided by it is null as well."""
    return F.when(F.size(xs) > 0, F.size(xs))


def mean(xs: Column) -> Column:
    """Null for a null or empty array, or one with a null entry; so are the measures built on it."""
    return total(xs) / length(xs)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: dbl(x) * dbl(y)))


def energy(xs: Column) -> Column:
    return total(F.transform(xs, lambda x: dbl(x) * dbl(x)))


def norm(xs: Column, p: float = 2) -> Column:
    if p == math.inf:
        return F.aggregate(xs, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(dbl(x))))
    if p == 1:
        return total(F.transform(xs, lambda x: F.abs(dbl(x))))
    if p == 2:
        return F.sqrt(energy(xs))
    return F.pow(total(F.transform(xs, lambda x: F.pow(F.abs(dbl(x)), F.lit(float(p))))), F.lit(1.0 / p))


def normalize(xs: Column, p: float = 2) -> Column:
    """Divided by its norm; a zero vector stays as it is."""
    return let(xs, lambda ys: let(norm(ys, p), lambda n: F.transform(ys, lambda x: F.when(n > 0, dbl(x) / n).otherwise(dbl(x)))))


def euclidean_distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: F.pow(dbl(x) - dbl(y), F.lit(2.0)))))


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b) + 1e-8)


def variance(xs: Column) -> Column:
    """Population variance."""
    return let(mean(xs), lambda m: total(F.transform(xs, lambda x: (dbl(x) - m) * (dbl(x) - m)))) / length(xs)


def one_hot(index: Column, classes: int) -> Column:
    """An array of 0 and 1; an index outside raises."""
    hot = F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == index).cast("double"))
    return F.when((index < 0) | (index >= classes), F.raise_error(F.lit("index outside the classes"))).otherwise(hot)


def first_argmax(xs: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(xs, F.array_max(xs)) - 1).cast("int")


def argsort(xs: Column, descending: bool = False) -> Column:
    """Places in order of value, then of place."""
    flip = -1.0 if descending else 1.0
    pairs = F.transform(xs, lambda x, i: F.struct((dbl(x) * flip).alias("v"), i.alias("i")))
    return F.transform(F.array_sort(pairs), lambda p: p["i"])


def cumsum(xs: Column) -> Column:
    steps = F.aggregate(xs, F.array().cast("array<double>"), lambda a, x: F.array_append(a, F.coalesce(F.try_element_at(a, F.lit(-1)), F.lit(0.0)) + dbl(x)))
    return F.when(F.size(xs) == 0, F.array().cast("array<double>")).otherwise(steps)


def gather(xs: Column, places: Column) -> Column:
    """Elements at 0-based places; negative ones count from the end."""
    return F.transform(places, lambda i: F.element_at(xs, F.when(i >= 0, i + 1).otherwise(i).cast("int")))


def tile(xs: Column, times: int) -> Column:
    return F.flatten(F.array_repeat(xs, times))


def pad(xs: Column, before: int, after: int, value: float = 0.0) -> Column:
    edge = F.lit(float(value))
    return F.concat(F.array_repeat(edge, before), xs.cast("array<double>"), F.array_repeat(edge, after))


def stretch(xs: Column, n: Column) -> Column:
    """The array brought to ``n`` entries on straight lines between the middles of its own; null for an empty one."""

    def at(m: Column, i: Column) -> Column:
        spot = F.greatest((i + 0.5) * m / n - 0.5, F.lit(0.0))
        low = F.least(F.floor(spot).cast("int"), m - 1)
        a, b = dbl(F.get(xs, low)), dbl(F.get(xs, F.least(low + 1, m - 1)))
        return a + (b - a) * (spot - low)

    return F.when((F.size(xs) > 0) & (n > 0), F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda i: at(F.size(xs), i)))


def roll(xs: Column, shift: Column) -> Column:
    n = F.size(xs)
    return F.transform(xs, lambda x, i: F.element_at(xs, (F.pmod(i - shift, n) + 1).cast("int")))


def dft(xs: Column) -> Column:
    """The discrete Fourier transform as array<struct<re, im>>, for short arrays (n squared steps)."""
    n = F.size(xs)

    def part(k: Column, fn, scale: float) -> Column:
        return total(F.transform(xs, lambda x, j: dbl(x) * scale * fn(2 * math.pi * ((k * j) % n) / n)))

    return F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct(part(k, F.cos, 1.0).alias("re"), part(k, F.sin, -1.0).alias("im")))


def phase_angle(xs: Column) -> Column:
    """Angle between the first component and the rest."""
    rest = F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0)))
    return F.atan2(norm(rest), dbl(xs[0]))


def partial_interference(base: Column, new: Column, alpha: float, eps: float = 1e-12) -> Column:
    """The blend (1 - alpha) base + alpha new, brought to length 1."""
    mixed = F.zip_with(base, new, lambda x, y: (1 - alpha) * dbl(x) + alpha * dbl(y))
    return let(mixed, lambda ys: let(F.greatest(norm(ys), F.lit(eps)), lambda n: F.transform(ys, lambda x: x / n)))


def pattern_similarity(a: Column, b: Column) -> Column:
    """1 less the mean absolute difference."""
    return 1 - total(F.zip_with(a, b, lambda x, y: F.abs(dbl(x) - dbl(y)))) / F.size(a)
