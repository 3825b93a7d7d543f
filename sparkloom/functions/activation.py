"""Activations as Column expressions; the array forms act along the array."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.ieee import dbl, maximum
from sparkloom.functions.vector import let


def relu(x: Column) -> Column:
    return maximum(x, F.lit(0.0))


def sigmoid(x: Column) -> Column:
    """Large negative values overflow the exponential to infinity, whose inverse is the right 0."""
    return 1 / (1 + F.exp(-dbl(x)))


def tanh(x: Column) -> Column:
    return F.tanh(x)


def softplus(x: Column) -> Column:
    return F.greatest(dbl(x), F.lit(0.0)) + F.log1p(F.exp(-F.abs(dbl(x))))


def lecun_tanh(x: Column) -> Column:
    return 1.7159 * F.tanh(dbl(x) * (2.0 / 3.0))


def softmax(xs: Column) -> Column:
    """Over an array; the maximum is taken out first."""
    e = let(dbl(F.array_max(xs)), lambda top: F.transform(xs, lambda x: F.exp(dbl(x) - top)))
    return let(e, lambda es: let(F.aggregate(es, F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(es, lambda x: x / total)))


def blocky_sigmoid(x: Column, steps: int = 10) -> Column:
    """The sigmoid quantised to ``steps`` levels."""
    return F.floor(sigmoid(x) * steps).cast("double") / steps
