"""Losses: ``*_terms`` are per row, the plain names aggregate (mean, or sum)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkloom.functions.activation import sigmoid, softmax
from sparkloom.functions.ieee import clip, dbl
from sparkloom.functions.vector import let, total

EPS = 1e-7


def _reduce(terms: Column, reduction: str) -> Column:
    return {"mean": F.avg, "sum": F.sum, "none": lambda c: c}[reduction](terms)


def mse(y: Column, p: Column, reduction: str = "mean") -> Column:
    return _reduce((dbl(p) - dbl(y)) * (dbl(p) - dbl(y)), reduction)


def mae(y: Column, p: Column, reduction: str = "mean") -> Column:
    return _reduce(F.abs(dbl(p) - dbl(y)), reduction)


def binary_crossentropy(y: Column, p: Column, from_logits: bool = False, reduction: str = "mean") -> Column:
    q = clip(sigmoid(p) if from_logits else p, EPS, 1 - EPS)
    return _reduce(-(dbl(y) * F.ln(q) + (1 - dbl(y)) * F.ln(1 - q)), reduction)


def categorical_crossentropy(y: Column, p: Column, from_logits: bool = False, reduction: str = "mean") -> Column:
    """Of arrays of class probabilities."""
    q = softmax(p) if from_logits else p
    return _reduce(-total(F.zip_with(y, q, lambda a, b: dbl(a) * F.ln(clip(b, EPS, 1 - EPS)))), reduction)


def sparse_categorical_crossentropy(y: Column, p: Column, from_logits: bool = False, reduction: str = "mean") -> Column:
    q = softmax(p) if from_logits else p
    return _reduce(-F.ln(clip(F.element_at(q, (y + 1).cast("int")), EPS, 1 - EPS)), reduction)


def smoothed_crossentropy(y: Column, logits: Column, ignored: int = -100, smoothing: float = 0.0, reduction: str = "mean") -> Column:
    """Of class numbers and an array of logits; rows labelled ``ignored``, or null, have no part in the mean or sum.

    ``smoothing`` moves that share of the label's weight evenly to all classes.  By rows
    (``none``) an ignored row is 0.  A label outside the classes, or a null or empty array, is null.
    """

    def term(z: Column) -> Column:
        top = F.array_max(z)
        log_sum = F.ln(total(F.transform(z, lambda x: F.exp(x - top)))) + top
        own = F.when((y >= 0) & (y < F.size(z)), F.get(z, y.cast("int")))
        return log_sum - (1 - smoothing) * own - smoothing * total(z) / F.size(z)

    loss = F.when(F.size(logits) > 0, let(F.transform(logits, dbl), term))
    counted = y.isNotNull() & (y != ignored)
    return F.when(counted, loss).otherwise(0.0) if reduction == "none" else _reduce(F.when(counted, loss), reduction)


def huber(y: Column, p: Column, delta: float = 1.0, reduction: str = "mean") -> Column:
    e = F.abs(dbl(p) - dbl(y))
    q = F.least(e, F.lit(delta))
    return _reduce(0.5 * q * q + delta * (e - q), reduction)


def log_cosh(y: Column, p: Column, reduction: str = "mean") -> Column:
    e = F.abs(dbl(p) - dbl(y))
    return _reduce(e + F.log1p(F.exp(-2 * e)) - math.log(2), reduction)
