"""Column functions against literal expectations."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import activation as A
from sparkloom.functions import bits as B
from sparkloom.functions import ieee as M
from sparkloom.functions import loss as L
from sparkloom.functions import vector as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def each(spark, values, fn, kind="long"):
    df = spark.createDataFrame([(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)], "i long, a " + kind + (f", b {kind}" if isinstance(values[0], tuple) else ""))
    args = [F.col("a"), F.col("b")] if isinstance(values[0], tuple) else [F.col("a")]
    return [r[0] for r in df.orderBy("i").select(fn(*args)).collect()]


def same(a, b):
    return a == b or (isinstance(a, float) and isinstance(b, float) and math.isnan(a) and math.isnan(b))


NAN, INF = float("nan"), float("inf")


@pytest.mark.parametrize(
    "fn,values,want",
    [
        (M.divide, [(1.0, 0.0), (-1.0, 0.0), (0.0, 0.0), (1.0, 4.0), (None, 0.0)], [INF, -INF, NAN, 0.25, None]),
        (M.mod, [(7.0, -3.0), (-7.0, 3.0), (7.0, 3.0), (6.0, 3.0), (1.0, 0.0)], [-2.0, 2.0, 1.0, 0.0, NAN]),
        (M.floor_divide, [(-7.0, 2.0), (7.0, 2.0), (1.0, 0.0)], [-4.0, 3.0, INF]),
        (M.equal, [(NAN, NAN), (1.0, 1.0), (None, 1.0)], [False, True, None]),
        (M.less, [(1.0, NAN), (1.0, 2.0)], [False, True]),
        (M.maximum, [(NAN, 1.0), (1.0, 2.0), (None, 1.0)], [NAN, 2.0, None]),
        (M.isclose, [(1.0, 1.000001), (1.0, 1.1), (INF, INF), (NAN, NAN)], [True, False, True, False]),
    ],
)
def test_pairs(spark, fn, values, want):
    assert all(same(a, b) for a, b in zip(each(spark, values, fn, "double"), want))


@pytest.mark.parametrize("fn,values,want", [(M.ln, [0.0, -1.0, 1.0], [-INF, NAN, 0.0]), (M.floor, [1e300, -1.5, INF], [1e300, -2.0, INF]), (lambda x: M.clip(x, 0, 1), [NAN, 5.0, -5.0, None], [NAN, 1.0, 0.0, None])])
def test_single(spark, fn, values, want):
    assert all(same(a, b) for a, b in zip(each(spark, values, fn, "double"), want))


def test_wrapping_integers(spark):
    assert each(spark, [300, -129, 127], lambda x: M.to_int(x, 8)) == [44, 127, 127]


A16, B16 = [10, 12, 3, 0], [5, 10, 15, 0]


def test_bits(spark):
    pairs = list(zip(A16, B16))
    assert each(spark, pairs, B.band) == [0, 8, 3, 0]
    assert each(spark, pairs, B.bor) == [15, 14, 15, 0]
    assert each(spark, pairs, B.bxor) == [15, 6, 12, 0]
    assert each(spark, A16, lambda x: B.bnot(x, 16)) == [65525, 65523, 65532, 65535]
    assert each(spark, list(zip(A16, [1, 2, 0, 4])), lambda x, s: B.left_shift(x, s, 16)) == [20, 48, 3, 0]
    assert each(spark, list(zip(A16, [1, 2, 0, 4])), lambda x, s: B.right_shift(x, s, 16)) == [5, 3, 3, 0]
    assert each(spark, [(202, 2), (129, 0), (129, 8), (129, 9), (129, 3)], lambda x, s: B.rotate_left(x, s, 8)) == [43, 129, 129, 3, 12]
    assert each(spark, [(202, 2), (129, 0), (129, 8), (129, 9), (129, 3)], lambda x, s: B.rotate_right(x, s, 8)) == [178, 129, 129, 192, 48]
    assert each(spark, [-1, 0, 1, -128], lambda x: B.count_ones(x, 8)) == [8, 0, 1, 1]
    assert each(spark, A16, lambda x: B.count_zeros(x, 16)) == [14, 14, 14, 16]
    assert each(spark, list(zip(A16, [1, 3, 0, 15])), B.get_bit) == [1, 1, 1, 0]
    assert each(spark, list(zip(A16, [0, 3, 1, 15])), B.toggle_bit) == [11, 4, 1, 32768]
    assert each(spark, list(zip(A16, [1, -2, 0, 3])), lambda x, s: B.propagate(x, s, 16)) == [20, 3, 3, 0]
    assert each(spark, [(1, 40)], lambda x, s: B.left_shift(x, s, 32)) == [0]


@pytest.mark.parametrize("share,ones", [(0.5, 4), (0.25, 2), (0.0, 0), (1.0, 8), (0.6, 5)])
def test_duty_cycle(spark, share, ones):
    assert one(spark, B.duty_cycle(F.lit(8), F.lit(share))) == [1] * ones + [0] * (8 - ones)


@pytest.mark.parametrize("n,half,want", [(8, 2, [1, 1, 0, 0, 1, 1, 0, 0]), (8, 3, [1, 1, 1, 0, 0, 0, 1, 1]), (7, 2, [1, 1, 0, 0, 1, 1, 0])])
def test_blocky_sin(spark, n, half, want):
    assert one(spark, B.blocky_sin(F.lit(n), F.lit(half))) == want


def test_bad_modes_raise():
    with pytest.raises(ValueError):
        B.interference([], "xor")
    with pytest.raises(ValueError):
        B.group_interference(None, "nand")


def arr(*xs):
    return F.array(*[F.lit(float(x)) for x in xs])


def test_vectors(spark):
    assert one(spark, V.normalize(arr(0, 0))) == [0.0, 0.0]
    assert one(spark, V.normalize(arr(1, 2, 2))) == pytest.approx([1 / 3, 2 / 3, 2 / 3])
    assert one(spark, V.euclidean_distance(arr(1, 2, 3), arr(4, 5, 6))) == pytest.approx(math.sqrt(27))
    assert one(spark, V.cosine_similarity(arr(1, 1), arr(1, 0))) == pytest.approx(2**-0.5, abs=1e-6)
    assert one(spark, V.one_hot(F.lit(2), 3)) == [0.0, 0.0, 1.0]
    with pytest.raises(Exception, match="index outside"):
        one(spark, V.one_hot(F.lit(3), 3))
    assert [(round(z["re"], 9), round(z["im"], 9)) for z in one(spark, V.dft(arr(1, 2, 1, 0)))] == [(4, 0), (0, -2), (0, 0), (0, 2)]
    assert one(spark, V.cumsum(arr(1, 2, 3))) == [1.0, 3.0, 6.0]
    assert one(spark, V.argsort(arr(3, 1, 2, 1))) == [1, 3, 2, 0]
    assert one(spark, V.argsort(arr(3, 1, 2, 1), True)) == [0, 2, 1, 3]
    assert one(spark, V.gather(arr(5, 6, 7), F.array(F.lit(0), F.lit(-1)))) == [5.0, 7.0]
    assert one(spark, V.roll(arr(1, 2, 3), F.lit(1))) == [3.0, 1.0, 2.0]


def test_activations_and_losses(spark):
    assert one(spark, A.sigmoid(F.lit(-1000.0))) == 0.0 and one(spark, A.softplus(F.lit(1000.0))) == 1000.0
    assert sum(one(spark, A.softmax(arr(1000, 1001)))) == pytest.approx(1)
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 2.1), (3.0, 3.1)], "y double, p double")
    y, p = F.col("y"), F.col("p")
    got = df.select(L.mse(y, p), L.mae(y, p), L.huber(y, p), L.mse(y, p, "sum"), L.log_cosh(y, p)).first()
    assert list(got) == pytest.approx([0.01, 0.1, 0.005, 0.03, math.log(math.cosh(0.1))])
    b = spark.createDataFrame([(1, 0.9), (0, 0.1), (1, 0.8), (0, 0.3)], "y int, p double")
    want = -(2 * math.log(0.9) + math.log(0.8) + math.log(0.7)) / 4
    assert b.select(L.binary_crossentropy(F.col("y"), F.col("p"))).first()[0] == pytest.approx(want)


def test_zeros_of_floor_ceil_and_mod_have_the_signs_of_the_sql(spark):
    """Also of numbers beyond a long, infinities and NaN."""
    xs = [-0.0, 0.0, -0.3, 0.3, -0.7, 0.7, -2.5, 2.5, -3.0, 1e300, -1e300, 4503599627370497.5, INF, -INF, float("nan")]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    got = df.select(M.floor(F.col("x")), M.ceil(F.col("x")), M.floor(F.lit(None).cast("double"))).collect()
    assert [repr(r[0]) for r in got] == [repr(float(np.floor(x))) for x in xs] and [repr(r[1]) for r in got] == [repr(float(np.ceil(x))) for x in xs]
    assert all(r[2] is None for r in got)
    pairs = [(-8.0, -2.0), (8.0, -2.0), (0.0, -3.0), (-8.0, 2.0), (-7.0, 2.0), (7.0, -2.0)]
    got = spark.createDataFrame(pairs, "a double, b double").select(M.mod(F.col("a"), F.col("b"))).collect()
    assert [repr(r[0]) for r in got] == [repr(a - b * float(np.floor(a / b))) for a, b in pairs]


def test_zero_by_zero_is_the_nan_of_the_sql(spark, duck):
    """To the sign bit, as text shows it; infinities keep the sign of the dividend."""
    pairs = [(0.0, 0.0), (-0.0, 0.0), (3.0, 0.0), (-3.0, 0.0), (None, 0.0), (1.0, None), (-7.0, 2.0), (INF, 0.0), (-INF, 0.0)]
    df = spark.createDataFrame(pairs, "a double, b double")
    got = df.select(M.divide(F.col("a"), F.col("b")).alias("q"), M.floor_divide(F.col("a"), F.col("b")).alias("f")).toArrow()
    duck.register("zero_by_zero", got)
    want = "SELECT (a / b)::VARCHAR, floor(a / b)::VARCHAR FROM (VALUES " + ", ".join(f"({'NULL' if a is None else repr(str(a))}::DOUBLE, {'NULL' if b is None else repr(str(b))}::DOUBLE)" for a, b in pairs) + ") AS t(a, b)"
    assert sorted(map(str, duck.execute("SELECT q::VARCHAR, f::VARCHAR FROM zero_by_zero").fetchall())) == sorted(map(str, duck.execute(want).fetchall()))
    duck.unregister("zero_by_zero")
