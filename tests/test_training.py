"""Losses with ignored labels, and variants of the optimizers, written out."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import loss
from sparkloom.operators.layers import Optimizer, WaveNetwork


def test_smoothed_crossentropy(spark):
    rows = [(0, [2.0, 0.0, -1.0]), (2, [800.0, -800.0, 799.0]), (9, [1.0, 5.0, 2.0]), (None, [1.0, 1.0, 1.0]), (1, []), (1, None), (7, [0.0, 1.0, 2.0])]
    df = spark.createDataFrame(rows, "y int, z array<double>")

    def plain(y, z, share):
        log = [x - max(z) - math.log(sum(math.exp(v - max(z)) for v in z)) for x in z]
        return -sum(((1 - share) * (i == y) + share / len(z)) * x for i, x in enumerate(log))

    for share in (0.0, 0.3):
        want = [plain(0, rows[0][1], share), plain(2, rows[1][1], share)]
        c = [F.col("y"), F.col("z"), 9, share]
        got = [r["t"] for r in df.select(loss.smoothed_crossentropy(*c, "none").alias("t")).collect()]
        assert got[:2] == pytest.approx(want) and got[2:] == [0.0, 0.0, None, None, None]
        mean, total = df.agg(loss.smoothed_crossentropy(*c), loss.smoothed_crossentropy(*c, "sum")).first()
        assert (mean, total) == pytest.approx((sum(want) / 2, sum(want)))
    assert df.where("y = 9").agg(loss.smoothed_crossentropy(*c)).first()[0] is None


def test_nesterov_and_amsgrad():
    gs = [np.array([1.0, -2.0]), np.array([0.1, 0.5]), np.array([-0.2, 0.0])]
    fast, plain = Optimizer("sgd", 0.1, 0.9, nesterov=True, decay=0.01), np.array([1.0, 2.0])
    got, buffer = plain.copy(), np.zeros(2)
    for g in gs:
        got = fast.step(got, g)
        pull = g + 0.01 * plain
        buffer = 0.9 * buffer + pull
        plain = plain - 0.1 * (pull + 0.9 * buffer)
        assert got == pytest.approx(plain)
    top, m, v, w = np.zeros(2), np.zeros(2), np.zeros(2), np.array([1.0, 2.0])
    best, got = Optimizer("adam", 0.1, betas=(0.9, 0.5), amsgrad=True), np.array([1.0, 2.0])
    for t, g in enumerate(gs, 1):
        m, v = 0.9 * m + 0.1 * g, 0.5 * v + 0.5 * g * g
        top = np.maximum(top, v)
        w = w - 0.1 / (1 - 0.9**t) * m / (np.sqrt(top) / math.sqrt(1 - 0.5**t) + 1e-8)
        got = best.step(got, g)
        assert got == pytest.approx(w)
    assert (top > v).all()


@pytest.mark.parametrize("memory", [None, 0, (1 << 63) | 5])
def test_wave_network(spark, memory):
    """One hot series over many ranges, a short one, nulls, and all 64 cells, against a loop."""
    rng = np.random.default_rng(2)
    net = WaveNetwork(["a", "b"], rng.normal(size=(2, 3)), rng.normal(size=(3, 64)), rng.normal(size=(3, 2)), int(rng.integers(1 << 62)) | 1 << 63, int(rng.integers(1 << 62)) | 1 << 63, 2.5)
    rows = [(None if i % 50 == 7 else int(i >= 290), i, None if i in (0, 33, 295) else float(rng.normal()), float(rng.normal()), i) for i in range(300)]
    df = spark.createDataFrame(rows, "k int, t int, a double, b double, wave_of int")
    got = {r["t"]: r for r in net.forward(df, ["k"], ["t"], memory, 7).collect()}
    state = {}
    for k, t, a, b, _ in rows:
        x = None if a is None else np.array([a, b])
        wave = None if x is None else sum(1 << c for c, v in enumerate(x @ net.inward @ net.cells) if v > 2.5)
        state.setdefault(k, (wave or 0) if memory is None else memory)
        state[k] |= (wave or 0) & net.memory_gate & net.update_gate
        r = got[t]
        assert r["memory"] & (1 << 64) - 1 == state[k]
        assert (r["wave"] is None) == (wave is None) and (wave is None or r["wave"] & (1 << 64) - 1 == wave)
        assert wave is None or [r["y_0"], r["y_1"]] == pytest.approx(x @ net.inward @ net.outward)
    assert len(got) == 300 and len({bin(s) for s in state.values()}) > 1
    assert net.forward(df.limit(0), ["k"], ["t"], memory, 3).count() == 0
