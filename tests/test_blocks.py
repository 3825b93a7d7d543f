"""Components of windows, detectors, harmonics and blocks against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import blend as B
from sparkloom.operators import linalg as LA
from sparkloom.operators import metrics as X
from sparkloom.operators import models as N
from sparkloom.operators import signal as S
from sparkloom.operators import waves as H
from sparkloom.operators import windows as W
from sparkloom.sources import io


def pca(x, k):
    values, vectors = np.linalg.eigh(np.cov(x.T))
    order = np.argsort(-values)[:k]
    v = vectors[:, order]
    v = v * np.sign(v[np.abs(v).argmax(axis=0), np.arange(k)])
    return (x - x.mean(axis=0)) @ v, values[order] / values.sum()


def test_blend_of_windows(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(2, 40, 2)).cumsum(axis=1)
    df = spark.createDataFrame([(k, i, float(x[k, i, 0]), float(x[k, i, 1])) for k in range(2) for i in range(40)] + [(9, 0, 1.0, 1.0)], "k int, i int, a double, b double")
    blend = B.fit_blend(df, ["k"], ["i"], ["a", "b"], 3, [1, 4], 2)
    for stride in (1, 4):
        at = [(k, s) for k in range(2) for s in range(0, 38, stride)]
        want, share = pca(np.array([x[k, s : s + 3].ravel() for k, s in at]), 2)
        got = {(r["k"], r["start"]): (r["pca_0"], r["pca_1"]) for r in blend.transform(df, stride).collect()}
        assert set(got) == set(at)
        for p, w in zip(at, want):
            assert got[p] == pytest.approx(tuple(w))
        assert blend.explained(stride) == pytest.approx(share.sum()) and set(blend.importance(stride)) == {f"t{t}_{c}" for t in range(3) for c in "ab"}
    assert len(B.fit_blend(df, ["k"], ["i"], ["a", "b"], 3, [1]).models[1].components) == 3  # half of six values
    assert len(B.fit_blend(df.where("i < 4 AND k = 0"), ["k"], ["i"], ["a", "b"], 3, [1]).models[1].components) == 1  # two windows
    none = B.fit_blend(df.limit(0), ["k"], ["i"], ["a"], 3, [1])
    assert none.transform(df.limit(0), 1).count() == 0


def test_groups_of_engineered_columns(spark):
    df = spark.createDataFrame([(i, float(i % 7), float(i * i % 11), "ab"[i % 2], "x y") for i in range(60)], "id int, p double, q double, c string, t string")
    rows, groups = B.engineered_by_kind(df, {"p": "numeric", "q": "numeric", "c": "categorical", "t": "text"})
    assert set(groups) == {"numeric", "categorical", "text"} and len(groups["categorical"]) == 2
    scores, models = B.pca_by_group(rows, groups, 1, ["id"])
    z = np.array([(i % 7, i * i % 11) for i in range(60)], dtype=float)
    want = pca((z - z.mean(axis=0)) / z.std(axis=0), 1)[0][:, 0]
    got = [r["numeric_pca_0"] for r in scores.orderBy("id").collect()]
    assert np.abs(got) == pytest.approx(np.abs(want), abs=1e-9)
    assert set(models) == {"numeric", "categorical", "text"}


def mean_field(x, w, a, b, steps):
    s = lambda z: 1 / (1 + np.exp(-z))
    h = s(x @ w + b)
    r, g = x, h
    for _ in range(steps):
        r = s(g @ w.T + a)
        g = s(r @ w + b)
    return (x.T @ h - r.T @ g) / len(x), (x - r).mean(axis=0), (h - g).mean(axis=0)


def test_rbm_training_steps(spark):
    x = np.random.default_rng(6).uniform(size=(50, 3))
    df = spark.createDataFrame(x.tolist(), "a double, b double, c double")
    rng = np.random.default_rng(0)
    w, a, b = rng.normal(scale=0.1, size=(3, 2)), np.zeros(3), np.zeros(2)
    speed = [np.zeros_like(w), np.zeros(3), np.zeros(2)]
    for _ in range(3):
        speed = [0.5 * v + g for v, g in zip(speed, mean_field(x, w, a, b, 2))]
        w, a, b = w + 0.2 * (speed[0] - 0.01 * w), a + 0.2 * speed[1], b + 0.2 * speed[2]
    m = N.train_rbm(df, ["a", "b", "c"], 2, 3, 0.2, steps=2, momentum=0.5, decay=0.01)
    assert m.weights == pytest.approx(w) and m.visible == pytest.approx(a) and m.hidden == pytest.approx(b)
    h = 1 / (1 + np.exp(-(x @ w + b)))
    error = ((x - 1 / (1 + np.exp(-(h @ w.T + a)))) ** 2).sum(axis=1)
    assert m.threshold == pytest.approx(np.quantile(error, 0.95))


def test_rbm_stops_early(spark, monkeypatch):
    df = spark.createDataFrame([(0.1, 0.9)] * 5, "a double, b double")
    seen = []
    step = N._divergence_step
    monkeypatch.setattr(N, "_divergence_step", lambda *a: seen.append(1) or step(*a) * -1)  # every step makes it worse
    N.train_rbm(df, ["a", "b"], 2, 20, 0.5, validation=df, patience=3)
    assert len(seen) <= 5


@pytest.mark.parametrize("scaling,method", [("standard", "free_energy"), ("minmax", "reconstruction")])
def test_detector(spark, scaling, method):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(200, 2)) * [1, 5] + [3, -2]
    df = spark.createDataFrame([(i, *map(float, v), 7.0) for i, v in enumerate(x)], "id int, a double, b double, same double")
    d = N.fit_detector(df, ["a", "b", "same"], 2, scaling, method, 0.9, epochs=2)
    z = np.column_stack([x, np.full(200, 7.0)])
    z = (z - z.mean(axis=0)) / np.where(z.std(axis=0) == 0, 1, z.std(axis=0)) if scaling == "standard" else (z - z.min(axis=0)) / np.where(np.ptp(z, axis=0) == 0, 1e-8, np.ptp(z, axis=0))
    m = d.machine
    h = z @ m.weights + m.hidden
    if method == "free_energy":
        score = np.log1p(np.exp(h)).sum(axis=1) + z @ m.visible
    else:
        score = ((z - 1 / (1 + np.exp(-(1 / (1 + np.exp(-h)) @ m.weights.T + m.visible)))) ** 2).sum(axis=1)
    got = d.detect(df).orderBy("id").collect()
    assert [r["score"] for r in got] == pytest.approx(score.tolist())
    assert d.threshold == pytest.approx(np.quantile(score, 0.9)) and sum(r["anomaly"] for r in got) == 20
    assert [r["probability"] for r in got] == pytest.approx((1 / (1 + np.exp(-(score - score.mean()) / score.std()))).tolist())
    assert d.detect(df).columns == ["id", "a", "b", "same", "score", "anomaly", "probability"]


def test_sliding_interference(spark):
    rng = np.random.default_rng(1)
    x, y = rng.normal(size=30), rng.normal(size=28)
    df = spark.createDataFrame([(x.tolist(), y.tolist()), (x[:3].tolist(), y.tolist()), (None, y.tolist())], "x array<double>, y array<double>")
    got = [r[0] for r in df.select(H.sliding_interference(F.col("x"), F.col("y"), 8)).collect()]
    want = []
    for i in range(28 - 8 + 1):
        p, q = x[i : i + 8], y[i : i + 8]
        turn = np.abs(np.angle(np.fft.fft(p)) - np.angle(np.fft.fft(q))).mean()
        want.append(np.corrcoef(p, q)[0, 1] * (1 - turn / math.pi))
    assert got[0] == pytest.approx(want) and got[1] == [] and got[2] is None
    f = np.abs(np.fft.fftfreq(28))
    band = (f >= 0.1) & (f <= 0.3)
    d = np.angle(np.fft.fft(x[:28]))[band] - np.angle(np.fft.fft(y))[band]
    assert df.select(H.banded_coherence(F.col("x"), F.col("y"), 0.1, 0.3)).first()[0] == pytest.approx(np.abs(np.exp(1j * d).mean()))
    same = df.limit(1).select(S.phase_coherence(F.col("x"), F.col("x"))).first()[0]
    assert same == pytest.approx(1)


def test_harmonics(spark):
    n, rate = 64, 64.0
    x = [math.sin(2 * math.pi * 8 * i / n) + 0.5 * math.sin(2 * math.pi * 20 * i / n) for i in range(n)]
    df = spark.createDataFrame([(x,), ([0.0] * n,)], "x array<double>").withColumn("m", H.spectrum(F.col("x"))).withColumn("p", H.harmonic_peaks(F.col("m"), rate / n))
    a, b = df.collect()
    assert [p["frequency"] for p in a["p"]] == [8, 20] and [p["amplitude"] for p in a["p"]] == pytest.approx([1, 0.5], abs=1e-6) and b["p"] == []
    ratio = df.select(H.harmonic_ratio(F.col("m"), F.col("p"))).collect()
    assert ratio[0][0] == pytest.approx(1.5 / sum(a["m"])) and ratio[1][0] == 0
    near = df.limit(1).select(H.harmonic_peaks(F.col("m"), rate / n, 0.1, 15)).first()[0]
    assert [p["frequency"] for p in near] == [8]
    wave = [r["v"] for r in H.reconstruct([(20, 0.5), (8, 1.0)], 1.0, rate, spark).orderBy("i").collect()]
    t = np.linspace(0, 1, n)
    assert wave == pytest.approx(((np.sin(2 * np.pi * 8 * t) + 0.5 * np.sin(2 * np.pi * 20 * t)) / 1.5).tolist())
    kept = df.limit(1).select(H.keep_harmonics(F.col("x"), [8, 20], rate)).first()[0]
    top = max(map(abs, x))
    assert kept == pytest.approx((top * (np.sin(2 * np.pi * 8 * t) + np.sin(2 * np.pi * 20 * t)) / 2).tolist())
    shaped = spark.createDataFrame([([1.0, -2.0, 3.0], [0.5, -1.0, 0.25])], "x array<double>, e array<double>").select(H.envelope(F.col("x"), F.col("e"))).first()[0]
    assert shaped == [0.5, -2.0, 0.75]


def test_blocks(spark):
    df = spark.createDataFrame([("a", i, v) for i, v in enumerate([0.0, 0.0, 1.0, -4.0, 2.0])], "k string, i int, v double")
    q = H.quantise_blocks(df, ["k"], "i", "v", 2)
    assert [(r["block"], r["q"]) for r in q.orderBy("i").collect()] == [(0, 128), (0, 128), (1, 160), (1, 1), (2, 255)]
    assert [r["mse"] for r in H.quantisation_error(q, ["k"], "v").orderBy("block").collect()] == pytest.approx([0, ((1 - 32 * 4 / 127) ** 2) / 2, 0])
    wide = spark.createDataFrame([("a", i, 16384) for i in range(10)], "k string, i int, pcm int")
    pwm = H.pulse_width(wide, ["k"], "i", "pcm", 8, 5)
    assert [r["pwm"] for r in pwm.orderBy("i").collect()] == [32767] * 6 + [-32768] * 2 + [0, 0]
    assert [tuple(r) for r in H.duty_cycles(pwm, ["k"], "i", "pwm", 8).collect()] == [("a", 0, 0.75, 16384)]
    few = H.activity(df, ["k"], ["i"], "v", 0.5).first()
    assert (few["n"], few["active"], few["trend"], few["last"]) == (5, 0.4, 0.0, 2.0)


def test_full_confusion(spark):
    df = spark.createDataFrame([(0, 1), (0, 1), (2, 2)], "y int, p int")
    got = {(r["y"], r["p"]): r["n"] for r in X.confusion_matrix(df, "y", "p", 3).collect()}
    assert len(got) == 9 and got[0, 1] == 2 and got[2, 2] == 1 and sum(got.values()) == 3


def test_patterns_and_noise(spark):
    x = np.random.default_rng(3).normal(size=16)
    df = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    back = df.select(H.decode_wave(H.encode_wave(F.col("x"), 5))).first()[0]
    basis = H._basis(5, 16, 1.0, 0.5)
    alive = (basis**2).sum(axis=0) > 1e-12
    assert np.array(back)[alive] == pytest.approx(x[alive]) and not np.array(back)[~alive].any()
    turned = df.select(H.match_pattern(F.col("x"), F.array(*[F.col("x")[(i - 3) % 16] for i in range(16)])).alias("m")).first()["m"]
    assert turned["shift"] == 3 and turned["similarity"] == pytest.approx(1)
    z = np.fft.fft(x / 4)
    pcm = spark.createDataFrame([(np.angle(z).tolist(), np.abs(z).tolist())], "p array<double>, m array<double>").select(H.phase_to_pcm(F.col("p"), F.col("m"))).first()[0]
    assert pcm == np.clip(np.round(x / 4 * 32768), -32768, 32767).astype(int).tolist()
    assert spark.range(1).select(H.energy_history_stability(F.array(F.lit(1.0), F.lit(3.0))), H.energy_history_stability(F.array().cast("array<double>"))).first() == (0.5, 1.0)
    spun = spark.range(1).select(H.rotate(F.array(*[F.lit(float(i)) for i in (1, 2, 3, 4)]), math.pi / 2, 4)).first()[0]
    assert spun == pytest.approx([1, -4, 3, 2])
    ones = H.binary_grid(spark, 60, 0.3, 4)
    assert ones.count() == 3600 and abs(ones.agg(F.avg("v")).first()[0] - 0.3) < 0.03 and sorted(ones.collect()) == sorted(H.binary_grid(spark, 60, 0.3, 4).repartition(3).collect())
    g = H.noise(spark, 4000, 2.0, "gaussian", 1).agg(F.avg("v"), F.stddev_pop("v")).first()
    u = H.noise(spark, 4000, 2.0, "uniform", 1).agg(F.min("v"), F.max("v"), F.avg("v")).first()
    assert abs(g[0]) < 0.1 and abs(g[1] - 2) < 0.1 and -2 <= u[0] < -1.9 and 1.9 < u[1] < 2 and abs(u[2]) < 0.1
    with pytest.raises(ValueError):
        H.noise(spark, 3, kind="pink")
    one = [r["v"] for r in H.wave_grid(spark, 1.0, 1.0, 5).orderBy("i", "j").collect()]
    assert one[:5] == pytest.approx([0.5] * 5) and one[6] == pytest.approx(1)


def test_rbm_states_and_rules(spark):
    m = N.RBM(["a", "b"], np.array([[2.0], [-1.0]]), np.zeros(2), np.zeros(1))
    df = spark.range(2000).select("id", F.lit(1.0).alias("a"), F.lit(0.5).alias("b"))
    s = m.sample_visible(m.sample_hidden(df, F.col("id"), 3), F.col("id"), 3)
    p = 1 / (1 + math.exp(-1.5))
    assert abs(s.agg(F.avg("s_0")).first()[0] - p) < 0.04
    want = p / (1 + math.exp(-2)) + (1 - p) / 2
    assert abs(s.agg(F.avg("v_a")).first()[0] - want) < 0.04
    assert sorted(s.select("id", "s_0", "v_b").collect()) == sorted(m.sample_visible(m.sample_hidden(df.repartition(5), F.col("id"), 3), F.col("id"), 3).select("id", "s_0", "v_b").collect())
    one = df.limit(1)
    assert not m.is_anomaly(one).first()["anomaly"] and m.is_anomaly(one, threshold=0.01).first()["anomaly"]
    assert not m.is_anomaly(one, "free_energy").first()["anomaly"] and m.is_anomaly(one, "free_energy", 9.0).first()["anomaly"]
    d = N.Detector(N.RBM(["__x0"], np.array([[0.5]]), np.zeros(1), np.zeros(1)), {"a": (3.0, 2.0)}, "reconstruction", 0, 0, 1)
    x = (1.0 - 3) / 2
    assert d.reconstruct(one).columns == ["id", "a", "b", "r_a"]
    assert d.reconstruct(one).first()["r_a"] == pytest.approx(2 / (1 + math.exp(-0.5 / (1 + math.exp(-0.5 * x)))) + 3)


def test_log_features(spark):
    df = spark.createDataFrame([("A", "up", "High"), ("B", None, "odd"), (None, "down", "Critical")], "location string, message string, severity string")
    got = W.log_features(df, "severity", ["A", "B"], ["up", "down"]).collect()
    assert [tuple(r)[3:] for r in got] == [(1.0, 0.0, 1.0, 0.0, 0.75), (0.0, 1.0, 0.0, 0.0, None), (0.0, 0.0, 0.0, 1.0, 1.0)]


def test_likely_number_of_components(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 5)) * [9, 5, 0.1, 0.1, 0.1]
    df = spark.createDataFrame(x.tolist(), ", ".join(f"c{i} double" for i in range(5)))
    m = LA.fit_pca(df, [f"c{i}" for i in range(5)], "mle")
    assert len(m.components) == LA.likely_components(np.linalg.eigvalsh(np.cov(x.T))[::-1], 300)
    assert LA.likely_components(np.array([4.0]), 9) == 1


def test_csv_with_a_header_file(spark, tmp_path):
    (tmp_path / "x.csv").write_text("1,a\n2,b\n")
    (tmp_path / "names.txt").write_text("n, s\n")
    assert io.load_csv(spark, str(tmp_path / "x.csv"), header_file=str(tmp_path / "names.txt")).dtypes == [("n", "int"), ("s", "string")]


def test_binary_wave_codes(spark):
    x = (0.8 * np.sin(np.arange(96) / 5)).tolist()
    df = spark.createDataFrame([(x,), ([],), (None,)], "x array<double>").withColumn("b", H.delta_sigma(F.col("x")))
    got, empty, none = (r["b"] for r in df.collect())
    errors, want = [0.0, 0.0], []
    for v in x:
        y = v + errors[0] * 1.5 - errors[1] * 0.5
        want.append(1 if y > 0 else 0)
        q = y - 1 if y > 0 else y
        errors = [q, errors[0] + q * 0.5]
    assert got == want and empty == [] and none is None
    out = df.select(H.band_bits(F.col("b"), 2, 6, 96.0).alias("band"), H.mean_phase(F.col("b")).alias("p")).collect()
    w = (np.array(want) * 2.0 - 1) * np.hanning(96)
    y = np.fft.irfft(np.fft.rfft(w) / (1 + ((np.fft.rfftfreq(96, 1 / 96) - 4) / 2) ** 4), 96)
    state, bits = 0, []
    for v in y:
        state = 1 if state == 0 and v > 0.1 else 0 if state == 1 and v < -0.1 else state
        bits.append(state)
    assert out[0]["band"] == bits and out[1]["band"] == [] and out[1]["p"] is None
    f = np.fft.fft(np.array(want) * 2.0 - 1)
    f[1:48] *= 2
    f[49:] = 0
    assert out[0]["p"] == pytest.approx(np.angle(np.fft.ifft(f)).mean() % (2 * math.pi))
