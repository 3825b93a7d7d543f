"""Operators on small fixtures: definitions, invariants and edge cases."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.operators import features as E
from sparkloom.operators import layers as L
from sparkloom.operators import linalg as LA
from sparkloom.operators import metrics as X
from sparkloom.operators import models as N
from sparkloom.operators import signal as S
from sparkloom.operators import tensor as T
from sparkloom.operators import windows as W
from sparkloom.sources import io
from sparkloom.streaming import stride


def coo(spark, rows):
    return spark.createDataFrame([(i, j, float(v)) for i, r in enumerate(rows) for j, v in enumerate(r)], "i long, j long, v double")


def cells(df):
    return {(r["i"], r["j"]): r["v"] for r in df.collect()}


def test_matrices(spark):
    a, b = coo(spark, [[1, 2], [3, 4]]), coo(spark, [[5, 6], [7, 8]])
    assert cells(T.matmul(a, b)) == {(0, 0): 19, (0, 1): 22, (1, 0): 43, (1, 1): 50}
    assert cells(T.transpose(a))[(0, 1)] == 3
    assert LA.det(a, 2).first()["det"] == pytest.approx(-2) and LA.det(coo(spark, [[1, 2], [2, 4]]), 2).first()["det"] == pytest.approx(0)
    assert cells(LA.inverse(a, 2))[(0, 0)] == pytest.approx(-2)
    assert [r["v"] for r in LA.solve(a, 2, spark.createDataFrame([(0, 5.0), (1, 11.0)], "i long, v double")).orderBy("i").collect()] == pytest.approx([1, 2])
    assert [r["v"] for r in LA.solve(a, 2, spark.createDataFrame([(1, 2.0)], "i long, v double")).orderBy("i").collect()] == pytest.approx([2, -1])
    turn = LA.eigenvalues(coo(spark, [[0, -1], [1, 0]]), 2).orderBy("i").collect()
    assert [(r["re"], r["im"]) for r in turn] == [pytest.approx((0, -1)), pytest.approx((0, 1))]
    assert T.norm_inf(a).first()[0] == 7 and T.norm_1(a).first()[0] == 6
    assert sorted(r["v"] for r in T.diagonal(a).collect()) == [1, 4]
    assert cells(T.concatenate([a, b], [2, 2], 1))[(1, 3)] == 8
    assert cells(T.split(a, [1, 1])[1]) == {(0, 0): 3, (0, 1): 4}
    with pytest.raises(ValueError):
        LA.det(a, 5000)


def test_scatter(spark):
    rows = spark.createDataFrame([(0, 1.0), (0, 3.0), (2, 5.0)], "index long, v double")
    got = {how: [r["v"] for r in T.scatter(rows, how, 4).orderBy("index").collect()] for how in ("add", "mean", "max", "min")}
    inf = float("inf")
    assert got == {"add": [4, 0, 5, 0], "mean": [2, 0, 5, 0], "max": [3, -inf, 5, -inf], "min": [1, inf, 5, inf]}
    soft = T.scatter_softmax(rows).groupBy("index").agg(F.sum("softmax").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in soft)
    up = spark.createDataFrame([(0, 0, 1, 7.0), (0, 0, 2, 9.0)], "i long, j long, n long, v double")
    assert cells(T.scatter_update(coo(spark, [[1, 2]]), up, ["i", "j"])) == {(0, 0): 9, (0, 1): 2}


def test_arange_and_linspace(spark):
    assert [r["v"] for r in T.arange(spark, 0, 1, 0.25).orderBy("i").collect()] == [0, 0.25, 0.5, 0.75]
    assert T.arange(spark, 3, 1).count() == 0
    assert [r["v"] for r in T.linspace(spark, 2, 5, 1).collect()] == [2]


def test_classification_metrics(spark):
    df = spark.createDataFrame([(0, 0), (1, 2), (2, 1), (0, 0), (1, 1), (2, 2)], "y int, p int")
    assert X.classification(df, "y", "p").first()["accuracy"] == pytest.approx(4 / 6)
    share = X.confusion(df, "y", "p", True).groupBy("y").agg(F.sum("n").alias("s")).collect()
    assert all(r["s"] == pytest.approx(1) for r in share)


def test_regression_metrics(spark):
    df = spark.createDataFrame([(1.0, 1.1), (2.0, 2.1), (3.0, 3.1)], "y double, p double")
    got = X.regression(df, "y", "p").first()
    assert (got["mse"], got["rmse"], got["mae"]) == pytest.approx((0.01, 0.1, 0.1))


@pytest.mark.parametrize("rows,auc", [([(1, 0.9), (0, 0.1)], 1.0), ([(1, 0.5), (0, 0.5)], 0.5), ([(0, 0.9), (1, 0.1)], 0.0), ([(1, 0.3)], 0.0)])
def test_auc(spark, rows, auc):
    assert X.roc_auc(spark.createDataFrame(rows, "y int, s double"), "y", "s").first()[0] == auc


def test_pca_invariants(spark):
    rng = np.random.default_rng(123)
    x = rng.normal((0, 1, -0.5, 2, -1), (1, 0.5, 2, 0.1, 1.5), (100, 5))
    cols = [f"x{i}" for i in range(5)]
    df = spark.createDataFrame(x.tolist(), ", ".join(f"{c} double" for c in cols))
    p = LA.fit_pca(df, cols, 3)
    assert list(p.variance) == sorted(p.variance, reverse=True)
    assert p.variance == pytest.approx(np.linalg.eigvalsh(np.cov(x.T))[::-1][:3])
    back = p.transform(df).select(*[e.alias(c) for c, e in p.inverse_exprs().items()]).toPandas().to_numpy()
    assert ((back - x) ** 2).mean() < 1
    white = p.transform(df, whiten=True).agg(*[F.var_samp(f"pca_{i}") for i in range(3)]).first()
    assert list(white) == pytest.approx([1, 1, 1])
    full = LA.fit_pca(df, cols, 0.9)
    assert full.ratio.sum() >= 0.9
    scale = E.fit_standard(df, cols)
    z = df.select(*[E.standard_expr(F.col(c), *scale[c]).alias(c) for c in cols]).agg(*[F.avg(c) for c in cols], *[F.stddev_pop(c) for c in cols]).first()
    assert max(map(abs, z[:5])) < 1e-5 and max(abs(v - 1) for v in z[5:]) < 1e-5


def test_qr_and_least_squares(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 3))
    y = x @ [1.0, -2.0, 0.5] + 3
    df = spark.createDataFrame(np.column_stack([x, y]).tolist(), "a double, b double, c double, y double").repartition(7)
    assert np.abs(LA.qr(df, ["a", "b", "c"])) == pytest.approx(np.abs(np.linalg.qr(x, mode="r")))
    assert LA.least_squares(df, ["a", "b", "c"], "y") == pytest.approx([3, 1, -2, 0.5])
    assert N.expectation_solver(df, ["a", "b", "c"], "y") == pytest.approx([1, -2, 0.5], abs=1e-3)
    l = LA.cholesky(df, ["a", "b", "c"])
    assert l @ l.T == pytest.approx(x.T @ x)
    assert LA.svd(df, ["a", "b", "c"])[0] == pytest.approx(np.linalg.svd(x, compute_uv=False))
    q = LA.orthogonal(5, 3)
    assert q.T @ q == pytest.approx(np.eye(3))


def test_feature_edges(spark):
    df = spark.createDataFrame([(1, None, None), (2, "a b", 1.0), (3, "c", float("nan"))], "id int, s string, x double")
    assert E.fit_median(df, "x") == 1.0 and E.fit_median(df, "x", True) == 0.0
    got = df.select(*[e.alias(n) for n, e in E.one_hot_exprs("s", ["a b"]).items()]).collect()
    assert [r["s_a_b"] for r in got] == [0.0, 1.0, 0.0]
    assert df.orderBy("id").select(E.hash_expr("s", 0)).first()[0] == 0.0
    text = df.orderBy("id").select(E.text_exprs("s")["s_word_count"]).collect()
    assert [r[0] for r in text] == [0.0, 2.0, 1.0]
    assert E.categories(spark.range(200).withColumnRenamed("id", "k"), "k", 100) is None
    nested = spark.createDataFrame([(1, (2, (3,)))], "a int, s struct<b:int, c:struct<d:int>>")
    assert E.flatten_struct(nested, "s").columns == ["a", "s_b", "s_c_d"]


def test_gradient_ends_and_short_series(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 4.0), ("a", 2, 9.0), ("b", 0, 1.0)], "k string, t int, v double")
    got = {(r["k"], r["t"]): r["gradient"] for r in W.gradient(df, ["k"], ["t"], "v").collect()}
    assert got == {("a", 0): 3, ("a", 1): 4, ("a", 2): 5, ("b", 0): None}
    assert W.rolling(df, ["k"], ["t"], "v", 3).first()["slope"] == pytest.approx(4)
    assert {r["k"]: r["stability"] for r in W.energy_stability(df, ["k"], ["t"], "v", 1).collect()}["b"] == 1.0


@pytest.mark.parametrize("kind", sorted(N.GATES))
def test_cells_keep_state_apart(spark, kind):
    df = spark.createDataFrame([(k, t, 1.0) for k in range(3) for t in range(4)], "k int, t int, x double")
    cell, by = N.Cell(kind, 1, 2), {}
    out = N.run_cell(df, cell, "k", "t", ["x"]).collect()
    for r in out:
        by.setdefault(r["t"], set()).add(tuple(round(v, 12) for v in r["h"]))
    assert len(out) == 12 and all(len(s) == 1 for s in by.values())
    state = (np.zeros(2), np.zeros(2))
    for t in range(4):
        state = cell.step(state, np.ones(1), 1.0)
        assert list(by[t])[0] == pytest.approx(state[0], abs=1e-11)


def test_cell_recurrences():
    """One unit with plain weights, worked out by hand."""
    sg, th = (lambda z: 1 / (1 + math.exp(-z))), math.tanh

    def after(kind, x=0.5, h=0.2, c=0.3, dt=2.0, **more):
        cell = N.Cell(kind, 1, 1, **more)
        cell.w[:], cell.u[:], cell.b[:] = 0.4, -0.6, 0.1
        if kind == "ltc":
            cell.leak[:], cell.rest[:], cell.cm[:], cell.erev[:], cell.sensory[:], cell.sensory_erev[:] = 0.5, -0.1, 2, 0.8, 0.7, 0.9
        h, c = cell.step((np.array([h]), np.array([c])), np.array([x]), dt)
        return h[0], c[0]

    a, r = 0.5 * 0.4 + 0.1, -0.6 * 0.2
    z = sg(a + r)
    assert after("rnn")[0] == pytest.approx(th(a + r))
    assert after("gru")[0] == pytest.approx(z * 0.2 + (1 - z) * th(a + z * r))  # the reset gate acts after the product
    c = z * 0.3 + z * th(a + r)
    assert after("lstm") == pytest.approx((z * th(c), c))
    d = math.exp(-2 / 1.5)
    assert after("cfc", tau=1.5) == pytest.approx((z * th(d * 0.2 + (1 - d) * c), c))
    assert after("ctrnn", tau=4)[0] == pytest.approx(0.2 + 2 * (th(a + r) - 0.2) / 4)
    assert after("ctrnn", tau=0.01, clip=0.9)[0] == -0.9
    assert after("ctgru", tau=4)[0] == pytest.approx(0.2 + 2 * ((1 - z) * 0.2 + z * th(a + r) - 0.2) / 4)
    assert after("stride", tau=4, stride=3)[0] == pytest.approx(0.2 + (a + r - 0.2) / (4 * 2 * 3))
    v = 0.2
    for _ in range(3):
        v += 2 * (0.5 * (-0.1 - v) + th(v) * -0.6 * (0.8 - v) + th(0.5) * 0.7 * (0.9 - v)) / 2
    assert after("ltc", unfolds=3)[0] == pytest.approx(v)

    def slope(v):
        return (0.5 * (-0.1 - v) + th(v) * -0.6 * (0.8 - v) + th(0.5) * 0.7 * (0.9 - v)) / 2

    k = slope(0.2)
    assert after("ltc", unfolds=1, solver="heun")[0] == pytest.approx(0.2 + 2 * (k + slope(0.2 + 2 * k)) / 2)
    k2 = slope(0.2 + k)
    k3 = slope(0.2 + k2)
    assert after("ltc", unfolds=1, solver="rk4")[0] == pytest.approx(0.2 + 2 * (k + 2 * k2 + 2 * k3 + slope(0.2 + 2 * k3)) / 6)


def test_both_ways(spark):
    df = spark.createDataFrame([(0, t, float(t)) for t in range(3)], "k int, t int, x double")
    one, two = N.Cell("gru", 1, 2, 1), N.Cell("gru", 1, 2, 2)
    got = {r["t"]: r["h"] for r in N.run_both_ways(df, one, two, "k", "t", ["x"]).collect()}
    state = (np.zeros(2), np.zeros(2))
    for t in (2, 1, 0):
        state = two.step(state, np.array([float(t)]), 1.0)
        assert got[t][2:] == pytest.approx(state[0])


def test_leaky_state_over_blocks(spark):
    x = np.random.default_rng(2).normal(size=60)
    df = spark.createDataFrame([("a" if i % 4 else "b", i // 7, i, float(v)) for i, v in enumerate(x)], "k string, b int, i int, v double")
    got = {r["k"]: r["state"] for r in N.leaky_state(df, ["k"], ["b"], ["i"], F.col("v"), 2.0).collect()}
    for k in "ab":
        h, d = 0.0, math.exp(-0.5)
        for i, v in enumerate(x):
            if ("a" if i % 4 else "b") == k:
                h = h * d + (1 - d) * math.tanh(v)
        assert got[k] == pytest.approx(h)


def test_recall_patterns_loses_no_pair(spark):
    rng = np.random.default_rng(5)
    bits = rng.integers(0, 2, (120, 64))
    for i in range(60):
        bits[60 + i] = bits[i]
        bits[60 + i, rng.choice(64, i % 15, replace=False)] ^= 1
    store = spark.createDataFrame([(i, b.tolist()) for i, b in enumerate(bits)] + [(500, None), (501, [1, 0])], "pattern_id long, pattern array<int>").repartition(3)
    asked = spark.createDataFrame([(i, bits[i].tolist()) for i in range(0, 60, 3)] + [(900, None), (901, [1, 1])], "query_id long, pattern array<int>")
    for threshold, block in ((0.8, 7), (0.5, 4096)):
        got = {(r["query_id"], r["pattern_id"]): r["similarity"] for r in L.recall_patterns(store, asked, threshold, block).collect()}
        want = {(i, j): 1 - (bits[i] != bits[j]).mean() for i in range(0, 60, 3) for j in range(120) if 1 - (bits[i] != bits[j]).mean() >= threshold}
        want |= {(901, 501): 0.5} if threshold <= 0.5 else {}
        assert got == pytest.approx(want)
    assert L.recall_patterns(store, asked.limit(0)).count() == 0


def test_leaky_fold(spark):
    got = spark.range(1).select(N.leaky_fold(F.array(F.lit(1.0), F.lit(0.0)))).first()[0]
    first = (1 - math.exp(-1)) * math.tanh(1)
    assert got == pytest.approx([first, first * math.exp(-1)])


def test_rbm_training_lowers_the_error(spark):
    df = spark.createDataFrame([(float(i % 2), float(i % 2)) for i in range(50)], "a double, b double")
    one, many = N.train_rbm(df, ["a", "b"], 2, 1, 0.5), N.train_rbm(df, ["a", "b"], 2, 25, 0.5)
    e = [m.reconstruction_error(df).agg(F.avg("error")).first()[0] for m in (one, many)]
    assert e[1] < e[0]


def test_spectra(spark):
    n = 64
    df = spark.createDataFrame([([math.sin(2 * math.pi * 8 * i / n) for i in range(n)],)], "x array<double>")
    assert df.select(S.dominant_frequency(S.magnitudes(F.col("x")), 1.0)).first()[0] == 8.0
    z = df.select(S.fft(F.col("x")).alias("z")).first()["z"]
    assert np.array([complex(v["re"], v["im"]) for v in z]) == pytest.approx(np.fft.fft(df.first()["x"]))
    assert len(df.select(S.mfcc(F.col("x"), 64)).first()[0]) == 13
    assert len(df.select(S.stft(F.col("x"), 16, 8)).first()[0]) == 7


def test_io(spark, tmp_path):
    p = tmp_path / "f.csv"
    p.write_text("col1,col2,col3\n1,A,True\n2,B,False\n3,A,True\n")
    assert io.load_csv(spark, str(p)).dtypes == [("col1", "int"), ("col2", "string"), ("col3", "boolean")]
    with pytest.raises(ValueError):
        io.scan(spark.range(5), limit=2)
    io.save_model(spark, str(tmp_path / "m"), {"w": [1.5]})
    assert io.load_model(spark, str(tmp_path / "m")) == {"w": [1.5]}
    assert io.row_count(spark.range(5), "id > 2") == 2


def test_order_places(spark):
    big = spark.range(4_000_000).select((F.pmod(F.xxhash64("id"), F.lit(1 << 40)) / 7).alias("v"))
    x = np.sort(np.array(big.toPandas()["v"]))
    lo, hi = x[len(x) // 4], x[3 * len(x) // 4]
    assert E.fit_order_iqr(big, "v") == (lo - 1.5 * (hi - lo), hi + 1.5 * (hi - lo))
    assert E.fit_order_scale(big, "v") == (x[len(x) // 20], x[19 * len(x) // 20])
    odd = [-math.inf, 5e-324, 0.0, 1e-323, -1e308, 1e308, 1e308, 2.0, 2.0, 2.5, 1e-9, math.inf, math.nan]
    df = spark.createDataFrame([(v,) for v in [*odd, None]], "v double")
    got = E.order_statistics(df, F.col("v"), list(range(13)), most=2, buckets=3)
    assert [got[i] for i in range(12)] == sorted(odd[:-1]) and math.isnan(got[12])


def test_quantiles_without_a_single_task(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(size=3000).round(2), np.zeros(3000), rng.lognormal(3, 3, 3000)])
    df = spark.createDataFrame([(int(i % 3) if i % 7 else None, float(v)) for i, v in enumerate(x)] + [(1, None), (9, None)], "g int, v double")
    shares = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    assert E.quantiles(df, "v", shares) == pytest.approx(np.quantile(x, shares).tolist())
    got = {r["g"]: (r["a"], r["b"]) for r in E.grouped_quantiles(df.union(spark.createDataFrame([(0, float("nan"))], df.schema)), ["g"], {"a": ("v", 0.5), "b": ("v", 0.93)}, accuracy=100).collect()}
    by = {g: [v for i, v in enumerate(x) if (int(i % 3) if i % 7 else None) == g] for g in (0, 1, 2, None)}
    assert set(got) == set(by) and all(got[g] == pytest.approx(tuple(np.quantile(v, [0.5, 0.93]))) for g, v in by.items())


def test_fits_of_empty_tables(spark):
    none = spark.createDataFrame([], "v double, k string, t timestamp")
    assert E.quantiles(none, "v", [0.5]) == [None] and E.fit_median(none, "v") is None
    assert E.fit_iqr(none, "v") == E.fit_order_iqr(none, "v") == E.fit_order_scale(none, "v") == (None, None)
    assert E.grouped_quantiles(none, ["k"], {"m": ("v", 0.5)}).count() == 0
    assert E.robust_numeric(none, ["v"]).columns[-1] == "v_scaled" and E.robust_numeric(none, ["v"]).count() == 0
    assert E.temporal_split(none, "t").count() == E.target_encode(none, "k", "v").count() == 0
    void = spark.createDataFrame([(None, "a", None), (float("nan"), None, None)], "v double, k string, t timestamp")
    assert [r["v_scaled"] for r in E.robust_numeric(void.where("v IS NULL"), ["v"]).collect()] == [0.0]
    assert [r["split"] for r in E.temporal_split(void, "t").collect()] == ["test", "test"]


def test_stream_of_many_batches(spark, tmp_path):
    """A key with most rows over batches of bounded size, in order though written out of it."""
    rows = [((i * 37) % 200, "a" if i % 5 else "b", float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "at long, key string, v double").repartition(3)
    stream = stride.in_order(df, "at", str(tmp_path / "in"), most=40)
    got = stride.drain(stride.strided(stream, "key", "at", "v", 5, [1, 3]), str(tmp_path / "out"), str(tmp_path / "state"))
    assert len(list((tmp_path / "state" / "commits").glob("[0-9]*"))) >= 5
    want = []
    for key in "ab":
        x = [v for _, k, v in sorted(rows) if k == key]
        want += [(key, s, i, sum(x[i : i + 5]) / 5) for s in (1, 3) for i in range(0, len(x) - 4, s)]
    assert sorted((r["key"], r["stride"], r["start"], r["mean"]) for r in got.collect()) == sorted(want)


def test_tfidf_moves_no_rare_terms(spark):
    """Ids on two rows are one; the exchange by row and term lies above the join with the commonest terms."""
    rows = [(i % 30, f"common{i % 3} common{i % 4} rare{i}") for i in range(60)] + [(None, "common1 x"), (90, None)]
    out = E.tfidf(spark.createDataFrame(rows, "k int, t string"), "k", "t", 3)
    by: dict = {}
    for k, t in rows:
        for w in (t or "").split():
            if len(w) > 1:
                by.setdefault((k, w), []).append(w)
    tf: dict = {}
    for (_, w), some in by.items():
        tf[w] = tf.get(w, 0) + len(some)
    top = sorted(tf, key=lambda w: (-tf[w], w))[:3]
    raw = {(k, w): len(n) * (math.log(63 / (1 + sum(v == w for _, v in by))) + 1) for (k, w), n in by.items() if w in top}
    want = {(k, w): x / math.sqrt(sum(y * y for (j, _), y in raw.items() if j == k)) for (k, w), x in raw.items()}
    assert {(r["k"], r["term"]): r["weight"] for r in out.collect()} == pytest.approx(want)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    first = next(line for line in plan.splitlines() if "Aggregate [k" in line)
    below = plan[plan.index(first) :]
    assert "Join" in below and below.index("Join") < below.index("Generate")


def test_transforms_of_whole_batches(spark):
    """Arrays of several lengths, null and broken ones; a batch costs numbers, not objects."""
    import tracemalloc

    import pyarrow as pa

    xs = [[1.0, 2.0, 4.0], None, [], [1.0, None, 2.0], [3.0, 1.0], [float("nan"), 1.0], [0.0, -1.0, 5.0], [7.0]]
    got = S._by_length(pa.array(xs, pa.list_(pa.float64())), lambda m: np.fft.fft(m, axis=1)).to_pylist()
    for x, z in zip(xs, got):
        fine = x and not any(v is None or v != v for v in x)
        assert (z is not None) == bool(fine) and (not fine or [complex(v["re"], v["im"]) for v in z] == pytest.approx(np.fft.fft(x).tolist()))
    df = spark.createDataFrame([(x,) for x in xs], "x array<double>").withColumn("z", S.fft(F.col("x"))).withColumn("h", S.fft(F.col("x"), real=True))
    for x, back, half in df.select("x", S.fft(F.col("z"), inverse=True), S.fft(F.col("h"), inverse=True, real=True, n=3)).collect():
        assert (back is None) == (half is None) and (back is None or [v["re"] for v in back] == pytest.approx(x) and (len(x) != 3 or half == pytest.approx(x)))
    many = pa.array(np.random.default_rng(0).normal(size=(20000, 64)).tolist(), pa.list_(pa.float64()))
    tracemalloc.start()
    S._by_length(many, lambda m: np.fft.fft(m, axis=1))
    assert tracemalloc.get_traced_memory()[1] < 150e6
    tracemalloc.stop()


def test_stream_state_of_shards(spark, tmp_path):
    """Many keys, one of them null, share few states; null values are part of a series."""
    rows = [(i, None if i % 50 == 7 else f"k{i % 50}", None if i == 407 else float(i)) for i in range(1000)]
    stream = stride.in_order(spark.createDataFrame(rows, "at long, key string, v double"), "at", str(tmp_path / "in"), most=300)
    got = stride.drain(stride.strided(stream, "key", "at", "v", 4, [1, 3], shards=3), str(tmp_path / "out"), str(tmp_path / "state")).collect()
    want = set()
    for key in {k for _, k, _ in rows}:
        x = [v for _, k, v in rows if k == key]
        want |= {(key, s, i, None if None in x[i : i + 4] else sum(x[i : i + 4]) / 4) for s in (1, 3) for i in range(0, len(x) - 3, s)}
    found = [(r["key"], r["stride"], r["start"], None if r["mean"] is None or r["mean"] != r["mean"] else r["mean"]) for r in got]
    assert len(found) == len(want) and set(found) == want


def test_type_table(spark):
    rows = [(i, f"n{i}", f"u{i}", "ab"[i % 2], f"w{i} x y", f"{i} " + "long text " * 15, bool(i % 2), i % 5, float(i) if i % 3 else None, f"c{i % 40}", [i]) for i in range(150)]
    df = spark.createDataFrame(rows, "k int, name string, user_id string, c string, t string, l string, b boolean, few int, x double, mid string, a array<int>")
    got = {r["column"]: (r["kind"], r["strategy"]) for r in E.type_table(df).collect()}
    assert got == {
        "k": ("numeric", "robust_scaling"), "name": ("text", "hash_encoding"), "user_id": ("text", "hash_encoding"), "c": ("categorical", "one_hot_encoding"), "t": ("text", "hash_encoding"),
        "l": ("text", "embeddings"), "b": ("boolean", "direct"), "few": ("categorical", "one_hot_encoding"), "x": ("numeric", "robust_scaling_with_imputation"), "mid": ("categorical", "one_hot_encoding"), "a": ("categorical", "one_hot_encoding"),
    }
    blank = spark.createDataFrame([(" " if i % 5 else f"v{i}",) * 2 for i in range(600)], "code string, other string")
    assert {r["column"]: r["kind"] for r in E.type_table(blank).collect()} == {"code": "identifier", "other": "categorical"}
    assert E.profile(df).where("column = 'name'").first()["n_distinct"] == 150 and E.type_table(df.limit(0)).count() == 11
    many = spark.range(200_000).select("id", F.lit(None).cast("int").alias("none"))
    assert {r["column"]: r["n_distinct"] for r in E.profile(many).collect()} == {"id": 200_000, "none": 0}


def test_extractor_on_other_rows(spark):
    kinds = {"x": "numeric", "c": "categorical", "t": "text", "b": "boolean"}
    df = spark.createDataFrame([(1.0, "a", "p q", True), (3.0, "b", None, False), (None, None, "r", None)], "x double, c string, t string, b boolean")
    new = spark.createDataFrame([(5.0, "z", "p", True), (None, None, None, None)], df.schema)
    m = E.fit_extractor(df, kinds, missing=True)
    got = m.transform(new).collect()
    assert (got[0]["x_scaled"], got[0]["c_a"], got[0]["c_MISSING"], got[0]["t_word_count"], got[0]["b_flag"]) == (3.0, 0.0, 0.0, 1.0, 1.0)
    assert (got[1]["x_scaled"], got[1]["c_MISSING"], got[1]["b_flag"]) == (0.0, 1.0, None)
    coded = E.fit_extractor(df.withColumn("y", F.col("x") * 2), kinds, target="y", smoothing=1.0)
    assert [r["c_target"] for r in coded.transform(new).collect()] == [4.0, 4.0]
    assert {r["c_target"] for r in coded.transform(df).collect()} == {(2 + 4) / 2, (6 + 4) / 2, 4.0}
    assert E.fit_extractor(df.limit(0), {"c": "categorical"}).transform(df.limit(0)).count() == 0


def test_curves_of_skewed_scores(spark):
    rng = np.random.default_rng(9)
    s = np.concatenate([rng.lognormal(0, 6, 4000), [0.0] * 50])
    y = (rng.uniform(size=len(s)) < 0.3).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    c = X.curve(df, "y", "s", 16)
    got = {r["score"]: (r["tp"], r["fp"]) for r in c.collect()}
    for v in (s.max(), 0.0, s[0], s[17]):
        assert got[v] == (y[s >= v].sum(), (1 - y)[s >= v].sum())
    assert X.curve(df.limit(0), "y", "s").count() == 0


def test_cepstra_by_hand(spark):
    """Power through triangles at equal mel steps, logarithms, and their cosine sums, written out."""
    x, rate, n_mels, n = np.random.default_rng(4).normal(size=64), 8000.0, 8, 5
    power = [abs(sum(x[j] * np.exp(-2j * math.pi * k * j / 64) for j in range(64))) ** 2 for k in range(33)]
    mel = [i * 2595 * math.log10(1 + rate / 1400) / (n_mels + 1) for i in range(n_mels + 2)]
    at, logs = [700 * (10 ** (m / 2595) - 1) for m in mel], []
    for a, b, c in zip(at, at[1:], at[2:]):
        total = 0.0
        for k, p in enumerate(power):
            f = k * rate / 64
            total += p * ((f - a) / (b - a) if a < f <= b else (c - f) / (c - b) if b < f < c else 0.0)
        logs.append(math.log(max(total, 1e-10)))
    want = [sum(v * math.cos(math.pi * k * (i + 0.5) / n_mels) for i, v in enumerate(logs)) for k in range(n)]
    got = spark.createDataFrame([(x.tolist(),)], "x array<double>").select(S.mfcc(F.col("x"), rate, n, n_mels)).first()[0]
    assert got == pytest.approx(want)


def test_random_draws_have_their_moments(spark):
    from sparkloom.functions import random as R

    df = spark.range(6000)
    cols = {"u": R.uniform(-1, 3, 1), "n": R.normal(2, 3, 2), "b": R.bernoulli(0.3, 3), "e": R.exponential(2.0, 4), "g": R.gamma(F.col("id"), 2.0, 1.5), "p": R.poisson(F.col("id"), 4.0), "w": R.glorot_uniform(10, 14, 1.0, 5), "k": R.categorical([0.0, math.log(3)], 6)}
    got = df.select(*[c.alias(n) for n, c in cols.items()]).agg(*[F.avg(n) for n in cols], *[F.stddev_pop(n) for n in cols]).first()
    means, devs = dict(zip(cols, got)), dict(zip(cols, got[len(cols) :]))
    want = {"u": (1, 4 / 12**0.5), "n": (2, 3), "b": (0.3, 0.21**0.5), "e": (2, 2), "g": (3, 2**0.5 * 1.5), "p": (4, 2), "w": (0, 0.5 / 3**0.5), "k": (0.75, 0.1875**0.5)}
    for name, (m, d) in want.items():
        assert abs(means[name] - m) < 0.06 * d + 1e-9 and abs(devs[name] - d) < 0.06 * d, name


def test_logistic_training_by_hand(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(80, 2))
    y = (x[:, 0] - x[:, 1] > 0.2).astype(float)
    df = spark.createDataFrame([(*map(float, a), int(b)) for a, b in zip(x, y)], "p double, q double, y int")
    full, w, m, v = np.column_stack([x, np.ones(80)]), np.zeros(3), np.zeros(3), np.zeros(3)
    for t in range(1, 5):
        g = full.T @ (1 / (1 + np.exp(-full @ w)) - y) / 80
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    assert L.train_logistic(df, ["p", "q"], "y", L.Optimizer("adam", 0.3), 4) == pytest.approx(w)
    w, v = np.zeros(3), np.zeros(3)
    for _ in range(3):
        v = 0.5 * v - 0.3 * full.T @ (1 / (1 + np.exp(-full @ w)) - y) / 80
        w = w + v
    assert L.train_logistic(df, ["p", "q"], "y", L.Optimizer("sgd", 0.3, 0.5), 3) == pytest.approx(w)
