"""Global orders, scans over ranges, wide and large matrices, measures of groups, chunks of rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkloom.functions import vector as V
from sparkloom.operators import chunks as K
from sparkloom.operators import dense as D
from sparkloom.operators import groups as G
from sparkloom.operators import linalg as LA
from sparkloom.operators import metrics as X
from sparkloom.operators import ordering as O
from sparkloom.operators import waves as H
from sparkloom.operators import windows as W
from sparkloom.plans import large as L
from sparkloom.sources.shared import folder


def tasks(spark, fn):
    """The numbers of tasks of the stages that ``fn`` runs."""
    group = f"g{random.random()}"
    spark.sparkContext.setJobGroup(group, "")
    fn()
    tracker = spark.sparkContext.statusTracker()
    infos = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    return [i.numTasks for i in infos if i]


def test_row_numbers_and_ties(spark):
    rows = [(k % 7, k % 3, None if k % 11 == 0 else "x") for k in range(500)] + [(3, 1, "hot")] * 400
    df = spark.createDataFrame(rows, "a int, b int, c string").repartition(5)
    got = O.row_numbers(df, [F.desc("a"), F.col("b")], "n", 16).orderBy("n").collect()
    assert [r["n"] for r in got] == list(range(1, 901)) and [(-r["a"], r["b"]) for r in got] == sorted((-a, b) for a, b, _ in rows)
    rows = O.placed(df, [F.col("a"), F.col("b")], 16)
    assert rows.where("c = 'hot'").select("__part").distinct().count() > 1  # repeated rows are dealt to several ranges
    assert O.row_numbers(df.limit(0), [F.col("a")]).count() == 0
    ranks = O.dense_ranks(df.withColumn("c", F.when(F.col("a") > 3, F.col("c"))), ["c"], "k")
    assert {(r["c"], r["k"]) for r in ranks.select("c", "k").distinct().collect()} == {(None, 1), ("x", 2)}


def test_permutation_has_no_single_task(spark):
    df = spark.range(0, 5000, 1, 12)
    got = O.permutation(df, ["id"], 3, parts=16)
    assert "SinglePartition" not in got._jdf.queryExecution().toString()
    first = [r["id"] for r in got.orderBy("place").collect()]
    assert sorted(first) == list(range(5000)) and first != list(range(5000))
    assert first == [r["id"] for r in O.permutation(df.repartition(3, "id"), ["id"], 3).orderBy("place").collect()]
    assert first != [r["id"] for r in O.permutation(df, ["id"], 4).orderBy("place").collect()]
    assert sorted(r["place"] for r in O.permuted_range(spark, 20, 1).collect()) == list(range(20))


def series(n, keys=("a", None, "c")):
    random.seed(n)
    return [(random.choice(keys), k, random.choice([None, 0.0, 0.6, 1.0, random.random()])) for k in range(n)]


@pytest.mark.parametrize("keys", [("a",), ("a", None, "c")])
def test_scans_equal_folds(spark, keys):
    rows = series(700, keys)
    df = spark.createDataFrame(rows, "k string, t long, x double").repartition(7)
    sums = {r["t"]: r["cumsum"] for r in O.cumulative(df, ["k"], ["t"], "x", parts=13).collect()}
    levels = {r["t"]: r["level"] for r in O.dopamine(df, ["k"], ["t"], "x", increase=0.3, decay=0.7, dt=0.1, start=0.4, parts=13).collect()}
    total, level = dict.fromkeys(keys, 0.0), dict.fromkeys(keys, 0.4)
    for k, t, x in rows:
        total[k] += x or 0.0
        level[k] = max(0.0, level[k] + (0.3 * (x - 0.5) if x is not None and x > 0.5 else 0.0) - 0.07)
        assert sums[t] == pytest.approx(total[k]) and levels[t] == pytest.approx(level[k], abs=1e-9), t
    assert O.placed(df, [F.col("k"), F.col("t")], 13).select("__part").distinct().count() >= 10
    assert O.cumulative(df.limit(0), ["k"], ["t"], "x").count() == O.dopamine(df.limit(0), ["k"], ["t"], "x").count() == 0


def test_interpolation_follows_lines(spark):
    rows = [("a", 0, None), ("a", 10, 1.0), ("a", 15, None), ("a", 20, 3.0), ("a", 60, None), ("b", 1, None), (None, 5, 2.0), (None, 6, None)]
    got = O.interpolated(spark.createDataFrame(rows, "k string, t long, x double"), ["k"], "t", "x", "y", 6)
    assert {(r["k"], r["t"]): r["y"] for r in got.collect()} == {("a", 0): 1, ("a", 10): 1, ("a", 15): 2, ("a", 20): 3, ("a", 60): 3, ("b", 1): None, (None, 5): 2, (None, 6): 2}
    random.seed(2)
    points = sorted(random.sample(range(5000), 200))
    values = [random.random() for _ in points]
    df = spark.createDataFrame([("s", t, v) for t, v in zip(points, values)] + [("s", points[0], None), ("s", None, 1.0)], "k string, t long, x double")
    grid = {r["t"]: r["x"] for r in O.resampled(df, ["k"], "t", "x", 7, 9).collect()}
    assert sorted(grid) == [t for t in range(0, 5000, 7) if points[0] <= t <= points[-1]]
    assert list(grid.values()) == pytest.approx(np.interp(list(grid), points, values).tolist())


def test_resampling_orders_points_and_not_what_it_makes(spark, monkeypatch):
    placed, stored = [], O.stored
    monkeypatch.setattr(O, "stored", lambda df, name: placed.append(df.count()) or stored(df, name) if name == "placed" else stored(df, name))
    df = spark.createDataFrame([("a", 0, 0.0), ("a", 100_000, 1.0), ("b", -7, 3.0)], "k string, t long, x double")
    got = O.resampled(df, ["k"], "t", "x", 1, 4)
    assert placed == [3]
    assert {r["k"]: (r["n"], r["x"]) for r in got.groupBy("k").agg(F.count("t").alias("n"), F.sum("x").alias("x")).collect()} == {"a": (100_001, pytest.approx(50_000.5)), "b": (1, 3.0)}


def test_ranges_follow_the_rows_and_series_may_end_anywhere(spark, monkeypatch):
    monkeypatch.setattr(O, "ROWS", 25)
    random.seed(5)
    keys = [None, "long", *[f"k{j}" for j in range(60)]]
    points = {k: sorted(random.sample(range(-3000, 3000), 700 if k == "long" else random.choice((1, 2, 9)))) for k in keys}
    rows = [(k, t, random.random()) for k in keys for t in points[k]]
    df = spark.createDataFrame(rows, "k string, t long, x double").repartition(5)
    assert O.placed(df, [F.col("k"), F.col("t")]).groupBy("__part").count().agg(F.max("count")).first()[0] <= 75
    got = {(r["k"], r["t"]): r["x"] for r in O.resampled(df, ["k"], "t", "x", 10).collect()}
    want, sums, levels, bits = {}, {}, {}, {}
    for k in keys:
        mine = [(t, x) for key, t, x in rows if key == k]
        grid = [t for t in range(-3000, 3000, 10) if mine[0][0] <= t <= mine[-1][0]]
        want |= {(k, t): v for t, v in zip(grid, np.interp(grid, *zip(*mine)))}
        total, level, met = 0.0, 0.0, 1 << (int(mine[0][1] * 1000) % 7)
        for t, x in mine:
            total, level, met = total + x, max(0.0, level + x - 0.5), met | 1 << (int(x * 1000) % 40)
            sums[k, t], levels[k, t], bits[k, t] = total, level, met
    assert got.keys() == want.keys() and all(got[p] == pytest.approx(want[p], abs=1e-12) for p in want)
    assert {(r["k"], r["t"]): r["cumsum"] for r in O.cumulative(df, ["k"], ["t"], "x").collect()} == pytest.approx(sums)
    assert {(r["k"], r["t"]): r["level"] for r in O.level(df, ["k"], ["t"], F.col("x") - 0.5).collect()} == pytest.approx(levels)
    one = lambda n: F.expr(f"shiftleft(1L, cast(int(x * 1000) % {n} as int))")
    assert {(r["k"], r["t"]): r["bits"] for r in O.gathered_bits(df, ["k"], ["t"], one(40), first=one(7)).collect()} == bits


def test_resampling_is_exact_at_large_times(spark):
    at = 1 << 60
    df = spark.createDataFrame([(at, 0.0), (at + 100, 100.0), (-(1 << 63), 7.0)], "t long, x double")
    near = O.resampled(df.where("t > 0"), [], "t", "x", 1, 3)
    assert [r["x"] for r in near.orderBy("t").collect()] == pytest.approx(list(range(101)))
    far = O.resampled(df.where("x in (7, 100)"), [], "t", "x", 1 << 61, 3)
    assert [(r["t"] >> 61, r["x"]) for r in far.orderBy("t").collect()] == [(k, pytest.approx(7 + 93 * (k + 4) / 4.5)) for k in range(-4, 1)]


def test_stretch_and_envelopes(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0], 6), ([5.0], 3), ([], 2), (None, 2), ([1.0, 3.0], 0), ([1.0, 2.0, 3.0, 4.0], 2)], "x array<double>, n int")
    got = [r[0] for r in df.select(V.stretch(F.col("x"), F.col("n"))).collect()]
    assert got == [pytest.approx([1, 1.25, 1.75, 2.5, 3.5, 4]), [5, 5, 5], None, None, None, pytest.approx([1.5, 3.5])]
    y = spark.sql("select array(2.0D, -2.0D, 2.0D, -2.0D) x, array(0.0D, 1.0D) e").select(H.envelope(F.col("x"), F.col("e"))).first()[0]
    assert y == pytest.approx([0, -0.5, 1.5, -2])


def test_qr_has_a_task_for_each_partition_and_takes_wide_tables(spark):
    df = spark.range(0, 6400, 1, 64).select((F.col("id") % 13).alias("a"), F.sin("id").alias("b"), (F.col("id") % 5).cast("double").alias("c"))
    x = np.array([[k % 13, math.sin(k), k % 5] for k in range(6400)])
    box = {}
    ran = tasks(spark, lambda: box.update(r=LA.qr(df, ["a", "b", "c"])))
    assert max(ran) >= 64 and box["r"].T @ box["r"] == pytest.approx(x.T @ x)
    names = [f"c{j}" for j in range(120)]
    wide = spark.range(0, 300, 1, 4).select(*[F.sin(F.col("id") * (j + 1)).alias(c) for j, c in enumerate(names)])
    n, s, g = LA.gram(wide, names)
    m = np.array([[math.sin(k * (j + 1)) for j in range(120)] for k in range(300)])
    assert n == 300 and s == pytest.approx(m.sum(axis=0)) and g == pytest.approx(m.T @ m, abs=1e-8)
    assert LA.qr(df.limit(0), ["a", "b", "c"]).shape == (0, 3)


def test_wide_singular_values(spark):
    rng = np.random.default_rng(1)
    a = rng.normal(size=(400, 6)) @ np.diag([90, 50, 20, 8, 3, 1]) @ rng.normal(size=(6, 1000)) + 0.01 * rng.normal(size=(400, 1000)) + 3
    df = spark.createDataFrame([(x.tolist(),) for x in a], "x array<double>").repartition(9)
    for centre in (False, True):
        got = D.wide_svd(df, 1000, 5, centre=centre)
        b = a - a.mean(axis=0) if centre else a
        _, s, vt = np.linalg.svd(b, full_matrices=False)
        assert got.values == pytest.approx(s[:5], rel=1e-8) and np.abs((got.vectors * vt[:5]).sum(axis=1)) == pytest.approx(np.ones(5), abs=1e-6)
    first = df.select(F.col("x"), got.scores(F.col("x")).alias("s")).first()
    assert first["s"] == pytest.approx((got.vectors @ (np.array(first["x"]) - a.mean(axis=0))).tolist())
    small = D.wide_svd(spark.createDataFrame([([1.0, None],), ([0.0, 2.0],)], "x array<double>"), 2, 2)
    assert small.values == pytest.approx([2, 1])
    assert len(D.wide_svd(df.limit(0), 1000, 3).values) == 0
    with pytest.raises(Exception, match="arrays of 3"):
        D.wide_svd(df, 3, 1)


def test_range_finder_stops_when_its_span_stays(spark, monkeypatch):
    """Rows of rank two take two rounds and the last pass, as many as there are trees."""
    rng = np.random.default_rng(3)
    a = rng.normal(size=(200, 2)) @ rng.normal(size=(2, 40))
    df, seen, real = spark.createDataFrame([(x.tolist(),) for x in a], "x array<double>"), [], D.tree
    monkeypatch.setattr(D, "tree", lambda *x, **y: (seen.append(1), real(*x, **y))[1])
    got = D.wide_svd(df, 40, 2)
    assert got.values == pytest.approx(np.linalg.svd(a, compute_uv=False)[:2], rel=1e-10) and len(seen) <= 3


def test_moments_of_batches_equal_one_pass_and_replays_count_once(spark):
    names = ["a", "b", "c"]
    df = spark.range(600).select((F.col("id") % 13).cast("double").alias("a"), F.sin("id").alias("b"), F.when(F.col("id") % 9 > 0, F.col("id") % 5).alias("c"), "id")
    m = D.Moments(spark, names, folder(spark, "moments"))
    for number in (0, 1, 2, 1, 0):
        m.add(df.where(F.col("id") % 3 == number), number)
    m.add(df.limit(0), 9)
    once = LA.gram(df, names)
    got = m.merged()
    assert got[0] == once[0] and got[1] == pytest.approx(once[1]) and got[2] == pytest.approx(once[2])
    assert LA.pca_of(names, *got).variance == pytest.approx(LA.fit_pca(df, names).variance)


def test_moments_in_a_stream(spark):
    source, names = folder(spark, "source"), ["a", "b"]
    df = spark.range(0, 90, 1, 3).select(F.col("id").cast("double").alias("a"), (F.col("id") % 7).cast("double").alias("b"))
    df.write.parquet(source)
    m = D.Moments(spark, names, folder(spark, "moments"))
    for _ in range(2):  # the second run has lost its progress and sees every batch again
        stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(source)
        stream.writeStream.foreachBatch(m.add).option("checkpointLocation", folder(spark, "progress")).trigger(availableNow=True).start().awaitTermination()
    assert m.merged()[0] == 90 and m.merged()[1] == pytest.approx([sum(range(90)), sum(k % 7 for k in range(90))])


def cells(spark, m):
    return spark.createDataFrame([(int(i), int(j), float(m[i, j])) for i, j in zip(*np.nonzero(m))], "i long, j long, v double")


def test_large_systems(spark):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(50, 50))
    m[:16, :16] = 0  # the first block alone is singular: rows have to change places
    b = rng.normal(size=50)
    right = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "i long, v double")
    x = D.solve_large(cells(spark, m), right, 50, 16).orderBy("i").collect()
    assert [r["i"] for r in x] == list(range(50)) and [r["v"] for r in x] == pytest.approx(np.linalg.solve(m, b).tolist())
    inv = np.zeros((50, 50))
    for r in D.inverse_large(cells(spark, m), 50, 20).collect():
        inv[r["i"], r["j"]] = r["v"]
    assert inv == pytest.approx(np.linalg.inv(m))
    for size in (7, 16, 50):
        assert D.log_det_large(cells(spark, m), 50, size) == pytest.approx(tuple(map(float, np.linalg.slogdet(m))))
    assert D.log_det_large(cells(spark, np.ones((5, 5))), 5, 5)[0] == 0 or D.log_det_large(cells(spark, np.ones((5, 5))), 5, 5)[1] < -30


def test_bordered_systems(spark):
    rng = np.random.default_rng(5)
    m, n = np.zeros((53, 53)), 50
    for k in range(0, n, 16):
        m[k : min(k + 16, n), k : min(k + 16, n)] = rng.normal(size=(min(16, n - k),) * 2)
    m[:, n:], m[n:, :] = rng.normal(size=(53, 3)), rng.normal(size=(3, 53))
    b = rng.normal(size=53)
    right = spark.createDataFrame([(i, float(v)) for i, v in enumerate(b)], "i long, v double")
    x = D.solve_bordered(cells(spark, m).unionByName(cells(spark, m)), right, n, 3, 16).orderBy("i").collect()
    assert [r["i"] for r in x] == list(range(n)) and [r["v"] for r in x] == pytest.approx((np.linalg.solve(m, b)[:n] / 2).tolist())
    m[3, 40] = 1.0
    with pytest.raises(Exception, match="between two blocks"):
        D.solve_bordered(cells(spark, m), right, n, 3, 16).count()


def test_large_system_is_made_of_few_cells(spark, tmp_path, monkeypatch):
    """Cells in proportion to the suppliers: 3,000 of them make 9,001, not nine million."""
    spark.range(3000).select(F.col("id").alias("s_suppkey"), (F.sin("id") * 900).alias("s_acctbal")).write.parquet(str(tmp_path / "supplier.parquet"))
    seen, real = [], D.solve_bordered
    monkeypatch.setattr(D, "solve_bordered", lambda a, *more: (seen.append(a.count()), real(a, *more))[1])
    got = {r["i"]: r["x"] for r in L.large_system(spark, str(tmp_path)).collect()}
    k = np.arange(3000)
    y = np.sin(k) * 900
    d, u, w = 100 + np.abs(y), 1.0 + k % 3, 1 / (1.0 + k % 5)
    want = (y - u * (w * y / d).sum() / (1 + (w * u / d).sum())) / d
    assert seen == [9001] and [got[i] for i in range(3000)] == pytest.approx(want.tolist(), abs=1e-6)


def test_two_thousand_unknowns(spark):
    """Off-diagonal cells of two thousand rows; the residual is tested with joins."""
    n = 2000
    a = spark.range(n * 40).select((F.col("id") % n).alias("i"), F.pmod(F.xxhash64("id"), F.lit(n)).alias("j"), F.sin("id").alias("v"))
    a = a.unionByName(spark.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(30.0).alias("v")))
    b = spark.range(n).select(F.col("id").alias("i"), F.cos("id").alias("v"))
    x = D.solve_large(a, b, n, 500)
    ax = a.join(x.select(F.col("i").alias("j"), F.col("v").alias("x")), "j").groupBy("i").agg(F.sum(F.col("v") * F.col("x")).alias("ax"))
    worst = ax.join(b, "i").agg(F.max(F.abs(F.col("ax") - F.col("v"))), F.count("*")).first()
    assert worst[0] < 1e-9 and worst[1] == n


def test_group_measures_over_all_pairs(spark):
    random.seed(6)
    rows = [(random.choice(["a", "b", None]), [random.gauss(0, 1) for _ in range(4)]) for _ in range(90)] + [("one", [1.0, 2.0]), ("none", [0.0, 0.0]), ("none", [0.0]), ("a", None), ("b", [])]
    df = spark.createDataFrame(rows, "k string, x array<double>").repartition(4)
    coherence = {r["k"]: r["coherence"] for r in G.coherence(df, ["k"], "x").collect()}
    for tile in (1024, 8):
        strength = {r["k"]: r["strength"] for r in G.interference(df, ["k"], "x", tile).collect()}
        for k in {r[0] for r in rows}:
            xs = [np.array(x) for n, x in rows if n == k and x is not None]
            pads = [np.pad(x, (0, 4 - len(x))) for x in xs]
            dots = [abs(float(x @ y)) for i, x in enumerate(pads) for y in pads[i + 1 :]]
            dots = [d for d in dots if d]
            assert strength[k] == pytest.approx(np.mean(dots) if dots else 0.0)
            p = [math.atan2(np.linalg.norm(x[1:]), x[0]) for x in xs if len(x)]
            pairs = [math.cos(u - v) for i, u in enumerate(p) for v in p[i + 1 :]]
            assert coherence[k] == pytest.approx(np.mean(pairs) if pairs else 1.0)
    assert G.interference(df.limit(0), ["k"], "x").count() == 0


def test_near_values(spark):
    random.seed(8)
    xs = [round(random.uniform(-5, 5), 2) for _ in range(300)] + [None, float("nan"), float("inf")]
    ks = [round(random.uniform(-5, 5), 1) for _ in range(20)] * 3 + [None, float("nan")]
    df, kept = spark.createDataFrame([(x, k % 2) for k, x in enumerate(xs)], "x double, g int"), spark.createDataFrame([(k, i % 2) for i, k in enumerate(ks)], "k double, g int")
    for tolerance in (0.0, 0.05, 0.3, 20.0):
        got = G.near_values(df.select("x"), "x", kept, "k", tolerance)
        want = [x for x in xs if x is not None and any(k is not None and abs(x - k) <= tolerance for k in ks)]
        assert sorted(r["x"] for r in got.collect()) == sorted(want)
    by = G.near_values(df, "x", kept, "k", 0.3, ["g"])
    assert by.count() == sum(x is not None and any(k is not None and i % 2 == j % 2 and abs(x - k) <= 0.3 for j, k in enumerate(ks)) for i, x in enumerate(xs))


def test_chunks_tell_what_failed(spark):
    def halves(frame):
        if (frame["id"] == 77).any():
            raise ValueError("not this one")
        if (frame["id"] == 5).any():
            return frame.rename(columns={"id": "other"})
        return frame[frame["id"] % 2 == 0].assign(y=frame["id"] / 2)[["id", "y"]]

    done = K.over_chunks(spark.range(0, 100, 1, 3), halves, "id long, y double", 10)
    failed = done.failed().collect()
    assert len(failed) == 2 and any("ValueError: not this one" in r["error"] for r in failed)
    told = done.chunks.agg(F.sum("n_rows"), F.sum("n_out")).first()
    assert told[0] == 100 and told[1] == done.rows.count() == sum((r["n_rows"] if r["error"] is None else 0) for r in done.chunks.collect()) // 2
    assert all(r["y"] == r["id"] / 2 for r in done.rows.collect())
    with pytest.raises(RuntimeError, match="2 chunks failed"):
        K.over_chunks(spark.range(0, 100, 1, 3), halves, "id long, y double", 10, most=1)
    assert K.over_chunks(spark.range(0), halves, "id long, y double").chunks.count() == 0


def test_curves_without_labels(spark):
    df = spark.createDataFrame([(None, 0.9), (1, 0.8), (0, 0.7), (1, 0.6), (1, None)], "y int, s double")
    assert X.average_precision(df, "y", "s").first()[0] == pytest.approx((1 + 2 / 3) / 2)
    assert X.precision_recall(df, "y", "s").count() == 3 and X.roc_auc(df, "y", "s").first()[0] == pytest.approx(0.5)
    assert max(r["recall"] for r in X.precision_recall(df, "y", "s").collect()) == 1


def test_slopes_keep_their_digits_along_a_series(spark):
    df = spark.range(0, 200_000, 1, 4).select(F.lit(1).alias("k"), "id", (F.lit(1000.0) + F.col("id") % 2 * 0).alias("x"))
    assert W.rolling(df, ["k"], ["id"], "x", 5).agg(F.max(F.abs("slope"))).first()[0] == 0


def test_null_and_empty_arrays(spark):
    from sparkloom.operators import layers as L
    from sparkloom.operators import signal as S

    df = spark.createDataFrame([(None,), ([],), ([1.0, None, 2.0],), ([3.0, -1.0, 2.0, 0.5],)], "x array<double>")
    x = F.col("x")
    measures = [S.rms(x), S.crest_factor(x), S.zero_crossings(x), S.binary_features(x)["density"], S.correlation(x, F.reverse(x)), V.mean(x), V.variance(x), S.phase_coherence(x, x), S.fft(x), S.fft(x, real=True), S.stft(x, 2, 1), S.mfcc(x, 8.0), S.magnitudes(x), H.delta_sigma(x)]
    rows = df.select(*[m.alias(f"m{k}") for k, m in enumerate(measures)]).collect()
    for k in range(len(measures) - 1):
        assert rows[0][k] is None and rows[1][k] is None, k
        assert rows[3][k] is not None, k
    assert rows[0][-1] is None and rows[1][-1] == [] and rows[2][-1] is None
    assert all(rows[2][k] is None for k in (0, 1, 4, 5, 6, 8, 9, 11))
    block = df.where(F.size("x") != 3).select(S.fft_nd(x, (2, 2)).alias("z"), L.layer_norm(x).alias("n")).collect()
    assert block[0]["z"] is None and block[0]["n"] == []  # a layer of nothing is nothing


def test_masked_attention_by_loops(spark):
    from sparkloom.operators import attention as A

    random.seed(11)
    rows = [(k, 3 * t % 50 - 20, [random.gauss(0, 1), random.gauss(0, 1)], [random.gauss(0, 1), random.gauss(0, 9)], [random.random(), float(t)], random.random() < 0.8) for k in ("a", None) for t in range(50)]
    rows.append(("alone", 5, [1.0, 1.0], None, [1.0, 2.0], True))
    df = spark.createDataFrame(rows, "k string, t int, q array<double>, w array<double>, v array<double>, known boolean").repartition(5)
    plain = lambda q, w: float(np.dot(q, w)) / math.sqrt(2)
    added = lambda q, w: 0.5 * math.tanh(q[0] + w[0]) - 2 * math.tanh(q[1] + w[1])
    for score, fn, width, ahead, block in ((plain, A.scaled, 8, 0, None), (added, A.additive([0.5, -2]), 5, 3, 2), (plain, A.scaled, 1000, 0, 7)):
        got = {(r["k"], r["t"]): r for r in A.masked(df, ["k"], "t", "q", "w", "v", width, fn, "known", ahead, block).collect()}
        assert len(got) == len(rows)
        for k, t, q, *_ in rows:
            near = [(score(q, w), v) for k2, u, _, w, v, known in rows if k2 == k and known and w is not None and t - width < u <= t + ahead]
            assert got[k, t]["n"] == len(near)
            if near:
                weights = np.exp(np.array([s for s, _ in near]) - max(s for s, _ in near))
                assert got[k, t]["attended"] == pytest.approx((weights @ np.array([v for _, v in near]) / weights.sum()).tolist())
            else:
                assert got[k, t]["attended"] is None


def test_zipped_csv_equals_plain_files(spark, tmp_path):
    import zipfile

    from sparkloom.sources import archives, io

    (tmp_path / "plain").mkdir()
    (tmp_path / "zips").mkdir()
    texts = [f"id,name,x\n{k},\"a, {k}\",{k / 4}\n{k + 10},,oops\n" for k in range(5)] + ["id,name,x\n"]
    for k, t in enumerate(texts):
        (tmp_path / "plain" / f"{k}.csv").write_text(t)
    for n, own in enumerate((texts[:4], texts[4:])):
        with zipfile.ZipFile(tmp_path / "zips" / f"{n}.zip", "w", zipfile.ZIP_DEFLATED) as z:
            z.writestr("read.me", "not a table")
            for k, t in enumerate(own):
                z.writestr(f"part/{k}.csv", t)
    schema = "id long, name string, x double"
    got = archives.load_zipped_csv(spark, str(tmp_path / "zips"), schema)
    want = io.load_csv(spark, str(tmp_path / "plain"), schema)
    assert got.rdd.getNumPartitions() == 6 and got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    one = archives.load_zipped_csv(spark, str(tmp_path / "zips" / "0.zip"))
    assert one.columns == ["id", "name", "x"] and one.count() == 8 and one.schema["x"].dataType.typeName() == "string"
