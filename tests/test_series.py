"""Series in event time: rows out of order, over batches, with expiry."""

from datetime import datetime, timedelta, timezone

from sparkloom.streaming import series, stride

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def _run(spark, tmp_path, rows, most, **more):
    """Windows of rows (arrival, key, second, value), read in the order of arrival in batches of about ``most``."""
    own = series.stateful_session(spark)
    shape = "arrival long, key string, time timestamp, at long, value double"
    df = own.createDataFrame([(a, k, None if s is None else T0 + timedelta(seconds=s), a, v) for a, k, s, v in rows], shape)
    stream = stride.in_order(df, "arrival", str(tmp_path / "in"), most=most)
    out = series.late_windows(stream, "key", "time", "at", "value", **more)
    got = stride.drain(out, str(tmp_path / "out"), str(tmp_path / "state"))
    return sorted((r["key"], r["stride"], r["start"], r["mean"], r["energy"]) for r in got.collect())


def test_rows_out_of_order(spark, tmp_path):
    """One key with most rows, times shuffled by up to ten seconds, several rows of one time: windows of the series in order."""
    rows = [(i, "a" if i % 5 else "b", (i // 10) * 10 + (i * 7) % 10 - (i % 2), float((i * 37) % 101)) for i in range(120)]
    rows += [(i, k, s, v) for i, (k, s, v) in enumerate([(None, 5000.0, 1.0), ("a", None, 1.0), ("b", 130.0, None)], 120)]
    want = []
    for key in "ab":
        x = [v for s, a, v in sorted((s, a, v) for a, k, s, v in rows if k == key and s is not None and v is not None)]
        want += [(key, s, i, sum(x[i : i + 4]) / 4, sum(v * v for v in x[i : i + 4])) for s in (1, 3) for i in range(0, len(x) - 3, s)]
    got = _run(spark, tmp_path, rows, 30, width=4, strides=[1, 3], late="20 seconds")
    assert len(list((tmp_path / "state" / "commits").glob("[0-9]*"))) >= 4 and got == sorted(want)


def test_idle_series_end(spark, tmp_path):
    """A gap as long as ``idle_ms`` ends a series: no window spans it, and places start again."""
    rows = [(i, "a", s, float(i)) for i, s in enumerate([0, 1, 2, 3, 100, 101, 102])] + [(7, None, 9000, 0.0)]
    got = _run(spark, tmp_path, rows, 3, width=3, strides=[1], idle_ms=50_000)
    assert [(s, m) for _, _, s, m, _ in got] == [(0, 1.0), (0, 5.0), (1, 2.0)]
    assert len(_run(spark, tmp_path / "whole", rows, 3, width=3, strides=[1])) == 5


def test_keys_share_the_state_of_a_shard(spark, tmp_path):
    """A thousand keys in one state, over batches: the windows of each."""
    rows = [(i, f"k{i % 1000}", (i * 7) % 97, float(i)) for i in range(4000)] + [(4000, None, 9000, 0.0)]
    got = _run(spark, tmp_path, rows, 1500, width=3, strides=[1], late="100 seconds", shards=1)
    want = []
    for k in range(1000):
        x = [v for _, v in sorted((s, v) for _, key, s, v in rows if key == f"k{k}")]
        want += [(f"k{k}", 1, i, sum(x[i : i + 3]) / 3, sum(v * v for v in x[i : i + 3])) for i in range(2)]
    assert got == sorted(want)


def test_a_stream_has_as_many_stores_as_tasks(spark, tmp_path):
    """A session of a hundred shuffle partitions: every batch would open and commit a hundred stores."""
    wide = spark.newSession()
    wide.conf.set("spark.sql.shuffle.partitions", "100")
    rows = [(i, f"k{i % 9}", i, float(i)) for i in range(90)] + [(90, None, 9000, 0.0)]
    got = _run(wide, tmp_path, rows, 50, width=10, strides=[1])
    assert sorted(got) == [(f"k{k}", 1, 0, k + 40.5, sum(float(k + 9 * i) ** 2 for i in range(10))) for k in range(9)]
    stores = len([p for p in (tmp_path / "state" / "state" / "0").iterdir() if p.name.isdigit()])
    assert stores == max(8, spark.sparkContext.defaultParallelism) and wide.conf.get("spark.sql.shuffle.partitions") == "100"


def test_batches_grow_with_their_number(spark, tmp_path):
    """Small tables in batches worth their cost, larger ones in several, the largest in batches of ``most``."""
    assert [stride.batches_of(n, 1 << 20, 8) for n in (0, 1, 100_001, 600_001, 6_000_001, 36_000_001)] == [1, 1, 2, 8, 8, 35]
    assert [stride.batches_of(n, 30, 1) for n in (0, 30, 31, 123)] == [1, 1, 2, 5]
    stride.in_order(spark.range(1 << 17), "id", str(tmp_path / "in"), several=8)
    assert len(list((tmp_path / "in").glob("part-*"))) == 2
