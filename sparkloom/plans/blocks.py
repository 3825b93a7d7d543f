"""Queries of components, detectors, harmonics and blocks."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import blend as B
from sparkloom.operators import features as E
from sparkloom.operators import metrics as X
from sparkloom.operators import models as N
from sparkloom.operators import waves as H
from sparkloom.plans.base import named, query, r, table
from sparkloom.plans.signals import _IM, _PAIR, _RE, _pairs
from sparkloom.plans.tables import _S, _scored

C = F.col


def _series(spark, sf_dir):
    """Events of a user in order, with their place from 0 and a sample from -32768 to 32767."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", "value", (F.row_number().over(w) - 1).alias("i"), F.floor(F.least(C("value") * 600, F.lit(65535.0)) - 32768).cast("int").alias("pcm"))


_SERIES = "(SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i, floor(least(value * 600, 65535.0) - 32768)::INT AS pcm FROM events)"
_WINDOWS = f"(SELECT user_id, i AS start, [value, i % 7, lead(value) OVER w, lead(i % 7) OVER w, lead(value, 2) OVER w, lead(i % 7, 2) OVER w] AS x FROM {_SERIES} WINDOW w AS (PARTITION BY user_id ORDER BY event_id) QUALIFY lead(1, 2) OVER w = 1)"


@query(f"""WITH w AS (SELECT stride, x.* FROM {_WINDOWS} x, (VALUES (1), (3)) AS t(stride) WHERE start % stride = 0), m AS (SELECT stride, list_transform(range(1, 7), lambda k: 0.0) AS z, avg(x[1]) AS a, avg(x[2]) AS b, avg(x[3]) AS c, avg(x[4]) AS d, avg(x[5]) AS e, avg(x[6]) AS f FROM w GROUP BY stride)
SELECT stride, user_id, start, round(pow(x[1] - a, 2) + pow(x[2] - b, 2) + pow(x[3] - c, 2) + pow(x[4] - d, 2) + pow(x[5] - e, 2) + pow(x[6] - f, 2), 4) AS energy, true AS whole FROM w JOIN m USING (stride)""")
def pca_blend_energy(spark, sf_dir):
    """All components of each stride's windows: their squares add up to the distance from the mean."""
    ev, out = _series(spark, sf_dir).withColumn("turn", C("i") % 7), None
    blend = B.fit_blend(ev, ["user_id"], ["event_id"], ["value", "turn"], 3, [1, 3], 6)
    for stride in (1, 3):
        energy = sum((C(f"pca_{i}") * C(f"pca_{i}") for i in range(6)), F.lit(0.0))
        part = blend.transform(ev, stride).select(F.lit(stride).alias("stride"), "user_id", C("start").cast("long").alias("start"), F.round(energy, 4).alias("energy"), F.lit(abs(blend.explained(stride) - 1) < 1e-9).alias("whole"))
        out = part if out is None else out.union(part)
    return out


_SCALED = "SELECT c_custkey, c_nationkey, c_acctbal, avg(c_acctbal) OVER () AS ma, avg(c_nationkey) OVER () AS mb, sqrt(var_pop(c_acctbal) OVER ()) AS sa, sqrt(var_pop(c_nationkey) OVER ()) AS sb, corr(c_acctbal, c_nationkey) OVER () AS r FROM customer"


@query(f"SELECT c_custkey, round(abs((c_acctbal - ma) / sa + CASE WHEN r >= 0 THEN 1 ELSE -1 END * (c_nationkey - mb) / sb) / sqrt(2), 5) AS score, round((1 + abs(r)) / 2, 6) AS share FROM ({_SCALED})")
def pca_by_kind(spark, sf_dir):
    """The first component of the engineered numeric columns; of two standardised ones it is their sum or difference."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_nationkey", "c_mktsegment")
    rows, groups = B.engineered_by_kind(df, {"c_acctbal": "numeric", "c_nationkey": "numeric", "c_mktsegment": "categorical"})
    scores, models = B.pca_by_group(rows, groups, 1, ["c_custkey"])
    return scores.select("c_custkey", F.round(F.abs("numeric_pca_0"), 5).alias("score"), F.round(F.lit(float(models["numeric"].ratio[0])), 6).alias("share"))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, (l_discount - avg(l_discount) OVER ()) / sqrt(var_pop(l_discount) OVER ()) AS a, (l_tax - min(l_tax) OVER ()) / (max(l_tax) OVER () - min(l_tax) OVER ()) AS b FROM lineitem),
f AS (SELECT *, ln(1 + exp(0.5 * a + 0.2 * b)) + ln(1 + exp(0.3 - 0.3 * a + 0.8 * b)) + 0.1 * a - 0.2 * b AS score FROM s), m AS (SELECT avg(score) AS m, stddev_pop(score) AS d, quantile_cont(score, 0.9) AS t FROM f)
SELECT l_orderkey, l_linenumber, l_partkey, round(score, 6) AS score, score > t AS anomaly, round(1 / (1 + exp(-(score - m) / d)), 6) AS probability FROM f, m""")
def rbm_detector(spark, sf_dir):
    """Free-energy scores with given weights, a standardised and a min-max column; the threshold is the 90th percentile."""
    import numpy as np

    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax")
    mean, std, low, high = li.agg(F.avg("l_discount"), F.stddev_pop("l_discount"), F.min("l_tax"), F.max("l_tax")).first()
    m = N.RBM(["__x0", "__x1"], np.array([[0.5, -0.3], [0.2, 0.8]]), np.array([0.1, -0.2]), np.array([0.0, 0.3]))
    d = N.Detector(m, {"l_discount": (mean, std), "l_tax": (low, high - low)}, "free_energy", 0.0, 0.0, 1.0)
    scores = d.score(li).select("score")
    d.mean, d.std = scores.agg(F.avg("score"), F.stddev_pop("score")).first()
    d.threshold = E.quantiles(scores, "score", [0.9])[0]
    return d.detect(li).select("l_orderkey", "l_linenumber", "l_partkey", F.round("score", 6).alias("score"), "anomaly", F.round("probability", 6).alias("probability"))


_PWM = f"(SELECT *, CASE WHEN n < 8 THEN 0 WHEN i % 8 < floor(round_even(duty * 15, 0) / 15 * 8) THEN 32767 ELSE -32768 END AS pwm FROM (SELECT *, i // 8 AS b, (avg(pcm) OVER (PARTITION BY user_id, i // 8) + 32768) / 65536 AS duty, count(*) OVER (PARTITION BY user_id, i // 8) AS n FROM {_SERIES}))"


@query(f"SELECT user_id, event_id, pwm FROM {_PWM}")
def pulse_width(spark, sf_dir):
    return H.pulse_width(_series(spark, sf_dir), ["user_id"], "i", "pcm", 8, 16).select("user_id", "event_id", "pwm")


@query(f"WITH d AS (SELECT user_id, b, count(*) FILTER (WHERE pwm > 0) / 8.0 AS duty FROM {_PWM} WHERE n = 8 GROUP BY ALL) SELECT user_id, round(avg(duty), 6) AS mean, min(duty) AS low, max(duty) AS high, count(DISTINCT duty) AS levels, sum(trunc(duty * 65536 - 32768)::BIGINT)::BIGINT AS pcm FROM d GROUP BY user_id")
def pulse_measures(spark, sf_dir):
    rows = H.pulse_width(_series(spark, sf_dir), ["user_id"], "i", "pcm", 8, 16)
    back = H.duty_cycles(rows, ["user_id"], "i", "pwm", 8).groupBy("user_id").agg(F.sum(C("pcm").cast("long")).alias("pcm"))
    return H.pulse_measures(rows, ["user_id"], "i", "pwm", 8).withColumn("mean", F.round("mean", 6)).join(back, "user_id")


@query(f"WITH s AS (SELECT user_id, i // 16 AS block, value - 50 AS v, max(abs(value - 50)) OVER (PARTITION BY user_id, i // 16) / 127 AS scale FROM {_SERIES}), q AS (SELECT *, round_even(greatest(-127, least(127, v / scale)) + 128, 0) AS q FROM s) SELECT user_id, block, round(max(scale), 8) AS scale, round(avg(pow(v - (q - 128) * scale, 2)), 8) AS mse FROM q GROUP BY ALL")
def quantised_blocks(spark, sf_dir):
    rows = H.quantise_blocks(_series(spark, sf_dir).withColumn("v", C("value") - 50), ["user_id"], "i", "v", 16)
    return H.quantisation_error(rows, ["user_id"], "v").select("user_id", "block", F.round("scale", 8).alias("scale"), F.round("mse", 8).alias("mse"))


@query(f"""WITH s AS (SELECT *, count(*) OVER (PARTITION BY user_id) - i AS z FROM {_SERIES}) SELECT user_id, count(*) AS n, round(avg((value > 60)::INT), 6) AS active, round(avg(value), 9) AS mean, min(value) AS low, max(value) AS high, round(stddev_pop(value), 5) AS std, max(CASE WHEN z = 1 THEN value END) AS last,
CASE WHEN count(*) > 10 THEN round(avg(CASE WHEN z <= 5 THEN value END) - avg(CASE WHEN i < 5 THEN value END), 6) + 0.0 ELSE 0.0 END AS trend FROM s GROUP BY user_id""")
def activity_measures(spark, sf_dir):
    a = H.activity(table(spark, sf_dir, "events"), ["user_id"], ["event_id"], "value", 60.0)
    return a.select("user_id", "n", *named(active=F.round("active", 6), mean=F.round("mean", 9)), "low", "high", F.round("std", 5).alias("std"), "last", r(C("trend")).alias("trend"))


@query("SELECT k AS i, round(0.5 * sin(2 * pi() * 3 * k * (2.0 / 199)) - 0.25 * sin(2 * pi() * 7 * k * (2.0 / 199)) + 0.25 * sin(2 * pi() * 11 * k * (2.0 / 199) + 0.5), 6) + 0.0 AS v FROM range(200) AS t(k)")
def harmonic_synthesis(spark, sf_dir):
    return H.harmonic_wave([3, 7, 11], [2.0, -1.0, 1.0], 2.0, 100, spark, [0.0, 0.0, 0.5]).select("i", r(C("v")).alias("v"))


_HANN = "(0.5 - 0.5 * cos(2 * pi() * j / 64.0))"
_HRE, _HIM = (x.replace("embedding[j + 1]::DOUBLE", f"embedding[j + 1]::DOUBLE * {_HANN}") for x in (_RE, _IM))


@query(f"""WITH m AS (SELECT vec_id, list_transform(range(33), lambda k: sqrt(pow({_HRE}, 2) + pow({_HIM}, 2))) AS m FROM embeddings),
p AS (SELECT vec_id, m, list_filter(range(1, 32), lambda i: m[i + 1] > m[i] AND m[i + 1] > m[i + 2] AND m[i + 1] > 0.1 * list_max(m)) AS p FROM m)
SELECT vec_id, len(p)::INT AS n_peaks, list_sort(p) AS frequencies, round(list_sum(list_transform(p, lambda i: m[i + 1])) / list_max(m) / list_sum(m), 6) AS ratio FROM p""")
def harmonic_peaks(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", H.spectrum(C("embedding")).alias("m")).withColumn("p", H.harmonic_peaks(C("m"), 1.0))
    return df.select("vec_id", F.size("p").alias("n_peaks"), F.array_sort(F.transform("p", lambda p: p["frequency"])).alias("frequencies"), F.round(H.harmonic_ratio(C("m"), C("p")), 6).alias("ratio"))


@query("SELECT k // 12 AS i, k % 12 AS j, round(least(1, greatest(0, 0.6 * 0.5 * (sin(2 * pi() * 1 * (k // 12) * (2.0 / 11)) * sin(2 * pi() * 1 * (k % 12) * (2.0 / 11)) + 1) + 0.8 * 0.5 * (sin(2 * pi() * 3 * (k // 12) * (2.0 / 11)) * sin(2 * pi() * 3 * (k % 12) * (2.0 / 11)) + 1))), 6) AS v FROM range(144) AS t(k)")
def interference_grid(spark, sf_dir):
    return H.interference_grid(spark, [1, 3], [0.6, 0.8], 2.0, 12).withColumn("v", F.round("v", 6))


@query("""WITH c AS (SELECT r_name, unicode(substr(r_name, p::INT, 1)) AS code, p::INT - 1 AS place FROM region, unnest(range(1, length(r_name) + 1)) AS u(p))
SELECT r_name, place, t::INT AS slice, list_transform(range(16), lambda a: round(((code >> (15 - ((a // 4) * 4 + ((a % 4) - t + 4) % 4))) & 1) * (1 - t * 0.1), 6)) AS cells FROM c, range(3) AS s(t)""")
def text_waves(spark, sf_dir):
    w = table(spark, sf_dir, "region").select("r_name", F.posexplode(H.text_waves(C("r_name"), 3)).alias("place", "w"))
    return w.select("r_name", "place", F.posexplode("w").alias("slice", "cells")).withColumn("cells", F.transform("cells", lambda x: F.round(x, 6)))


_NORMED = "list_transform({0}, lambda v: v::DOUBLE / sqrt(list_sum(list_transform({0}, lambda u: u::DOUBLE * u))))"


@query(f"""WITH p AS (SELECT vec_id, {_NORMED.format("x")} AS a, {_NORMED.format("y")} AS b FROM {_PAIR}), s AS (SELECT vec_id, list_transform(range(4), lambda s: list_sum(list_transform(range(64), lambda i: a[(i - s + 64) % 64 + 1] * b[i + 1]))) AS s FROM p)
SELECT vec_id, round(list_max(s), 6) AS similarity, (list_position(s, list_max(s)) - 1)::INT AS shift FROM s""")
def pattern_match(spark, sf_dir):
    m = _pairs(spark, sf_dir).select("vec_id", H.match_pattern(C("x"), C("y"), 4).alias("m"))
    return m.select("vec_id", F.round("m.similarity", 6).alias("similarity"), "m.shift")


@query()
def sliding_interference(spark, sf_dir):
    return _pairs(spark, sf_dir).select("vec_id", H.sliding_interference(C("x"), C("y"), 16).alias("strength"), H.banded_coherence(C("x"), C("y"), 0.1, 0.3).alias("coherence"))


@query(_S + ", g AS (SELECT a.k AS y, b.k AS p FROM range(3) a(k), range(3) b(k)) SELECT g.y::INT AS y, g.p::INT AS p, count(s.quality) AS n FROM g LEFT JOIN s ON s.quality = g.y AND s.toxic = g.p GROUP BY ALL")
def confusion_full(spark, sf_dir):
    return X.confusion_matrix(_scored(spark, sf_dir), "quality", "toxic", 3)
