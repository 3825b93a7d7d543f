"""Queries of vectors, similarity, spectra, waves and streams."""

import math

from pyspark.sql import functions as F

from sparkloom.functions import vector as V
from sparkloom.operators import models as N
from sparkloom.operators import signal as S
from sparkloom.plans.base import named, query, r, table
from sparkloom.sources import shared
from sparkloom.streaming import series, stride

C = F.col


@query("""SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)), 6) AS energy, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))), 6) AS norm, round(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 5) AS norm1, round(list_max(list_transform(embedding, lambda x: abs(x::DOUBLE))), 6) AS norm_inf,
round(list_avg(list_transform(embedding, lambda x: x::DOUBLE)), 6) + 0.0 AS mean, round(list_var_pop(list_transform(embedding, lambda x: x::DOUBLE)), 6) AS var, (list_position(embedding, list_max(embedding)) - 1)::INT AS argmax, round(list_sum(list_transform(embedding[1:8], lambda x: x::DOUBLE)), 6) + 0.0 AS head FROM embeddings""")
def stats_axis1_array(spark, sf_dir):
    e = C("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", *named(energy=F.round(V.energy(e), 6), norm=F.round(V.norm(e), 6), norm1=F.round(V.norm(e, 1), 5), norm_inf=F.round(V.norm(e, math.inf), 6), mean=r(V.mean(e)), var=F.round(V.variance(e), 6), argmax=V.first_argmax(e), head=r(F.element_at(V.cumsum(F.slice(e, 1, 8)), -1))))


@query("SELECT vec_id, list_transform(embedding, lambda x: round(x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y))), 5) + 0.0) AS unit FROM embeddings")
def normalize_rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(V.normalize(C("embedding")), lambda x: r(x, 5)).alias("unit"))


_PAIR = "(SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def _pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    return e.select("vec_id", C("embedding").alias("x")).join(e.select((C("vec_id") - 1).alias("vec_id"), C("embedding").alias("y")), "vec_id")


@query(f"""SELECT vec_id, round(list_sum(list_transform(list_zip(x, y), lambda p: p[1]::DOUBLE * p[2])), 6) + 0.0 AS dot, round(sqrt(list_sum(list_transform(list_zip(x, y), lambda p: pow(p[1]::DOUBLE - p[2], 2)))), 6) AS euclidean,
round(list_sum(list_transform(list_zip(x, y), lambda p: p[1]::DOUBLE * p[2])) / (sqrt(list_sum(list_transform(x, lambda v: v::DOUBLE * v))) * sqrt(list_sum(list_transform(y, lambda v: v::DOUBLE * v))) + 1e-8), 6) + 0.0 AS cosine,
round(1 - list_sum(list_transform(list_zip(x, y), lambda p: abs(p[1]::DOUBLE - p[2]))) / len(x), 6) AS similarity FROM {_PAIR}""")
def vector_pairs(spark, sf_dir):
    x, y = C("x"), C("y")
    return _pairs(spark, sf_dir).select("vec_id", *named(dot=r(V.dot(x, y)), euclidean=F.round(V.euclidean_distance(x, y), 6), cosine=r(V.cosine_similarity(x, y)), similarity=F.round(V.pattern_similarity(x, y), 6)))


@query("""SELECT vec_id, list_transform(range(10), lambda i: (i = label)::INT::DOUBLE) AS hot, list_concat([0.0, 0.0], list_transform(embedding[1:3], lambda x: x::DOUBLE), [0.0]) AS padded, list_concat(embedding[1:2], embedding[1:2]) AS tiled, [embedding[3], embedding[1], embedding[-1]] AS taken, embedding[2:4] AS cut FROM embeddings""")
def array_reshaping(spark, sf_dir):
    e = C("embedding")
    return table(spark, sf_dir, "embeddings").select("vec_id", *named(hot=V.one_hot(C("label"), 10), padded=V.pad(F.slice(e, 1, 3), 2, 1), tiled=V.tile(F.slice(e, 1, 2), 2), taken=V.gather(e, F.array(F.lit(2), F.lit(0), F.lit(-1))), cut=F.slice(e, 2, 3)))


_RE = "list_sum(list_transform(range(64), lambda j: embedding[j + 1]::DOUBLE * cos(2 * pi() * ((k * j) % 64) / 64.0)))"
_IM = "-list_sum(list_transform(range(64), lambda j: embedding[j + 1]::DOUBLE * sin(2 * pi() * ((k * j) % 64) / 64.0)))"


@query(f"SELECT vec_id, list_transform(range(64), lambda k: round({_RE}, 6) + 0.0) AS re, list_transform(range(64), lambda k: round({_IM}, 6) + 0.0) AS im FROM embeddings")
def dft_native(spark, sf_dir):
    z = S.dft_rows(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 64)
    return z.select("vec_id", F.transform("z", lambda x: r(x["re"])).alias("re"), F.transform("z", lambda x: r(x["im"])).alias("im"))


@query(f"SELECT vec_id, list_transform(range(64), lambda k: round({_RE}, 6) + 0.0) AS re, true AS inverted FROM embeddings")
def fft_arrow(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", C("embedding").alias("x"), S.fft(C("embedding")).alias("z")).withColumn("back", S.fft(C("z"), inverse=True))
    same = F.forall(F.zip_with("x", "back", lambda a, b: F.abs(a - b["re"]) < 1e-9), lambda ok: ok)
    return df.select("vec_id", F.transform("z", lambda z: r(z["re"])).alias("re"), same.alias("inverted"))


_HALF = "list_transform(range(33), lambda k: [round({}, 6) + 0.0, round({}, 6) + 0.0])".format(_RE, _IM)
_GRID = "list_transform(range(64), lambda k: round(list_sum(list_transform(range(64), lambda j: embedding[j + 1]::DOUBLE * cos(2 * pi() * (((k // 8) * (j // 8) + (k % 8) * (j % 8)) % 8) / 8.0))), 6) + 0.0)"


@query(f"SELECT vec_id, {_HALF} AS half, true AS half_back, {_GRID} AS grid, true AS grid_back, 48 AS cube FROM embeddings")
def fft_other_forms(spark, sf_dir):
    """Real, inverse real and n-dimensional forms, over 64 values as a line, an 8 x 8 grid and a 4 x 4 x 4 cube (whose half spectrum has 48 values)."""
    x = C("embedding")
    df = table(spark, sf_dir, "embeddings").select("vec_id", x, S.fft(x, real=True).alias("half"), S.fft_nd(x, (8, 8)).alias("grid"), F.size(S.fft_nd(x, (4, 4, 4), real=True)).alias("cube"))
    back, grid_back = S.fft(C("half"), inverse=True, real=True), S.fft_nd(C("grid"), (8, 8), inverse=True)

    def same(y, part=lambda v: v):
        return F.forall(F.zip_with("embedding", y, lambda a, b: F.abs(a - part(b)) < 1e-9), lambda ok: ok)

    df = df.withColumns({"half_back": same(back), "grid_back": same(grid_back, lambda v: v["re"])})
    return df.select("vec_id", F.transform("half", lambda z: F.array(r(z["re"]), r(z["im"]))).alias("half"), "half_back", F.transform("grid", lambda z: r(z["re"])).alias("grid"), "grid_back", "cube")


@query(f"""WITH m AS (SELECT vec_id, embedding AS x, list_transform(range(33), lambda k: sqrt(pow({_RE}, 2) + pow({_IM}, 2))) AS m FROM embeddings),
c AS (SELECT *, list_sum(list_transform(range(33), lambda k: m[k + 1] * k * 100.0)) / list_sum(m) AS c, sqrt(list_avg(list_transform(x, lambda v: v::DOUBLE * v))) AS rms, list_max(list_transform(x, lambda v: abs(v::DOUBLE))) AS peak FROM m)
SELECT vec_id, round(c, 3) AS centroid, round(sqrt(list_sum(list_transform(range(33), lambda k: m[k + 1] * pow(k * 100.0 - c, 2))) / list_sum(m)), 3) AS bandwidth, (list_position(m, list_max(m)) - 1) * 100.0 AS dominant, len(list_filter(range(1, 34), lambda i: list_sum(m[1:i]) < 0.85 * list_sum(m))) * 100.0 AS rolloff, round(rms, 6) AS rms, round(peak, 6) AS peak, round(peak / rms, 5) AS crest,
list_sum(list_transform(range(1, 64), lambda i: ((x[i] >= 0) <> (x[i + 1] >= 0))::INT)) / 64.0 AS crossings FROM c""")
def spectral_features(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings").select("vec_id", C("embedding").alias("x")).withColumn("m", S.magnitudes(C("x")))
    x, m = C("x"), C("m")
    return df.select("vec_id", *named(centroid=F.round(S.spectral_centroid(m, 100.0), 3), bandwidth=F.round(S.spectral_bandwidth(m, 100.0), 3), dominant=S.dominant_frequency(m, 100.0), rolloff=S.spectral_rolloff(m, 100.0), rms=F.round(S.rms(x), 6), peak=F.round(S.peak(x), 6), crest=F.round(S.crest_factor(x), 5), crossings=S.zero_crossings(x)))


@query(f"""WITH b AS (SELECT vec_id, list_transform(x, lambda v: (v > 0)::INT) AS a, list_transform(y, lambda v: (v > 0)::INT) AS b FROM (SELECT a.vec_id, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1))
SELECT vec_id, list_transform(list_zip(a, b), lambda p: (p[1] <> p[2])::INT) AS x, list_transform(list_zip(a, b), lambda p: p[1] * p[2]) AS n, list_transform(list_zip(a, b), lambda p: greatest(p[1], p[2])) AS o, list_avg(a) AS density, list_sum(list_transform(range(1, 64), lambda i: abs(a[i] - a[i + 1])))::DOUBLE AS transitions,
1 - list_sum(list_transform(range(1, 65), lambda i: abs(a[i] - a[65 - i]))) / 64.0 AS symmetry, list_concat(a[62:64], a[1:61]) AS turned FROM b""")
def binary_wave_ops(spark, sf_dir):
    from sparkloom.functions.bits import rotate_elements

    e = _pairs(spark, sf_dir).select("vec_id", S.to_binary(C("x")).alias("a"), S.to_binary(C("y")).alias("b"))
    f = S.binary_features(C("a"))
    return e.select("vec_id", *named(x=S.binary_interference(C("a"), C("b")), n=S.binary_interference(C("a"), C("b"), "and"), o=S.binary_interference(C("a"), C("b"), "or"), density=f["density"], transitions=f["transitions"], symmetry=f["symmetry"], turned=rotate_elements(C("a"), 3)))


@query("""SELECT k AS i, round(2 * sin(2 * pi() * 5 * k / 100.0), 6) + 0.0 AS sine, CASE WHEN k * 5 / 100.0 - floor(k * 5 / 100.0) < 0.5 THEN 1.0 ELSE -1.0 END AS square, round(2 * (k * 5 / 100.0 - floor(k * 5 / 100.0) - 0.5), 6) + 0.0 AS sawtooth, round(2 * abs(2 * (k * 5 / 100.0 - floor(k * 5 / 100.0)) - 1) - 1, 6) + 0.0 AS triangle FROM range(200) AS t(k)""")
def synth_waves(spark, sf_dir):
    out = S.wave(spark, "sine", 5, 200, 100, 2.0).select("i", r(C("v")).alias("sine"))
    for kind in ("square", "sawtooth", "triangle"):
        out = out.join(S.wave(spark, kind, 5, 200, 100).select("i", r(C("v")).alias(kind)), "i")
    return out


@query("""WITH p AS (SELECT user_id, event_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b, max(value) OVER (PARTITION BY user_id) AS m FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)) SELECT user_id, event_id, value FROM p WHERE value > a AND value > b AND value > 0.5 * m""")
def find_peaks(spark, sf_dir):
    return S.peaks(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), ["user_id"], "event_id", "value", 0.5)


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(l_quantity / 32768, 8) AS f, least(greatest(round((l_quantity - 25) / 20 * 32768), -32768), 32767)::INT AS pcm, round(greatest(20 * log10(greatest(abs(l_discount), 1e-10)), -80), 6) AS db, round(greatest(10 * log10(greatest(l_tax, 1e-10)), -80), 6) AS power_db, round(pow(10, l_linenumber / 20.0), 6) AS amplitude FROM lineitem")
def pcm_conversions(spark, sf_dir):
    q = C("l_quantity")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *named(f=F.round(S.pcm_to_float(q), 8), pcm=S.float_to_pcm((q - 25) / 20), db=F.round(S.amplitude_to_db(C("l_discount")), 6), power_db=F.round(S.power_to_db(C("l_tax")), 6), amplitude=F.round(S.db_to_amplitude(C("l_linenumber")), 6)))


_FRAME = "list_sum(list_transform(range(16), lambda j: embedding[f * 8 + j + 1]::DOUBLE * (0.5 - 0.5 * cos(2 * pi() * j / 16.0)) * {}(2 * pi() * ((k * j) % 16) / 16.0)))"


@query(f"SELECT vec_id, list_transform(range(7), lambda f: list_transform(range(9), lambda k: round(sqrt(pow({_FRAME.format('cos')}, 2) + pow({_FRAME.format('sin')}, 2)), 5))) AS frames FROM embeddings")
def spectrogram(spark, sf_dir):
    frames = S.stft(C("embedding"), 16, 8)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(frames, lambda f: F.transform(f, lambda x: F.round(x, 5))).alias("frames"))


@query()
def cepstra(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", S.mfcc(C("embedding"), 8000, 5, 8).alias("mfcc"))


_AT = "(SELECT vec_id, list_transform(range(64), lambda k: atan2(round({im}, 9) + 0.0, {re})) AS p FROM embeddings)".format(re=_RE, im=_IM)


@query(f"""WITH a AS {_AT}, p AS (SELECT w.vec_id, x, y, a.p AS p, b.p AS q FROM {_PAIR} w JOIN a ON a.vec_id = w.vec_id JOIN a b ON b.vec_id = w.vec_id + 1),
d AS (SELECT *, list_transform(range(1, 65), lambda i: p[i] - q[i]) AS d, list_avg(list_transform(x, lambda v: v::DOUBLE)) AS mx, list_avg(list_transform(y, lambda v: v::DOUBLE)) AS my, list_transform(range(1, 65), lambda i: 0.7 * x[i]::DOUBLE + 0.3 * y[i]::DOUBLE) AS mixed,
  list_transform(range(4), lambda s: 1 - list_sum(list_transform(range(64), lambda i: abs((x[i + 1] > 0)::INT - (y[(i - s + 64) % 64 + 1] > 0)::INT))) / 64.0) AS likeness FROM p)
SELECT vec_id, round(sqrt(pow(list_avg(list_transform(d, lambda v: cos(v))), 2) + pow(list_avg(list_transform(d, lambda v: sin(v))), 2)), 6) AS coherence,
  round(list_avg(list_transform(range(1, 65), lambda i: (x[i] - mx) * (y[i] - my))) / sqrt(list_var_pop(list_transform(x, lambda v: v::DOUBLE)) * list_var_pop(list_transform(y, lambda v: v::DOUBLE))) * (1 - list_avg(list_transform(d, lambda v: abs(v))) / pi()), 6) + 0.0 AS strength,
  (list_position(likeness, list_max(likeness)) - 1)::INT AS shift, list_max(likeness) AS likeness, round(atan2(sqrt(list_sum(list_transform(x[2:64], lambda v: v::DOUBLE * v))), x[1]::DOUBLE), 6) AS angle,
  list_transform(mixed, lambda v: round(v / sqrt(list_sum(list_transform(mixed, lambda u: u * u))), 6) + 0.0) AS blend FROM d""")
def wave_pair_measures(spark, sf_dir):
    x, y = C("x"), C("y")
    shift = S.best_shift(S.to_binary(x), S.to_binary(y), 4)
    return _pairs(spark, sf_dir).select("vec_id", *named(coherence=F.round(S.phase_coherence(x, y), 6), strength=r(S.interference_strength(x, y)), shift=shift["shift"], likeness=shift["similarity"], angle=F.round(V.phase_angle(x), 6), blend=F.transform(V.partial_interference(x, y, 0.3), lambda v: r(v))))


@query(f"""WITH p AS (SELECT vec_id, x[1:16] AS q, [x[17:32], x[33:48], x[49:64]] AS ks, [y[1:32], y[33:64], x[1:32]] AS vs FROM {_PAIR}), e AS (SELECT *, list_transform(ks, lambda k: exp(list_sum(list_transform(list_zip(q, k), lambda p: p[1]::DOUBLE * p[2])) / 4)) AS e FROM p)
SELECT vec_id, list_transform(range(1, 33), lambda i: round((e[1] * vs[1][i]::DOUBLE + e[2] * vs[2][i]::DOUBLE + e[3] * vs[3][i]::DOUBLE) / list_sum(e), 6) + 0.0) AS attended FROM e""")
def attention_softmax(spark, sf_dir):
    """The first quarter of a vector asks the three others; values are the halves of the next vector and of its own."""
    x, y = "x", "y"
    out = N.attention(F.slice(x, 1, 16), F.array(*[F.slice(x, i, 16) for i in (17, 33, 49)]), F.array(F.slice(y, 1, 32), F.slice(y, 33, 32), F.slice(x, 1, 32)))
    return _pairs(spark, sf_dir).select("vec_id", F.transform(out, lambda v: r(v)).alias("attended"))


@query("""WITH s AS (SELECT user_id::VARCHAR AS key, row_number() OVER w - 1 AS start, list(value) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT key, stride, start, round(list_avg(x), 6) AS mean, round(list_sum(list_transform(x, lambda v: v * v)), 4) AS energy FROM s, (VALUES (1), (3)) AS t(stride) WHERE len(x) = 5 AND start % stride = 0""")
def stream_stride_state(spark, sf_dir):
    folder = shared.folder(spark, "stream")
    stream = stride.in_order(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "event_id", f"{folder}/events")
    out = stride.strided(stream, "user_id", "event_id", "value", 5, [1, 3])
    got = stride.drain(out, f"{folder}/windows", f"{folder}/state")
    return got.select("key", "stride", "start", F.round("mean", 6).alias("mean"), F.round("energy", 4).alias("energy"))


@query("""WITH s AS (SELECT user_id::VARCHAR AS key, row_number() OVER w - 1 AS start, list(value) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS x FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_id IS NOT NULL AND value IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT key, stride, start, round(list_avg(x), 6) AS mean, round(list_sum(list_transform(x, lambda v: v * v)), 4) AS energy FROM s, (VALUES (1), (3)) AS t(stride) WHERE len(x) = 5 AND start % stride = 0""")
def stream_late_windows(spark, sf_dir):
    """Events arrive up to six hours after their time, in an order dealt by a hash; a last row without a user moves the watermark past all."""
    folder, own = shared.folder(spark, "late"), series.stateful_session(spark)
    events = table(own, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    closing = own.range(1).select(F.lit(None).cast(events.schema["user_id"].dataType).alias("user_id"), F.lit("2100-01-01").cast(events.schema["ts"].dataType).alias("ts"), F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("double").alias("value"))
    moment = F.unix_micros(C("ts").cast("timestamp")) + F.pmod(F.xxhash64("event_id"), F.lit(6 * 3600 * 1_000_000))
    stream = stride.in_order(events.union(closing).withColumn("arrival", moment), "arrival", f"{folder}/events", several=8)
    out = series.late_windows(stream, "user_id", "ts", "event_id", "value", 5, [1, 3], late="6 hours")
    shape = stride.drain(out, f"{folder}/windows", f"{folder}/state").schema
    got = spark.read.schema(shape).parquet(f"{folder}/windows")
    return got.select("key", "stride", "start", F.round("mean", 6).alias("mean"), F.round("energy", 4).alias("energy"))
