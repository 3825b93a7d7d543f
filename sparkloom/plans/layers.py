"""Queries of layers, training steps, geometry and pattern memory."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparkloom.operators import layers as L
from sparkloom.operators import models as N
from sparkloom.operators import signal as S
from sparkloom.plans.base import named, query, r, table
from sparkloom.plans.signals import _PAIR, _pairs

C = F.col


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(2 * (l_quantity - m) / sqrt(v + 1e-5) + 1, 6) + 0.0 AS l_quantity FROM lineitem, (SELECT avg(l_quantity) AS m, var_pop(l_quantity) AS v FROM lineitem)")
def batch_norm(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return L.batch_norm(li, ["l_quantity"], 2.0, 1.0).withColumn("l_quantity", r(C("l_quantity")))


@query("SELECT vec_id, list_transform(e, lambda x: round((x - list_avg(e)) / sqrt(list_var_pop(e) + 1e-5), 5) + 0.0) AS y FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)")
def layer_norm(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(L.layer_norm(C("embedding")), lambda x: r(x, 5)).alias("y"))


@query("SELECT o_orderkey, CASE WHEN ('0x' || substr(md5(o_orderkey || ':3'), 1, 13))::BIGINT / 4503599627370496.0 < 0.25 THEN 0.0 ELSE round(o_totalprice / 0.75, 4) END AS kept FROM orders")
def dropout(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(L.dropout(C("o_totalprice"), C("o_orderkey"), 0.25, 3), 4).alias("kept"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, round(0.5 * l_discount + 0.2 * l_tax + 0.1, 8) AS y_0, round(-0.3 * l_discount + 0.8 * l_tax, 8) + 0.0 AS y_1 FROM lineitem")
def dense_layer(spark, sf_dir):
    out = N.dense(["l_discount", "l_tax"], np.array([[0.5, -0.3], [0.2, 0.8]]), np.array([0.1, 0.0]))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *[r(e, 8).alias(n) for n, e in out.items()])


@query("SELECT n_nationkey, [round(sin(n_nationkey), 6) + 0.0, round(cos(n_nationkey), 6), round(sin(n_nationkey / 100.0), 6) + 0.0, round(cos(n_nationkey / 100.0), 6)] AS code FROM nation")
def positional_encoding(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.transform(L.positional_encoding(C("n_nationkey"), 4), lambda x: r(x)).alias("code"))


@query("""WITH w AS (SELECT event_id, value AS q, list(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS p FROM events)
SELECT event_id, round(list_sum(list_transform(p, lambda x: exp(-abs(x / 50 - q / 50)) * x)) / list_sum(list_transform(p, lambda x: exp(-abs(x / 50 - q / 50)))), 5) AS attended FROM w""")
def causal_attention(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (C("value") / 50).alias("q"))
    return L.causal_attention(ev, ["user_id"], ["event_id"], "q", "value", 4).select("event_id", F.round("attended", 5).alias("attended"))


@query("""WITH w AS (SELECT event_id, value / 50 AS q, list({'k': value / 25, 'v': value, 'e': -abs(coalesce(before, 0) - value)}) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) AS p FROM (SELECT *, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events)),
s AS (SELECT event_id, p, list_transform(p, lambda x: q * x.k * exp(x.e) / list_sum(list_transform(p, lambda y: exp(y.e)))) AS s FROM w)
SELECT event_id, round(list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i].v * exp(s[i]))) / list_sum(list_transform(s, lambda x: exp(x))), 5) AS attended FROM s""")
def prediction_attention(spark, sf_dir):
    """A row's prediction is the value before it; rows that were foreseen count more."""
    ev = table(spark, sf_dir, "events").select("user_id", "event_id", "value", (C("value") / 50).alias("q"), (C("value") / 25).alias("k"))
    ev = ev.withColumn("said", F.coalesce(F.lag("value").over(Window.partitionBy("user_id").orderBy("event_id")), F.lit(0.0)))
    return L.prediction_attention(ev, ["user_id"], ["event_id"], "q", "k", "value", "said", 4).select("event_id", F.round("attended", 5).alias("attended"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS x, '{b}' AS y, round(0.01 * avg({a} * {b}), 8) AS w FROM lineitem" for a in ("l_discount", "l_tax") for b in ("l_quantity", "l_tax")))
def hebbian_update(spark, sf_dir):
    return L.hebbian(table(spark, sf_dir, "lineitem"), ["l_discount", "l_tax"], ["l_quantity", "l_tax"]).withColumn("w", F.round("w", 8))


@query()
def logistic_training(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select((C("l_quantity") / 50).alias("q"), C("l_discount").alias("d"), (C("l_extendedprice") > 40000).cast("int").alias("y"))
    w = L.train_logistic(li, ["q", "d"], "y", L.Optimizer("adam", 0.5), 5)
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(w)], "i int, w double")


_D = "list_sum(list_transform(list_zip(x, y), lambda p: p[1]::DOUBLE * p[2]))"


@query(f"""SELECT vec_id, round(sqrt(list_sum(list_transform(range(1, 65), lambda i: pow(acos(d) * (y[i]::DOUBLE - d * x[i]) / sqrt(1 - d * d), 2)))), 4) AS length FROM (SELECT vec_id, x, y, {_D} AS d FROM (SELECT vec_id, list_transform(x, lambda v: v::DOUBLE / sqrt(list_sum(list_transform(x, lambda w: w::DOUBLE * w)))) AS x, list_transform(y, lambda v: v::DOUBLE / sqrt(list_sum(list_transform(y, lambda w: w::DOUBLE * w)))) AS y FROM {_PAIR}))""")
def sphere_log_map(spark, sf_dir):
    from sparkloom.functions.vector import norm

    p = _pairs(spark, sf_dir).select("vec_id", L.to_sphere(C("x")).alias("x"), L.to_sphere(C("y")).alias("y"))
    return p.select("vec_id", F.round(norm(L.log_map(C("x"), C("y"))), 4).alias("length"))


@query(f"""SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: pow(x[i]::DOUBLE + y[i], 2))) / e, 6) AS constructive, round(list_sum(list_transform(range(1, 65), lambda i: pow(x[i]::DOUBLE - y[i], 2))) / e, 6) AS destructive, round(list_sum(list_transform(range(1, 65), lambda i: pow(x[i]::DOUBLE * y[i], 2))) / e, 6) AS multiplicative
FROM (SELECT *, list_sum(list_transform(range(1, 65), lambda i: x[i]::DOUBLE * x[i] + y[i]::DOUBLE * y[i])) AS e FROM {_PAIR})""")
def interference_parts(spark, sf_dir):
    z = L.detect_interference(C("x"), C("y"))
    return _pairs(spark, sf_dir).select("vec_id", *[F.round(z[k], 6).alias(k) for k in ("constructive", "destructive", "multiplicative")])


@query("SELECT vec_id, list_transform(range(4), lambda s: round(list_sum(list_transform(range(64), lambda i: embedding[i + 1]::DOUBLE * embedding[(i - s + 64) % 64 + 1])) / 64, 7) + 0.0) AS resonance FROM embeddings")
def wave_resonance(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(L.resonance(C("embedding"), 4), lambda x: r(x, 7)).alias("resonance"))


@query("""WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: (x > 0)::INT) AS p FROM embeddings) SELECT a.vec_id AS query_id, b.vec_id AS pattern_id, round(1 - list_sum(list_transform(range(1, 65), lambda i: abs(a.p[i] - b.p[i]))) / 64.0, 6) AS similarity FROM b a, b WHERE a.vec_id % 10 = 0
AND list_sum(list_transform(range(1, 65), lambda i: abs(a.p[i] - b.p[i]))) <= 19""")
def pattern_retrieval(spark, sf_dir):
    """Every tenth vector's signs against all: at most 19 of 64 differ, a likeness of 0.7."""
    bits = table(spark, sf_dir, "embeddings").select("vec_id", S.to_binary(C("embedding")).alias("pattern"))
    asked = bits.where("vec_id % 10 = 0").withColumnRenamed("vec_id", "query_id")
    return L.recall_patterns(bits.withColumnRenamed("vec_id", "pattern_id"), asked, 0.7).withColumn("similarity", F.round("similarity", 6))


_CELLS = np.array([[((7 * i + 5 * c) % 13 - 6) / 7 for c in range(16)] for i in range(3)])
_NET = L.WaveNetwork(["x0", "x1"], np.array([[0.9, -0.4, 0.3], [0.2, 0.7, -0.8]]), _CELLS, np.array([[0.5], [-0.25], [1.0]]), 0b1011011101101101, 0b1101111011010110)
_WAVE = " + ".join(f"CASE WHEN {a!r} * x0 + {b!r} * x1 > 0.5 THEN {1 << c} ELSE 0 END" for c, (a, b) in enumerate((_NET.inward @ _CELLS).T.tolist()))
_OUT = (_NET.inward @ _NET.outward)[:, 0].tolist()


@query(f"""WITH x AS (SELECT event_id, user_id, ln(1 + value) AS x0, (event_id % 11) / 5 AS x1 FROM events),
w AS (SELECT *, ({_WAVE})::BIGINT AS wave FROM x)
SELECT event_id, wave, round({_OUT[0]!r} * x0 + {_OUT[1]!r} * x1, 6) + 0.0 AS y_0,
first_value(wave) OVER s | bit_or(wave & {_NET.memory_gate & _NET.update_gate}) OVER s AS memory FROM w WINDOW s AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def wave_network(spark, sf_dir):
    """What the events of a user leave in a memory of 16 cells."""
    df = table(spark, sf_dir, "events").select("event_id", "user_id", F.ln(1 + C("value")).alias("x0"), (C("event_id") % 11 / 5).alias("x1"))
    return _NET.forward(df, ["user_id"], ["event_id"]).select("event_id", "wave", r(C("y_0")).alias("y_0"), "memory")
