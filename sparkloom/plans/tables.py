"""Queries of statistics, features, windows, metrics and models on tables."""

import math

import numpy as np
from pyspark.sql import functions as F

from sparkloom.functions import ieee as M
from sparkloom.operators import features as E
from sparkloom.operators import linalg as LA
from sparkloom.operators import metrics as X
from sparkloom.operators import models as N
from sparkloom.operators import tensor as T
from sparkloom.operators import windows as W
from sparkloom.plans.base import named, query, r, table
from sparkloom.sources import io

C = F.col


@query("""WITH a AS (SELECT l_returnflag, coalesce(l_extendedprice, (SELECT median(l_extendedprice) FROM lineitem)) AS x FROM lineitem),
q AS (SELECT quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3 FROM a), b AS (SELECT l_returnflag, least(greatest(x, q1 - 1.5 * (q3 - q1)), q3 + 1.5 * (q3 - q1)) AS x FROM a, q),
p AS (SELECT quantile_cont(x, 0.05) AS lo, quantile_cont(x, 0.95) AS hi FROM b)
SELECT l_returnflag, count(*) AS n, round(avg(least(greatest((x - lo) / greatest(hi - lo, 1e-8), 0), 1)), 6) AS mean, round(stddev_pop(least(greatest((x - lo) / greatest(hi - lo, 1e-8), 0), 1)), 6) AS std FROM b, p GROUP BY l_returnflag""")
def robust_numeric_features(spark, sf_dir):
    x = C("l_extendedprice_scaled")
    df = E.robust_numeric(table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice"), ["l_extendedprice"])
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 100 OFFSET 20")
def scan_limit_filter(spark, sf_dir):
    return io.scan(table(spark, sf_dir, "orders"), ["o_orderkey", "o_totalprice"], "o_orderstatus = 'F'", 100, 20, ["o_orderkey"])


@query("SELECT event_id, (props::JSON->>'k')::BIGINT AS props_k FROM events")
def struct_flatten_json(spark, sf_dir):
    return io.json_fields(table(spark, sf_dir, "events").select("event_id", "props"), "props", "k long").select("event_id", "props_k")


@query("SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10")
def warehouse_sql(spark, sf_dir):
    return io.query(spark, "SELECT o_orderpriority, count(*) AS n FROM {orders} GROUP BY 1 ORDER BY n DESC, 1 LIMIT 10", orders=table(spark, sf_dir, "orders"))


@query("""SELECT l_returnflag, round(avg(l_quantity), 6) AS mean, round(var_pop(l_quantity), 6) AS var, round(stddev_pop(l_quantity), 6) AS std, round(var_samp(l_quantity), 6) AS var1, round(stddev_samp(l_quantity), 6) AS std1, sum(l_quantity) AS total, min(l_quantity) AS low, max(l_quantity) AS high,
median(l_quantity) AS median, round(quantile_cont(l_extendedprice, 0.9), 6) AS p90 FROM lineitem GROUP BY l_returnflag""")
def stats_axis0(spark, sf_dir):
    q, li = C("l_quantity"), table(spark, sf_dir, "lineitem")
    moments = li.groupBy("l_returnflag").agg(*named(mean=F.round(F.avg(q), 6), var=F.round(F.var_pop(q), 6), std=F.round(F.stddev_pop(q), 6), var1=F.round(F.var_samp(q), 6), std1=F.round(F.stddev_samp(q), 6), total=F.sum(q), low=M.agg_min(q), high=M.agg_max(q)))
    places = E.grouped_quantiles(li, ["l_returnflag"], {"median": ("l_quantity", 0.5), "p90": ("l_extendedprice", 0.9)})
    return moments.join(places.withColumn("p90", F.round("p90", 6)), "l_returnflag")


@query("""WITH s AS (SELECT user_id, ts, event_id, value, row_number() OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT event_id, round(avg(value) OVER f, 6) AS mean, round(stddev_pop(value) OVER f, 5) AS std, min(value) OVER f AS low, max(value) OVER f AS high, round((sum(value * n) OVER f - sum(value) OVER f * (n - 2)) / 10, 6) AS slope FROM s
WINDOW f AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) QUALIFY n >= 5 AND (n - 5) % 2 = 0""")
def rolling_stats_slope(spark, sf_dir):
    ev = table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return W.rolling(ev, ["user_id"], ["ts", "event_id"], "value", 5, 2).select("event_id", F.round("mean", 6).alias("mean"), F.round("std", 5).alias("std"), C("min").alias("low"), C("max").alias("high"), F.round("slope", 6).alias("slope"))


@query("""WITH s AS (SELECT user_id, row_number() OVER w - 1 AS start, list(value) OVER (w ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING) AS x FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))
SELECT user_id, stride, start, round(list_sum(x), 6) AS total FROM s, (VALUES (1), (3), (5)) AS t(stride) WHERE len(x) = 5 AND start % stride = 0""")
def strided_windows(spark, sf_dir):
    out = W.strided(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 5, [1, 3, 5])
    return out.select("user_id", "stride", C("start").cast("long").alias("start"), F.round(F.aggregate("window", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


@query("""SELECT event_id, round(CASE WHEN a IS NULL THEN b - value WHEN b IS NULL THEN value - a ELSE (b - a) / 2 END, 6) AS gradient, round(s, 4) AS cumsum FROM (SELECT event_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b, sum(value) OVER (w ROWS UNBOUNDED PRECEDING) AS s FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def gradient_cumsum(spark, sf_dir):
    key, order = ["user_id"], ["ts", "event_id"]
    df = W.cumulative(W.gradient(table(spark, sf_dir, "events"), key, order, "value"), key, order, "value")
    return df.select("event_id", F.round("gradient", 6).alias("gradient"), F.round("cumsum", 4).alias("cumsum"))


@query("""SELECT event_id, round(CASE WHEN a IS NULL THEN coalesce((4 * b - 3 * value - b2) / 2, b - value) WHEN b IS NULL THEN coalesce((3 * value - 4 * a + a2) / 2, value - a) ELSE (b - a) / 2 END, 6) AS gradient
FROM (SELECT event_id, value, lag(value) OVER w AS a, lead(value) OVER w AS b, lag(value, 2) OVER w AS a2, lead(value, 2) OVER w AS b2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))""")
def gradient_second_order_edges(spark, sf_dir):
    df = W.gradient(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 2)
    return df.select("event_id", F.round("gradient", 6).alias("gradient"))


@query("""WITH b AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) // 10 AS b, value FROM events), e AS (SELECT user_id, b, sum(value * value) AS e FROM b GROUP BY ALL HAVING count(*) = 10),
g AS (SELECT user_id, avg(e) AS m, var_pop(e) AS v, count(*) AS k FROM e GROUP BY user_id) SELECT u.user_id, round(CASE WHEN coalesce(k, 0) < 2 OR m = 0 THEN 1.0 ELSE 1 / (1 + v / m) END, 6) AS stability FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN g USING (user_id)""")
def energy_stability(spark, sf_dir):
    out = W.energy_stability(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "value", 10)
    return out.select("user_id", F.round("stability", 6).alias("stability"))


@query("""WITH e AS (SELECT *, CASE WHEN value > 80 THEN 'critical' WHEN value > 50 THEN 'high' ELSE 'low' END AS sev FROM events),
w AS (SELECT event_id, count(*) OVER f AS n, count(*) FILTER (WHERE sev = 'critical') OVER f AS c, count(*) FILTER (WHERE sev = 'high') OVER f AS h, len(list_distinct(list(event_type) OVER f)) < 10 AS rep, len(list_distinct(list(user_id % 3) OVER f)) = 1 AS alone
FROM e WINDOW f AS (PARTITION BY user_id % 7 ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)) SELECT event_id, (c >= 2 OR (c >= 1 AND rep) OR (alone AND h >= 3 AND rep))::INT AS label FROM w WHERE n = 10""")
def sliding_label_rules(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumns({"sev": F.when(C("value") > 80, "critical").when(C("value") > 50, "high").otherwise("low"), "g": C("user_id") % 7, "place": C("user_id") % 3})
    return W.incident_labels(ev, ["g"], ["ts", "event_id"], "sev", "event_type", "place").select("event_id", "label")


@query("""SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / sqrt((SELECT var_pop(c_acctbal) FROM customer)), 6) + 0.0 AS standard, round((c_acctbal - (SELECT min(c_acctbal) FROM customer)) / ((SELECT max(c_acctbal) - min(c_acctbal) FROM customer)), 6) AS minmax,
(c_mktsegment = 'BUILDING')::DOUBLE AS c_mktsegment_BUILDING, (c_mktsegment = 'MACHINERY')::DOUBLE AS c_mktsegment_MACHINERY, (SELECT count(DISTINCT c_mktsegment) FROM customer c2 WHERE c2.c_mktsegment < customer.c_mktsegment)::INT AS ordinal,
(('0x' || substr(md5(c_mktsegment || '42'), 1, 7))::BIGINT % 10000) / 10000.0 AS hash_0, (('0x' || substr(md5(c_mktsegment || '43'), 1, 7))::BIGINT % 10000) / 10000.0 AS hash_1 FROM customer""")
def encode_scale(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    mean, std = E.fit_standard(df, ["c_acctbal"])["c_acctbal"]
    low, high = df.agg(F.min("c_acctbal"), F.max("c_acctbal")).first()
    values = E.categories(df, "c_mktsegment")
    hot = E.one_hot_exprs("c_mktsegment", values)
    return df.select("c_custkey", r(E.standard_expr(C("c_acctbal"), mean, std)).alias("standard"), F.round(E.minmax_expr(C("c_acctbal"), low, high), 6).alias("minmax"), *[hot[k].alias(k) for k in ("c_mktsegment_BUILDING", "c_mktsegment_MACHINERY")], E.ordinal_expr("c_mktsegment", values).alias("ordinal"), *[E.hash_expr("c_mktsegment", j).alias(f"hash_{j}") for j in (0, 1)])


@query("""SELECT c_custkey, round((m * n + g * 10) / (n + 10), 6) AS c_mktsegment_target FROM customer JOIN (SELECT c_mktsegment, avg(c_acctbal) AS m, count(*) AS n FROM customer GROUP BY 1) USING (c_mktsegment), (SELECT avg(c_acctbal) AS g FROM customer)""")
def target_encode_smoothed(spark, sf_dir):
    return E.target_encode(table(spark, sf_dir, "customer"), "c_mktsegment", "c_acctbal").select("c_custkey", F.round("c_mktsegment_target", 6).alias("c_mktsegment_target"))


_CYC = ", ".join(f"round({fn}(2 * pi() * {e}), 6) + 0.0 AS ts_{fn}_{k}" for k, e in (("hour", "hour(ts) / 23.0"), ("dayofweek", "(isodow(ts) - 1) / 6.0"), ("day", "(day(ts) - 1) / 30.0"), ("month", "(month(ts) - 1) / 11.0")) for fn in ("sin", "cos"))


@query(f"SELECT event_id, {_CYC}, year(ts)::INT AS ts_year, month(ts)::INT AS ts_month, day(ts)::INT AS ts_day, (isodow(ts) - 1)::INT AS ts_dayofweek, hour(ts)::INT AS ts_hour, minute(ts)::INT AS ts_minute, quarter(ts)::INT AS ts_quarter, floor(epoch(ts))::BIGINT AS ts_epoch FROM events")
def datetime_features(spark, sf_dir):
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", *[r(e).alias(n) for n, e in E.cyclical_exprs("ts").items()], *[e.alias(n) for n, e in E.component_exprs("ts").items()])


@query("""SELECT doc_id, length(t)::DOUBLE AS text_length, n::DOUBLE AS text_word_count, round(length(t) / (n + 1), 6) AS text_avg_word_length, round(length(regexp_replace(t, '[^A-Z]', '', 'g')) / (length(t) + 1), 6) AS text_upper_ratio,
round(length(regexp_replace(t, '[^0-9]', '', 'g')) / (length(t) + 1), 6) AS text_digit_ratio, round(length(regexp_replace(t, '[a-zA-Z0-9 \\t\\n\\r]', '', 'g')) / (length(t) + 1), 6) AS text_special_ratio FROM (SELECT doc_id, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS n FROM documents)""")
def text_basic(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", *[F.round(e, 6).alias(n) for n, e in E.text_exprs("text").items()])


@query("""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{2,}')) AS t FROM documents) SELECT t AS term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM w GROUP BY t ORDER BY tf DESC, t LIMIT 50""")
def text_vocabulary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    terms = docs.select("doc_id", F.explode(E._terms("text")).alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    return terms.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df")).orderBy(F.desc("tf"), "term").limit(50)


@query("""WITH c AS (SELECT doc_id, t AS term, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]{2,}')) AS t FROM documents) GROUP BY ALL), top AS (SELECT term, sum(n) AS tf, count(*) AS df FROM c GROUP BY term ORDER BY tf DESC, term LIMIT 20),
w AS (SELECT doc_id, term, n * (ln((1 + (SELECT count(*) FROM documents)) / (1.0 + df)) + 1) AS w FROM c JOIN top USING (term)) SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def text_tfidf(spark, sf_dir):
    return E.tfidf(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", 20).withColumn("weight", F.round("weight", 6))


@query("SELECT o_orderkey, CASE WHEN epoch_us(o_orderdate) <= a THEN 'train' WHEN epoch_us(o_orderdate) <= b THEN 'validation' ELSE 'test' END AS split FROM orders, (SELECT quantile_cont(epoch_us(o_orderdate)::DOUBLE, 0.8) AS a, quantile_cont(epoch_us(o_orderdate)::DOUBLE, 0.9) AS b FROM orders)")
def temporal_split(spark, sf_dir):
    return E.temporal_split(table(spark, sf_dir, "orders"), "o_orderdate").select("o_orderkey", "split")


@query("SELECT o_orderkey, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END AS split FROM (SELECT o_orderkey, ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 7))::BIGINT % 100 AS b FROM orders)")
def hash_split(spark, sf_dir):
    return E.hash_split(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", "split")


@query("""SELECT 'c_custkey' AS "column", 'bigint' AS type, avg((c_custkey IS NULL)::INT) AS null_ratio, count(DISTINCT c_custkey) AS n_distinct, NULL::DOUBLE AS avg_length, NULL::DOUBLE AS avg_words FROM customer UNION ALL SELECT 'c_mktsegment', 'string', avg((c_mktsegment IS NULL)::INT), count(DISTINCT c_mktsegment), avg(length(c_mktsegment)), 1.0 FROM customer
UNION ALL SELECT 'c_acctbal', 'double', avg((c_acctbal IS NULL)::INT), count(DISTINCT c_acctbal), NULL, NULL FROM customer""")
def profile_columns(spark, sf_dir):
    return E.profile(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"))


@query("SELECT * FROM (VALUES ('c_custkey', 'numeric'), ('c_name', 'text'), ('c_nationkey', 'numeric'), ('c_acctbal', 'numeric'), ('c_mktsegment', 'categorical')) AS t(name, kind)")
def type_detect(spark, sf_dir):
    return spark.createDataFrame(list(E.detect_types(table(spark, sf_dir, "customer")).items()), "name string, kind string")


@query("SELECT column_name AS \"column\", kind, strategy FROM (VALUES ('event_id', 'numeric', 'robust_scaling'), ('user_id', 'numeric', 'robust_scaling'), ('ts', 'datetime', 'cyclical_encoding'), ('value', 'numeric', 'robust_scaling')) AS t(column_name, kind, strategy)")
def type_decisions(spark, sf_dir):
    return E.type_table(table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "value")).select("column", "kind", "strategy")


_CUSTOMER = "SELECT *, avg(c_acctbal) OVER () AS ma, sqrt(var_pop(c_acctbal) OVER ()) AS sa FROM customer"
_HOT = ", ".join(f"(c_mktsegment = '{v}')::DOUBLE AS c_mktsegment_{v}" for v in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))
_HASHED = ", ".join(f"(('0x' || substr(md5(c_name || '{42 + j}'), 1, 7))::BIGINT % 10000) / 10000.0 AS c_name_hash_{j}" for j in range(16))


@query(f"SELECT c_custkey, round((c_acctbal - ma) / sa, 6) + 0.0 AS c_acctbal_scaled, {_HOT}, 0.0 AS c_mktsegment_MISSING, {_HASHED} FROM ({_CUSTOMER})")
def engineered(spark, sf_dir):
    """Scaled numbers, one-hot categories with one for null, and hashes of a column with too many values."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_mktsegment", "c_name")
    out = E.fit_extractor(df, {"c_acctbal": "numeric", "c_mktsegment": "categorical", "c_name": "categorical"}, missing=True).transform(df)
    return out.withColumn("c_acctbal_scaled", r(C("c_acctbal_scaled")))


@query("""WITH s AS (SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'validation' ELSE 'test' END AS split FROM (SELECT *, ('0x' || substr(md5(o_orderkey::VARCHAR), 1, 7))::BIGINT % 100 AS b FROM orders)),
m AS (SELECT avg(o_totalprice) AS m, avg(o_custkey) AS c, sqrt(var_pop(o_custkey)) AS d FROM s WHERE split = 'train'), p AS (SELECT o_orderpriority, avg(o_totalprice) AS v, count(*) AS n FROM s WHERE split = 'train' GROUP BY 1)
SELECT o_orderkey, o_totalprice, split, round((o_custkey - c) / d, 6) + 0.0 AS o_custkey_scaled, round((v * n + m * 10) / (n + 10), 4) AS o_orderpriority_target FROM s JOIN p USING (o_orderpriority), m""")
def prepared(spark, sf_dir):
    """From a table to split features: a dropped column, one of nulls alone, a forced category coded by the target of the training rows."""
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority", C("o_orderstatus").alias("unused"), F.lit(None).cast("double").alias("empty"))
    out, _ = E.prepare(df, "o_orderkey", {"o_custkey": "numeric", "o_orderpriority": "text", "empty": "numeric", "unused": "categorical"}, "o_totalprice", ("o_orderpriority",), ("unused",))
    return out.withColumn("o_custkey_scaled", r(C("o_custkey_scaled"))).withColumn("o_orderpriority_target", F.round("o_orderpriority_target", 4))


@query("""WITH s AS (SELECT l_quantity, l_extendedprice, row_number() OVER (ORDER BY l_extendedprice) - 1 AS k, count(*) OVER () AS n FROM lineitem), q AS (SELECT max(CASE WHEN k = n // 4 THEN l_extendedprice END) AS a, max(CASE WHEN k = 3 * n // 4 THEN l_extendedprice END) AS b FROM s)
SELECT round(a - 1.5 * (b - a), 4) AS low, round(b + 1.5 * (b - a), 4) AS high FROM q""")
def order_stat_outliers(spark, sf_dir):
    low, high = E.fit_order_iqr(table(spark, sf_dir, "lineitem"), "l_extendedprice")
    return spark.range(1).select(F.round(F.lit(low), 4).alias("low"), F.round(F.lit(high), 4).alias("high"))


@query("SELECT median(x) AS plain, median(coalesce(x, 0)) AS zero_filled FROM (SELECT CASE WHEN l_linenumber = 1 THEN NULL ELSE l_quantity END AS x FROM lineitem)")
def two_medians(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").select(F.when(C("l_linenumber") == 1, None).otherwise(C("l_quantity")).alias("x"))
    return spark.range(1).select(F.lit(E.fit_median(df, "x")).alias("plain"), F.lit(E.fit_median(df, "x", True)).alias("zero_filled"))


# Tensors


def _matrices(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    a = li.groupBy((C("l_partkey") % 40).alias("i"), (C("l_suppkey") % 30).alias("j")).agg(F.sum("l_quantity").alias("v"))
    b = li.groupBy((C("l_suppkey") % 30).alias("i"), (C("l_orderkey") % 20).alias("j")).agg(F.sum("l_quantity").alias("v"))
    return a, b


_AB = "WITH a AS (SELECT l_partkey % 40 AS i, l_suppkey % 30 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL), b AS (SELECT l_suppkey % 30 AS i, l_orderkey % 20 AS j, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)"


@query(_AB + " SELECT a.i, b.j, sum(a.v * b.v) AS v FROM a JOIN b ON a.j = b.i GROUP BY ALL")
def matmul_coo(spark, sf_dir):
    return T.matmul(*_matrices(spark, sf_dir))


@query(_AB + " SELECT (j * 40 + i) // 60 AS i, (j * 40 + i) % 60 AS j, v FROM a")
def transpose_reshape(spark, sf_dir):
    return T.reshape(T.transpose(_matrices(spark, sf_dir)[0]), 40, 60)


@query(_AB + " SELECT round((SELECT sqrt(sum(v * v)) FROM a), 4) AS fro, (SELECT max(s) FROM (SELECT sum(abs(v)) AS s FROM a GROUP BY j)) AS one, (SELECT max(s) FROM (SELECT sum(abs(v)) AS s FROM a GROUP BY i)) AS inf")
def matrix_norms(spark, sf_dir):
    a = _matrices(spark, sf_dir)[0]
    return T.frobenius(a).select(F.round("norm", 4).alias("fro"), F.lit(T.norm_1(a).first()[0]).alias("one"), F.lit(T.norm_inf(a).first()[0]).alias("inf"))


@query("SELECT s AS index, coalesce(a, 0) AS total, coalesce(m, 0) AS mean, coalesce(hi, '-inf'::DOUBLE) AS high, coalesce(lo, 'inf'::DOUBLE) AS low FROM range(120) AS t(s) LEFT JOIN (SELECT l_suppkey AS k, sum(l_quantity) AS a, round(avg(l_quantity), 6) AS m, max(l_quantity) AS hi, min(l_quantity) AS lo FROM lineitem GROUP BY 1) ON s = k")
def scatter_aggregates(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(C("l_suppkey").alias("index"), C("l_quantity").alias("v"))
    parts = {"total": "add", "mean": "mean", "high": "max", "low": "min"}
    out = None
    for name, how in parts.items():
        one = T.scatter(li, how, 120).withColumn("v", F.round("v", 6)).withColumnRenamed("v", name)
        out = one if out is None else out.join(one, "index")
    return out


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(exp(l_discount - max(l_discount) OVER w) / sum(exp(l_discount)) OVER w * exp(max(l_discount) OVER w), 8) AS softmax FROM lineitem WINDOW w AS (PARTITION BY l_suppkey)")
def scatter_softmax(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount")
    return T.scatter_softmax(li, "l_suppkey", "l_discount").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("softmax", 8).alias("softmax"))


@query("SELECT o_custkey, arg_min(o_orderkey, (-o_totalprice, o_orderkey)) AS argmax, max(o_totalprice) AS max FROM orders GROUP BY o_custkey")
def argmax_first(spark, sf_dir):
    return T.argmax_by(table(spark, sf_dir, "orders"), ["o_custkey"], "o_totalprice", "o_orderkey")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) - 1 AS rank FROM orders")
def argsort_by_key(spark, sf_dir):
    return T.sort_within(table(spark, sf_dir, "orders"), "o_custkey", "o_totalprice", "o_orderkey", True).select("o_orderkey", C("rank").cast("long").alias("rank"))


@query("SELECT i, j, (i = j)::DOUBLE AS v FROM range(6) AS a(i), range(4) AS b(j)")
def eye_matrix(spark, sf_dir):
    return T.eye(spark, 6, 4)


@query("SELECT k AS i, 0.5 + k * 0.25 AS v FROM range(11) AS t(k)")
def linspace_vector(spark, sf_dir):
    return T.linspace(spark, 0.5, 3.0, 11).select("i", "v")


@query("SELECT i::INT AS i, j::INT AS j, j * 1.0::DOUBLE AS x, i * 10.0::DOUBLE AS y FROM range(3) AS a(i), range(4) AS b(j)")
def meshgrid_pairs(spark, sf_dir):
    return T.meshgrid(spark, [0, 1, 2, 3], [0, 10, 20])


# Metrics


def _scored(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "n_chars")
    return table(spark, sf_dir, "labels").join(docs, "doc_id").withColumn("score", F.least(C("n_chars") / 5000.0, F.lit(1.0)))


_S = "WITH s AS (SELECT l.*, n_chars, least(n_chars / 5000.0, 1.0)::DOUBLE AS score FROM labels l JOIN documents USING (doc_id))"


@query(_S + " SELECT quality AS y, toxic AS p, count(*) AS n FROM s GROUP BY ALL")
def confusion(spark, sf_dir):
    return X.confusion(_scored(spark, sf_dir), "quality", "toxic")


@query(_S + """, c AS (SELECT count(*) FILTER (WHERE score > 0.5 AND quality = 1) AS tp, count(*) FILTER (WHERE score > 0.5 AND quality <> 1) AS fp, count(*) FILTER (WHERE score <= 0.5 AND quality = 1) AS fn, count(*) FILTER (WHERE score <= 0.5 AND quality <> 1) AS tn FROM s)
SELECT *, round((tp + tn) / (tp + fp + fn + tn), 8) AS accuracy, round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, round(tn / (tn + fp), 8) AS specificity, round(2 * tp / (2 * tp + fp + fn), 8) AS f1 FROM c""")
def binary_metrics(spark, sf_dir):
    m = X.binary(_scored(spark, sf_dir), "quality", "score")
    return m.select("tp", "fp", "fn", "tn", *[F.round(c, 8).alias(c) for c in ("accuracy", "precision", "recall", "specificity", "f1")])


@query(_S + " SELECT round(sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END) / count(*), 8) AS auc FROM s a, s b WHERE a.quality = 1 AND b.quality <> 1")
def roc_auc_rank(spark, sf_dir):
    return X.roc_auc(_scored(spark, sf_dir), "quality", "score").select(F.round("auc", 8).alias("auc"))


@query(_S + ", g AS (SELECT score, count(*) FILTER (WHERE quality = 1) AS p, count(*) AS n FROM s GROUP BY 1), c AS (SELECT score, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS n, sum(p) OVER () AS t FROM g) SELECT score, round(tp / n, 8) AS precision, round(tp / t, 8) AS recall FROM c")
def pr_curve(spark, sf_dir):
    return X.precision_recall(_scored(spark, sf_dir), "quality", "score").select("score", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"))


@query(_S + ", g AS (SELECT score, count(*) FILTER (WHERE quality = 1) AS p, count(*) AS n FROM s GROUP BY 1), c AS (SELECT p, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS n, sum(p) OVER () AS t FROM g) SELECT round(sum(p / t * tp / n), 8) AS average_precision FROM c")
def average_precision(spark, sf_dir):
    return X.average_precision(_scored(spark, sf_dir), "quality", "score").select(F.round("average_precision", 8).alias("average_precision"))


@query("SELECT round(avg(e * e), 6) AS mse, round(sqrt(avg(e * e)), 6) AS rmse, round(avg(abs(e)), 6) AS mae, round(1 - avg(e * e) / var_pop(y), 8) AS r2 FROM (SELECT l_quantity AS y, l_extendedprice / 1500 - l_quantity AS e FROM lineitem)")
def regression_metrics(spark, sf_dir):
    m = X.regression(table(spark, sf_dir, "lineitem").withColumn("p", C("l_extendedprice") / 1500), "l_quantity", "p")
    return m.select(F.round("mse", 6).alias("mse"), F.round("rmse", 6).alias("rmse"), F.round("mae", 6).alias("mae"), F.round("r2", 8).alias("r2"))


@query(_S + """, k AS (SELECT c, count(*) FILTER (WHERE quality = c) AS support, count(*) FILTER (WHERE quality = c AND toxic = c) AS tp, count(*) FILTER (WHERE toxic = c) AS said FROM s, (VALUES (0), (1)) AS t(c) GROUP BY c)
SELECT c AS class, support::BIGINT AS support, round(CASE WHEN said = 0 THEN 0 ELSE tp / said END, 8) AS precision, round(tp / support, 8) AS recall, round(CASE WHEN tp = 0 THEN 0 ELSE 2 * tp / (said + support) END, 8) AS f1 FROM k""")
def class_metrics(spark, sf_dir):
    m = X.per_class(_scored(spark, sf_dir), "quality", "toxic")
    return m.select("class", "support", F.round("precision", 8).alias("precision"), F.round("recall", 8).alias("recall"), F.round("f1", 8).alias("f1"))


# Linear algebra and models

_X3 = ["l_quantity", "l_discount", "l_tax"]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum({a} * {b}), 4) AS v FROM lineitem" for a in _X3 for b in _X3))
def gram_matrix(spark, sf_dir):
    return LA.gram_table(table(spark, sf_dir, "lineitem"), _X3).select("a", "b", F.round("v", 4).alias("v"))


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_samp({a}, {b}), 7) + 0.0 AS v FROM lineitem" for a in _X3 for b in _X3))
def covariance(spark, sf_dir):
    return LA.covariance_table(table(spark, sf_dir, "lineitem"), _X3).select("a", "b", r(C("v"), 7).alias("v"))


@query("SELECT round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_slope(l_extendedprice, l_quantity), 5) AS slope FROM lineitem")
def least_squares(spark, sf_dir):
    beta = LA.least_squares(table(spark, sf_dir, "lineitem"), ["l_quantity"], "l_extendedprice")
    return spark.range(1).select(F.round(F.lit(float(beta[0])), 3).alias("intercept"), F.round(F.lit(float(beta[1])), 5).alias("slope"))


_GROUPS = "SELECT l_returnflag, covar_pop(l_quantity, l_quantity) AS a, covar_pop(l_quantity, l_discount) AS b, covar_pop(l_discount, l_discount) AS c, covar_pop(l_quantity, l_extendedprice) AS p, covar_pop(l_discount, l_extendedprice) AS q FROM lineitem GROUP BY 1"


def _systems(spark, sf_dir):
    """Normal equations of one small regression for each return flag, as cells."""
    x, y = ["l_quantity", "l_discount"], "l_extendedprice"
    pairs = [(i, j, F.covar_pop(a, b)) for i, a in enumerate(x) for j, b in enumerate([*x, y])]
    cells = [F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), c.alias("v")) for i, j, c in pairs]
    rows = table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.array(*cells).alias("c")).select("l_returnflag", F.explode("c").alias("c")).select("l_returnflag", "c.*")
    return rows.where("j < 2"), rows.where("j = 2").select("l_returnflag", "i", "v")


@query(f"WITH g AS ({_GROUPS}) SELECT l_returnflag, 0::BIGINT AS i, round((c * p - b * q) / (a * c - b * b), 3) AS v FROM g UNION ALL SELECT l_returnflag, 1, round((a * q - b * p) / (a * c - b * b), 3) FROM g")
def solve_by_group(spark, sf_dir):
    a, b = _systems(spark, sf_dir)
    return LA.solve(a, 2, b, ["l_returnflag"]).withColumn("v", F.round("v", 3))


@query(f"WITH g AS ({_GROUPS}), e AS (SELECT *, (a + c) / 2 AS m, sqrt(pow((a - c) / 2, 2) + b * b) AS d FROM g) SELECT l_returnflag, round(a * c - b * b, 6) AS det, round(m - d, 6) AS low, round(m + d, 4) AS high FROM e")
def matrix_measures_by_group(spark, sf_dir):
    a = _systems(spark, sf_dir)[0]
    e = LA.eigenvalues(a, 2, ["l_returnflag"]).groupBy("l_returnflag").agg(F.round(F.min("re"), 6).alias("low"), F.round(F.max("re"), 4).alias("high"))
    return LA.det(a, 2, ["l_returnflag"]).withColumn("det", F.round("det", 6)).join(e, "l_returnflag")


@query()
def pca_scores(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", *_X3, "l_extendedprice")
    return LA.fit_pca(li, [*_X3, "l_extendedprice"], 2).transform(li).select("l_orderkey", "pca_0", "pca_1")


_G = ", ".join(f"sum({a} * {b}) AS g{i}{j}" for i, a in enumerate(_X3) for j, b in enumerate(_X3) if i <= j)


@query(f"""WITH g AS (SELECT {_G} FROM lineitem), a AS (SELECT *, sqrt(g00) AS r00, g01 / sqrt(g00) AS r01, g02 / sqrt(g00) AS r02 FROM g), b AS (SELECT *, sqrt(g11 - r01 * r01) AS r11 FROM a), c AS (SELECT *, (g12 - r01 * r02) / r11 AS r12 FROM b), d AS (SELECT *, sqrt(g22 - r02 * r02 - r12 * r12) AS r22 FROM c)
SELECT i, j, round(v, 5) + 0.0 AS v FROM d, LATERAL (VALUES (0, 0, r00), (0, 1, r01), (0, 2, r02), (1, 0, 0.0), (1, 1, r11), (1, 2, r12), (2, 0, 0.0), (2, 1, 0.0), (2, 2, r22)) AS t(i, j, v)""")
def qr_factor(spark, sf_dir):
    rr = LA.qr(table(spark, sf_dir, "lineitem"), _X3)
    return spark.createDataFrame([(i, j, round(float(rr[i, j]), 5) + 0.0) for i in range(3) for j in range(3)], "i int, j int, v double")


_W = np.array([[0.5, -0.3], [0.2, 0.8]])


def _rbm():
    return N.RBM(["l_discount", "l_tax"], _W, np.array([0.1, -0.2]), np.array([0.0, 0.3]), 0.7)


@query("""WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, l_discount AS v0, l_tax AS v1, 1 / (1 + exp(-(0.5 * l_discount + 0.2 * l_tax))) AS h0, 1 / (1 + exp(-(0.3 - 0.3 * l_discount + 0.8 * l_tax))) AS h1,
-(ln(1 + exp(0.5 * l_discount + 0.2 * l_tax)) + ln(1 + exp(0.3 - 0.3 * l_discount + 0.8 * l_tax)) + 0.1 * l_discount - 0.2 * l_tax) AS f FROM lineitem),
e AS (SELECT *, pow(v0 - 1 / (1 + exp(-(0.1 + 0.5 * h0 - 0.3 * h1))), 2) + pow(v1 - 1 / (1 + exp(-(-0.2 + 0.2 * h0 + 0.8 * h1))), 2) AS e FROM h) SELECT l_orderkey, l_linenumber, l_partkey, round(e, 6) AS error, e > 0.7 AS anomaly, round(f, 6) AS free_energy FROM e""")
def rbm_score(spark, sf_dir):
    m = _rbm()
    out = m.detect(table(spark, sf_dir, "lineitem")).withColumn("free_energy", F.round(m.free_energy(), 6))
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.round("error", 6).alias("error"), "anomaly", "free_energy")


@query()
def rbm_trained(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (C("l_quantity") / 50).alias("q"), (C("l_discount") * 10).alias("d"), (C("l_tax") * 12).alias("t"))
    return N.train_rbm(li, ["q", "d", "t"], 2, 3).detect(li).select("l_orderkey", "error", "anomaly")


_DECAY = math.exp(-1.0)


@query(f"""WITH s AS (SELECT user_id, list(value / 100 ORDER BY ts, event_id) AS xs FROM events GROUP BY user_id) SELECT user_id, round(list_reduce(list_prepend(0.0, xs), lambda h, x: h * {_DECAY!r} + (1 - {_DECAY!r}) * tanh(x)), 6) AS state FROM s""")
def ctrnn_fold(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("day", F.to_date("ts"))
    return N.leaky_state(ev, ["user_id"], ["day"], ["ts", "event_id"], C("value") / 100).select("user_id", F.round("state", 6).alias("state"))


@query()
def recurrent_cells(spark, sf_dir):
    ev = table(spark, sf_dir, "events").withColumn("x", C("value") / 100)
    return N.run_cell(ev, N.Cell("gru", 1, 3), "user_id", "event_id", ["x"]).select("user_id", "event_id", "h")


@query("""WITH c AS (SELECT var_samp(l_quantity) + 1e-6 AS a, covar_samp(l_quantity, l_discount) AS b, var_samp(l_discount) + 1e-6 AS d, covar_samp(l_quantity, l_extendedprice) AS p, covar_samp(l_discount, l_extendedprice) AS q FROM lineitem)
SELECT 0 AS i, round((d * p - b * q) / (a * d - b * b), 3) AS beta FROM c UNION ALL SELECT 1, round((a * q - b * p) / (a * d - b * b), 2) FROM c""")
def expectation_regression(spark, sf_dir):
    beta = N.expectation_solver(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return spark.createDataFrame([(i, round(float(b), 3 - i)) for i, b in enumerate(beta)], "i int, beta double")
