"""Queries of element-wise math, comparison, activations, losses and bits."""

from pyspark.sql import functions as F

from sparkloom.functions import activation as A
from sparkloom.functions import bits as B
from sparkloom.functions import ieee as M
from sparkloom.functions import loss as L
from sparkloom.functions import random as R
from sparkloom.plans.base import named, query, r, table

C = F.col


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_quantity + l_discount AS a, l_quantity - l_extendedprice AS s, l_quantity * l_tax AS m, round(l_extendedprice / l_quantity, 6) + 0.0 AS d,
round(exp(l_discount), 6) AS e, round(ln(l_quantity), 6) AS ln, round(log10(l_extendedprice), 6) AS lg, round(log2(l_quantity), 6) AS l2, round(pow(l_quantity, 1.5), 4) AS p, round(sqrt(l_extendedprice), 6) AS q,
l_quantity * l_quantity AS sq, abs(l_quantity - 25) AS ab, -l_quantity AS ng, sign(l_quantity - 25)::DOUBLE AS sg, round(sin(l_quantity), 6) AS si, round(cos(l_quantity), 6) AS co, round(tan(l_discount), 6) AS ta,
round(sinh(l_discount), 6) AS sh, round(cosh(l_discount), 6) AS ch, round(tanh(l_quantity / 50), 6) AS th FROM lineitem""")
def math_elementwise(spark, sf_dir):
    q, p, d, t = C("l_quantity"), C("l_extendedprice"), C("l_discount"), C("l_tax")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        *named(a=q + d, s=q - p, m=q * t, d=r(M.divide(p, q)), e=F.round(F.exp(d), 6), ln=F.round(M.ln(q), 6), lg=F.round(M.log10(p), 6), l2=F.round(M.log2(q), 6), p=F.round(F.pow(q, F.lit(1.5)), 4), q=F.round(F.sqrt(p), 6),
               sq=M.square(q), ab=F.abs(q - 25), ng=-q, sg=M.sign(q - 25), si=F.round(F.sin(q), 6), co=F.round(F.cos(q), 6), ta=F.round(F.tan(d), 6), sh=F.round(F.sinh(d), 6), ch=F.round(F.cosh(d), 6), th=F.round(A.tanh(q / 50), 6)),
    )


@query("""SELECT l_orderkey, l_linenumber, l_partkey, a, b, CASE WHEN b = 0 THEN 'NaN'::DOUBLE ELSE a - b * floor(a / b) END AS modulo, floor(a / b) AS floored, a / b AS quotient, floor(a / 7) AS fl, ceil(a / 7) AS ce
FROM (SELECT *, l_quantity - 25 AS a, (l_linenumber - 4)::DOUBLE AS b FROM lineitem)""")
def math_floor_mod(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumns({"a": C("l_quantity") - 25, "b": (C("l_linenumber") - 4).cast("double")})
    a, b = C("a"), C("b")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "a", "b", *named(modulo=M.mod(a, b), floored=M.floor_divide(a, b), quotient=M.divide(a, b), fl=M.floor(a / 7), ce=M.ceil(a / 7)))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, least(greatest(l_quantity, 10), 40) AS clipped, greatest(l_quantity, 25.0) AS larger, least(l_quantity, 25.0) AS smaller, CASE WHEN l_discount > 0.05 THEN l_tax ELSE l_discount END AS picked,
abs(l_discount - l_tax) <= 1e-8 + 1e-5 * abs(l_tax) AS near, l_discount = l_tax AS eq, l_discount <> l_tax AS ne, l_discount < l_tax AS lt, l_discount <= l_tax AS le, l_discount > l_tax AS gt, l_discount >= l_tax AS ge,
(l_discount <> 0 AND l_tax <> 0) AS both_true, (l_discount <> 0 OR l_tax <> 0) AS either, ((l_discount <> 0) <> (l_tax <> 0)) AS one, NOT (l_tax <> 0) AS none FROM lineitem""")
def clip_where_isclose(spark, sf_dir):
    q, d, t = C("l_quantity"), C("l_discount"), C("l_tax")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey",
        *named(clipped=M.clip(q, 10, 40), larger=M.maximum(q, F.lit(25.0)), smaller=M.minimum(q, F.lit(25.0)), picked=M.where(d > 0.05, t, d), near=M.isclose(d, t), eq=M.equal(d, t), ne=M.not_equal(d, t), lt=M.less(d, t), le=M.less_equal(d, t),
               gt=M.greater(d, t), ge=M.greater_equal(d, t), both_true=M.logical_and(d, t), either=M.logical_or(d, t), one=M.logical_xor(d, t), none=M.logical_not(t)),
    )


@query("SELECT l_returnflag, bool_and(abs(l_discount - l_tax) <= 1e-8 + 1e-5 * abs(l_tax)) AS close, bool_and(l_quantity <> 0) AS every, bool_or(l_tax = 0) AS some FROM lineitem GROUP BY l_returnflag")
def all_any_allclose(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*named(close=M.allclose(C("l_discount"), C("l_tax")), every=F.bool_and(M.truth(C("l_quantity"))), some=F.bool_or(C("l_tax") == 0)))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, greatest(x, 0.0) AS relu, round(1 / (1 + exp(-x)), 6) AS sigmoid, round(tanh(x), 6) AS tanh, round(ln(1 + exp(x)), 6) AS softplus, round(1.7159 * tanh(x * 2 / 3), 6) AS lecun,
floor(1 / (1 + exp(-x)) * 10) / 10 AS blocky FROM (SELECT *, (l_quantity - 25.3) / 10 AS x FROM lineitem)""")
def activations(spark, sf_dir):
    x = (C("l_quantity") - 25.3) / 10
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", *named(relu=A.relu(x), sigmoid=F.round(A.sigmoid(x), 6), tanh=F.round(A.tanh(x), 6), softplus=F.round(A.softplus(x), 6), lecun=F.round(A.lecun_tanh(x), 6), blocky=A.blocky_sigmoid(x)))


@query("""SELECT vec_id, list_transform(e, lambda x: round(x / s, 6)) AS softmax FROM (SELECT vec_id, list_transform(embedding, lambda x: exp(x::DOUBLE)) AS e, list_sum(list_transform(embedding, lambda x: exp(x::DOUBLE))) AS s FROM embeddings)""")
def softmax_rows(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(A.softmax(C("embedding")), lambda x: F.round(x, 6)).alias("softmax"))


@query("""SELECT l_returnflag, round(avg((p - y) * (p - y)), 6) AS mse, round(avg(abs(p - y)), 6) AS mae, round(avg(-(t * ln(c) + (1 - t) * ln(1 - c))), 6) AS bce, round(avg(CASE WHEN abs(p - y) <= 1 THEN 0.5 * (p - y) * (p - y) ELSE abs(p - y) - 0.5 END), 6) AS huber,
round(avg(ln(cosh(p - y))), 6) AS log_cosh, round(sum((p - y) * (p - y)), 3) AS sse FROM (SELECT l_returnflag, l_quantity / 10 AS y, l_linenumber + l_tax AS p, (l_quantity > 25)::INT AS t, least(greatest(l_discount * 9, 1e-7), 1 - 1e-7) AS c FROM lineitem) GROUP BY l_returnflag""")
def loss_suite(spark, sf_dir):
    y, p, t = C("l_quantity") / 10, C("l_linenumber") + C("l_tax"), (C("l_quantity") > 25).cast("int")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*named(mse=F.round(L.mse(y, p), 6), mae=F.round(L.mae(y, p), 6), bce=F.round(L.binary_crossentropy(t, C("l_discount") * 9), 6), huber=F.round(L.huber(y, p), 6), log_cosh=F.round(L.log_cosh(y, p), 6), sse=F.round(L.mse(y, p, "sum"), 3)))


@query("""WITH p AS (SELECT label, list_transform(embedding[1:10], lambda x: exp(x::DOUBLE)) AS e FROM embeddings), q AS (SELECT label, list_transform(e, lambda x: x / list_sum(e)) AS p FROM p)
SELECT round(avg(-ln(p[label + 1])), 6) AS sparse, round(avg(-ln(p[label + 1])), 6) AS onehot FROM q""")
def crossentropy_arrays(spark, sf_dir):
    from sparkloom.functions.vector import one_hot

    first = F.slice("embedding", 1, 10)
    return table(spark, sf_dir, "embeddings").agg(*named(sparse=F.round(L.sparse_categorical_crossentropy(C("label"), first, True), 6), onehot=F.round(L.categorical_crossentropy(one_hot(C("label"), 10), first, True), 6)))


@query("""WITH p AS (SELECT vec_id % 4 AS part, label, list_transform(embedding, lambda x: x::DOUBLE) AS z FROM embeddings WHERE label <> 3 OR label IS NULL)
SELECT part, round(avg(ln(list_sum(list_transform(z, lambda x: exp(x)))) - 0.9 * z[label + 1] - 0.1 * list_avg(z)), 6) AS loss FROM p GROUP BY part""")
def crossentropy_smoothed(spark, sf_dir):
    """A class that is ignored, and a tenth of each label's weight dealt to all 64 classes."""
    part = (C("vec_id") % 4).alias("part")
    return table(spark, sf_dir, "embeddings").groupBy(part).agg(F.round(L.smoothed_crossentropy(C("label"), C("embedding"), 3, 0.1), 6).alias("loss"))


@query("""SELECT o_orderkey, o_orderkey & o_custkey AS a, o_orderkey | o_custkey AS o, xor(o_orderkey, o_custkey) AS x, (~o_orderkey) & 4294967295 AS n, ((o_orderkey & 4294967295) << 3) & 4294967295 AS l, (o_orderkey & 4294967295) >> 2 AS r,
(((o_orderkey << 5) & 4294967295) | ((o_orderkey & 4294967295) >> 27)) AS rl, ((o_orderkey & 4294967295) >> 5) | ((o_orderkey << 27) & 4294967295) AS rr, bit_count(o_orderkey::BIGINT)::INT AS ones, (32 - bit_count(o_orderkey::BIGINT))::INT AS zeros,
((o_orderkey >> 3) & 1)::INT AS bit3, (o_orderkey & ~(1::BIGINT << 4)) | (1::BIGINT << 4) AS set4, xor(o_orderkey, 1::BIGINT << 2) AS toggled FROM orders""")
def bitwise_basic(spark, sf_dir):
    k, c, i = C("o_orderkey"), C("o_custkey"), F.lit
    return table(spark, sf_dir, "orders").select("o_orderkey", *named(a=B.band(k, c), o=B.bor(k, c), x=B.bxor(k, c), n=B.bnot(k), l=B.left_shift(k, i(3)), r=B.right_shift(k, i(2)), rl=B.rotate_left(k, i(5)), rr=B.rotate_right(k, i(5)), ones=B.count_ones(k), zeros=B.count_zeros(k), bit3=B.get_bit(k, i(3)), set4=B.set_bit(k, i(4), i(1)), toggled=B.toggle_bit(k, i(2))))


@query("SELECT o_orderstatus, bit_xor(o_custkey) AS x, bit_and(o_custkey | 1) AS a, bit_or(o_custkey) AS o FROM orders GROUP BY o_orderstatus")
def wave_interference_group(spark, sf_dir):
    k = C("o_custkey")
    return table(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(*named(x=B.group_interference(k), a=B.group_interference(k.bitwiseOR(F.lit(1)), "and"), o=B.group_interference(k, "or")))


@query("""SELECT n_nationkey, list_transform(range(8), lambda i: (i < round_even(8 * n_nationkey / 25.0, 0))::INT) AS duty, list_transform(range(8), lambda i: ((i % (2 * (n_nationkey % 3 + 1))) < n_nationkey % 3 + 1)::INT) AS blocky,
CASE WHEN n_regionkey >= 2 THEN (n_nationkey::BIGINT << (n_regionkey - 2)) ELSE n_nationkey::BIGINT >> (2 - n_regionkey) END AS moved FROM nation""")
def binary_waves(spark, sf_dir):
    k = C("n_nationkey")
    return table(spark, sf_dir, "nation").select("n_nationkey", *named(duty=B.duty_cycle(F.lit(8), k / 25), blocky=B.blocky_sin(F.lit(8), k % 3 + 1), moved=B.propagate(k, C("n_regionkey") - 2)))


@query("""SELECT o_orderkey, ('0x' || substr(md5(o_orderkey || ':7'), 1, 13))::BIGINT / 4503599627370496.0 AS u FROM orders""")
def keyed_uniform(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", R.keyed_uniform(C("o_orderkey"), 7).alias("u"))


@query()
def random_draws(spark, sf_dir):
    k = C("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", *named(normal=R.normal(1, 2, 3), uniform=R.uniform(-1, 1, 3), bernoulli=R.bernoulli(0.3, 3), exponential=R.exponential(2.0, 3), gamma=R.gamma(k, 2.0, 1.5), poisson=R.poisson(k, 4.0), category=R.categorical([0.0, 1.0, 2.0], 3), glorot=R.glorot_uniform(4, 4, 1.0, 3)))


@query("SELECT l_returnflag, sum(l_extendedprice::DECIMAL(38,2))::VARCHAR AS total, max(l_orderkey::DECIMAL(38,0) * 1000000007 * 998244353)::VARCHAR AS big FROM lineitem GROUP BY l_returnflag")
def decimal_exact(spark, sf_dir):
    price = C("l_extendedprice").cast("decimal(38,2)")
    big = (C("l_orderkey").cast("decimal(18,0)") * F.lit(1000000007 * 998244353).cast("decimal(19,0)")).cast("decimal(38,0)")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(price).cast("decimal(38,2)").cast("string").alias("total"), F.max(big).cast("string").alias("big"))


@query("SELECT round(exp(-0.5 * pow((l_quantity - 25) / 10, 2)) / (10 * sqrt(2 * pi())), 9) AS density, l_quantity, count(*) AS n, round(l_quantity * exp(-0.1 * l_linenumber), 6) AS decayed FROM lineitem GROUP BY l_quantity, l_linenumber")
def gaussian_decay(spark, sf_dir):
    g = table(spark, sf_dir, "lineitem").groupBy("l_quantity", "l_linenumber").agg(F.count("*").alias("n"))
    return g.select(F.round(M.gaussian(C("l_quantity"), 25, 10), 9).alias("density"), "l_quantity", "n", F.round(M.exponential_decay(C("l_quantity"), 0.1, C("l_linenumber")), 6).alias("decayed"))
